"""What the token files hold besides rows: stripes, run-length encoding, row indexes, Bloom filters, and what they save."""

from pathlib import Path

import pyarrow as pa
from pyspark.sql import functions as F

from barloom.llm import common, token_orc
from barloom.llm import queries as q


def footers(spark, path):
    """Encodings of columns and kinds of streams of every stripe of a file."""
    jvm, out = spark._jvm, []
    conf = spark._jsc.hadoopConfiguration()
    reader = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.orc.OrcFile.readerOptions(conf))
    rows = reader.rows()
    for stripe in reader.getStripes():
        footer = rows.readStripeFooter(stripe)
        encodings = [c.getKind().toString() for c in footer.getColumnsList()]
        out.append((encodings, {(s.getColumn(), s.getKind().toString()) for s in footer.getStreamsList()}, stripe.getNumberOfRows()))
    stride = reader.getRowIndexStride()
    rows.close()
    return out, stride


def read_rows(df):
    """Rows that the scan gave when ``df`` was collected, and the result."""
    plan, got = df._jdf.queryExecution(), df.collect()
    leaf = plan.executedPlan().collectLeaves().head()
    return leaf.metrics().get("numOutputRows").get().value(), got


def test_files_have_stripes_encodings_indexes_and_filters(spark, tmp_path):
    docs = spark.range(20_000).select((F.col("id") * 7).alias("doc_id"), F.concat_ws(" ", F.lit("word"), F.col("id").cast("string")).alias("text"))
    path = token_orc.write_tokens(docs, str(tmp_path / "t"), q.TOKENIZER, stripe_bytes=32 << 10, row_index_stride=1000, partitions_=2)
    files = sorted(Path(path).glob("*.orc"))
    assert len(files) == 2
    for f in files:
        stripes, stride = footers(spark, str(f))
        assert len(stripes) > 1 and stride == 1000
        for encodings, streams, n in stripes:
            # Columns: 0 the row, 1 doc_id, 2 part, 3 part_start, 4 n_tokens, 5 tokens, 6 their ids; lengths of lists are run-length coded, too.
            assert all(encodings[c] == "DIRECT_V2" for c in (1, 2, 3, 4, 5, 6)) and n > 0
            assert (1, "ROW_INDEX") in streams and (6, "ROW_INDEX") in streams and (1, "BLOOM_FILTER_UTF8") in streams
            assert not {(c, k) for c, k in streams if k.startswith("BLOOM") and c != 1}
    files = spark.read.schema(token_orc.FILE_SCHEMA).orc(path)
    n, got = read_rows(files.where(F.col("doc_id") == 7 * 12_345).select("doc_id", "tokens"))
    assert len(got) == 1 and got[0].tokens[-1] == token_orc.END and 1 <= n <= 1000  # one row group of 20
    n, got = read_rows(files.where(F.col("doc_id") == 7 * 12_345 + 3).select("doc_id"))
    assert not got and n == 0  # within the range of a row group: the Bloom filter has it out
    assert 1500 <= read_rows(files.where(F.col("doc_id") < 7 * 1500).select("doc_id"))[0] <= 2000


def test_stripes_are_read_side_by_side(spark, tmp_path):
    """A file of several stripes is several tasks' input, and each stripe is read once."""
    docs = spark.range(30_000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.col("id").cast("string"), F.col("id").cast("string")).alias("text"))
    path = token_orc.write_tokens(docs, str(tmp_path / "t"), q.TOKENIZER, stripe_bytes=32 << 10, partitions_=1)
    size = sum(f.stat().st_size for f in Path(path).glob("*.orc"))
    name, cost = "spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"
    before = {k: spark.conf.get(k) for k in (name, cost)}
    spark.conf.set(name, str(size // 4))
    spark.conf.set(cost, "0")
    try:
        tasks = spark.read.schema(token_orc.FILE_SCHEMA).orc(path).groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("d")).collect()
        assert sum(r.n > 0 for r in tasks) > 1 and sum(r.n for r in tasks) == sum(r.d for r in tasks) == 30_000
        assert [r.start for r in token_orc.read_tokens(spark, path).orderBy("doc_id").limit(2).collect()] == [0, len(token_orc.encode(token_orc.encoder(q.TOKENIZER), "0 0")) // 4 + 1]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_a_worker_keeps_few_pieces_and_none_for_other_work():
    texts = pa.array([" ".join(f"w{k} {k}x" for k in range(30_000))], pa.string())
    pieces = token_orc.encoder(q.TOKENIZER)
    before = token_orc.encode_all(pieces, texts)[0].tobytes()
    assert len(pieces) > token_orc.KEPT_ENTRIES
    pieces.shrink()
    assert 0 < len(pieces) <= token_orc.KEPT_ENTRIES and not pieces.old
    assert token_orc.encoder(q.TOKENIZER) is pieces and token_orc.encode_all(pieces, texts)[0].tobytes() == before
    list(common.text_slices(pa.array(["another operator's text"])))
    assert token_orc.encoder(q.TOKENIZER) is not pieces and common._kept.keys() == {"tokens"}
