"""I-Match fingerprints: hashes of the terms within a band of document frequency, over random subsets of that lexicon."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions

#: Shares of the documents in which a term of the lexicon stands: inverse document frequencies from 4.3 to 6.6 bits.
#: As each counts in one document of a hundred at least, the lexicon has at most a hundred times as many terms as a
#: mean document has distinct ones, whatever the corpus' size; this bounds what is sent to all tasks.
LOW, HIGH = 0.01, 0.05
#: Subsets at each scale; a scale of s takes the terms whose hash s divides, and deals them to this many subsets.
SUBSETS = 16
SCALES = (1, 4, 16)
HEX = 6
#: Terms of the lexicon below which a text is fingerprinted over all of its terms: so few fill too few subsets.
LEAST_TERMS = 4
NONE = "-" * HEX
#: Ranges of ids in which texts meet their neighbours, for each partition of the session.
RANGES = 4


def terms(text: Column) -> Column:
    """64-bit hashes of the distinct words, sorted. Words are as in the other scans, with all letters in lower case."""
    split = F.split(F.lower(text), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    return F.sort_array(F.transform(F.array_distinct(F.filter(split, lambda w: w != "")), lambda w: F.xxhash64(w)))


def lexicon(docs: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """One row, ``terms``: the sorted hashes of terms within the band, counted over all documents."""
    n = docs.agg(F.count(F.lit(1)).alias("n"))
    df = docs.where(F.col("text").isNotNull()).select(F.explode(terms(F.col("text"))).alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df"))
    total = n.scalar()
    band = df.where((F.col("df") >= F.lit(low) * total) & (F.col("df") <= F.lit(high) * total))
    return band.agg(F.sort_array(F.collect_list("t")).alias("terms"))


def fingerprint(own: Column, known: Column) -> Column:
    """Hashes of the terms in each subset, in hexadecimal, ``------`` for a subset without terms.

    ``own``: a text's terms; ``known``: those of the lexicon among them. A text with under LEAST_TERMS
    of the lexicon is fingerprinted over all of its terms.
    """
    chosen = F.when(F.size(known) >= LEAST_TERMS, known).otherwise(own)
    return _hashes(F.array(*(_at_scale(chosen, s) for s in SCALES)))


def _at_scale(terms_: Column, scale: int) -> Column:
    return F.filter(terms_, lambda t: F.pmod(F.shiftright(t, 20), F.lit(scale)) == 0)


def _hashes(levels: Column) -> Column:
    """One string of all subsets' hashes from the terms at each scale."""
    subset = lambda level: F.transform(F.sequence(F.lit(0), F.lit(SUBSETS - 1)), lambda r: F.filter(level, lambda t: F.pmod(t, F.lit(SUBSETS)) == r))
    code = lambda s: F.when(F.size(s) == 0, F.lit(NONE)).otherwise(F.substring(F.lower(F.lpad(F.hex(F.xxhash64(s)), 16, "0")), 1, HEX))
    return F.array_join(F.transform(F.flatten(F.transform(levels, subset)), code), "")


def likeness(a: Column, b: Column) -> Column:
    """1 for equal fingerprints, else the best scale's share of equal hashes among its subsets with terms in either.

    A scale with under four such subsets does not count.
    """
    best = F.lit(0.0)
    for k in range(len(SCALES)):
        at = F.sequence(F.lit(k * SUBSETS), F.lit((k + 1) * SUBSETS - 1))
        cut = lambda c, i: F.substring(c, F.lit(1) + i * HEX, F.lit(HEX))
        some = F.filter(at, lambda i: (cut(a, i) != NONE) | (cut(b, i) != NONE))
        same = F.filter(some, lambda i: cut(a, i) == cut(b, i))
        best = F.greatest(best, F.when(F.size(some) >= 4, F.size(same) / F.size(some)).otherwise(0.0))
    return F.when(a == b, 1.0).otherwise(best)


def id_ranges(ids: DataFrame, n: int) -> Column:
    """The number of each doc_id's range (null: 0), rising with the ids; some ``n`` ranges of about as many rows each.

    Approximate quantiles bound coarse ranges, and again fine ones within each. So a quantile's state has the square
    root of n bounds, as has either array that an id is looked up in, and n may be as large as the corpus asks for.
    """
    wide = max(2, math.isqrt(n - 1) + 1)
    cuts = F.percentile_approx("doc_id", [k / wide for k in range(1, wide)], 10 * wide)
    below = lambda bounds: F.size(F.filter(bounds, lambda b: b < F.col("doc_id")))
    literal = lambda x, kind: F.from_json(F.lit(json.dumps(x)), kind)
    ids = ids.where(F.col("doc_id").isNotNull())
    coarse = sorted(set(ids.agg(cuts.alias("b")).first().b or []))
    part = below(literal(coarse, "array<bigint>"))
    found = {r.c: sorted(set(r.b)) for r in ids.groupBy(part.alias("c")).agg(cuts.alias("b")).collect()}
    fine = literal([found.get(c, []) for c in range(len(coarse) + 1)], "array<array<bigint>>")
    return F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(part * wide + below(F.element_at(fine, part + 1)))


def with_neighbour(docs: DataFrame) -> DataFrame:
    """doc_id, text (null: empty), and ``ghost``, for texts that stand in a bucket only as a neighbour of its first.

    Buckets are ranges of ids, and get the largest id of the bucket before (the first gets the largest of all), so
    that each text's next in descending order, the largest lower id, is in its bucket. What is broadcast, and numbered
    in one task, is one row for each bucket; their number grows with the session's partitions.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    ids = rows.select("doc_id")
    rows = rows.withColumn("bucket", id_ranges(ids, RANGES * partitions(docs)))
    last = rows.where(F.col("doc_id").isNotNull()).groupBy("bucket").agg(F.max("doc_id").alias("doc_id"))
    up = Window.orderBy("bucket")
    follower = F.coalesce(F.lead("bucket").over(up), F.first("bucket").over(up.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    rows = rows.join(F.broadcast(last.select("doc_id", follower.alias("follower"))), "doc_id", "left")
    place = lambda bucket, ghost: F.struct(F.col(bucket).alias("bucket"), F.lit(ghost).alias("ghost"))
    places = F.when(F.col("follower").isNull(), F.array(place("bucket", False))).otherwise(F.array(place("bucket", False), place("follower", True)))
    return rows.select("doc_id", "text", F.explode(places).alias("p")).select("doc_id", "text", "p.bucket", "p.ghost")


def compare(docs: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """Fingerprints of each text (doc_id, text) and of its edited text, and how like its own they and the next's are.

    The edited text has, for its last third of code points, the first as many, or all, of the next document's in
    descending order of doc_id; after the last comes the first. Null texts are empty; two texts without terms are
    alike. Rows of one doc_id follow each other by text; a null id comes before all others. Repeated rows all stay;
    other columns are ignored; an empty table gives an empty result. Each text is shuffled once, to its bucket.
    """
    known = lexicon(docs.select("text"), low, high).scalar()
    rows = with_neighbour(docs)
    order = Window.partitionBy("bucket").orderBy(F.desc("ghost"), "doc_id", "text")
    rows = rows.withColumn("other", F.lag("text").over(order))
    # A ghost's neighbour is not needed; a single document is its own neighbour.
    rows = rows.withColumn("other", F.coalesce("other", "text")).withColumn("n_chars", F.length("text"))
    third = F.expr("n_chars div 3").cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars") - third), F.substring(F.col("other"), F.lit(1), third)))
    rows = rows.select("doc_id", "bucket", "ghost", "text", F.col("n_chars").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), terms(F.col("text")).alias("a"), terms(F.col("edited")).alias("b"))
    rows = rows.withColumn("both", F.array_intersect(F.array_union("a", "b"), known))
    inside = lambda c: F.sort_array(F.array_intersect(F.col(c), F.col("both")))
    rows = rows.withColumns({"ka": inside("a"), "kb": inside("b")})
    rows = rows.withColumns({"fingerprint": fingerprint(F.col("a"), F.col("ka")), "edited_fingerprint": fingerprint(F.col("b"), F.col("kb"))})
    rows = rows.withColumn("next", F.coalesce(F.lag("fingerprint").over(order), F.col("fingerprint"))).where(~F.col("ghost"))
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next")).alias("near_next"),
    )
