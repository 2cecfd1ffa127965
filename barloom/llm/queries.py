"""Queries over the driver's text tables: one for each operator, and the corpus pipeline."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.session import ship_package

from . import bbit_minhash, chat, code_vectors, cotrain, decontaminate, imatch, impact_index, langid, license_scan, mixing, parity_join, secret_scan, token_orc
from .common import held_out, written

Query = Callable[[SparkSession, str], DataFrame]
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents, written as ORC and read back."""
    return token_orc.tokenised(table(spark, sf_dir, "documents"), TOKENIZER)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses in all documents."""
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op3_cotrained_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality and toxicity of all documents, learnt from ``labels``."""
    scored = cotrain.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.withColumn("keep", (F.col("quality_score") >= 0.5) & (F.col("toxic_score") < 0.5))


def op4_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one that says control strings, formatted in windows and read back."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return chat.conversation_digests(written(chat.windows(turns.unionByName(extra)), "chat"))


def op5_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return imatch.compare(table(spark, sf_dir, "documents"))


def op6_parity_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents under links of word shingles."""
    return parity_join.near_groups(table(spark, sf_dir, "documents"))


#: Weights by domain, by domain and language, and by domain, language and source.
MIX_WEIGHTS = {("web",): 5, ("books",): 3, ("code",): 2, ("web", "en"): 4, ("books", "en"): 2, ("code", "en"): 3, ("web", "en", "src0"): 2}
MIX_PERCENT, MIX_EPOCHS, MIX_SEED = 80, 2, 7


def domain() -> Column:
    """A domain for each source, by the number in its name."""
    k = F.coalesce(F.regexp_extract("source", "([0-9]+)$", 1).try_cast("long"), F.lit(0)) % 3
    return F.when(k == 0, "web").when(k == 1, "books").otherwise("code")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each document goes into a mixture of four fifths of all tokens."""
    mixed = mixing.mix(table(spark, sf_dir, "documents"), domain(), MIX_WEIGHTS, MIX_PERCENT, MIX_EPOCHS, MIX_SEED)
    return mixed.select("doc_id", "__leaf.domain", "__leaf.lang", "__leaf.source", F.col("__tokens").alias("n_tokens"), F.col("__copies").alias("copies"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents, as counts and spans."""
    return secret_scan.digests(secret_scan.find(table(spark, sf_dir, "documents")))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted languages of all documents, learnt from the two thirds that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = langid.learn(docs, ~held_out("doc_id"))
    return langid.predict(docs, model, ["doc_id"]).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score", "bits_per_byte")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents within any occurrence of a benchmark window; matches and their places are the operator's."""
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op11_bbit_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents under links of word shingles, and which documents stay."""
    return bbit_minhash.near_dedup(table(spark, sf_dir, "documents"))


def op12_filtering_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Product codes of all vectors, their errors and the digest of the codebooks."""
    return code_vectors.coded(table(spark, sf_dir, "embeddings"))


def op13_impact_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents for each benchmark item, from an index of all documents."""
    return impact_index.search(impact_index.build(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_token_orc, op2_license_scan, op3_cotrained_quality, op4_chat_windows, op5_imatch, op6_parity_join, op7_mixing, op8_secret_scan, op9_language_id, op10_decontamination, op11_bbit_minhash, op12_filtering_lloyd, op13_impact_search)}


_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_GROUPS_SQL = rf"""
with recursive w as (select doc_id, regexp_extract_all({_LOW}, '[^\x20\x09-\x0D]+') as w from documents),
s as (select doc_id, case when len(w) = 0 then [] when len(w) < {{k}} then [array_to_string(w, ' ')]
 else list_distinct([array_to_string(w[i:i + {{k}} - 1], ' ') for i in range(1, len(w) - {{k}} + 2)]) end as s from w),
e as materialized (select doc_id, hash(unnest(s)) as g, len(s) as n from s),
links as materialized (select a.doc_id as a, b.doc_id as b from e a join e b on a.g = b.g and a.doc_id <> b.doc_id and 100 * least(a.n, b.n) >= {{num}} * greatest(a.n, b.n)
 group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= {{num}} * (a.n + b.n - count(*))),
reach(a, b) as (select a, b from links union select r.a, l.b from reach r join links l on l.a = r.b)
select s.doc_id, cast(len(s.s) as bigint) as n_shingles, least(s.doc_id, coalesce(r.m, s.doc_id)) as component_id
from s left join (select a, min(b) as m from reach group by a) r on r.a = s.doc_id
"""
OP6_SQL = _GROUPS_SQL.format(k=5, num=75)
OP11_SQL = f"select *, doc_id = component_id as kept from ({_GROUPS_SQL.format(k=4, num=80)})"

OP10_SQL = rf"""
with d as materialized (select doc_id, regexp_extract_all({_LOW}, '{_ALNUM}') as w from documents),
i as (select item_id, regexp_extract_all({_LOW}, '{_ALNUM}') as w from benchmark),
windows as materialized (select distinct item_id, least(len(w), 10) as n, array_to_string(w[k:k + least(len(w), 10) - 1], ' ') as g
 from (select item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) as k from i where len(w) > 0)),
sizes as (select distinct n from windows),
grams as (select doc_id, k, n, array_to_string(w[k:k + n - 1], ' ') as g from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as k from d, sizes where len(w) >= n)),
hits as materialized (select distinct doc_id, k, grams.n, item_id from grams join windows using (n, g)),
words as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(k, k + n)) as p from hits) group by doc_id),
items as (select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as names from (select distinct doc_id, cast(item_id as varchar) as item_id from hits) group by doc_id)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(names, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join words using (doc_id) left join items using (doc_id)
"""


def _lloyd_round(k: int) -> str:
    """Nearest entries under codebook k, and the codebook that follows."""
    return f"""
a{k} as materialized (select x.vec_id, part, x, min({{'d': zz - 2 * list_inner_product(z, x), 'entry': entry}}).entry as entry, min(zz - 2 * list_inner_product(z, x)) + any_value(xx) as d
 from x join b{k} using (part) group by x.vec_id, part, x),
m{k} as (select part, entry, list(v order by j) as z from (select part, entry, j, floor(sum(x[j]) / count(*)) as v from a{k}, (select unnest(range(1, 17)) as j) group by part, entry, j) group by part, entry),
b{k + 1} as materialized (select part, entry, z, list_inner_product(z, z) as zz from (select part, entry, coalesce(m{k}.z, b{k}.z) as z from b{k} left join m{k} using (part, entry)))"""


#: Vectors have 64 components here; whole numbers are held as doubles, which are exact for them.
OP12_SQL = f"""
with v as materialized (select vec_id, label, list_transform(embedding, lambda c: floor(1024 * cast(c as double))) as e from embeddings
 where embedding is not null and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0),
x as materialized (select *, list_inner_product(x, x) as xx from (select vec_id, part, e[16 * part + 1:16 * part + 16] as x from v, (select unnest(range(4)) as part))),
b0 as materialized (select part, cast(rank as int) as entry, x as z, xx as zz from x join (select vec_id, row_number() over (order by vec_id) - 1 as rank from v) using (vec_id) where rank < 256),
{",".join(_lloyd_round(k) for k in range(5))},
c as (select vec_id, string_agg(lower(printf('%02x', cast(entry as int))), '' order by part) as code, cast(sum(d) as bigint) as error from a4 group by vec_id),
digest as (select sha256(string_agg(cast(cast(n as bigint) as varchar), ',' order by part, entry, j)) as codebooks_sha256 from (select part, entry, unnest(z) as n, unnest(range(16)) as j from b4))
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, codebooks_sha256 from c join v using (vec_id), digest
"""


OP13_SQL = rf"""
with d as materialized (select doc_id, term, count(*) as tf from (select doc_id, unnest(regexp_extract_all({_LOW}, '{_ALNUM}')) as term from documents) group by doc_id, term),
n as (select doc_id, cast(sum(tf) as bigint) as n from d group by doc_id),
whole as (select count(*) as docs, cast(sum(n) as bigint) as words from n),
m as (select doc_id, 75 + (25 * n * docs) // words as m from n, whole),
w as (select term, cast(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) as bigint) as w from d, whole group by term, docs),
i as (select item_id, term, count(*) as c from (select item_id, unnest(regexp_extract_all({_LOW}, '{_ALNUM}')) as term from benchmark) group by item_id, term),
scores as (select item_id, doc_id, cast(sum(c * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) as bigint) as score from i join w using (term) join d using (term) join m using (doc_id) group by item_id, doc_id)
select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id) as int) as rank, doc_id, score from scores where score > 0
qualify rank <= 20
"""


def oracle_sql() -> dict[str, str]:
    return {"op6_parity_join": OP6_SQL, "op10_decontamination": OP10_SQL, "op11_bbit_minhash": OP11_SQL, "op12_filtering_lloyd": OP12_SQL, "op13_impact_search": OP13_SQL}
