"""From raw documents to token files, in stages that are each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from barloom.llm import queries as q
from barloom.llm import decontaminate, langid, mixing, parity_join, token_orc
from barloom.llm.common import held_out, written
from barloom.session import ship_package


#: A text that the best language's model needs as many bits for as plain bytes have is in none of the languages.
MAX_BITS_PER_BYTE = 8.0


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: null, empty or letterless texts, and texts that no learnt language codes in
    under MAX_BITS_PER_BYTE. All others stay as they are; if nothing was learnt, all texts with a letter do. Each row is
    judged by its text alone: null ids and other null columns, repeated rows and extra columns make no difference. An
    empty table stays empty."""
    ship_package(spark)
    return langid.of_some_language(docs, langid.learn(docs, ~held_out("doc_id")), MAX_BITS_PER_BYTE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near copies, of equal ids one row by its text. Rows
    without an id all stay, as do null and empty texts, which are near nothing; extra columns stay as they are, and an
    empty table stays empty."""
    ship_package(spark)
    return parity_join.one_of_groups(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which a window of a benchmark item stands; a hot passage drops all of its documents, repeated
    rows alike. Null and empty texts, and null ids, stay if their text is clean; an empty table stays empty."""
    return decontaminate.clean(docs, q.table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture of all tokens takes them; a leaf over its target loses rows, one under it repeats them.

    Null names are a leaf of their own, null and empty texts count one token; rows of a leaf with equal ids, null ones
    too, go together. Extra columns stay as they are; an empty table stays empty."""
    return mixing.repeated(docs, q.domain(), q.MIX_WEIGHTS, 100, q.MIX_EPOCHS, q.MIX_SEED)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of all documents, in the order of id and text; returns their digests, one for each row.

    Null ids come first, null and empty texts have the end id alone, repeated rows all stay; an empty table gives none."""
    ship_package(spark)
    return token_orc.tokenised(docs, q.TOKENIZER)


STAGES = [
    ("language ID", language_id),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixture),
    ("token-ID output", token_output),
]
#: Tokenizers are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written as Parquet and reread as the next one's input."""
    docs = q.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, "pipeline")
    return docs
