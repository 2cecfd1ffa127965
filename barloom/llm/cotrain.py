"""Quality classification by co-training of a text view and a page-metadata view."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel, HashingTF, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Labelled rows to fit on, in expectation; labels are exchanged over all unlabelled rows, and all rows are scored.
LABELLED = 6000
ROUNDS = 2
#: Probability from which a view's label goes to the other view.
CONFIDENT = 0.95
#: One labelled row of this many is kept to calibrate and combine the views.
CALIBRATION = 4
#: Terms of the text view: those in the most documents, in LEAST_ROWS of them at least.
TERMS, LEAST_ROWS = 1 << 14, 5
#: Fewer labelled rows than this, or of one label only, teach nothing.
LEAST = 20
_DRAW = 1 << 40
META = ("chars", "lines", "line_chars", "word_chars", "words", "digits", "signs", "upper", "bars", "same_lines")


def _share(text: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(pattern)) / F.greatest(F.length(text), F.lit(1)), F.lit(0.0))


def views(docs: DataFrame) -> DataFrame:
    """Adds ``terms``, words with what is attached to them, and ``meta``, measures of layout and origin."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words, lines = F.split(F.trim(text), r"\s+"), F.split(text, "\n")
    chars = F.length(text)
    meta = {
        "chars": F.log1p(chars), "lines": F.log1p(F.size(lines)), "line_chars": F.log1p(chars / F.size(lines)), "words": F.log1p(F.size(words)), "word_chars": chars / F.size(words),
        "digits": _share(text, "[0-9]"), "signs": _share(text, r"[^\p{L}\p{N}\s]"), "upper": _share(text, "[A-Z]"), "bars": _share(text, r"[|]"), "same_lines": 1 - F.size(F.array_distinct(lines)) / F.size(lines),
    }
    rows = docs.withColumns({f"__{k}": v.cast("double") for k, v in meta.items()})
    rows = rows.withColumn("terms", F.transform(words, lambda w: F.lower(F.rtrim(w, F.lit(".,")))))
    rows = rows.withColumn("__origin", F.array(F.concat(F.lit("lang="), F.coalesce(F.col("lang").cast("string"), F.lit(""))), F.concat(F.lit("source="), F.coalesce(F.col("source").cast("string"), F.lit("")))))
    rows = HashingTF(numFeatures=64, inputCol="__origin", outputCol="__from").transform(rows)
    rows = VectorAssembler(inputCols=[*(f"__{k}" for k in META), "__from"], outputCol="meta").transform(rows)
    return rows.drop("__origin", "__from", *(f"__{k}" for k in META))


def _fit(rows: DataFrame, view: str) -> LogisticRegressionModel:
    return LogisticRegression(featuresCol=view, labelCol="label", maxIter=20, regParam=0.004, elasticNetParam=0.5 if view == "content" else 0.0, weightCol="weight", rawPredictionCol="r", probabilityCol="p", predictionCol="y").fit(rows)


def _score(rows: DataFrame, model: LogisticRegressionModel, view: str, out: str) -> DataFrame:
    """Adds the model's log-odds as ``out``."""
    return model.transform(rows).withColumn(out, vector_to_array("r")[1]).drop("r", "p", "y")


def _odds(probability: float) -> float:
    from math import log

    return log(probability / (1 - probability))


def co_train(sample: DataFrame, target: str, rounds: int = ROUNDS) -> tuple[LogisticRegressionModel, LogisticRegressionModel, LogisticRegressionModel] | None:
    """Text model, metadata model, and the model that combines their log-odds, from rows with views and labels.

    In each round, the unlabelled rows of which one view is confident, and the other not of the contrary, go with that
    label to the other view's next fit; together they weigh no more than the labelled ones. Rows with a fold are the
    labelled sample; a part of it is used only to calibrate and combine the two. None if too few rows, or rows of one
    label only, are there.
    """
    known = sample.where(F.col(target).isNotNull() & F.col("fold").isNotNull()).withColumns({"label": F.col(target).cast("double"), "weight": F.lit(1.0)})
    count = known.agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("lo"), F.max("label").alias("hi")).first()
    if count.n < LEAST or count.lo == count.hi:
        return None
    train, held = known.where(F.col("fold") > 0), known.where(F.col("fold") == 0)
    split = held.agg(F.min("label").alias("lo"), F.max("label").alias("hi")).first()
    if split.lo is None or split.lo == split.hi:
        train = held = known
    pool, sure = sample.where(F.col(target).isNull()), _odds(CONFIDENT)
    learnt = train.count()
    content, meta = _fit(train.select("content", "label", "weight"), "content"), _fit(train.select("meta", "label", "weight"), "meta")
    for _ in range(rounds):
        scored = _score(_score(pool, content, "content", "a"), meta, "meta", "b")
        sure_of = lambda mine, other: (F.abs(mine) >= sure) & ~((F.abs(other) >= sure) & (F.signum(mine) != F.signum(other)))
        n = scored.agg(F.count_if(sure_of("a", "b")).alias("a"), F.count_if(sure_of("b", "a")).alias("b")).first()
        give = lambda mine, other: scored.where(sure_of(mine, other)).withColumns({"label": (F.col(mine) > 0).cast("double"), "weight": F.lit(min(1.0, learnt / max(n[mine], 1)))})  # noqa: E731, B023
        to_meta, to_content = give("a", "b"), give("b", "a")
        content, meta = (
            _fit(train.select("content", "label", "weight").unionAll(to_content.select("content", "label", "weight")), "content"),
            _fit(train.select("meta", "label", "weight").unionAll(to_meta.select("meta", "label", "weight")), "meta"),
        )
    scored = _score(_score(held, content, "content", "a"), meta, "meta", "b")
    return content, meta, _fit(VectorAssembler(inputCols=["a", "b"], outputCol="both").transform(scored).select("both", "label", "weight"), "both")


def vocabulary(docs: DataFrame) -> list[str]:
    """The TERMS terms that stand in the most rows of ``docs``, counted over all of them; ties by name."""
    each = views(docs).select(F.explode(F.array_distinct("terms")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    return [r.term for r in each.where(F.col("df") >= LEAST_ROWS).orderBy(F.desc("df"), "term").limit(TERMS).collect()]


def with_views(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, seed: int = 3) -> DataFrame:
    """All rows of ``docs`` with their views and labels, as a written table; ``fold`` is null but for some ``labelled``
    labelled rows.

    These are taken or not by a hash of the id, at a rate that the table's size gives.
    """
    one = labels.groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"), F.max("toxic").cast("int").alias("toxic"))
    draw = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(_DRAW))
    fold = F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id"), F.lit(CALIBRATION))
    one = one.withColumn("fold", F.when(draw < min(_DRAW, _DRAW * labelled // max(one.count(), 1)), fold))
    terms = CountVectorizerModel.from_vocabulary(vocabulary(docs) or [" "], inputCol="terms", outputCol="content", binary=True)
    rows = terms.transform(views(docs)).select("doc_id", "content", "meta")
    return written(rows.join(one, "doc_id", "left"), "cotrain-views")


def classify(docs: DataFrame, labels: DataFrame, targets: tuple[str, ...] = ("quality", "toxic")) -> DataFrame:
    """For each row of ``docs`` (doc_id, text, lang, source) and each target: the log-odds of either view,
    ``<target>_text`` and ``<target>_meta``, and their combined calibrated probability ``<target>_score``.

    ``labels`` (doc_id, quality, toxic; 0, 1 or null) teaches; of rows with the same doc_id the largest label counts. A
    text that is null or empty is scored by its other features. If labels teach nothing, views are null and the score is
    one half. Repeated rows are scored alike; an empty table gives an empty result; other columns are ignored. Views
    are written once, and shuffled to meet the labels; texts are not shuffled.
    """
    sample = with_views(docs.select("doc_id", "text", "lang", "source"), labels)
    scored = sample.select("doc_id", "content", "meta")
    for target in targets:
        models = co_train(sample, target)
        if models is None:
            scored = scored.withColumns({f"{target}_text": F.lit(None).cast("double"), f"{target}_meta": F.lit(None).cast("double"), f"{target}_score": F.lit(0.5)})
            continue
        content, meta, both = models
        scored = _score(_score(scored, content, "content", f"{target}_text"), meta, "meta", f"{target}_meta")
        odds = F.lit(float(both.intercept)) + F.lit(float(both.coefficients[0])) * F.col(f"{target}_text") + F.lit(float(both.coefficients[1])) * F.col(f"{target}_meta")
        scored = scored.withColumn(f"{target}_score", 1 / (1 + F.exp(-odds)))
    return scored.select("doc_id", *(f"{t}_{c}" for t in targets for c in ("text", "meta", "score")))
