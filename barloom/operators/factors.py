"""Evaluation of factors against a label."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.storage import estimated_bytes, small, written

#: Tables of fewer bytes, as the optimizer sees them, have the values of a factor ranked in one task.
SMALL_BYTES = 32 << 20


def covered(rows: DataFrame, factors: list[str], least: float = 0.5) -> list[str]:
    """Factors that have finite values in at least a share of the rows."""
    ok = lambda c: F.avg(F.coalesce((~F.isnan(c) & (F.abs(c) < float("inf"))).cast("double"), F.lit(0.0))).alias(c)
    share = rows.agg(*(ok(c) for c in factors)).first()
    return [c for c in factors if (share[c] or 0.0) >= least]


def split(rows: DataFrame, order: list[str], share: float = 0.7, pieces: int = 200) -> DataFrame:
    """Adds ``train`` for the first part of the rows in time: a rounded share (5 to 95 %) of their number.

    Places come from sums over ranges of the order, so no task sees all rows. At least 100 rows, and 50 on either side,
    must be there.
    """
    n = rows.count()
    k = int(n * min(max(share, 0.05), 0.95) + 0.5)
    if n < 100 or k < 50 or n - k < 50:
        raise ValueError("too few rows to split")
    dealt = rows.repartitionByRange(pieces, *order).withColumn("__piece", F.spark_partition_id())
    place = F.row_number().over(Window.partitionBy("__piece").orderBy(*order))
    sums = dealt.groupBy("__piece").agg(F.count(F.lit(1)).alias("__n"))
    before = sums.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return dealt.withColumn("__place", place).join(F.broadcast(before), "__piece").withColumn("train", F.col("__before") + F.col("__place") <= k).drop("__piece", "__place", "__n", "__before")


def ranked(counts: DataFrame, group: str, value: str, pieces: int = 0) -> DataFrame:
    """Numbers ``k`` of each ``value`` of each ``group`` with ``upto``, the sum of those up to it. With ``pieces``, values
    are dealt to so many ranges, which are summed up first, so a group of any size is many tasks' work."""
    if not pieces:
        return counts.withColumn("upto", F.sum("k").over(Window.partitionBy(group).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)))
    dealt = written(counts.repartitionByRange(pieces, group, value).withColumn("__piece", F.spark_partition_id()), "ranges")
    sums = dealt.groupBy(group, "__piece").agg(F.sum("k").alias("__k"))
    before = F.sum("__k").over(Window.partitionBy(group).orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1))
    sums = written(sums.select(group, "__piece", F.coalesce(before, F.lit(0)).alias("__before")), "sums")
    within = F.sum("k").over(Window.partitionBy(group, "__piece").orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    placed = dealt.withColumn("upto", within).join(small(sums), [group, "__piece"])
    return placed.withColumn("upto", F.col("upto") + F.col("__before")).select(*counts.columns, "upto")


def spearman(rows: DataFrame, factors: list[str], label: str, pieces: int | None = None) -> DataFrame:
    """factor, n, ic: the correlation of average ranks over rows where both values are finite; null under three rows, 0
    without spread. Ranks come from counts by value: the values are summed up, not the rows, in ``pieces`` ranges of
    values (0: one for each factor; if it isn't given, that for small tables, else the session's partitions)."""
    if pieces is None:
        pieces = 0 if estimated_bytes(rows) < SMALL_BYTES else int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    long = rows.select(F.col(label).cast("double").alias("y"), F.explode(F.array(*(F.struct(F.lit(c).alias("factor"), F.col(c).cast("double").alias("x")) for c in factors))).alias("f")).select("f.factor", "f.x", "y")
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    long = long.where(finite("x") & finite("y"))

    def ranks(c: str) -> DataFrame:
        count = long.groupBy("factor", c).agg(F.count(F.lit(1)).alias("k"))
        return ranked(count, "factor", c, pieces).select("factor", c, (F.col("upto") - (F.col("k") - 1) / 2).alias(f"r{c}"))

    both = long.join(ranks("x"), ["factor", "x"]).join(ranks("y"), ["factor", "y"])
    out = both.groupBy("factor").agg(F.count(F.lit(1)).alias("n"), F.corr("rx", "ry").alias("c"))
    return out.select("factor", "n", F.when(F.col("n") >= 3, F.coalesce(F.nanvl("c", F.lit(0.0)), F.lit(0.0))).alias("ic"))


def report(scored: DataFrame, prediction: str = "prediction", label: str = "label", majority: int = 1) -> DataFrame:
    """R squared, the share of right signs (labels of 0 left out), that of always the majority's, and the correlation."""
    y, p = F.col(label).cast("double"), F.col(prediction)
    rows = scored.withColumn("mean", scored.agg(F.avg(y)).scalar())
    hit = F.avg(F.when(y != 0, (F.signum(p) == F.signum(y)).cast("double")))
    return rows.agg(
        (1 - F.sum((y - p) * (y - p)) / F.sum((y - F.col("mean")) * (y - F.col("mean")))).alias("r2"), hit.alias("hit_rate"),
        F.avg(F.when(y != 0, (F.signum(y) == majority).cast("double"))).alias("baseline"), F.corr(p, y).alias("correlation"),
    )


def boosted(train: DataFrame, factors: list[str], label: str, trees: int = 20, depth: int = 4):
    """A gradient-boosted model of Spark's own kind, missing values as 0 with a flag of their own, and the factors by
    importance. Its figures are not those of other learners."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    inputs = [f"{c}__v" for c in factors] + [f"{c}__m" for c in factors]
    prepare = lambda df: df.withColumns({f"{c}__v": F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")), F.lit(0.0)) for c in factors} | {f"{c}__m": F.col(c).isNull().cast("double") for c in factors})
    model = Pipeline(stages=[VectorAssembler(inputCols=inputs, outputCol="__features"), GBTRegressor(featuresCol="__features", labelCol=label, maxIter=trees, maxDepth=depth, seed=1)]).fit(prepare(train))
    gain = model.stages[-1].featureImportances.toArray()
    ranked = sorted(((c, float(gain[i] + gain[i + len(factors)])) for i, c in enumerate(factors)), key=lambda x: -x[1])
    return lambda df: model.transform(prepare(df)).drop("__features", *inputs), ranked
