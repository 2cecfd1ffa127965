"""A search's runs as a tree that branches on their parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.storage import written

#: The value of a parameter that a run doesn't have.
NONE = "—"


def _named(df: DataFrame) -> DataFrame:
    """node with ``implied``: its parameters (key, value, rank) by rank."""
    pairs = F.sort_array(F.collect_list(F.struct("rank", "key", "value")))
    return df.groupBy("node").agg(F.transform(pairs, lambda p: F.struct(p["key"].alias("key"), p["value"].alias("value"))).alias("implied"))


def _best() -> list[Column]:
    return [F.count(F.lit(1)).alias("runs"), F.max("net_pnl").alias("best"), F.min_by("run_id", F.struct(-F.col("net_pnl"), F.col("run_id"))).alias("best_run")]


def run_tree(runs: DataFrame, params: list[str]) -> DataFrame:
    """The tree of ``runs`` (run_id, strategy, net_pnl, and ``params``, null where a run has none): a row for each node.

    Runs branch by strategy first. Below, a node branches on the first parameter that varies among its runs, those with
    the fewest values in the strategy first, then by name; parameters that a branch leaves with one value are
    ``implied`` there. A strategy implies what all its runs share, unless all runs of all strategies do
    (``metrics.shared_params``). Runs among which nothing varies are leaves.

    Columns: node_id, its path; parent_id; depth; key and value of the branch; implied; runs; best, the best net_pnl, and
    best_run, the first of such by id; place among its siblings, by best and value; and run_id, of leaves only.

    The tree grows a level at a time over all nodes, so its work is as many groupings as it has levels, at most one for
    each parameter; each level is a written table.
    """
    has = F.array(*(F.struct(F.lit(p).alias("key"), F.col(p).cast("string").alias("own")) for p in sorted(params)))
    rows = written(runs.select("run_id", F.col("strategy").cast("string").alias("strategy"), "net_pnl"), "runs")
    long = runs.select("run_id", F.col("strategy").cast("string").alias("node"), "net_pnl", F.inline(has)).withColumn("value", F.coalesce("own", F.lit(NONE)))
    long = written(long, "params")
    counts = [F.count_distinct("value").alias("values"), F.count("own").alias("with"), F.count(F.lit(1)).alias("n"), F.min("value").alias("only")]
    shared = long.groupBy("key").agg(*counts).where("values = 1 and with = n").select("key")
    each = written(long.groupBy("node", "key").agg(*counts).where("with > 0"), "keys")
    order = F.row_number().over(Window.partitionBy("node").orderBy("values", "key"))
    varying = each.where("values > 1").withColumn("rank", order).select("node", "key", "rank")
    constant = each.where("values = 1 and with = n").join(shared, "key", "left_anti").select("node", "key", F.col("only").alias("value"), F.lit(0).alias("rank"))
    roots = rows.groupBy(F.col("strategy").alias("node")).agg(*_best()).join(_named(constant), "node", "left")
    tree = [roots.select("node", F.lit(None).cast("string").alias("parent"), F.lit(0).alias("depth"), F.lit("strategy").alias("key"), F.col("node").alias("value"), "implied", "runs", "best", "best_run")]
    at = rows.select("run_id", F.col("strategy").alias("node"))
    open_ = written(long.join(varying, ["node", "key"]).select("run_id", "node", "net_pnl", "key", "value", "rank"), "level")
    for depth in range(1, len(params) + 1):
        active = written(open_.groupBy("node", "key", "rank").agg(F.count_distinct("value").alias("values")).where("values > 1").drop("values"), "active")
        if active.isEmpty():
            break
        branch = active.groupBy("node").agg(F.min_by("key", "rank").alias("key"))
        chosen = open_.join(branch, ["node", "key"]).select("run_id", F.col("node").alias("parent"), "net_pnl", F.col("key").alias("on"), F.col("value").alias("as"))
        chosen = written(chosen.withColumn("child", F.concat("parent", F.lit("/"), "on", F.lit("="), "as")), "chosen")
        rest = open_.join(active.select("node", "key"), ["node", "key"]).join(chosen.select("run_id", "on", "child"), "run_id").where("key <> on")
        open_ = written(rest.select("run_id", F.col("child").alias("node"), "net_pnl", "key", "value", "rank"), "level")
        fixed = open_.groupBy("node", "key", "rank").agg(F.count_distinct("value").alias("values"), F.min("value").alias("value")).where("values = 1")
        nodes = chosen.groupBy(F.col("child").alias("node"), "parent", F.col("on").alias("key"), F.col("as").alias("value")).agg(*_best())
        nodes = nodes.join(_named(fixed), "node", "left").withColumn("depth", F.lit(depth))
        tree.append(written(nodes.select(*tree[0].columns), "nodes"))
        at = written(at.join(chosen.select("run_id", "child"), "run_id", "left").select("run_id", F.coalesce("child", "node").alias("node")), "at")
    nodes = tree[0]
    for level in tree[1:]:
        nodes = nodes.unionByName(level)
    nodes = nodes.withColumn("place", F.row_number().over(Window.partitionBy("parent").orderBy(F.col("best").desc(), "value")))
    none = F.lit(None)
    nodes = nodes.select(
        F.col("node").alias("node_id"), F.col("parent").alias("parent_id"), "depth", "key", "value",
        F.coalesce("implied", F.array().cast("array<struct<key: string, value: string>>")).alias("implied"), "runs", "best", "best_run", "place", none.cast(rows.schema["run_id"].dataType).alias("run_id"),
    )
    leaves = at.join(rows.select("run_id", "net_pnl"), "run_id")
    leaves = leaves.join(nodes.select("node_id", (F.col("depth") + 1).alias("depth")), F.col("node") == F.col("node_id")).select(
        F.concat("node", F.lit("/#"), F.col("run_id").cast("string")).alias("node_id"), F.col("node").alias("parent_id"), "depth", none.cast("string").alias("key"), none.cast("string").alias("value"),
        F.array().cast("array<struct<key: string, value: string>>").alias("implied"), F.lit(1).cast("long").alias("runs"), F.col("net_pnl").alias("best"), F.col("run_id").alias("best_run"), none.cast("int").alias("place"), "run_id",
    )
    return nodes.unionByName(leaves)
