"""Mixing sources to target weights over a domain, language and source tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import set_aside, written

LEVELS = ("domain", "lang", "source")
MISSING = "(none)"
#: Leaves of the tree up to which their table is broadcast; beyond, it is joined by a shuffle.
BROADCAST_LEAVES = 20_000
#: Hexadecimal digits of the order's hash by which a leaf's tokens are summed before they are sorted.
BUCKET_DIGITS = 3


def token_count(text: Column) -> Column:
    """Runs of dark characters, one at least."""
    return F.greatest(F.coalesce(F.regexp_count(text, F.lit("[^ \\t\\n\\r]+")), F.lit(0)), F.lit(1)).cast("long")


def with_leaf(docs: DataFrame, domain: Column) -> DataFrame:
    """Adds the struct ``__leaf`` of domain, lang and source; null names are "(none)"."""
    name = lambda c: F.coalesce(c.cast("string"), F.lit(MISSING))
    return docs.withColumn("__leaf", F.struct(name(domain).alias("domain"), name(F.col("lang")).alias("lang"), name(F.col("source")).alias("source")))


def fill(nodes: DataFrame, parent: list[str], order: str) -> DataFrame:
    """Divides each parent's ``amount`` among its children in proportion to ``weight``, none over its ``supply``.

    What a child can't take goes to its siblings, again in proportion. Children are sorted by supply for weight; those
    before the water level are full. Parts of a token that rounding leaves go to the first children by name.
    """
    by = Window.partitionBy(*parent)
    rising = by.orderBy(F.col("supply") / F.col("weight"), order).rowsBetween(Window.unboundedPreceding, -1)
    before, used = F.coalesce(F.sum("supply").over(rising), F.lit(0)), F.coalesce(F.sum("weight").over(rising), F.lit(0))
    nodes = nodes.withColumn("full", (F.col("amount") - before) / (F.sum("weight").over(by) - used) >= F.col("supply") / F.col("weight"))
    left = F.greatest(F.col("amount") - F.coalesce(F.sum(F.when(F.col("full"), F.col("supply"))).over(by), F.lit(0)), F.lit(0))
    open_ = F.sum(F.when(~F.col("full"), F.col("weight"))).over(by)
    nodes = nodes.withColumns({"left": left, "part": F.when(~F.col("full"), F.floor(left / open_ * F.col("weight")))})
    rest = F.col("left") - F.sum("part").over(by)
    rank = F.row_number().over(Window.partitionBy(*parent, "full").orderBy(order))
    share = F.when(F.col("full"), F.col("supply")).otherwise(F.least(F.col("part") + F.when(rank <= rest, 1).otherwise(0), F.col("supply")))
    return nodes.withColumn("share", share.cast("long")).drop("full", "left", "part")


def _weight(weights: dict[tuple[str, ...], int], path: list[str]) -> Column:
    found = F.lit(None).cast("long")
    for names, w in weights.items():
        if len(names) == len(path):
            same = F.lit(True)
            for c, n in zip(path, names, strict=True):
                same &= F.col(c) == n
            found = F.when(same, F.lit(w).cast("long")).otherwise(found)
    return F.coalesce(found, F.lit(1).cast("long"))


def budgets(leaves: DataFrame, weights: dict[tuple[str, ...], int], percent: int, max_epochs: int) -> DataFrame:
    """Tokens that each leaf (domain, lang, source, tokens) is to give: ``share``.

    The budget is ``percent`` of all tokens. Weights, positive whole numbers by path and 1 where not given, divide it
    from the root down. A node's supply is what its leaves hold times ``max_epochs``; as a node never gets more than
    that, a leaf's shortage goes to its siblings first, and to its ancestors' siblings only when all of those are full.
    """
    leaves = leaves.withColumn("supply", F.col("tokens") * max_epochs)
    above = leaves.agg(F.floor(F.coalesce(F.sum("tokens"), F.lit(0)) * percent / 100).alias("amount")).withColumn("root", F.lit(0))
    key: list[str] = ["root"]
    leaves = leaves.withColumn("root", F.lit(0))
    for k, level in enumerate(LEVELS):
        path = [*LEVELS[: k + 1]]
        nodes = leaves.groupBy("root", *path).agg(F.sum("supply").alias("supply"), F.sum("tokens").alias("tokens"))
        nodes = nodes.join(above.select(*key, "amount"), key).withColumn("weight", _weight(weights, path))
        above = fill(nodes, key, level).withColumn("amount", F.col("share"))
        key = ["root", *path]
    return above.select(*LEVELS, "tokens", "share")


def mix(docs: DataFrame, domain: Column, weights: dict[tuple[str, ...], int], percent: int = 100, max_epochs: int = 2, seed: int = 7) -> DataFrame:
    """``docs`` (doc_id, text, lang, source and any others whose names don't begin with ``__``) with ``__leaf``, ``__tokens``
    and ``__copies``, how often each row goes into the mixture.

    A leaf's share is whole epochs of all its rows, then the prefix of one more whose tokens come nearest to what is left, in
    the order of md5 of seed, epoch and id. The prefix ends at one hash a leaf: tokens are summed by leaf and by the
    hash's first digits, and only the piece in which the share ends is sorted, so a leaf of any size is dealt to many
    tasks, and no text is shuffled.

    Null texts count one token, as empty ones do; null ids hash as "null"; rows of a leaf with the same id go
    together. An empty table gives an empty result.
    """
    rows = with_leaf(docs, domain).withColumn("__tokens", token_count(F.col("text")))
    light = written(rows.select("__leaf.*", F.col("doc_id").cast("string").alias("id"), F.col("__tokens").alias("tokens")), "mix-tokens")
    leaves = light.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens"))
    share = budgets(leaves, weights, percent, max_epochs).select(*LEVELS, F.expr("share div tokens").alias("epochs"), F.expr("share % tokens").alias("rest"))
    share = written(share, "mix-shares")
    few = share.limit(BROADCAST_LEAVES + 1).count() <= BROADCAST_LEAVES
    small = F.broadcast if few else (lambda df: df)
    order = lambda id_, epochs: F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(epochs).cast("string"), F.coalesce(id_, F.lit("null"))))
    hashed = light.join(small(share.where("rest > 0")), [*LEVELS]).withColumn("h", order(F.col("id"), "epochs")).withColumn("bucket", F.substring("h", 1, BUCKET_DIGITS))
    sums = hashed.groupBy(*LEVELS, "bucket", "rest").agg(F.sum("tokens").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(*LEVELS).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    last = sums.withColumn("upto", upto).where((F.col("upto") >= F.col("rest")) & (F.col("upto") - F.col("n") < F.col("rest")))
    last = last.select(*LEVELS, "bucket", (F.col("rest") - (F.col("upto") - F.col("n"))).alias("room"))
    inside = hashed.join(small(last), [*LEVELS, "bucket"])
    upto = F.sum("tokens").over(Window.partitionBy(*LEVELS).orderBy("h").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    own = F.sum("tokens").over(Window.partitionBy(*LEVELS, "h"))
    # All hashes of the pieces before are less than the piece's own digits.
    end = F.coalesce(F.max(F.when(F.col("upto") - F.col("own") / 2 <= F.col("room"), F.col("h"))), F.first("bucket"))
    ends = inside.withColumns({"upto": upto, "own": own}).groupBy(*LEVELS).agg(end.alias("end"))
    plan = written(share.join(ends, [*LEVELS], "left"), "mix-plan")
    leaf = plan.select(F.struct(*LEVELS).alias("__leaf"), F.col("epochs").alias("__epochs"), F.col("end").alias("__end"))
    joined = rows.join(small(leaf), "__leaf", "left")
    within = F.coalesce(order(F.col("doc_id").cast("string"), "__epochs") <= F.col("__end"), F.lit(False))
    return joined.withColumn("__copies", (F.coalesce(F.col("__epochs"), F.lit(0)) + within.cast("long")).cast("long")).drop("__epochs", "__end")


def repeated(docs: DataFrame, domain: Column, *args, **kwargs) -> DataFrame:
    """The rows of ``docs``, each as often as ``mix`` takes it with these arguments; columns, whatever their names, are unchanged."""
    docs, named = set_aside(docs, "doc_id", "text", "lang", "source")
    mixed = mix(docs, domain, *args, **kwargs).where(F.col("__copies") > 0)
    return named(mixed.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col("__copies"))).alias("__copy")))
