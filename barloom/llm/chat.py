"""Chat formatting in token windows of whole turns.

Prefix sums of turn tokens deal the turns of a conversation to windows. Every window opens with the conversation's
system turn and some of the turns before it; what was already in an earlier window is under no loss mask again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
BUDGET, HISTORY = 1024, 256
#: Turns whose tokens are summed in one piece; the sums of the pieces are summed next.
BLOCK = 256
#: Tokens that the markers of a turn count.
MARKER_TOKENS = 4


def escape(text: Column) -> Column:
    r"""``\`` becomes ``\e``, ``<`` ``\l`` and ``[`` ``\k``: no control string survives, and nothing is lost."""
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\e")), F.lit("<"), F.lit("\\l")), F.lit("["), F.lit("\\k"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\k"), F.lit("[")), F.lit("\\e"), F.lit("\\"))


def _escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def _unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("\\n"), F.lit("\n")))


def token_count(text: Column) -> Column:
    """Runs of letters and digits, and other dark characters one by one."""
    return F.regexp_count(text, F.lit(r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]")).cast("long")


def _join(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """An inner join in which null keys are equal."""
    for k in keys:
        b = b.withColumnRenamed(k, f"__{k}")
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    return a.join(b, on).drop(*(f"__{k}" for k in keys))


def numbered_turns(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """Turns with their ordinal, tokens, and the tokens before them in the conversation.

    Sums go over blocks of turn numbers and then over the blocks' totals, so a conversation with any number of turns
    is dealt to many tasks.
    """
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).withColumns({"block": F.floor(F.col("turn") / block), "tokens": token_count("text") + MARKER_TOKENS})
    inner = Window.partitionBy("conv_id", "block").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"rank": F.count(F.lit(1)).over(inner), "upto": F.sum("tokens").over(inner)})
    outer = Window.partitionBy("conv_id").orderBy("block")
    before = outer.rowsBetween(Window.unboundedPreceding, -1)
    opening = F.max(F.when((F.col("rank") == 1) & (F.col("role") == "system"), F.struct("tokens", "text")))
    blocks = rows.groupBy("conv_id", "block").agg(F.count(F.lit(1)).alias("n"), F.sum("tokens").alias("sum"), opening.alias("opening"))
    blocks = blocks.select(
        "conv_id", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n_before"), F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("sum_before"),
        F.first("opening").over(outer.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("system"),
    )
    return _join(rows, blocks, ["conv_id", "block"]).select(
        "conv_id", "turn", "role", "text", "tokens", "system", (F.col("n_before") + F.col("rank")).alias("ordinal"), (F.col("sum_before") + F.col("upto") - F.col("tokens")).alias("before"),
    )


def windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, block: int = BLOCK) -> DataFrame:
    """Formatted windows of all conversations (conv_id, turn, role, text).

    Returns conv_id, window, formatted, n_tokens and segments: ordinal (from 1), start and stop in code points of
    ``formatted``, repeated, and loss_start and loss_stop, the mask, for an assistant's text that is not repeated.

    What is left of the budget after the history and the system turn (but a quarter of it at least) is the room for
    new turns. Turns that lie within the same multiple of the room share a window; one that reaches over its end joins
    them if it fits, else has a window of its own. A window thus exceeds the budget only by a system turn or a single
    turn that is too long, which stay whole. The history is what ends last before the window within ``history`` tokens.

    The system turn is the conversation's first if it has that role. Null roles and texts are empty; rows with null
    conv_id are one conversation; turns of the same number are ordered by role and text, null first; repeated rows
    all count; other columns are ignored. An empty table has no windows.
    """
    turns = numbered_turns(turns, block)
    own = F.coalesce(F.col("system.tokens"), F.lit(0))
    turns = turns.withColumn("room", F.greatest(F.lit(budget - history) - own, F.lit(-(-budget // 4))).cast("long"))
    turns = turns.withColumns({"cell": F.expr("before div room"), "over": F.expr("(before + tokens - 1) div room > before div room")})
    first = F.min(F.when(~F.col("over"), F.col("before"))).over(Window.partitionBy("conv_id", "cell"))
    alone = F.col("over") & ~F.coalesce(F.col("before") + F.col("tokens") - first <= F.col("room"), F.lit(False))
    turns = turns.withColumn("window", 2 * F.col("cell") + F.when(alone, 1).otherwise(0))
    opening = (F.col("ordinal") == 1) & F.col("system").isNotNull()
    fresh = turns.select("conv_id", "window", "ordinal", "role", "text", "tokens", F.lit(False).alias("repeated"))
    starts = turns.groupBy("conv_id", "window").agg(F.min("before").alias("start"), F.first("system").alias("system"), F.max(opening).alias("has_system"))
    again = turns.where(~opening & (F.col("tokens") <= history)).withColumn("window", F.explode(F.sequence(F.col("window"), F.expr(f"2 * ((before + {history}) div room) + 1"))))
    again = _join(again.drop("system"), starts.select("conv_id", "window", "start"), ["conv_id", "window"])
    again = again.where((F.col("start") >= F.col("before") + F.col("tokens")) & (F.col("start") - history <= F.col("before")))
    again = again.select("conv_id", "window", "ordinal", "role", "text", "tokens", F.lit(True).alias("repeated"))
    system = starts.where(F.col("system").isNotNull() & ~F.col("has_system")).select(
        "conv_id", "window", F.lit(1).cast("long").alias("ordinal"), F.lit("system").alias("role"), F.col("system.text").alias("text"), F.col("system.tokens").alias("tokens"), F.lit(True).alias("repeated"),
    )
    head = F.concat(F.lit(OPEN), _escape_role(F.col("role")), F.lit("\n"))
    rows = fresh.unionByName(again).unionByName(system).withColumns({"head": head, "body": escape(F.col("text"))})
    rows = rows.withColumn("piece", F.concat("head", "body", F.lit(CLOSE)))
    order = Window.partitionBy("conv_id", "window").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("stop", F.sum(F.length("piece")).over(order)).withColumn("start", F.col("stop") - F.length("piece"))
    loss = (F.col("role") == "assistant") & ~F.col("repeated")
    at = F.col("start") + F.length("head")
    segment = F.struct("ordinal", "start", "stop", "repeated", F.when(loss, at).alias("loss_start"), F.when(loss, at + F.length("body")).alias("loss_stop"))
    parts = F.sort_array(F.collect_list(F.struct("ordinal", "piece", segment.alias("segment"), "tokens")))
    packed = rows.groupBy("conv_id", "window").agg(parts.alias("parts"))
    return packed.select(
        "conv_id", "window", F.array_join("parts.piece", "").alias("formatted"), F.aggregate("parts.tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("n_tokens"), F.col("parts.segment").alias("segments"),
    )


def read_turns(formatted: DataFrame) -> DataFrame:
    """Turns parsed from the windows' text: conv_id, ordinal, role, text, and loss_text, what stands under the mask."""
    s = formatted.select("conv_id", "formatted", F.explode("segments").alias("s")).where(~F.col("s.repeated"))
    part = lambda a, b: F.substring(F.col("formatted"), F.col(a).cast("int") + 1, (F.col(b) - F.col(a)).cast("int"))
    s = s.select("conv_id", F.col("s.ordinal").alias("ordinal"), part("s.start", "s.stop").alias("piece"), part("s.loss_start", "s.loss_stop").alias("loss"))
    body = F.substring(F.col("piece"), F.lit(len(OPEN) + 1), F.length("piece") - len(OPEN) - len(CLOSE))
    s = s.withColumn("body", body).withColumn("role", F.substring_index("body", "\n", 1))
    text = F.substring(F.col("body"), F.length("role") + 2, F.length("body"))
    return s.select("conv_id", "ordinal", _unescape_role(F.col("role")).alias("role"), unescape(text).alias("text"), unescape(F.col("loss")).alias("loss_text"))


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """One row a conversation, read back from the windows; a digest needs a conversation's texts in one row."""
    turns = F.sort_array(F.collect_list(F.struct("ordinal", "role", "text", "loss_text")))
    each = read_turns(formatted).groupBy("conv_id").agg(turns.alias("t"))
    loss = F.array_join(F.transform("t", lambda x: F.coalesce(x["loss_text"], F.lit(""))), "")
    whole = F.array_join(F.transform("t", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    each = each.select(
        "conv_id", F.size("t").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
    )
    size = formatted.groupBy("conv_id").agg(F.sum(F.length("formatted")).alias("formatted_chars"), F.count(F.lit(1)).alias("n_windows"))
    return _join(each, size, ["conv_id"])
