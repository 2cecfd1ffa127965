"""Secret scan: patterns of known secrets, and character Markov models for the rest.

Two first-order models, one of random strings and one of ordinary identifiers, are trained from labelled samples; a
long run of token characters is a secret if the log-likelihood ratio says so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Kinds in the order of their listing: pattern, group that counts, characters it must have.
KINDS = {
    "assign": (r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    "access": (r"AKIA[A-Z0-9]{14,}", 0, 18),
    "hex": (r"[0-9a-f]{16,}", 0, 16),
}
METHOD = "markov"
#: Characters of tokens; the models know no others.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
CANDIDATE = r"[A-Za-z0-9+/_=-]{16,}"
#: Words of which the sample's ordinary identifiers are made.
WORDS = (
    "account action active address admin after agent alert alias align amount anchor answer apply archive array async attach audit author balance banner "
    "batch before binary block board border branch bridge bucket buffer build button cache calendar cancel capture category center chain change channel "
    "check child class clean client close cluster color column command commit common compare config confirm connect constant content context control "
    "convert count create current cursor custom data date debug default delete deploy depth detail device dialog direct disable display document domain "
    "driver dynamic edge edit element email enable encode end engine entry error event example execute export extend factory feature fetch field file "
    "filter find first flag folder format forward frame function general generate global graph group handle handler header height history host image "
    "import index info initial input insert instance internal interval item iterator join kernel keyword label language last layer layout length level "
    "library limit line link list listener loader local location manager mapping master match memory message method metric model module monitor"
).split()
#: Parts of the syllables of which other ordinary words are made.
ONSETS = "b c d f g h j k l m n p r s t v w z bl br ch cl cr dr fl fr gr pl pr qu sch sh sp st str th tr wh".split()
NUCLEI = "a e i o u a e i o u ai au ea ee ei ie io oa oo ou y".split()
CODAS = ["", "", "", *"n r s t l m d ch ck ll nd ng nt rd rs rt ss st th".split()]
#: Strings of either label in the training sample.
SAMPLES = 6000
#: Log-likelihood ratio from which a run is a secret.
THRESHOLD = 10.0


def samples(spark: SparkSession, n: int = SAMPLES, seed: str = "8") -> DataFrame:
    """Labelled strings (text, random): ``n`` random ones in several alphabets and lengths, and ``n`` ordinary ones: identifiers in several
    styles, words run together, paths, dates, versions, numbers, rules, and characters or pairs of them repeated.

    Their number is a parameter, so what training gathers is bounded.
    """
    i, taken = F.col("id"), iter(range(1 << 30))
    digest = lambda salt: F.sha2(F.concat_ws("|", F.lit(seed), F.lit(salt), i), 256)
    # Each choice has a draw of its own from a row's list of hashes.
    drawn = spark.range(n).withColumn("draw", F.transform(F.sequence(F.lit(0), F.lit(99)), lambda j: F.xxhash64(F.lit(seed), j, i)))
    pick = lambda k: F.pmod(F.get("draw", next(taken)), F.lit(k)).cast("int")
    of = lambda known: F.element_at(F.array(*(F.lit(x) for x in known)), pick(len(known)) + 1)
    b64 = F.rtrim(F.base64(F.unhex(F.concat(digest("a"), digest("b")))), F.lit("="))
    plain = F.regexp_replace(b64, "[+/]", "")
    hexes = F.concat(digest("c"), digest("d"))
    form = F.array(b64, plain, plain, F.translate(b64, "+/", "-_"), hexes, F.upper(hexes), F.upper(plain), F.lower(plain))
    random = drawn.select(F.substring(F.element_at(form, pick(8) + 1), F.lit(1), 16 + pick(40)).alias("text"), F.lit(True).alias("random"))
    syllable = lambda: F.concat(of(ONSETS), of(NUCLEI), of(CODAS))
    # Words of two to four syllables; each place has such a word or a known one.
    words = drawn.select("id", "draw", *(F.slice(F.array(*(syllable() for _ in range(4))), F.lit(1), 2 + pick(3)).alias(f"y{k}") for k in range(4)))
    words = words.select("id", "draw", *(F.array_join(f"y{k}", "").alias(f"made{k}") for k in range(4)))
    words = words.select("*", *(F.when(pick(2) == 0, of(WORDS)).otherwise(F.col(f"made{k}")).alias(f"some{k}") for k in range(4)))
    made, some = [F.col(f"made{k}") for k in range(4)], [F.col(f"some{k}") for k in range(4)]
    two = lambda k: F.lpad(pick(k).cast("string"), 2, "0")
    date = F.concat(F.lit("20"), two(40), F.lit("-"), two(12), F.lit("-"), two(31))
    one = F.substring(F.lit(ALPHABET), F.pmod(i, F.lit(len(ALPHABET))).cast("int") + 1, F.lit(1))
    other = F.substring(F.lit(ALPHABET), pick(len(ALPHABET)) + 1, F.lit(1))
    count = F.lpad(pick(10**9).cast("string"), 16, "0")
    times = 16 + pick(24)
    style = F.array(
        F.concat_ws("_", *some), F.concat(some[0], *(F.initcap(w) for w in some[1:])), F.concat(*some), F.concat(*made), F.concat_ws("-", *some), F.upper(F.concat_ws("_", *some)), F.upper(F.concat(*made)),
        F.concat(*(F.initcap(w) for w in some)), F.concat(F.concat_ws("_", *some[:3]), pick(100)), F.concat_ws("/", *some), F.concat_ws("/", some[0], F.translate(date, "-", "/"), F.concat_ws("-", *some[1:])),
        F.concat(date, F.lit("_"), two(24), F.lit("-"), two(60), F.lit("-"), two(60)), F.concat_ws("-", some[0], some[1], date), F.concat(some[0], F.lit("-v"), pick(10), F.lit("-"), pick(20), F.lit("-"), pick(100)),
        F.concat(some[0], F.lit("="), some[1], F.lit("_"), some[2]), count, F.concat(some[0], F.lit("_"), count), F.repeat(one, 10 * times), F.repeat(F.concat(one, other), times), F.concat(F.repeat(F.lit("-"), times), some[0]), F.repeat(F.concat(of("-=_+/"), of("-=_+/")), 3 * times),
    )
    ordinary = words.select(F.element_at(style, pick(21) + 1).alias("text"), F.lit(False).alias("random"))
    return random.unionAll(ordinary)


def _codes(text: Column) -> Column:
    return F.transform(F.split(text, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)


def train(labelled: DataFrame) -> DataFrame:
    """One row, ``model``: for each pair of characters, the logarithm of how much likelier the second follows the first
    in random strings than in identifiers, with one added to each count."""
    size = len(ALPHABET)
    codes = labelled.where(F.col("text").isNotNull()).select("random", _codes(F.col("text")).alias("c"))
    pairs = codes.select("random", F.explode(F.arrays_zip(F.col("c").alias("a"), F.slice("c", 2, 1 << 30).alias("b"))).alias("p")).where((F.col("p.a") >= 0) & (F.col("p.b") >= 0))
    seen = pairs.groupBy((F.col("p.a") * size + F.col("p.b")).cast("long").alias("pair")).agg(F.count_if("random").alias("r"), F.count_if(~F.col("random")).alias("o"))
    grid = labelled.sparkSession.range(size * size).withColumnRenamed("id", "pair")
    every = grid.join(seen, "pair", "left").select("pair", F.coalesce("r", F.lit(0)).alias("r"), F.coalesce("o", F.lit(0)).alias("o"), F.expr(f"pair div {size}").alias("first"))
    total = every.groupBy("first").agg((F.sum("r") + size).alias("rs"), (F.sum("o") + size).alias("os"))
    ratio = F.log((F.col("r") + 1) / F.col("rs")) - F.log((F.col("o") + 1) / F.col("os"))
    return every.join(total, "first").agg(F.sort_array(F.collect_list(F.struct("pair", ratio.alias("llr")))).alias("m")).select(F.col("m.llr").alias("model"))


def log_ratio(token: Column, model: Column) -> Column:
    """Sum of the model over the token's pairs of characters."""
    codes = _codes(token)
    terms = F.zip_with(codes, F.slice(codes, 2, 1 << 30), lambda a, b: F.coalesce(F.get(model, a * len(ALPHABET) + b), F.lit(0.0)))
    return F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)


def _places(text: Column, pattern: str, group: int, least: int) -> Column:
    """Matches from left to right as structs of start, stop and text; those whose group is too short are dropped.

    What lies between matches is what splitting by the pattern leaves, so lengths give the places.
    """
    p = F.lit(pattern)
    whole, kept = F.regexp_extract_all(text, p, F.lit(0)), F.regexp_extract_all(text, p, F.lit(group))
    rows = F.arrays_zip(whole.alias("m"), kept.alias("g"), F.slice(F.split(text, pattern, -1), 1, 1 << 30).alias("gap"))
    zero = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start: int, stop: int, text: string>>)").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        stop = start + F.length(x["m"])
        one = F.array(F.struct(start.alias("start"), stop.alias("stop"), x["g"].alias("text")))
        return F.struct(stop.alias("at"), F.when(F.length(x["g"]) >= least, F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    found = F.aggregate(F.filter(rows, lambda x: x["m"].isNotNull()), zero, step)["out"]
    return F.when(text.rlike(pattern), found).otherwise(zero["out"])


def _tagged(spans: str, kind: int) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["stop"].alias("stop"), s["text"].alias("text")))


def find(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Secrets of each row of ``docs`` (doc_id, text): spans, an array of start, kind (its place in the listing), stop
    and text in order, starts and stops in code points.

    The patterns' spans come first; the models add runs of token characters that overlap none of them. Null and empty
    texts have none. Each row stands for itself, repeated or not; other columns are ignored. Nothing is shuffled but the
    bounded sample.
    """
    model = train(samples(docs.sparkSession)).scalar()
    rows = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumns({k: _places(F.col("text"), *v) for k, v in KINDS.items()})
    rows = rows.withColumns({"runs": _places(F.col("text"), CANDIDATE, 0, 16), "model": model})
    known = F.concat(*KINDS)
    free = F.filter("runs", lambda c: ~F.exists(known, lambda b: (b["start"] < c["stop"]) & (c["start"] < b["stop"])))
    rows = rows.withColumn(METHOD, F.filter(free, lambda c: log_ratio(c["text"], F.col("model")) >= threshold))
    tagged = [_tagged(k, i) for i, k in enumerate([*KINDS, METHOD])]
    return rows.select("doc_id", *KINDS, METHOD, F.sort_array(F.concat(*tagged)).alias("spans"))


def _named(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in [*KINDS, METHOD]))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["stop"])), ",")


def digests(found: DataFrame) -> DataFrame:
    """Counts by kind, base_sha256 of the patterns' spans, and all spans as text."""
    count = [F.size(k).cast("long").alias(f"n_{k}") for k in [*KINDS, METHOD]]
    base = F.filter("spans", lambda s: s["kind"] < len(KINDS))
    return found.select("doc_id", *count[:-1], F.sha2(_named(base), 256).alias("base_sha256"), _named(F.col("spans")).alias("spans"), count[-1])
