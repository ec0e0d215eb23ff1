"""Secret scan: three fixed patterns, and a battery of randomness tests on every other long token.

Built-in expressions only. Texts are read once; what is kept of a text is its spans.

A token is a maximal run of 16 or more characters of ``[A-Za-z0-9+/_=-]`` with a digit or an inner
change from lower to upper case; others cannot pass the test of class changes below. Its encoding is
inferred from its characters: hexadecimal, base32, or base64. Against a uniform draw from that
alphabet stand three tests, and none may reject: chi-squared of the symbol counts, runs above and
below the middle symbol, and correlation of neighbouring symbols. Against ordinary text stand two
bounds: how rarely symbols repeat (``ORDINARY_COINCIDENCE``) and how often character classes change
(``ORDINARY_CHANGE``); Fisher's method joins them. What counts as found is decided per length band over
all tokens of the corpus with Benjamini and Hochberg's rule, since short tokens carry little evidence
and are many. That rule needs one count per band and tenth of a decimal digit.

Defined results: a null text is the empty text without spans; null and repeated ``doc_id`` are rows
like any others; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from penprint.llm.common import saved, table

# The base patterns. "Letters there in either case" is the (?i) of the first.
KINDS = ["assign", "access", "hex"]
PATTERNS = {
    "assign": r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]{12,}",
    "hex": r"[0-9a-f]{32,}",
}
LEAST_VALUE = 8

SYMBOL = "[A-Za-z0-9+/_=-]"
TOKEN = rf"(?<!{SYMBOL})(?=[A-Za-z+/_=-]*+[0-9]|[A-Za-z0-9+/_=-]*?[a-z][A-Z]){SYMBOL}{{16,}}"
ALPHABETS = {
    16: "0123456789abcdef",
    32: "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    64: "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}
BANDS = [24, 32, 48, 64]
MAX_Z = 3.0
ORDINARY_COINCIDENCE, ORDINARY_TRIPLE = 0.06, 0.0048
ORDINARY_CHANGE = 0.05
FALSE_DISCOVERY_RATE = 0.001
BINS_PER_DECADE, LAST_BIN = 10, 400
SPAN = "array<struct<start:int,end:int,value:string>>"


def spans_of(text: Column, pattern: str) -> Column:
    """Places and values of all matches, leftmost first, in code points, end exclusive.

    Built-ins give matches without their places: the lengths of what lies between them, from
    splitting at the same pattern, supply those.
    """
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    pairs = F.arrays_zip(matches.alias("m"), gaps.alias("g"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

    def add(state: Column, pair: Column) -> Column:
        first = state["at"] + pair["g"]
        end = first + F.coalesce(F.length(pair["m"]), F.lit(0))
        span = F.struct(first.alias("start"), end.alias("end"), pair["m"].alias("value"))
        return F.struct(
            end.alias("at"), F.when(pair["m"].isNull(), state["out"]).otherwise(F.array_append(state["out"], span)).alias("out")
        )

    found = F.aggregate(pairs, start, add, lambda state: state["out"])
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(SPAN))


def find_spans(docs: DataFrame) -> DataFrame:
    """``__row, doc_id, __base, __tokens`` for rows of ``doc_id`` and ``text``, written once."""
    text = F.coalesce(F.col("text"), F.lit(""))
    out = docs.select("doc_id", text.alias("__text"))
    for kind in KINDS:
        spans = spans_of(F.col("__text"), PATTERNS[kind])
        if kind == "assign":
            spans = F.filter(
                spans, lambda s: F.length(F.regexp_extract(s["value"], PATTERNS["assign"], 2)) >= LEAST_VALUE
            )
        out = out.withColumn(f"__{kind}", spans)
    def placed(kind: str) -> Column:
        order = F.lit(KINDS.index(kind)).alias("kind")
        return F.transform(f"__{kind}", lambda s: F.struct(s["start"].alias("start"), order, s["end"].alias("end")))

    out = out.select(
        F.monotonically_increasing_id().alias("__row"),
        "doc_id",
        F.sort_array(F.concat(*[placed(kind) for kind in KINDS])).alias("__base"),
        *[F.size(f"__{kind}").cast("bigint").alias(f"n_{kind}") for kind in KINDS],
        spans_of(F.col("__text"), TOKEN).alias("__tokens"),
    )
    alone = F.filter(
        "__tokens",
        lambda t: ~F.exists("__base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])),
    )
    return saved(out.withColumn("__tokens", alone), "secret-spans")


def randomness(tokens: DataFrame) -> DataFrame:
    """Adds ``n, alphabet, chi_z, runs_z, serial_z, p_ordinary`` to rows with a ``value``."""
    body = F.rtrim(F.col("value"), F.lit("="))
    hexadecimal = body.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")
    base32 = body.rlike("^[A-Z2-7]+$")
    out = tokens.withColumn("__body", body).withColumn(
        "alphabet", F.when(hexadecimal, 16).when(base32, 32).otherwise(64)
    )
    normal = F.when(F.col("alphabet") == 16, F.lower("__body")).otherwise(F.translate("__body", "-_=", "+//"))
    letters = F.when(F.col("alphabet") == 16, ALPHABETS[16]).when(F.col("alphabet") == 32, ALPHABETS[32])
    out = out.withColumn("__body", normal).withColumn("__letters", letters.otherwise(ALPHABETS[64]))
    each = F.sequence(F.lit(1), F.greatest(F.length("__body"), F.lit(1)))
    char = lambda i: F.substr("__body", i, F.lit(1))
    out = out.withColumn("__x", F.transform(each, lambda i: F.position(char(i), F.col("__letters")) - F.lit(1)))
    out = out.withColumn(
        "__c",
        F.transform(
            each,
            lambda i: F.when(char(i).rlike("[a-z]"), 0).when(char(i).rlike("[A-Z]"), 1).when(char(i).rlike("[0-9]"), 2).otherwise(3),
        ),
    )
    n, k = F.size("__x").cast("double"), F.col("alphabet").cast("double")
    squares = F.aggregate(
        F.array_distinct("__x"),
        F.lit(0.0),
        lambda a, s: a + F.pow(F.size(F.filter("__x", lambda x: x == s)).cast("double"), F.lit(2.0)),
    )
    mean = F.aggregate("__x", F.lit(0.0), lambda a, x: a + x) / n
    out = out.select(
        "*", n.alias("n"), k.alias("k"), squares.alias("__squares"), mean.alias("__mean"),
        F.size(F.filter("__x", lambda x: x * 2 >= F.col("alphabet"))).cast("double").alias("__high"),
    )
    n, k = F.col("n"), F.col("k")
    neighbours = F.sequence(F.lit(1), F.greatest(F.size("__x") - 1, F.lit(1)))
    high = lambda x: x * 2 >= F.col("alphabet")
    at = lambda name, i: F.get(name, i)
    before = lambda name, i: F.get(name, i - F.lit(1))
    changes = lambda name, view: F.size(
        F.filter(neighbours, lambda i: view(at(name, i)) != view(before(name, i)))
    ).cast("double")
    products = F.aggregate(
        neighbours,
        F.lit(0.0),
        lambda a, i: a + F.coalesce((at("__x", i) - F.col("__mean")) * (before("__x", i) - F.col("__mean")), F.lit(0.0)),
    )
    spread = F.aggregate("__x", F.lit(0.0), lambda a, x: a + (x - F.col("__mean")) * (x - F.col("__mean")))
    out = out.select(
        "*",
        (changes("__x", high) + 1).alias("__runs"),
        changes("__c", lambda c: c).alias("__changes"),
        F.try_divide(products, spread).alias("__r"),
    )
    chi = F.col("__squares") * k / n - n
    low_n = n - F.col("__high")
    runs_mean = 2 * F.col("__high") * low_n / n + 1
    runs_sd = F.sqrt(F.greatest((runs_mean - 1) * (runs_mean - 2) / F.greatest(n - 1, F.lit(1.0)), F.lit(0.0)))
    # Ordinary text: how few pairs of equal symbols, and how many class changes, are still likely.
    pairs = n * (n - 1)
    c = F.lit(ORDINARY_COINCIDENCE)
    pairs_sd = F.sqrt(2 * pairs * (c - c * c) + 4 * pairs * (n - 2) * (F.lit(ORDINARY_TRIPLE) - c * c))
    pairs_z = (pairs * c - (F.col("__squares") - n)) / pairs_sd
    p_pairs = F.when(pairs_z > 0, 0.5 * F.exp(-pairs_z * pairs_z / 2)).otherwise(1.0)
    share = F.least(F.col("__changes") / F.greatest(n - 1, F.lit(1.0)), F.lit(1 - 1e-9))
    q = F.lit(ORDINARY_CHANGE)
    distance = share * F.log(share / q) + (1 - share) * F.log((1 - share) / (1 - q))
    p_changes = F.when(share > q, F.exp(-(n - 1) * distance)).otherwise(1.0)
    both = F.greatest(p_pairs * p_changes, F.lit(1e-300))
    return out.select(
        *tokens.columns,
        "n",
        "alphabet",
        ((chi - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n)).alias("chi_z"),
        F.try_divide(F.col("__runs") - runs_mean, runs_sd).alias("runs_z"),
        ((F.col("__r") + 1 / n) * F.sqrt(n)).alias("serial_z"),
        F.least(both * (1 - F.log(both)), F.lit(1.0)).alias("p_ordinary"),
    )


def random_tokens(tokens: DataFrame) -> DataFrame:
    """``__row, start, end`` of the tokens that pass the battery, with false discoveries controlled."""
    tested = randomness(tokens)
    like_random = (F.col("chi_z") <= MAX_Z) & (F.abs("runs_z") <= MAX_Z) & (F.abs("serial_z") <= MAX_Z)
    evidence = F.when(F.coalesce(like_random, F.lit(False)), -F.log10("p_ordinary")).otherwise(0.0)
    band = F.lit(0)
    for edge in BANDS:
        band = band + (F.col("n") >= edge).cast("int")
    tested = saved(
        tested.select(
            "__row",
            "start",
            "end",
            band.alias("band"),
            F.least(F.floor(evidence * BINS_PER_DECADE), F.lit(LAST_BIN)).cast("int").alias("bin"),
        ),
        "secret-tests",
    )
    down = Window.partitionBy("band").orderBy(F.desc("bin"))
    bins = tested.groupBy("band", "bin").agg(F.count(F.lit(1)).alias("m")).select(
        "band",
        "bin",
        F.sum("m").over(down).alias("rank"),
        F.sum("m").over(Window.partitionBy("band")).alias("all"),
    )
    found = F.pow(F.lit(10.0), -F.col("bin") / BINS_PER_DECADE) <= FALSE_DISCOVERY_RATE * F.col("rank") / F.col("all")
    cuts = bins.where(found & (F.col("bin") > 0)).groupBy("band").agg(F.min("bin").alias("cut"))
    # One row per length band at most, so the broadcast has a fixed size.
    return tested.join(F.broadcast(cuts), "band").where("bin >= cut").select("__row", "start", "end")


def scan_secrets(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, base counts, ``base`` and ``all`` spans as text."""
    found = find_spans(docs)
    tokens = found.select("__row", F.explode("__tokens").alias("t")).select("__row", "t.*")
    random = random_tokens(tokens).groupBy("__row").agg(
        F.collect_list(F.struct("start", F.lit(len(KINDS)).alias("kind"), "end")).alias("__random")
    )
    names = F.array(*[F.lit(k) for k in [*KINDS, "random"]])

    def listed(spans: Column) -> Column:
        return F.array_join(
            F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ","
        )

    kind = "array<struct<start:int,kind:int,end:int>>"
    every = F.sort_array(
        F.concat(F.col("__base").cast(kind), F.coalesce(F.col("__random").cast(kind), F.array().cast(kind)))
    )
    return found.join(random, "__row", "left").select(
        "doc_id",
        *[f"n_{kind}" for kind in KINDS],
        listed(F.col("__base")).alias("base"),
        listed(every).alias("spans"),
    )


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id", *[f"n_{kind}" for kind in KINDS], F.sha2("base", 256).alias("base_sha256"), "spans"
    )
