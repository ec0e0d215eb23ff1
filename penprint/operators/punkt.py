"""Sentence splitting that learns abbreviations from the corpus itself.

The method of Kiss and Strunk (Unsupervised Multilingual Sentence Boundary Detection, 2006). One pass over the
texts counts word types with what stands before them (``punkt_counts``); everything else is worked out on that
table, whose size is the vocabulary's: abbreviations (``is_abbr``), frequent sentence starters, collocations across
a period, and how types are written inside and at the start of sentences (``punkt_model``). ``punkt_sentences``
joins the model to the places where a period stands; texts move only to meet the places that are no ends.

``by`` names columns, for example a language, whose values are learned apart. Joins are plain equi-joins, so Spark
broadcasts the model only where it is small.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from penprint.functions import text as tx
from penprint.operators import scan as sc
from penprint.operators.scan import row_groups
from penprint.plans.keys import join_on
from penprint.session import stored

# Fixed values of the method: least scores of abbreviations, collocations and sentence starters, and the share of
# periods that an abbreviation is expected to carry.
ABBREVIATION, COLLOCATION, STARTER = 0.3, 7.88, 30.0
CERTAIN = 0.99
NUMBER = "##number##"
ALL = "__all"

PIECE = f"{tx.NON_SPACE}+{tx.SPACE}*"
LETTERS = r"\p{L}\p{N}"
TAIL = f"[^{LETTERS}.!?…]*$"
CLOSED = f"^[\"'”’»)\\]]*{tx.SPACE}*$"
MARKS = "[.!?…]+$"
IS_NUMBER = r"^\p{N}[\p{N}.,]*$"
INITIAL = r"^\p{L}$"
# Most pieces are a word and white space: nothing has to be cut off them.
PLAIN = f"^[{LETTERS}]+{tx.SPACE}*$"
STOPS = "[.!?…]"


def tokens_of(text: Column) -> Column:
    """Per white-space piece of a text: ``raw, typ, letter`` (u, l, o) and ``mark``.

    ``mark`` is ``.``, ``…`` or ``!`` where a sentence may end, ``,`` for a period before other punctuation.
    """
    return _tokens(F.regexp_extract_all(text, F.lit(PIECE), F.lit(0)))


def _tokens(pieces: Column) -> Column:
    """The tokens of an array of pieces; the tail is null where a piece is plain."""
    cut = F.transform(pieces, lambda p: F.struct(p.alias("raw"), F.when(~p.rlike(PLAIN), F.regexp_extract(p, TAIL, 0)).alias("tail")))
    cut = F.transform(
        cut,
        lambda x: F.struct(
            x["raw"].alias("raw"),
            x["tail"].alias("tail"),
            F.when(x["tail"].isNull(), tx.strip(x["raw"])).otherwise(F.substr(x["raw"], F.lit(1), F.length(x["raw"]) - F.length(x["tail"]))).alias("bare"),
        ),
    )
    cut = F.transform(
        cut,
        lambda x: F.struct(
            x["raw"].alias("raw"),
            F.when(x["tail"].isNull(), "").otherwise(F.regexp_extract(x["bare"], MARKS, 0)).alias("marks"),
            x["tail"].rlike(CLOSED).alias("closed"),
            F.when(x["tail"].isNull(), x["bare"])
            .otherwise(F.regexp_replace(F.regexp_replace(x["bare"], MARKS, ""), f"^[^{LETTERS}]+|[^{LETTERS}]+$", ""))
            .alias("word"),
        ),
    )

    def token(x: Column) -> Column:
        typ = F.when(x["word"].rlike(IS_NUMBER), NUMBER).otherwise(F.lower(x["word"]))
        letter = F.when(x["word"].rlike(r"^\p{Lu}"), "u").when(x["word"].rlike(r"^\p{Ll}"), "l").otherwise("o")
        mark = (
            F.when(x["marks"] == "", "")
            .when(~x["closed"], F.when(x["marks"] == ".", ",").otherwise(""))
            .when(x["marks"] == ".", ".")
            .when(x["marks"].rlike("[!?]"), "!")
            .otherwise("…")
        )
        return F.struct(x["raw"].alias("raw"), typ.alias("typ"), letter.alias("letter"), mark.alias("mark"))

    return F.transform(cut, token)


def _pieces(chunk: sc.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """Begin and end of the pieces between white space, whether a stop is in them, the distinct ones and their numbers."""
    inside = chunk.kind != sc.SPACE
    inside[chunk.ends] = False
    starts, ends = chunk.runs(inside)
    stops = np.flatnonzero((chunk.kind == sc.STOP) | (chunk.codes == ord("…")))
    found = sc.to_strings(chunk.codes[inside], ends - starts).dictionary_encode()
    return starts, ends, sc.between(stops, starts, ends) > 0, found.dictionary, found.indices.to_numpy().astype(np.int64)


def punkt_counts(df: DataFrame, text: str = "text", by: Sequence[str] = ()) -> DataFrame:
    """``by, before, context, typ, letter, mark, n``: word types with what stands before them.

    ``context`` is ``start`` (first of a text or after ``!``), ``mid``, ``.`` or ``…``; ``before`` is the type
    before a period or ellipsis, else empty. The counts are written once, since learning reads them several times.
    """
    # A token follows from its piece alone, so pieces are counted first, each with the one before if that may end a
    # sentence (null for none before, empty for any other), and every distinct pair is looked at once.
    borders = sc.classes(df.sparkSession)["word"]

    def work(part: pa.RecordBatch, texts: list[str]) -> Iterator[list]:
        chunk = sc.Chunk(texts, borders)
        starts, ends, stops, distinct, ids = _pieces(chunk)
        of = chunk.text_of(starts)
        group, first = row_groups(part.columns[:-1], len(texts))
        # The piece before by number, 0 for none, 1 for one that ends nothing.
        size = max(len(distinct), 1)
        last = np.where(np.append(False, of[1:] == of[:-1])[: len(of)], np.append(0, np.where(stops, ids + 2, 1)[:-1])[: len(of)], 0)
        keys, n, _, _ = sc.tally((group[of] * (size + 2) + last) * size + ids, len(first) * (size + 2) * size)
        last, row = keys // size % (size + 2), first[keys // size // (size + 2)]
        shown = pa.concat_arrays([pa.array([None, ""], distinct.type), distinct])
        yield [*(c.take(pa.array(row)) for c in part.columns[:-1]), sc.taken(shown, last), sc.taken(distinct, keys % size), n]

    whole = df.select(*by, F.coalesce(F.col(text), F.lit("")).alias("__whole"))
    schema = T.StructType([*whole.schema.fields[:-1], T.StructField("__last", T.StringType()), T.StructField("__raw", T.StringType()), T.StructField("__n", T.LongType())])
    pairs = sc.counted(whole, "__whole", schema, work, sums=["__n"]).groupBy(*by, "__last", "__raw").agg(F.sum("__n").alias("__n"))
    tokens = pairs.select(*by, "__n", F.col("__last").isNull().alias("__first"), _tokens(F.array(F.coalesce("__last", F.lit("")), "__raw")).alias("t"))

    before, x = F.get("t", F.lit(0)), F.get("t", F.lit(1))
    stop = before["mark"].isin(".", "…")
    context = F.when(F.col("__first") | (before["mark"] == "!"), "start").when(stop, before["mark"]).otherwise("mid")
    counted = [F.when(stop, before["typ"]).otherwise("").alias("before"), context.alias("context"), *[x[c].alias(c) for c in ("typ", "letter", "mark")]]
    rows = tokens.select(*by, *counted, "__n")
    return stored(rows.groupBy(*by, "before", "context", "typ", "letter", "mark").agg(F.sum("__n").alias("n")), "punkt-counts")


def _log_term(count: Column, share: Column) -> Column:
    """``count * ln(share)``, and 0 for nothing counted."""
    return F.when(count == 0, 0.0).otherwise(count * F.log(F.greatest(share, F.lit(1e-300))))


def _binomial(hits: Column, trials: Column, share: Column) -> Column:
    return _log_term(hits, share) + _log_term(trials - hits, 1 - share)


def abbreviation_score(typ: Column, with_period: Column, without: Column, periods: Column, total: Column) -> Column:
    """Dunning's ratio of "a period as often as anywhere" to "nearly always", scaled by the form of the type."""
    seen = with_period + without
    ratio = -2 * (_binomial(with_period, seen, periods / total) - _binomial(with_period, seen, F.lit(CERTAIN)))
    inner = F.length(typ) - F.length(F.replace(typ, F.lit("."), F.lit("")))
    letters = (F.length(typ) - inner).cast("double")
    return ratio * F.exp(-letters) * (inner + 1) * F.pow(letters, -without.cast("double"))


def association(first: Column, second: Column, both: Column, total: Column) -> Column:
    """Dunning's log-likelihood ratio of two events that came together ``both`` times."""
    rest, others = second - both, total - first
    apart = _binomial(both, first, second / total) + _binomial(rest, others, second / total)
    tied = _binomial(both, first, both / first) + _binomial(rest, others, rest / F.greatest(others, F.lit(1)))
    return -2 * (apart - tied)


def _total(condition: Column) -> Column:
    return F.sum(F.when(condition, F.col("n")).otherwise(0))


def _grouped(counts: DataFrame, by: Sequence[str]) -> tuple[DataFrame, Sequence[str]]:
    """One group for all texts where none are named."""
    return (counts, by) if by else (counts.withColumn(ALL, F.lit(0)), [ALL])


def punkt_types(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``by, typ, with_period, without, score, is_abbr`` and the totals ``periods, total``, a row per type."""
    period = F.col("mark").isin(".", ",")
    counts, by = _grouped(counts, by)
    totals = counts.groupBy(*by).agg(_total(period).alias("periods"), F.sum("n").alias("total"))
    types = counts.where("typ <> ''").groupBy(*by, "typ").agg(_total(period).alias("with_period"), _total(~period).alias("without"))
    types = join_on(types, totals, by)
    able = F.col("typ").rlike(r"\p{L}") & (F.col("typ") != NUMBER) & (F.col("with_period") > 0)
    score = F.when(able, abbreviation_score(F.col("typ"), F.col("with_period"), F.col("without"), F.col("periods"), F.col("total")))
    types = types.withColumn("score", score).withColumn("is_abbr", F.coalesce(F.col("score") >= ABBREVIATION, F.lit(False)))
    return types.drop(ALL)


def punkt_model(counts: DataFrame, by: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """What splitting needs: a row per type, and the collocations ``by, before, typ``.

    Types: ``is_abbr``; ``is_starter``; ``opens`` (written small somewhere and never large inside a sentence: a large
    letter starts one); ``small_start`` (starts sentences small and is never large); ``ever_small``.
    """
    counts, by = _grouped(counts, by)
    types = punkt_types(counts, by)
    types = types if ALL not in by else types.withColumn(ALL, F.lit(0))
    known = types.select(*by, F.col("typ").alias("before"), F.col("is_abbr").alias("abbr_before"))
    rows = join_on(counts, known, [*by, "before"], "left").withColumn("abbr_before", F.coalesce("abbr_before", F.lit(False)))
    broken = (F.col("context") == ".") & ~F.col("abbr_before")
    starts, inside = broken | (F.col("context") == "start"), F.col("context") == "mid"
    large, small = F.col("letter") == "u", F.col("letter") == "l"
    loose = (F.col("before") == NUMBER) | F.col("before").rlike(INITIAL)

    flags = rows.where("typ <> ''").groupBy(*by, "typ").agg(
        _total(large & inside).alias("large_inside"),
        _total(large).alias("large"),
        _total(small).alias("small"),
        _total(small & starts).alias("small_starts"),
        _total(broken & ~loose).alias("at_break"),
    )
    breaks = join_on(counts, types.select(*by, "typ", "is_abbr"), [*by, "typ"], "left")
    breaks = breaks.groupBy(*by).agg(_total((F.col("mark") == ".") & ~F.coalesce("is_abbr", F.lit(False))).alias("breaks"))
    words = join_on(types, flags, [*by, "typ"])
    words = join_on(words, breaks, by)
    seen, at_break = F.col("with_period") + F.col("without"), F.col("at_break")
    starter = (
        (at_break > 0)
        & (F.col("typ") != NUMBER)
        & (at_break * F.col("total") > seen * F.col("breaks"))
        & (association(F.col("breaks"), seen, at_break, F.col("total")) >= STARTER)
    )
    words = words.select(
        *by,
        "typ",
        "is_abbr",
        starter.alias("is_starter"),
        ((F.col("small") > 0) & (F.col("large_inside") == 0)).alias("opens"),
        ((F.col("small_starts") > 0) & (F.col("large") == 0)).alias("small_start"),
        (F.col("small") > 0).alias("ever_small"),
        seen.alias("seen"),
        "total",
    )

    pairs = rows.where((F.col("context") == ".") & (F.col("typ") != "") & (F.col("typ") != NUMBER) & (F.col("abbr_before") | loose))
    pairs = pairs.groupBy(*by, "before", "typ").agg(F.sum("n").alias("both")).where("both > 1")
    pairs = join_on(pairs, words.select(*by, F.col("typ").alias("before"), F.col("seen").alias("first")), [*by, "before"])
    pairs = join_on(pairs, words.where(~F.col("is_starter")).select(*by, "typ", F.col("seen").alias("second"), "total"), [*by, "typ"])
    tied = (F.col("both") * F.col("total") > F.col("first") * F.col("second")) & (
        association(F.col("first"), F.col("second"), F.col("both"), F.col("total")) >= COLLOCATION
    )
    return words.drop("seen", "total", ALL), pairs.where(tied).select(*by, "before", "typ").drop(ALL)


def _no_end(places: DataFrame, words: DataFrame, collocations: DataFrame, by: Sequence[str]) -> DataFrame:
    """The places where a period or ellipsis ends no sentence.

    ``places``: ``typ`` and ``mark`` of the token, ``after`` and ``letter`` of the next one.
    """
    first = words.select(*by, "typ", "is_abbr")
    second = words.select(*by, F.col("typ").alias("after"), "is_starter", "opens", "small_start", "ever_small")
    tied = collocations.select(*by, F.col("before").alias("typ"), F.col("typ").alias("after"), F.lit(True).alias("tied"))
    rows = join_on(join_on(join_on(places, first, [*by, "typ"], "left"), second, [*by, "after"], "left"), tied, [*by, "typ", "after"], "left")
    known = lambda c: F.coalesce(F.col(c), F.lit(False))
    large, small = F.col("letter") == "u", F.col("letter") == "l"
    starts = large & known("opens")
    stays = small & ~known("small_start")
    initial = (F.col("mark") == ".") & F.col("typ").rlike(INITIAL)
    number = (F.col("mark") == ".") & (F.col("typ") == NUMBER)
    abbr = (F.col("mark") == ".") & known("is_abbr")
    unsure_name = ~starts & large & ~known("ever_small")
    ends = (
        F.when(known("tied") & (F.col("mark") == "."), False)
        .when((abbr | (F.col("mark") == "…")) & ~initial, starts | (large & known("is_starter")))
        .when((initial | number) & stays, False)
        .when(initial & unsure_name, False)
        .otherwise(starts | ~abbr)
    )
    return rows.where(~ends)


def punkt_sentences(
    df: DataFrame, words: DataFrame, collocations: DataFrame, keys: Sequence[str], text: str = "text", by: Sequence[str] = ()
) -> DataFrame:
    """One row per sentence: ``keys``, ``sent_id`` from 0 and ``sentence`` with its closing marks.

    ``words, collocations`` come from ``punkt_model``, learned on these or other texts; types it has not seen are
    no abbreviations. Rows of equal keys may hold different texts.
    """
    keys = [*dict.fromkeys([*by, *keys])]
    borders = sc.classes(df.sparkSession)["word"]
    whole = df.select(*keys, F.xxhash64(text).alias("__text"), F.coalesce(F.col(text), F.lit("")).alias("__whole"))
    names = [*keys, "__text"]

    # Only pieces with a stop in them can end a sentence; they go with the piece behind.
    def marked(part: pa.RecordBatch, texts: list[str]) -> Iterator[list]:
        chunk = sc.Chunk(texts, borders)
        starts, _, stops, distinct, ids = _pieces(chunk)
        of, at = chunk.text_of(starts), np.flatnonzero(stops)
        follows = np.append(of[1:] == of[:-1], False)[: len(of)]
        after = pa.array(np.append(ids[1:], 0)[: len(ids)][at], mask=~follows[at])
        place = at - np.searchsorted(starts, chunk.starts)[of[at]]
        yield [*(c.take(pa.array(of[at])) for c in part.columns[:-1]), place, sc.taken(distinct, ids[at]), distinct.take(after)]

    fields = [T.StructField("at", T.IntegerType()), T.StructField("__raw", T.StringType()), T.StructField("__after", T.StringType())]
    rows = sc.counted(whole, "__whole", T.StructType([*(whole.schema[n] for n in names), *fields]), marked, sums=[], merge=False)
    rows = rows.select(*names, "at", F.col("__after").isNotNull().alias("__more"), _tokens(F.array("__raw", F.coalesce("__after", F.lit("")))).alias("t"))
    here, after = F.get("t", F.lit(0)), F.get("t", F.lit(1))
    rows = rows.select(*names, "at", "__more", here["typ"].alias("typ"), here["mark"].alias("mark"), after["typ"].alias("after"), after["letter"].alias("letter"))
    rows = stored(rows.where(F.col("mark").isin(".", "…", "!")), "punkt-marks")
    places = rows.where(F.col("mark").isin(".", "…") & F.col("__more")).drop("__more")
    open_ends = _no_end(places, words, collocations, by).select(*names, "at").distinct()
    ends = join_on(rows.select(*names, "at"), open_ends, [*names, "at"], "left_anti").groupBy(*names).agg(F.collect_set("at").alias("ends"))
    # Texts move only to meet the places where their sentences end.
    met = join_on(whole, ends, names, "left").drop("__text")

    def cut(part: pa.RecordBatch, texts: list[str]) -> Iterator[list]:
        chunk = sc.Chunk(texts, borders)
        starts, ends, *_ = _pieces(chunk)
        first = np.searchsorted(starts, chunk.starts)
        till = np.append(first[1:], len(starts))
        lists = part.column(len(keys) + 1)
        of = np.repeat(np.arange(len(texts)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy())
        # The last piece ends the last sentence.
        filled = np.flatnonzero(till > first)
        last = np.unique(np.concatenate([first[of] + lists.flatten().to_numpy(), till[filled] - 1]))
        of = chunk.text_of(starts[last])
        fresh = np.append(True, of[1:] != of[:-1])[: len(of)]
        begin = starts[np.where(fresh, first[of], np.append(0, last[:-1] + 1)[: len(last)])] - chunk.starts[of]
        end = ends[last] - chunk.starts[of]
        sentences = [texts[i][b:e] for i, b, e in zip(of.tolist(), begin.tolist(), end.tolist())]
        yield [*(c.take(pa.array(of)) for c in part.columns[: len(keys)]), np.arange(len(of)) - np.searchsorted(of, of), pa.array(sentences, pa.string())]

    schema = T.StructType([*(whole.schema[k] for k in keys), T.StructField("sent_id", T.IntegerType()), T.StructField("sentence", T.StringType())])
    return sc.counted(met.select(*keys, "__whole", "ends"), "__whole", schema, cut, sums=[], merge=False)
