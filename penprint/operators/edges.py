"""The edges of texts: what is needed to join an author's texts without gathering them."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from penprint import lexicons as lx
from penprint.functions import text as tx
from penprint.operators import scan as sc
from penprint.plans.keys import running_totals
from penprint.session import scratch_path

AUXILIARIES = ["was", "were", "been", "being"]
# Items kept at either end of a text: one less than the longest n-gram of the profile.
WORD_REACH, CHAR_REACH = 2, 3
TOTALS = {"word_offset": "word_size", "char_offset": "char_size", "stop_offset": "stops", "text_offset": "real_text", "inner_offset": "inner"}
# Columns that only n-grams over seams read.
GRAMS = ("word_size", "char_size", "word_first", "word_last", "char_first", "char_last")


_FLAGS = ("real", "conj", "sub", "conj_any", "sub_any", "pause")
_END = T.StructType([
    T.StructField("will", T.BooleanType()), T.StructField("dash", T.IntegerType()), T.StructField("passive", T.BooleanType()),
    T.StructField("near", T.StringType()),
])
_EDGES = [
    *(T.StructField(n, T.IntegerType()) for n in ("word_size", "char_size", "stops", "real_text", "inner")),
    *(T.StructField(n, T.ArrayType(T.StringType())) for n in ("word_first", "word_last", "char_first", "char_last")),
    # What a sentence fragment adds to its sentence; the number counts the stops before it.
    T.StructField("fragments", T.ArrayType(T.StructType([
        T.StructField("number", T.LongType()), T.StructField("n", T.LongType()), *(T.StructField(n, T.IntegerType()) for n in _FLAGS)
    ]))),
    T.StructField("closing", _END),
    T.StructField("opening", _END),
]


def text_edges(df: DataFrame, author: str = "author", seq: str = "seq", text: str = "text") -> DataFrame:
    """One narrow row per text: sizes, first and last items, first and last sentence fragment. A null text is an empty one."""
    borders = sc.classes(df.sparkSession)["word"]

    def work(part: pa.RecordBatch, texts: list[str]) -> list:
        low = sc.strings(part.column(3))
        chunk, small = sc.Chunk(texts, borders), sc.Chunk(low, borders)
        return [part.column(0), part.column(1), *_word_edges(small), *_fragments(chunk, borders), *_ends(chunk, low)]

    both = df.select(author, seq, text, F.lower(F.col(text)).alias("__low"))
    # The order in which the columns are made.
    made = [*GRAMS, "stops", "real_text", "inner", "fragments", "closing", "opening"]
    fields = {f.name: f for f in _EDGES}
    schema = T.StructType([df.schema[author], df.schema[seq], *(fields[n] for n in made)])
    return sc.mapped(both, text, schema, work).select(author, seq, *fields)


def _word_edges(low: sc.Chunk) -> list:
    """Numbers of words and of characters that are no white space, and the first and last of them."""
    starts, ends = low.words()
    first, till = np.searchsorted(starts, low.starts), np.searchsorted(starts, low.ends)
    kept = low.kind != sc.SPACE
    kept[low.ends] = False
    places = np.flatnonzero(kept)
    begin, end = np.searchsorted(places, low.starts), np.searchsorted(places, low.ends)
    columns = [[], [], [], []]
    for t, at, a, b, c, d in zip(low.texts, low.starts.tolist(), first.tolist(), till.tolist(), begin.tolist(), end.tolist()):
        opening = [t[i - at : j - at] for i, j in zip(starts[a : min(a + WORD_REACH, b)].tolist(), ends[a : min(a + WORD_REACH, b)].tolist())]
        closing = [t[i - at : j - at] for i, j in zip(starts[max(a, b - WORD_REACH) : b].tolist(), ends[max(a, b - WORD_REACH) : b].tolist())]
        columns[0].append([" ".join(opening[:k]) for k in range(1, WORD_REACH + 1)])
        columns[1].append([" ".join(closing[-k:]) for k in range(1, WORD_REACH + 1)])
        head, tail = ("".join(t[i - at] for i in places[x:y].tolist()) for x, y in ((c, min(c + CHAR_REACH, d)), (max(c, d - CHAR_REACH), d)))
        columns[2].append([head[:k] for k in range(1, CHAR_REACH + 1)])
        columns[3].append([tail[-k:] for k in range(1, CHAR_REACH + 1)])
    return [till - first, end - begin, *columns]


def _fragments(chunk: sc.Chunk, borders: bytes) -> list:
    """Numbers of stops, whether more than white space is there, sentences wholly within the text, outer fragments."""
    from penprint.operators.counters import sentence_marks

    begin, end, of = chunk.fragments()
    first = np.searchsorted(of, np.arange(len(chunk.texts)))
    last = np.searchsorted(of, np.arange(len(chunk.texts)), "right") - 1
    nonspace = chunk.nonspace()
    real = np.concatenate([[0], np.cumsum(nonspace[end] > nonspace[begin])])
    inner = np.where(last - first > 1, real[last] - real[np.minimum(first + 1, last)], 0)
    outer = np.unique(np.concatenate([first, last]))
    number, of = outer - first[of[outer]], of[outer]
    at = chunk.starts[of]
    cuts = zip(of.tolist(), (begin[outer] - at).tolist(), (end[outer] - at).tolist())
    pieces = sc.Chunk([chunk.texts[i][b:e] for i, b, e in cuts], borders)
    whole, n, conj, sub, pause = sentence_marks(pieces, pieces.starts, pieces.ends, False)
    _, _, conj_any, sub_any, _ = sentence_marks(pieces, pieces.starts, pieces.ends, True)
    names = ["number", "n", *_FLAGS]
    values = [number, n, *(x.astype(np.int32) for x in (whole, conj, sub, conj_any, sub_any, pause))]
    rows = pa.StructArray.from_arrays([pa.array(v) for v in values], names)
    offsets = np.concatenate([[0], np.cumsum(1 + (last > first))]).astype(np.int32)
    return [last - first, (nonspace[chunk.ends] > nonspace[chunk.starts]), inner, pa.ListArray.from_arrays(pa.array(offsets), rows)]


def _ends(chunk: sc.Chunk, low: list[str]) -> list:
    """What the closing and the opening of a text add to patterns over a seam."""
    width = max(len(m) for m in lx.POLITENESS if " " in m)
    reach = max(map(len, AUXILIARIES)) + 1
    starts, ends = chunk.words()
    nonspace = chunk.nonspace()
    # The first word of a text with nothing but white space before it.
    first = np.minimum(np.searchsorted(starts, chunk.starts), max(len(starts) - 1, 0))
    led = (starts[first] < chunk.ends) & (starts[first] >= chunk.starts) & (nonspace[starts[first]] == nonspace[chunk.starts]) if len(starts) else np.zeros(len(chunk.texts), bool)
    closing, opening = [], []
    for i, (t, x) in enumerate(zip(chunk.texts, low)):
        tail = t.rstrip(tx.SPACES)[-reach:]
        passive, plain = False, "".join(c.lower() if c.isascii() else c for c in tail)
        for word in AUXILIARIES:
            if plain.endswith(word):
                before = tail[: -len(word)][-1:]
                # Behind a character above 0xFFFF the patterns begin a word.
                passive |= not before or ord(before) > 0xFFFF or not chunk.kind_of(before) == sc.WORD
        dash = f"{t} ".count(" - ") - t.count(" - ") if t.endswith(" -") else 0
        closing.append({"will": x.endswith("will"), "dash": dash, "passive": passive, "near": x[-width:]})
        word = t[int(starts[first[i]] - chunk.starts[i]) : int(ends[first[i]] - chunk.starts[i])] if led[i] else ""
        dash = f" {t}".count(" - ") - t.count(" - ") if t.startswith("- ") else 0
        opening.append({"will": False, "dash": dash, "passive": len(word) > 2 and word.endswith("ed"), "near": x[:width]})
    return [pa.array(closing, _ARROW_END), pa.array(opening, _ARROW_END)]


_ARROW_END = pa.struct([("will", pa.bool_()), ("dash", pa.int32()), ("passive", pa.bool_()), ("near", pa.string())])


def place_edges(edges: DataFrame, author: str = "author", seq: str = "seq") -> DataFrame:
    """Add how many words, characters, stops and non-blank texts of the author come before."""
    return running_totals(edges, author, seq, {new: value for new, value in TOTALS.items() if value in edges.columns})


def stored_edges(
    df: DataFrame, author: str = "author", seq: str = "seq", text: str = "text", without: Sequence[str] = ()
) -> DataFrame:
    """Placed edges read back from the shared folder, less the columns named by ``without``.

    The narrow rows are written once, so that their several uses, and a lost executor, do not read
    and split the texts again.
    """
    path = scratch_path(df.sparkSession, "edges")
    text_edges(df, author, seq, text).drop(*without).write.parquet(path)
    return place_edges(df.sparkSession.read.parquet(path), author, seq)
