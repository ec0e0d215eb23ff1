"""Texts of an Arrow batch as arrays of code points, so that a task counts them by numpy.

A regular expression of the JVM costs some hundred nanoseconds a character, a comparison of arrays about one. Which
characters make words is asked of the JVM once (``classes``), so that the arrays say the same as ``functions.text``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from penprint.functions import text as tx

# So many characters are looked at together, and at least one text.
CHUNK = 2_000_000
# Counted rows that a task holds before it sends them on.
HELD = 1_000_000
POINTS = 0x110000
OTHER, WORD, SPACE, STOP = 0, 1, 2, 3

_found: dict[str, bytes] = {}


def classes(spark: SparkSession) -> dict[str, bytes]:
    """Borders of the runs of word characters and of number characters among all code points, as the JVM has them."""
    if not _found:
        points = "".join(map(chr, [*range(0xD800), *range(0xE000, POINTS)]))
        for name, pattern in (("word", f"[^{tx.WORD_CLASS}]+"), ("number", r"\P{N}+")):
            kept = spark._jvm.java.util.regex.Pattern.compile(pattern).matcher(points).replaceAll("")
            member = np.zeros(POINTS + 1, np.int8)
            member[[ord(c) for c in kept]] = 1
            _found[name] = np.flatnonzero(np.diff(member, prepend=0)).astype(np.int32).tobytes()
    return dict(_found)


@lru_cache(maxsize=4)
def members(borders: bytes) -> np.ndarray:
    """One bool per code point."""
    flips = np.zeros(POINTS + 1, np.int8)
    flips[np.frombuffer(borders, np.int32)] = 1
    return (np.cumsum(flips[:POINTS]) & 1).astype(bool)


@lru_cache(maxsize=4)
def kinds_of(borders: bytes) -> np.ndarray:
    """One of ``OTHER, WORD, SPACE, STOP`` per code point."""
    table = members(borders).astype(np.uint8)
    table[[ord(c) for c in tx.SPACES]] = SPACE
    table[[ord(c) for c in ".!?"]] = STOP
    return table


def strings(column: pa.Array) -> list[str]:
    """The values of a string column, the empty text for null ones."""
    try:
        values = column.to_pylist()
    except UnicodeDecodeError:
        values = [v if v is None else v.decode("utf-8", "replace") for v in column.cast(pa.binary()).to_pylist()]
    return [v or "" for v in values]


def codes_of(text: str) -> np.ndarray:
    """Code points in the narrowest type that holds them."""
    if text.isascii():
        return np.frombuffer(text.encode("ascii"), np.uint8)
    wide = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    return wide.astype(np.uint16) if wide.max() < 1 << 16 else wide


def to_strings(codes: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Strings that lie end to end in ``codes``."""
    ends = np.concatenate([[0], np.cumsum(lengths)])
    if codes.dtype != np.uint8:
        width = 1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000)
        ends = np.concatenate([[0], np.cumsum(width)])[ends]
        data = codes.astype("<u4").tobytes().decode("utf-32-le").encode()
    else:
        data = codes.tobytes()
    return pa.LargeStringArray.from_buffers(len(lengths), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data))


class Chunk:
    """Some texts laid end to end, a NUL of class ``OTHER`` behind each."""

    def __init__(self, texts: Sequence[str], borders: bytes):
        self.texts = texts
        self.lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.codes = codes_of("\0".join(texts) + "\0")
        self.starts = np.concatenate([[0], np.cumsum(self.lengths + 1)[:-1]]) if len(texts) else np.empty(0, np.int64)
        self.ends = self.starts + self.lengths
        self.table = kinds_of(borders)
        self.kind = self.table[self.codes]

    def kind_of(self, character: str) -> int:
        return int(self.table[ord(character)])

    def runs(self, member: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where runs of true entries begin and end; none reaches over the end of a text."""
        edge = np.flatnonzero(np.diff(member.view(np.int8), prepend=0, append=0))
        return edge[::2], edge[1::2]

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        return self.runs(self.kind == WORD)

    def last_parts(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Where whole words of the patterns begin in runs of word characters.

        The JVM looks back by half a character: behind one above 0xFFFF it takes the rest of a run for a word.
        """
        if self.codes.dtype != np.uint32:
            return starts
        far = np.concatenate([[-1], np.flatnonzero(self.codes > 0xFFFF)])
        return np.maximum(starts, far[np.searchsorted(far, ends) - 1] + 1)

    def text_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, at, "right") - 1

    def per_text(self, at: np.ndarray) -> np.ndarray:
        """How many of the places, in ascending order, lie in each text."""
        return np.searchsorted(at, self.ends) - np.searchsorted(at, self.starts)

    def nonspace(self) -> np.ndarray:
        """Number of characters before each place that are no white space; the ends of texts count as such."""
        return np.concatenate([[0], np.cumsum(self.kind != SPACE)])

    def fragments(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Begin, end and text of the pieces between runs of stops, the blank and the last ones included."""
        begin, end = self.runs(self.kind == STOP)
        starts, ends = np.sort(np.concatenate([self.starts, end])), np.sort(np.concatenate([self.ends, begin]))
        return starts, ends, self.text_of(starts)


def ascii_lower(codes: np.ndarray) -> np.ndarray:
    """ASCII letters in lower case, all others as they are."""
    return np.where((codes >= 65) & (codes <= 90), codes + codes.dtype.type(32), codes)


def find(codes: np.ndarray, piece: str) -> np.ndarray:
    """Where a literal stands, overlaps included."""
    at = np.flatnonzero(codes[: max(len(codes) - len(piece) + 1, 0)] == ord(piece[0]))
    for k in range(1, len(piece)):
        at = at[codes[at + k] == ord(piece[k])]
    return at


def listed(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, terms: Sequence[str]) -> np.ndarray:
    """Which of the runs from ``starts`` to ``ends`` are one of the terms."""
    hit = np.zeros(len(starts), bool)
    sizes = ends - starts
    for size in sorted({len(t) for t in terms}):
        mine = np.flatnonzero(sizes == size)
        for term in (t for t in terms if len(t) == size):
            left = mine
            for k, c in enumerate(term):
                left = left[codes[starts[left] + k] == ord(c)]
            hit[left] = True
    return hit


def between(at: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """How many of the places, in ascending order, lie from ``begin`` to before ``end``."""
    return np.searchsorted(at, end) - np.searchsorted(at, begin)


def tally(keys: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys from 0 to ``most`` in ascending order, how often each comes, where first, and the order of places.

    Key and place share one integer where both fit, since plain integers are sorted several times faster.
    """
    n = len(keys)
    bits = max(n, 1).bit_length()
    if int(most).bit_length() + bits <= 63:
        both = np.sort(keys.astype(np.int64) << bits | np.arange(n))
        order, ordered = both & ((1 << bits) - 1), both >> bits
    else:
        order = np.argsort(keys, kind="stable")
        ordered = keys[order]
    at = np.flatnonzero(np.concatenate([[n > 0], ordered[1:] != ordered[:-1]])) if n else np.empty(0, np.int64)
    return ordered[at], np.diff(at, append=n), order[at], order


def numbered(keys: np.ndarray, most: int) -> tuple[np.ndarray, int]:
    """The keys as numbers from 0 without gaps, in the same order, and how many there are."""
    distinct, n, _, order = tally(keys, most)
    number = np.empty(len(keys), np.int64)
    number[order] = np.repeat(np.arange(len(distinct)), n)
    return number, len(distinct)


def chunks(batch: pa.RecordBatch, text: int) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Parts of a batch that hold about ``CHUNK`` characters, with their texts."""
    texts = strings(batch.column(text))
    at, held = 0, 0
    for i, t in enumerate(texts):
        if held and held + len(t) > CHUNK:
            yield batch.slice(at, i - at), texts[at:i]
            at, held = i, 0
        held += len(t) + 1
    if at < len(texts):
        yield batch.slice(at), texts[at:]


def mapped(df: DataFrame, text: str, schema: T.StructType, work: Callable[[pa.RecordBatch, list[str]], list | None]) -> DataFrame:
    """The columns that ``work`` makes of every part of the rows and its texts."""
    at, names = df.columns.index(text), schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in chunks(batch, at):
                yield pa.RecordBatch.from_arrays(_typed(work(part, texts), types()), names)

    def types() -> list[pa.DataType]:
        from pyspark.sql.pandas.types import to_arrow_type

        return [to_arrow_type(f.dataType) for f in schema.fields]

    return df.mapInArrow(run, schema)


def _typed(columns: list, types: list[pa.DataType]) -> list[pa.Array]:
    columns = [c if isinstance(c, pa.Array) else pa.array(c) for c in columns]
    return [c if c.type == t else c.cast(t) for c, t in zip(columns, types)]


def counted(
    df: DataFrame,
    text: str,
    schema: T.StructType,
    work: Callable[[pa.RecordBatch, list[str]], Iterator[list]],
    sums: Sequence[str] = ("n",),
    least: Sequence[str] = (),
    merge: bool = True,
) -> DataFrame:
    """Rows that ``work`` makes of the texts, those of equal keys merged as far as a task holds them together."""
    at, names = df.columns.index(text), schema.names
    keys = [n for n in names if n not in (*sums, *least)]

    def types() -> list[pa.DataType]:
        from pyspark.sql.pandas.types import to_arrow_type

        return [to_arrow_type(f.dataType) for f in schema.fields]

    def merged(held: list[pa.RecordBatch]) -> pa.Table:
        table = pa.Table.from_batches(held)
        grouped = table.group_by(keys).aggregate([*((s, "sum") for s in sums), *((s, "min") for s in least)])
        renamed = grouped.rename_columns([*keys, *sums, *least] if grouped.column_names[: len(keys)] == keys else [c.removesuffix("_sum").removesuffix("_min") for c in grouped.column_names])
        return renamed.select(names).cast(table.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, kinds = [], 0, types()
        for batch in batches:
            for part, texts in chunks(batch, at):
                for columns in work(part, texts):
                    made = pa.RecordBatch.from_arrays(_typed(columns, kinds), names)
                    if not merge:
                        yield from _pieces(made)
                        continue
                    held.append(made)
                    rows += len(made)
                if rows > HELD:
                    table = merged(held)
                    # What hardly shrinks is sent on, so that it is not merged again and again.
                    if len(table) > HELD // 2:
                        yield from table.to_batches(max_chunksize=100_000)
                        held, rows = [], 0
                    else:
                        held, rows = table.to_batches(), len(table)
        if rows:
            yield from merged(held).to_batches(max_chunksize=100_000)

    return df.mapInArrow(run, schema)


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(batch), 100_000):
        yield batch.slice(at, 100_000)


def grouped_by_author(part: pa.RecordBatch, texts: list[str], author: int, order: int | None = None) -> tuple[pa.RecordBatch, list[str], np.ndarray, pa.Array]:
    """The rows ordered by author (and by the column ``order``, nulls last), a number for each row's author, and the authors."""
    coded = part.column(author).dictionary_encode(null_encoding="encode")
    number = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    if order is None:
        return part, texts, number, coded.dictionary
    table = pa.table({"a": pa.array(number), "o": part.column(order), "i": pa.array(np.arange(len(number)))})
    by = table.sort_by([("a", "ascending"), ("o", "ascending"), ("i", "ascending")])["i"].to_numpy()
    return part.take(pa.array(by)), [texts[i] for i in by], number[by], coded.dictionary


def coded_words(chunk: Chunk, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """A number for every word, and the distinct words."""
    found = to_strings(chunk.codes[chunk.kind == WORD], ends - starts).dictionary_encode()
    return found.indices.to_numpy().astype(np.int64), found.dictionary


def taken(values: pa.Array, at: np.ndarray) -> pa.Array:
    return pc.take(values, pa.array(at))


def row_groups(by: Sequence[pa.Array], rows: int) -> tuple[np.ndarray, np.ndarray]:
    """A number for every row, equal where all columns are, and the first row of each number."""
    group, first = np.zeros(rows, dtype=np.int64), np.zeros(1, dtype=np.int64)
    for column in by:
        codes = column.dictionary_encode(null_encoding="encode")
        _, first, group = np.unique(group * (len(codes.dictionary) + 1) + codes.indices.to_numpy(), return_index=True, return_inverse=True)
    return group, first
