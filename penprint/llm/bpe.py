"""Byte-pair encoding and decoding through a table of distinct words.

Encoding: built-in expressions split texts into the tokenizer's words. Each Arrow batch becomes a chunk:
its texts as numbers into the chunk's own word list. The words of all chunks are shuffled by a hash
of the word, each distinct word is encoded once, and its ids go back to the chunks that hold it, where
they are joined to the texts by position. Only words and word numbers are shuffled, never a row per
occurrence, so that a word as frequent as a third of all words moves once per chunk.

Decoding: ids are joined to the table of pieces by position and the bytes are joined up.

A chunk is named by its content. Both branches read the input, so it must come from files or another
stable source; if the branches see different chunks the job ends with an error, never with other ids.

Defined results: a null text is the empty text, without ids; null or repeated ``doc_id`` are rows like any
others; a special token written in a text is that token, as in the library; an empty table gives an
empty table; other columns are ignored. Texts with code points that Java's character tables lack are
split by the library's own splitter instead.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import chain, repeat
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from penprint.llm.common import table

# Fixed value: the word pattern of byte-level tokenizers, with white space spelled for Java.
WORD = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{IsWhite_Space}\p{L}\p{N}]+"
    r"|\p{IsWhite_Space}+(?!\P{IsWhite_Space})|\p{IsWhite_Space}+"
)
# A task forgets its words when it knows this many; a forgotten word is encoded again.
KNOWN_WORDS = 1_200_000
# The library's encodings are large objects, so words go through it in portions. Words of a space and letters go
# as texts of so many, each with a line end behind it; the library cuts them there.
PORTION, TOGETHER = 2_000, 50
SPACED_LETTERS = r"^ \p{L}+$"
# A chunk is a run of whole texts of at most this many words, or a single longer text.
CHUNK_WORDS = 1_500_000
BATCH_BYTES = 24_000_000


def words_of(text: Column, specials: list[str]) -> Column:
    """The words of a text in order. Special tokens are words, and cut the text before words are sought."""
    plain = lambda t: F.regexp_extract_all(t, F.lit(WORD), F.lit(0))
    if not specials:
        return plain(text)
    any_special = "|".join(re.sub(r"([^\w\s])", r"\\\1", s) for s in sorted(specials, key=len, reverse=True))
    found = F.regexp_extract_all(text, F.lit(any_special), F.lit(0))
    between = F.split(text, any_special, -1)
    mixed = F.flatten(
        F.transform(
            F.arrays_zip(between.alias("t"), found.alias("s")),
            lambda x: F.concat(plain(x["t"]), F.when(x["s"].isNull(), F.array().cast("array<string>")).otherwise(F.array(x["s"]))),
        )
    )
    return F.when(text.rlike(any_special), mixed).otherwise(plain(text))


def worded(docs: DataFrame, specials: list[str]) -> DataFrame:
    """``doc_id, words, odd``: the words of every text, or the text itself where Java may split it wrongly."""
    body = F.coalesce(F.col("text"), F.lit(""))
    odd = body.rlike(r"\p{Cn}")
    return docs.select(
        "doc_id",
        F.when(~odd, words_of(body, specials)).alias("words"),
        F.when(odd, body).alias("odd"),
    )


class Vocabulary:
    """What tasks need of a tokenizer file."""

    def __init__(self, text: str):
        self.text = text
        data = json.loads(text)
        self.specials = [t["content"] for t in data.get("added_tokens", [])]
        kind = data.get("pre_tokenizer") or {}
        if kind.get("type") != "ByteLevel" or kind.get("add_prefix_space") or not kind.get("use_regex") or data.get("normalizer"):
            raise ValueError("a byte-level tokenizer without prefix space and normalizer is needed")

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        return cls(Path(path).read_text(encoding="utf-8"))

    def encoder(self) -> WordCoder:
        return _coder(self.text)

    def pieces(self) -> pa.Array:
        return _pieces(self.text)


@cache
def _coder(text: str) -> WordCoder:
    return WordCoder(text)


@cache
def _pieces(text: str) -> pa.Array:
    """Bytes of every id. Byte-level pieces write each byte as one printable character."""
    data = json.loads(text)
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    code = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(printable)))}
    tokens = {i: bytes(code[c] for c in t) for t, i in data["model"]["vocab"].items()}
    tokens |= {t["id"]: t["content"].encode() for t in data.get("added_tokens", [])}
    return pa.array([tokens.get(i, b"") for i in range(max(tokens) + 1)], pa.large_binary())


def _lists(lengths: list[np.ndarray], flat: list[np.ndarray]) -> pa.LargeListArray:
    offsets = np.cumsum(np.concatenate([[0], *lengths])).astype(np.int64)
    return pa.LargeListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.empty(0, np.int32), *flat]), pa.int32()))


class WordCoder:
    """Ids of words, each distinct word encoded once while it is known."""

    def __init__(self, text: str):
        self.tokenizer = Tokenizer.from_str(text)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.line_end = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.known_ids = _lists([], [])

    def ids(self, words: list[str]) -> pa.LargeListArray:
        """Ids of every word; ``words`` are distinct or few. Only unknown ones are encoded, the rest is one lookup."""
        if len(self.known) > KNOWN_WORDS:
            self.forget()
        get = self.known.get
        places = np.fromiter(map(get, words, repeat(-1)), np.int64, len(words))
        unknown = np.flatnonzero(places < 0).tolist()
        if unknown:
            new = list(dict.fromkeys(words[i] for i in unknown))
            self.known_ids = pa.concat_arrays([self.known_ids, self._encoded(pa.array(new, pa.large_string()))])
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
            places[unknown] = [get(words[i]) for i in unknown]
        return self.known_ids.take(pa.array(places))

    def _encoded(self, words: pa.Array) -> pa.LargeListArray:
        """Ids of distinct words by the library."""
        together = pc.match_substring_regex(words, SPACED_LETTERS) if len(self.line_end) == 1 else pa.array([False] * len(words))
        plain, rest = (np.flatnonzero(x.to_numpy(zero_copy_only=False)) for x in (together, pc.invert(together)))
        lengths, flat = [], []
        listed = words.take(pa.array(plain)).to_pylist()
        for at in range(0, len(listed), PORTION):
            groups = [listed[i : i + TOGETHER] for i in range(at, min(at + PORTION, len(listed)), TOGETHER)]
            codes = self.tokenizer.encode_batch_fast(["\n".join(g) + "\n" for g in groups], add_special_tokens=False)
            for group, code in zip(groups, codes, strict=True):
                ids = np.array(code.ids, np.int32)
                ends = np.flatnonzero(ids == self.line_end[0])
                if len(ends) == len(group):
                    lengths.append(np.diff(ends, prepend=-1) - 1)
                    flat.append(ids[ids != self.line_end[0]])
                else:  # the library's letters are others
                    self._one_by_one(group, lengths, flat)
        self._one_by_one(words.take(pa.array(rest)).to_pylist(), lengths, flat)
        back = np.empty(len(words), np.int64)
        back[np.concatenate([plain, rest])] = np.arange(len(words))
        return _lists(lengths, flat).take(pa.array(back))

    def _one_by_one(self, words: list[str], lengths: list, flat: list) -> None:
        for at in range(0, len(words), PORTION):
            codes = [c.ids for c in self.tokenizer.encode_batch_fast(words[at : at + PORTION], add_special_tokens=False)]
            lengths.append(np.fromiter(map(len, codes), np.int64, len(codes)))
            flat.append(np.fromiter(chain.from_iterable(codes), np.int32))

    def words(self, batch: pa.RecordBatch, specials: list[str]) -> pa.ListArray:
        """The word lists of rows from ``worded``, with odd texts split here."""
        words, odd = batch.column("words"), batch.column("odd")
        if odd.null_count == len(odd):
            return words
        lists = words.to_pylist()
        for i, text in enumerate(odd.to_pylist()):
            if text is not None:
                lists[i] = self.split(text, specials)
        return pa.array(lists, pa.list_(pa.string()))

    def split(self, text: str, specials: list[str]) -> list[str]:
        cut = re.split("(" + "|".join(map(re.escape, specials)) + ")", text) if specials else [text]
        out = []
        for i, part in enumerate(cut):
            places = [] if i % 2 else self.tokenizer.pre_tokenizer.pre_tokenize_str(part)
            out += [part] if i % 2 else [part[a:b] for _, (a, b) in places]
        return out

    def texts(self, words: pa.ListArray) -> pa.LargeListArray:
        """Ids of texts that are given as lists of words."""
        numbers = words.flatten().dictionary_encode()
        return joined(offsets_of(words), numbers.indices, self.ids(numbers.dictionary.to_pylist()))


def chunks_of(batch: pa.RecordBatch, words: pa.ListArray) -> Iterator[tuple[pa.RecordBatch, pa.ListArray]]:
    """Runs of rows of at most ``CHUNK_WORDS`` words, or single rows."""
    ends, first = offsets_of(words), 0
    while first < len(words):
        last = int(np.searchsorted(ends, ends[first] + CHUNK_WORDS, side="right")) - 1
        last = max(last, first + 1)
        yield batch.slice(first, last - first), words.slice(first, last - first)
        first = last


def offsets_of(lists: pa.ListArray) -> np.ndarray:
    offsets = lists.offsets.to_numpy()
    return (offsets - offsets[0]).astype(np.int64)


def joined(offsets: np.ndarray, numbers: pa.Array, ids: pa.LargeListArray) -> pa.LargeListArray:
    """Replace word numbers by the word's ids, text by text."""
    taken = ids.take(numbers)
    inner = taken.offsets.to_numpy()
    inner = inner - inner[0]
    return pa.LargeListArray.from_arrays(pa.array(inner[offsets]), taken.flatten())


def _packed(numbers: np.ndarray) -> bytes:
    """Word numbers as byte planes: frequent words have small numbers, so the upper planes are mostly zero."""
    planes = numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(planes).tobytes())


def _unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1)


def _chunk(batch: pa.RecordBatch, words: pa.ListArray) -> tuple[int, np.ndarray, np.ndarray, pa.Array]:
    """Name, text offsets, word numbers and word list (frequent words first) of a chunk."""
    coded = words.flatten().dictionary_encode()
    numbers, vocabulary = coded.indices.to_numpy(), coded.dictionary
    order = np.argsort(-np.bincount(numbers, minlength=len(vocabulary)), kind="stable")
    place = np.empty(len(order), np.uint32)
    place[order] = np.arange(len(order), dtype=np.uint32)
    numbers = place[numbers] if len(order) else np.empty(0, np.uint32)
    offsets = offsets_of(words)
    listed = vocabulary.take(pa.array(order))
    name = xxhash.xxh3_64()
    for part in (numbers.tobytes(), offsets.tobytes(), repr(batch.column("doc_id").to_pylist()).encode()):
        name.update(part)
    name.update(b"".join(bytes(b) for b in listed.buffers()[1:] if b))
    return name.intdigest() - 2**63, offsets, numbers, listed


def bounded_batches(spark: SparkSession) -> None:
    """Word lists are wide rows: lets a batch that goes to Python hold ``BATCH_BYTES`` at most."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(re.sub(r"\D", "", spark.conf.get(name, "67108864"))) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def _zipped(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(data)


def _unzipped(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def encode(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``doc_id, ids`` for rows of ``doc_id`` and ``text``."""
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(vocabulary)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = worded(docs, vocabulary.specials)
    kind = docs.schema["doc_id"].dataType.simpleString()
    id_type = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
    # Texts of a chunk: ids of documents, offsets, word numbers, their order by bucket, bucket sizes.
    # Words of a chunk in a bucket: lengths and bytes. Answers to them: lengths and ids.
    names = ["chunk", "bucket", "doc_ids", "a", "b", "order", "sizes"]
    types = [pa.int64(), pa.int32(), pa.list_(id_type), *[pa.binary()] * 4]
    schema = f"chunk bigint, bucket int, doc_ids array<{kind}>, a binary, b binary, order binary, sizes binary"

    def batch_of(*columns) -> pa.RecordBatch:
        pa.default_memory_pool().release_unused()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        coder = shared.value.encoder()
        for batch in batches:
            for part, words in chunks_of(batch, coder.words(batch, shared.value.specials)):
                name, offsets, numbers, listed = _chunk(part, words)
                bucket = np.fromiter((zlib.crc32(w.encode()) % buckets for w in listed.to_pylist()), np.int64, len(listed))
                # Words of a bucket in alphabetical order, which packs well.
                sorted_words = pc.sort_indices(listed).to_numpy().astype(np.int64)
                order = sorted_words[np.argsort(bucket[sorted_words], kind="stable")]
                yield part, name, offsets, numbers, listed, order, np.bincount(bucket, minlength=buckets)

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, name, offsets, numbers, _, order, sizes in chunks(batches):
            yield batch_of(
                [name], [None], [part.column("doc_id").to_pylist()], [offsets.tobytes()], [_packed(numbers)], [_packed(order)], [_packed(sizes)]
            )

    def packets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, name, _, _, listed, order, sizes in chunks(batches):
            words = [w.encode() for w in listed.take(pa.array(order)).to_pylist()]
            ends = np.cumsum(sizes)
            used = np.flatnonzero(sizes)
            cut = [words[ends[b] - sizes[b] : ends[b]] for b in used]
            lengths = [_packed(np.fromiter(map(len, c), np.int64, len(c))) for c in cut]
            yield batch_of(
                [name] * len(used), used, [None] * len(used), lengths, [_zipped(b"".join(c)) for c in cut], [None] * len(used), [None] * len(used)
            )

    def word_table(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = shared.value.encoder()
        coder.forget()  # other tasks' words are not met here
        wide = "<u2" if len(shared.value.pieces()) <= 65536 else "<u4"
        for batch in batches:
            for row in batch.to_pylist():
                ends = np.cumsum(_unpacked(row["a"]).astype(np.int64))
                data = _unzipped(row["b"])
                words = [data[x:y].decode() for x, y in zip([0, *ends[:-1]], ends, strict=True)]
                ids = coder.ids(words)
                codes = ids.flatten().to_numpy().astype(wide).tobytes()
                yield batch_of(
                    [row["chunk"]], [row["bucket"]], [None], [_packed(np.diff(ids.offsets.to_numpy()))], [_zipped(codes)], [None], [None]
                )

    def joined_back(part: pa.Table) -> pa.Table:
        wide = "<u2" if len(shared.value.pieces()) <= 65536 else "<u4"
        answers, texts_of, same_texts = {}, None, 0
        for row in part.to_pylist():
            if row["bucket"] is None:
                texts_of, same_texts = row, same_texts + 1
            else:  # equal chunks have equal names and equal answers
                answers[row["bucket"]] = row
        if texts_of is None:
            raise RuntimeError("the input changed between two readings: words without their texts")
        sizes = _unpacked(texts_of["sizes"])
        if sorted(answers) != np.flatnonzero(sizes).tolist():
            raise RuntimeError("the input changed between two readings: texts without their words")
        found = [answers[b] for b in sorted(answers)]
        lengths = np.concatenate([np.empty(0, np.int64), *(_unpacked(r["a"]).astype(np.int64) for r in found)])
        flat = np.concatenate([np.empty(0, np.int32), *(np.frombuffer(_unzipped(r["b"]), wide).astype(np.int32) for r in found)])
        order = _unpacked(texts_of["order"])
        place = np.empty(len(order), np.uint32)
        place[order] = np.arange(len(order), dtype=np.uint32)
        table_of_words = pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)])), pa.array(flat))
        offsets = np.frombuffer(texts_of["a"], np.int64)
        out = joined(offsets, pa.array(place[_unpacked(texts_of["b"])]), table_of_words)
        one = pa.table({"doc_id": pa.array(texts_of["doc_ids"], id_type), "ids": out.cast(pa.list_(pa.int32()))})
        return pa.concat_tables([one] * same_texts)

    coded = rows.mapInArrow(texts, schema)
    dealt = rows.mapInArrow(packets, schema).repartition(buckets, "bucket")
    answers = dealt.mapInArrow(word_table, schema)
    return coded.union(answers).groupBy("chunk").applyInArrow(joined_back, f"doc_id {kind}, ids array<int>")


def decoded_bytes(ids: pa.ListArray, pieces: pa.Array) -> Iterator[bytes]:
    """The bytes of every list of ids: ids joined to their pieces by position."""
    offsets = offsets_of(ids)
    taken = pieces.take(ids.flatten())
    if not len(taken):
        yield from (b"" for _ in range(len(ids)))
        return
    ends = np.frombuffer(taken.buffers()[1], np.int64)[taken.offset : taken.offset + len(taken) + 1]
    data = memoryview(taken.buffers()[2] or b"")
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        yield bytes(data[ends[a] : ends[b]])


def decode(rows: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``doc_id, text`` for rows of ``doc_id`` and ``ids``; bytes that are no UTF-8 become U+FFFD."""
    shared = rows.sparkSession.sparkContext.broadcast(vocabulary)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [b.decode("utf-8", "replace") for b in decoded_bytes(batch.column("ids"), shared.value.pieces())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(work, f"doc_id {kind}, text string")


def digests(rows: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` for rows of ``doc_id`` and ``ids``."""
    shared = rows.sparkSession.sparkContext.broadcast(vocabulary)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            offsets, flat = offsets_of(ids), ids.flatten().to_numpy().astype("<u4")
            shas = [hashlib.sha256(flat[a:b].tobytes()).hexdigest() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            texts = [
                hashlib.sha256(b.decode("utf-8", "replace").encode()).hexdigest()
                for b in decoded_bytes(ids, shared.value.pieces())
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(offsets)), pa.array(shas), pa.array(texts)],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    schema = f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return rows.select("doc_id", "ids").mapInArrow(work, schema)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = Vocabulary.load(tokenizer_path())
    return digests(encode(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary), vocabulary)
