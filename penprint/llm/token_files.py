"""Token ids in seekable compressed files: independent zstandard frames and a trailing seek table.

Layout of a file: data frames, one after the other, each with the ids of whole documents as
little-endian unsigned 32-bit integers; one skippable frame with the index of documents; one
skippable frame with the seek table of zstandard's seekable format, whose entries hold the compressed
size, the size and the low 32 bits of the xxh64 of each data frame. Any zstandard reader
can read the data; a reader that wants some documents reads the tables and unpacks only their frames.

Files hold documents in ascending ``doc_id`` order, and so do their numbers. Tasks write each file under
a name of its own; the manifest lists those of successful tasks.

Defined results: a null text is the empty text, which is the end id alone; null ids come first; rows
that repeat an id are kept, in the order of a hash of their text; an empty table gives an empty
manifest; other columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from penprint.llm.bpe import Vocabulary, bounded_batches, chunks_of, offsets_of, tokenizer_path, worded
from penprint.llm.common import saved, table
from penprint.llm.files import Output, read_range
from penprint.session import scratch_path

END_ID = 0
FRAME_IDS = 65_536
FILE_BYTES = 64_000_000
# Fixed values of the format.
SKIPPABLE, SEEK_MAGIC = 0x184D2A5E, 0x8F92EAB1
CHECKSUMS = 0x80
ENTRY, FOOTER = struct.Struct("<III"), struct.Struct("<IBI")
INDEX = np.dtype([("doc_id", "<i8"), ("known", "<u1"), ("frame", "<u4"), ("first", "<u4"), ("length", "<u4")])
MANIFEST = "part int, file int, path string, documents bigint, ids bigint, bytes bigint"


class Writer:
    """Writes one file; documents come in order."""

    def __init__(self, path: str):
        self.out = Output(path)
        self.packer = zstandard.ZstdCompressor(level=3)
        self.frames: list[tuple[int, int, int]] = []
        self.index: list[tuple[int, int, int, int, int]] = []
        self.open: list[np.ndarray] = []
        self.filled = self.ids = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        if self.filled and self.filled + len(ids) > FRAME_IDS:
            self._end_frame()
        self.index.append((doc_id or 0, doc_id is not None, len(self.frames), self.filled, len(ids)))
        self.open.append(ids)
        self.filled += len(ids)
        self.ids += len(ids)

    def _end_frame(self) -> None:
        data = np.concatenate(self.open).astype("<u4").tobytes()
        packed = self.packer.compress(data)
        self.out.write(packed)
        self.frames.append((len(packed), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))
        self.open, self.filled = [], 0

    def close(self) -> None:
        if self.open:
            self._end_frame()
        index = self.packer.compress(np.array(self.index, INDEX).tobytes())
        self.out.write(struct.pack("<II", SKIPPABLE, len(index)) + index)
        entries = b"".join(ENTRY.pack(*f) for f in [*self.frames, (len(index) + 8, 0, 0)])
        self.out.write(struct.pack("<II", SKIPPABLE, len(entries) + FOOTER.size) + entries)
        self.out.write(FOOTER.pack(len(self.frames) + 1, CHECKSUMS, SEEK_MAGIC))
        self.out.close()


class Reader:
    """Reads documents of one file; unpacks only the frames that hold them."""

    def __init__(self, path: str, size: int):
        self.path = path
        frames, flags, magic = FOOTER.unpack(read_range(path, size - FOOTER.size, FOOTER.size))
        if magic != SEEK_MAGIC or not flags & CHECKSUMS:
            raise ValueError(f"{path}: no seek table with checksums")
        entries = read_range(path, size - FOOTER.size - frames * ENTRY.size, frames * ENTRY.size)
        self.frames = [ENTRY.unpack_from(entries, i * ENTRY.size) for i in range(frames)]
        self.starts = np.concatenate([[0], np.cumsum([f[0] for f in self.frames], dtype=np.int64)])
        packed = read_range(path, int(self.starts[-2]) + 8, self.frames[-1][0] - 8)
        self.index = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), INDEX)
        self.unpacked = 0

    def frame(self, i: int) -> np.ndarray:
        packed_size, size, check = self.frames[i]
        data = zstandard.ZstdDecompressor().decompress(read_range(self.path, int(self.starts[i]), packed_size), max_output_size=size)
        if len(data) != size or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != check:
            raise ValueError(f"{self.path}: frame {i} is damaged")
        self.unpacked += 1
        return np.frombuffer(data, "<u4")

    def documents(self, wanted: set | None = None) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """Id, place of the first token in the file, and tokens; all documents or those wanted."""
        before = np.concatenate([[0], np.cumsum(self.index["length"], dtype=np.int64)])
        held, ids = -1, None
        for i, row in enumerate(self.index):
            doc_id = int(row["doc_id"]) if row["known"] else None
            if wanted is None or doc_id in wanted:
                if held != row["frame"]:
                    held, ids = int(row["frame"]), self.frame(int(row["frame"]))
                yield doc_id, int(before[i]), ids[row["first"] : row["first"] + row["length"]]


def write_tokens(docs: DataFrame, vocabulary: Vocabulary, folder: str) -> DataFrame:
    """Encodes ``doc_id, text`` rows, writes files below ``folder`` and returns their manifest."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64("text").alias("tie"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("tie")]
    ordered = worded(rows.repartitionByRange(*order).sortWithinPartitions(*order), vocabulary.specials)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, written, writer = shared.value.encoder(), TaskContext.get().partitionId(), [], None

        def finish() -> None:
            writer.close()
            written.append((part, len(written), writer.out.path, len(writer.index), writer.ids, writer.out.size))

        for batch in batches:
            for rows, words in chunks_of(batch, coder.words(batch, shared.value.specials)):
                ids = coder.texts(words)
                offsets, flat = offsets_of(ids), ids.flatten().to_numpy()
                flat = np.insert(flat, offsets[1:], END_ID)
                offsets = (offsets + np.arange(len(offsets))).tolist()
                for i, doc_id in enumerate(rows.column("doc_id").to_pylist()):
                    if writer is None:
                        writer = Writer(f"{folder}/part-{part:06d}-{len(written):04d}-{uuid.uuid4().hex}.zst")
                    writer.add(doc_id, flat[offsets[i] : offsets[i + 1]])
                    if writer.out.size >= FILE_BYTES:
                        finish()
                        writer = None
        if writer is not None:
            finish()
        types = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        columns = list(zip(*written, strict=True)) or [()] * len(types)
        names = [f.split()[0] for f in MANIFEST.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return saved(ordered.mapInArrow(work, MANIFEST), "token-manifest")


def read_tokens(manifest: DataFrame, only: list[int] | None = None, with_ids: bool = True) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32, ids`` from the files of a manifest.

    ``start`` counts the ids of all documents before. ``only`` names documents; the others' frames are not
    unpacked. One row per file, not per document, passes through the window that adds up starts.
    """
    earlier = Window.orderBy("part", "file").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.withColumn("base", F.coalesce(F.sum("ids").over(earlier), F.lit(0)))
    wanted = None if only is None else set(only)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, size, base in zip(*(batch.column(c).to_pylist() for c in ("path", "bytes", "base")), strict=True):
                rows = []
                for doc_id, start, ids in Reader(path, size).documents(wanted):
                    rows.append((doc_id, base + start, len(ids), zlib.crc32(ids.tobytes()), ids.view(np.int32) if with_ids else None))
                    if len(rows) == 1000:
                        yield _batch(rows)
                        rows = []
                if rows:
                    yield _batch(rows)

    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint, ids array<int>"
    return files.select("path", "bytes", "base").repartition(max(1, manifest.count()), "path").mapInArrow(work, schema)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64()] * 4 + [pa.list_(pa.int32())]
    names = ["doc_id", "start", "n_tokens", "ids_crc32", "ids"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    manifest = write_tokens(docs, Vocabulary.load(tokenizer_path()), scratch_path(spark, "tokens"))
    return read_tokens(manifest, with_ids=False).drop("ids")
