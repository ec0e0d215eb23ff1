import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from penprint.llm import bpe, token_files
from penprint.session import scratch_path


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary.load(bpe.tokenizer_path())


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.tokenizer_path())


def odd_texts():
    rng = random.Random(1)
    texts = [None, "", "a  <|endoftext|>  b<|endoftext|>", "<|endoftext|>", "x\x85   y's it'll I'D \n\n \t z  ", "\x1c\x1f a\x1c b ᠎ ​", " " * 500, "a" * 3000]
    ranges = [(32, 0x250), (0x300, 0x3000), (0x3000, 0xD800), (0xE000, 0x1F000), (0x10000, 0x20000)]
    return texts + ["".join(chr(rng.randrange(*rng.choice(ranges))) for _ in range(50)) for _ in range(200)]


def test_ids_and_texts_against_the_library(spark, edge_docs, edge_rows, vocabulary, library):
    texts = [(r[0], r[1]) for r in edge_rows] + [(100 + i, t) for i, t in enumerate(odd_texts())]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    ids = bpe.encode(docs.repartition(3), vocabulary)
    want = [(d, library.encode(t or "", add_special_tokens=False).ids) for d, t in texts]
    assert sorted(((r.doc_id, list(r.ids)) for r in ids.collect()), key=repr) == sorted(want, key=repr)
    back = [(d, library.decode(i, skip_special_tokens=False)) for d, i in want]
    assert sorted(map(tuple, bpe.decode(ids, vocabulary).collect()), key=repr) == sorted(back, key=repr)
    assert sorted(t or "" for _, t in texts) == sorted(t for _, t in back)


def test_empty_table_and_bytes_that_are_no_text(spark, no_docs, vocabulary):
    assert bpe.digests(bpe.encode(no_docs, vocabulary), vocabulary).count() == 0
    lone = spark.createDataFrame([("a", [222]), ("b", [])], "doc_id string, ids array<int>")
    assert {r.doc_id: r.text for r in bpe.decode(lone, vocabulary).collect()} == {"a": "�", "b": ""}


def test_words_are_encoded_once_each(vocabulary, monkeypatch):
    coder = bpe.WordCoder(vocabulary.text)
    first = coder.ids([" the", " dog", " the"]).to_pylist()
    monkeypatch.setattr(coder, "tokenizer", None)
    monkeypatch.setattr(coder, "known", dict(coder.known))
    assert first[0] == first[2] and set(coder.known) == {" the", " dog"}


def test_files_give_back_every_document(spark, edge_docs, edge_rows, no_docs, vocabulary, library):
    manifest = token_files.write_tokens(edge_docs, vocabulary, scratch_path(spark, "tokens"))
    found = token_files.read_tokens(manifest).collect()
    want = [(r[0], [*library.encode(r[1] or "", add_special_tokens=False).ids, 0]) for r in edge_rows]
    assert sorted(((r.doc_id, list(r.ids)) for r in found), key=repr) == sorted(want, key=repr)
    by_start = sorted(found, key=lambda r: r.start)
    assert [r.start for r in by_start] == np.cumsum([0] + [r.n_tokens for r in by_start[:-1]]).tolist()
    ids = [r.doc_id for r in by_start]
    assert ids == sorted(ids, key=lambda d: (d is not None, d))
    assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in found)
    only = token_files.read_tokens(manifest, only=[7, 4]).collect()
    assert sorted(r.doc_id for r in only) == [4, 4, 7]
    assert token_files.read_tokens(token_files.write_tokens(no_docs, vocabulary, scratch_path(spark, "none"))).count() == 0


def test_a_reader_unpacks_only_what_it_needs(tmp_path, monkeypatch):
    import zstandard

    monkeypatch.setattr(token_files, "FRAME_IDS", 100)
    writer = token_files.Writer(str(tmp_path / "x.zst"))
    docs = {i: np.arange(i, i + 37, dtype=np.int32) for i in range(40)}
    for i, ids in docs.items():
        writer.add(i, ids)
    writer.close()
    data = (tmp_path / "x.zst").read_bytes()
    reader = token_files.Reader(str(tmp_path / "x.zst"), len(data))
    assert len(reader.frames) == 21  # two documents a frame, and the index
    [(i, start, ids)] = list(reader.documents({17}))
    assert (i, start, reader.unpacked) == (17, 17 * 37, 1) and (ids == docs[17]).all()
    assert [(i, ids.tolist()) for i, _, ids in reader.documents()] == [(i, x.tolist()) for i, x in docs.items()]
    # Any zstandard reader can read it, passing over the skippable frames.
    whole = zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read()
    assert whole == np.concatenate(list(docs.values())).astype("<u4").tobytes()
    damaged = bytearray(data)
    damaged[int(reader.starts[3]) + 40] ^= 0xFF
    (tmp_path / "y.zst").write_bytes(damaged)
    broken = token_files.Reader(str(tmp_path / "y.zst"), len(data))
    assert len(list(broken.documents({0}))) == 1
    with pytest.raises((ValueError, zstandard.ZstdError)):
        list(broken.documents({6, 7}))


def test_texts_with_new_code_points_are_split_by_the_library(spark, vocabulary, library):
    text = "ab\U0001e4d0cd \U0001e4f5 xࡰy"  # letters and digits newer than Java's tables
    docs = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    assert bpe.worded(docs, []).select(F.col("odd").isNotNull()).first()[0]
    assert list(bpe.encode(docs, vocabulary).first().ids) == library.encode(text, add_special_tokens=False).ids
