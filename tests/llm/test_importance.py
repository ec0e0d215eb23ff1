import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from penprint.llm import importance as im

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_features(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = WORD.findall(text)
    runs = words + [f"{a} {b}" for a, b in zip(words, words[1:])]
    return len(words), [zlib.crc32(f.encode()) % im.BUCKETS for f in runs]


def plain_resample(docs, target):
    s, t = Counter(), Counter()
    found = [(doc_id, *plain_features(text)) for doc_id, text in docs]
    for _, _, features in found:
        s.update(features)
    for text in target:
        t.update(plain_features(text)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + 10000) / ((s[b] + 1) * (all_t + 10000)))) for b in range(10000)]
    out = []
    for doc_id, words, features in found:
        h = int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in features) // len(features) if features else 0
        out.append([doc_id, len(features), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, words])
    drawn = [r for r in out if r[5] >= 20]
    drawn.sort(key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[2], r[1]))
    for rank, r in enumerate(drawn[: 25 * len(drawn) // 100], 1):
        r[4] = rank
    return sorted((tuple(r[:5]) for r in out), key=repr)


@pytest.mark.parametrize("window", [1, 7, 64, 4_000_000])
def test_portions_find_the_features_of_every_text(window, monkeypatch):
    monkeypatch.setattr(im, "WINDOW_BYTES", window)
    rng = random.Random(window)
    texts = ["", None, "one", "x" * 3000 + " y", "Ünï CODE-two 3four", " ", "end", "Start"]
    texts += ["".join(rng.choices("aB9 é-\n😀z", k=rng.randrange(40))) for _ in range(200)]
    words, features = Counter(), [Counter() for _ in texts]
    for p in im.portions(pa.array(texts).slice(1)):
        for doc in p.doc.tolist():
            words[doc + 1] += 1
        for number, bucket, doc in ((p.word, p.word_bucket, p.doc), (p.pair, p.pair_bucket, p.pair_doc)):
            for n, d in zip(number.tolist(), doc.tolist(), strict=True):
                features[d + 1][int(bucket[n])] += 1
    for i, text in enumerate(texts[1:], 1):
        n, want = plain_features(text)
        assert words[i] == n and features[i] == Counter(want), text


def test_crcs_of_all_lengths():
    rng = random.Random(3)
    entries = [rng.randbytes(n) for n in [*range(40), 511, 512, 513, 5000] for _ in range(7)]
    rng.shuffle(entries)
    array = pa.array(entries, pa.large_binary())
    assert im.crc32_of(array).tolist() == [zlib.crc32(e) for e in entries]
    assert im.crc32_of(array.slice(5, 9)).tolist() == [zlib.crc32(e) for e in entries[5:14]]
    assert len(im.crc32_of(pa.array([], pa.large_binary()))) == 0


def test_whole_result_on_awkward_rows(spark, edge_docs, edge_rows, monkeypatch):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(300)] + ["Ärger", "naïve", "x-y"]
    more = [(100 + i, " ".join(rng.choices(words, k=rng.randrange(10, 60)))) for i in range(300)]
    more += [(7000, more[0][1])] * 90  # one id with many equal rows
    target = [" ".join(rng.choices(words[:50], k=30)) for _ in range(20)] + [None, ""]
    docs = edge_docs.select("doc_id", "text", "kept", "start").union(
        spark.createDataFrame(more, "doc_id bigint, text string").select("*", F.lit(True), F.lit(1))
    ).withColumns({c: F.lit("x") for c in ("score", "rank", "tie", "weight", "bucket", "one", "__block")})
    goal = spark.createDataFrame([(t, "x") for t in target], "text string, bucket string")
    result = im.resample(docs.repartition(7), goal)
    got = sorted((tuple(r) for r in result.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr)
    want = plain_resample([(r[0], r[1]) for r in edge_rows] + more, target)
    assert [r[:4] for r in got] == [r[:4] for r in want]
    ranks = lambda rows: sorted((r[4], r[3], r[0]) for r in rows if r[4] is not None)
    assert ranks(got) == ranks(want)
    kept = im.draw(docs, goal)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r[0] for r in want if r[4] is not None}


def test_draw_leans_towards_the_target(spark):
    rng = random.Random(1)
    kinds = {"sea": [f"wave{i}" for i in range(200)], "land": [f"hill{i}" for i in range(200)]}
    rows = [(i, " ".join(rng.choices(kinds["sea" if i % 10 == 0 else "land"], k=40))) for i in range(2000)]
    goal = spark.createDataFrame([(" ".join(rng.choices(kinds["sea"], k=40)),) for _ in range(200)], "text string")
    drawn = im.draw(spark.createDataFrame(rows, "doc_id bigint, text string"), goal).collect()
    assert len(drawn) == 500
    assert sum(r.doc_id % 10 == 0 for r in drawn) >= 150  # of 200, against 50 by chance


def test_empty_tables(spark, no_docs):
    nothing = spark.createDataFrame([], "text string")
    assert im.resample(no_docs, nothing).collect() == []
    assert np.array_equal(im.gains(no_docs, nothing), np.zeros(im.BUCKETS))
    one = spark.createDataFrame([(1, " ".join("abcdefghijklmnopqrstuvwxyz"))], "doc_id bigint, text string")
    assert [r.rank for r in im.resample(one, nothing, percent=100).collect()] == [1]
