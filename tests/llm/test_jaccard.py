import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from penprint.llm import jaccard_join as jj
from penprint.llm import near_dedup

WORDS = [f"word{i}" for i in range(4000)]


def plain_set(text, size):
    words = "".join(c.lower() if c.isascii() else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def plain_join(rows, size, percent):
    sets = [plain_set(text, size) for _, text in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = 0
    for a, b in combinations(range(len(rows)), 2):
        if sets[a] and sets[b]:
            both = len(sets[a] & sets[b])
            if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                links += sets[a] != sets[b]
                root[max(find(a), find(b))] = min(find(a), find(b))
    low = {}
    for i, (doc_id, _) in enumerate(rows):
        known = low.get(find(i))
        low[find(i)] = doc_id if known is None else known if doc_id is None else min(known, doc_id)
    out = [(rows[i][0], len(sets[i]), low[find(i)] if sets[i] else rows[i][0]) for i in range(len(rows))]
    return sorted(out, key=repr), links


def changed(rng, words, n):
    words = list(words)
    for _ in range(n):
        at = rng.randrange(len(words))
        kind = rng.randrange(3)
        words[at : at + (kind != 0)] = [rng.choice(WORDS)] if kind != 2 or len(words) == 1 else []
    return words


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(12)
    passage = rng.choices(WORDS, k=60)
    rows = []
    add = lambda words: rows.append((len(rows) * 3 % 1009, " ".join(words)))
    for _ in range(60):
        base = rng.choices(WORDS, k=rng.choice((3, 8, 20, 60, 200)))
        for n in (0, 0, 1, 2, 3, 5):
            add(changed(rng, base, n))
    walk = rng.choices(WORDS, k=80)
    for _ in range(40):  # a chain whose ends are far apart
        walk = changed(rng, walk, 1)
        add(walk)
    hot = rng.choices(WORDS, k=120)
    for _ in range(60):  # near copies on both sides of the threshold, by two to eight edits
        add(changed(rng, hot, rng.randrange(2, 9)))
    for _ in range(80):  # a passage that many unlike documents share
        at = rng.randrange(1, 20)
        own = rng.choices(WORDS, k=30)
        add(own[:at] + passage + own[at:])
    return rows


@pytest.mark.parametrize(("size", "percent"), [(3, 90), (2, 70), (1, 95)])
def test_all_links_between_all_rows(spark, corpus, edge_docs, edge_rows, size, percent, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK_ROWS", 16)  # many blocks
    more = spark.createDataFrame(corpus, "doc_id bigint, text string")
    docs = edge_docs.select("doc_id", "text", "class", "key").union(more.select("*", F.lit("c"), F.lit("k")))
    docs = docs.withColumns({c: F.lit(1) for c in ("center", "token", "n", "at", "id", "root", "node", "low")})
    got = sorted((tuple(r) for r in jj.jaccard_join(docs.repartition(6), size, percent).collect()), key=repr)
    want, links = plain_join([(r[0], r[1]) for r in edge_rows] + corpus, size, percent)
    assert links > 100
    assert got == want


def test_links_are_links_and_span(spark, corpus):
    docs = spark.createDataFrame(corpus, "doc_id bigint, text string")
    links, roots, rows = jj.jaccard_classes(docs)
    text_of = dict(corpus)
    member = {r["class"]: r.id for r in rows.where("n > 0").collect()}
    for a, b in links.collect():
        x, y = (plain_set(text_of[member[c]], 3) for c in (a, b))
        assert 100 * len(x & y) >= 90 * len(x | y)
    assert roots.count() == len({c for pair in links.collect() for c in pair})


def test_prefixes_of_similar_sets_meet_under_every_order():
    rng = np.random.default_rng(4)
    places = [rng.permutation(1 << bits).astype(np.uint32) for bits, _ in jj.ORDERS]
    for percent in (60, 85, 90, 100):
        for _ in range(300):
            n = int(rng.integers(1, 200))
            union = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
            n = len(union)
            shared = -(-percent * n // 100)
            left = int(rng.integers(0, n - shared + 1))
            a, b = union[: shared + left], np.concatenate([union[:shared], union[shared + left :]])
            for p, q in zip(jj.prefixes(np.sort(a), places, percent), jj.prefixes(np.sort(b), places, percent), strict=True):
                assert len(np.intersect1d(p, q))


def test_sets_of_fitting_sizes_lie_in_neighbouring_bands():
    for percent in (50, 67, 85, 90, 99, 100):
        edges = jj.size_edges(percent)
        for n in [*range(1, 300), 12_345, 2_000_000]:
            largest = n * 100 // percent
            first, last = np.searchsorted(edges, [n, largest], "right")
            assert last - first <= 1, (percent, n)


def test_other_orders_thin_out_candidates(spark):
    """Unlike documents that share a short passage may meet under one order, and seldom under all."""
    rng = random.Random(6)
    passages = [rng.choices(WORDS, k=8) for _ in range(20)]
    rows = [(i, " ".join(rng.choices(WORDS, k=40) + passages[i % 20] + rng.choices(WORDS, k=40))) for i in range(300)]
    rows += [(1000 + i, " ".join(changed(rng, rows[i][1].split(), 1))) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    mixed = np.random.default_rng(1)  # orders that know nothing of counts
    places = [mixed.permutation(1 << bits).astype(np.uint32) for bits, _ in jj.ORDERS]
    classes = jj._sketches(docs, places, 3, 90).where("n > 0").dropDuplicates(["class"]).persist()
    tokens = classes.select("class", F.explode("prefix0").alias("token"))
    pairs = tokens.alias("a").join(tokens.alias("b"), "token").where("a.class < b.class")
    tested = pairs.select(F.col("a.class").alias("center"), F.col("b.class").alias("class")).distinct().persist()
    met = {tuple(r) for r in jj.candidates(tested, classes, 90).collect()}
    assert 90 <= len(met) < 0.5 * tested.count()
    sets = {r["class"]: plain_set(dict(rows)[r.id], 3) for r in classes.collect()}
    for a, b in combinations(sorted(sets), 2):
        if 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]):
            assert (a, b) in met


def test_crowded_shingles_come_last(spark):
    rng = random.Random(2)
    texts = [" ".join(["every", "text", "says", "this"] + rng.choices(WORDS, k=30)) for _ in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    places = jj.crowds(docs, 3)
    common = near_dedup.shingle_set("every text says", 3)
    for place, (bits, mixer) in zip(places, jj.ORDERS, strict=True):
        assert sorted(place) == list(range(1 << bits))
        assert place[jj._cells(jj._mixed(common, mixer), bits)[0]] >= len(place) - 2
    for text in texts[:20]:
        for prefix in jj.prefixes(near_dedup.shingle_set(text, 3), places, 90):
            assert common.astype(np.uint32).view(np.int32)[0] not in prefix


def test_similar_sets_share_several_shingles_of_the_first_prefix():
    rng = np.random.default_rng(9)
    places = [rng.permutation(1 << bits).astype(np.uint32) for bits, _ in jj.ORDERS]
    for percent in (50, 85, 90, 100):
        for _ in range(300):
            union = np.unique(rng.integers(0, 2**63, int(rng.integers(1, 200)), dtype=np.uint64))
            if rng.random() < 0.3:  # shingles that agree in 32 bits are still two
                union = np.unique(np.concatenate([union, union ^ np.uint64(1 << 50)]))
            union = rng.permutation(union)
            shared = -(-percent * len(union) // 100)
            left = int(rng.integers(0, len(union) - shared + 1))
            a, b = union[: shared + left], np.concatenate([union[:shared], union[shared + left :]])
            p, q = (jj.prefixes(np.sort(x), places, percent)[0] for x in (a, b))
            both = sum(min((p == t).sum(), (q == t).sum()) for t in np.intersect1d(p, q))
            assert both >= min(jj.MEETINGS, shared)


@pytest.mark.parametrize("percent", [50, 90])
def test_pairs_that_meet_by_one_shingle_go_no_further(spark, percent, monkeypatch):
    rng = random.Random(8)
    rows = []
    for i in range(200):  # pairs that share three words and no more
        words = rng.choices(WORDS, k=3)
        for k in range(2):
            own = [f"own{i}x{k}x{j}" for j in range(9)]
            rows.append((len(rows), " ".join(own[:4] + words + own[4:])))
    rows += [(1000 + i, " ".join(changed(rng, rows[i][1].split(), 1))) for i in range(0, 40, 2)]
    rows += [(2000 + i, " ".join([*rows[i][1].split(), "more"])) for i in range(0, 40, 2)]
    mixed = np.random.default_rng(3)  # orders that know nothing of counts, so the shared words stand anywhere
    places = [mixed.permutation(1 << bits).astype(np.uint32) for bits, _ in jj.ORDERS]
    monkeypatch.setattr(jj, "crowds", lambda docs, size: places)
    reached = []
    candidates = jj.candidates
    monkeypatch.setattr(jj, "candidates", lambda tested, *rest: reached.append(tested.count()) or candidates(tested, *rest))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted((tuple(r) for r in jj.jaccard_join(docs, 3, percent).collect()), key=repr)
    assert got == plain_join(rows, 3, percent)[0]
    assert 20 <= reached[0] <= 60


def test_sieve_keeps_every_wanted_class(spark):
    rows = spark.range(-500, 500).select(F.xxhash64("id").alias("class"), F.array("id").alias("list"))
    wanted = rows.select("class").where("pmod(class, 7) = 0")
    want = {r["class"] for r in wanted.collect()}
    got = {r["class"] for r in jj.sifted(rows, wanted).collect()}
    assert want <= got and len(got) < len(want) + 20
    assert jj.sifted(rows, wanted.where("false")).count() == 0


def test_empty_table(spark, no_docs):
    assert jj.jaccard_join(no_docs).collect() == []
