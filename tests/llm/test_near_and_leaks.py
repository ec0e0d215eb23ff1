import random

from penprint.llm import components, decontaminate, near_dedup


def shingles(text, size):
    words = (text or "").encode().lower().split()
    if len(words) < size:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1))


def brute(rows, size, percent):
    """component id of each id, for unique ids."""
    sets = {d: shingles(t, size) for d, t in rows}
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            shared = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * shared >= percent * (len(sets[a]) + len(sets[b]) - shared):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: find(d) for d in ids}


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
    return " ".join(words)


def test_near_duplicates_against_brute_force(spark):
    """Copies, edits around the threshold, chains of edits, short texts; some groups without a center."""
    rng = random.Random(3)
    rows = []
    for _ in range(6):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([12, 60, 200]))]
        rows += [" ".join(base)] * 2 + [edited(rng, base, rng.randrange(0, 6)) for _ in range(25)]
        step = base
        for _ in range(8):
            step = edited(rng, step, 1).split()
            rows.append(" ".join(step))
    rows += ["", "  ", "one", "One", "one two", "A b", "a B"]
    rows = list(enumerate(rows))
    for size, percent in ((3, 85), (5, 80)):
        got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), size, percent).collect()
        want = brute(rows, size, percent)
        assert {r.doc_id: r.component_id for r in got} == want
        assert all(r.kept == (r.doc_id == r.component_id) for r in got)
        assert all(r.n_shingles == len(shingles(dict(rows)[r.doc_id], size)) for r in got)


def test_the_buckets_meet_every_pair_that_the_threshold_needs(spark):
    """Signatures that differ in 27 slots, the most that 0.80 asks for, in 23 for 0.85; some spread evenly."""
    assert near_dedup.chunks(85) == 12 and near_dedup.chunks(80) == 14
    rng = random.Random(2)
    for percent, most in ((85, 23), (80, 27)):
        rows = []
        for i in range(200):
            sig = bytes(rng.randrange(256) for _ in range(64))
            slots = rng.sample(range(64), most) if i % 2 else [round((k + rng.random()) * 64 / most - 0.5) % 64 for k in range(most)]
            other = bytes(b ^ 1 if k in slots else b for k, b in enumerate(sig))
            rows += [(i, 0, sig), (i, 1, other)]
        keys = near_dedup._keys(percent).alias("keys")
        both = spark.createDataFrame(rows, "pair int, side int, sig binary").select("pair", "side", keys).collect()
        found = {}
        for r in both:
            found.setdefault(r.pair, []).append(set(r["keys"]))
        assert all(a & b for a, b in found.values())


def test_a_group_without_a_center_is_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK_ROWS", 7)
    rng = random.Random(8)
    base = [f"w{i}" for i in range(60)]
    rows = list(enumerate(edited(rng, base, rng.randrange(1, 6)) for _ in range(120)))
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), 3, 85).collect()
    assert {r.doc_id: r.component_id for r in got} == brute(rows, 3, 85)


def test_near_duplicate_edges(spark, edge_docs, no_docs):
    got = near_dedup.near_duplicates(edge_docs, 3, 85).collect()
    kept = sorted((repr(r.doc_id), r.n_shingles > 0, repr(r.component_id), r.kept) for r in got)
    assert len(kept) == edge_docs.count()
    assert sum(1 for r in got if r.component_id == 4 and r.kept) == 2  # the repeated row with the lowest id
    assert [r.component_id for r in got if r.doc_id is None and r.n_shingles] == [4]
    out = near_dedup.keep_one(edge_docs)
    assert out.columns == edge_docs.columns and not [r for r in out.collect() if r.doc_id == 5]
    assert near_dedup.keep_one(no_docs).count() == 0


def test_components_of_a_long_path(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1002), (1001, 1002), (5, 5)]
    found = components.components(spark.createDataFrame(edges, "a bigint, b bigint"))
    got = {r.node: r.root for r in found.collect()}
    assert got == {i: 0 for i in range(201)} | {1000: 1000, 1001: 1000, 1002: 1000}


ITEMS = [
    (0, "The capital of the northern province lies by a wide and slow river, and its old bridge has nine arches of grey stone."),
    (1, "Add seventeen to the number of apples in the basket, then divide what you get by the number of children at the table."),
    (2, "two words"),
    (3, None),
]


def test_leaks_of_items_whole_changed_and_partial(spark, edge_docs, no_docs):
    filler = " ".join(f"filler{i}" for i in range(40))
    item = ITEMS[0][1]
    rows = [
        (0, f"{filler} {item} {filler}"),
        (1, f"{filler}. {item.upper().replace(',', ' ;')}"),
        (2, f"{filler} {' '.join(item.split()[:9])} {filler}"),
        (3, f"{item} {ITEMS[1][1]}"),
        (4, filler),
        (5, "Two WORDS!"),
        (6, f"{filler} two words {filler}"),
        (7, f"{filler} {item.replace('stone', 'rock')}"),
        (None, item),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    bench = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    found = {(r.doc_id, r.item_id): r for r in decontaminate.find_leaks(docs, bench).collect()}
    assert set(found) == {(0, 0), (1, 0), (3, 0), (3, 1), (5, 2), (7, 0), (None, 0)}
    assert found[0, 0].first_word == 40 and found[0, 0].similarity == 1.0 and found[0, 0].n_words == 23
    assert 0.8 <= found[7, 0].similarity < 1
    assert {r.doc_id for r in decontaminate.decontaminate(docs, bench).collect()} == {2, 4, 6}
    assert decontaminate.decontaminate(edge_docs, bench).columns == edge_docs.columns
    assert decontaminate.decontaminate(edge_docs, bench.limit(0)).count() == edge_docs.count()
    assert decontaminate.decontaminate(no_docs, bench).count() == 0


def test_the_index_holds_every_print_within_the_radius(spark):
    rng = random.Random(1)
    prints = [rng.getrandbits(64) - 2**63 for _ in range(50)]
    moved = []
    for p in prints:
        for bits in range(decontaminate.RADIUS + 1):
            q = p & (2**64 - 1)
            for b in rng.sample(range(64), bits):
                q ^= 1 << b
            moved.append((p, q - 2**64 if q >= 2**63 else q))
    left = spark.createDataFrame(moved, "home bigint, __print bigint").select("home", "__print")
    from pyspark.sql import functions as F

    probes = left.select("home", F.col("__print").alias("q"), F.explode_outer(decontaminate._blocks(False)).alias("b")).select("home", "q", "b.*")
    index = spark.createDataFrame([(p,) for p in prints], "__print bigint")
    index = index.select(F.col("__print").alias("home"), F.explode_outer(decontaminate._blocks(True)).alias("b")).select("home", "b.*")
    assert probes.join(index, ["home", "block", "value"]).select("home", "q").distinct().count() == len(set(moved))


def best_windows(doc, items):
    """item -> similarity and first word of the best window that a shared shingle fixes."""
    words, found = doc.lower().split(), {}
    for item_id, text in items:
        item = text.lower().split()
        grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        starts = {max(i - k, 0) for k in range(len(item) - 4) for i, g in enumerate(grams) if g == tuple(item[k : k + 5])}
        b = {tuple(item[i : i + 5]) for i in range(len(item) - 4)}
        weigh = lambda some: sum(len(" ".join(g)) for g in some)
        for p in starts:
            w = words[p : p + len(item)]
            a = {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))}
            s = weigh(a & b) / weigh(a | b)
            if s >= 0.8 and (s, -p) > found.get(item_id, (0, 0)):
                found[item_id] = (s, -p)
    return found


def test_leaks_with_changed_cut_and_replaced_words_against_brute_force(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 11)))
    items = [(n, " ".join(word() for _ in range(n))) for n in range(15, 61)]
    rows = []
    for _, text in items:
        item = text.split()
        n = len(item)
        edge, cut, mid = max(n // 10, 1), max(n * 3 // 20, 1), n // 2
        for changed in (
            [word(), *item[1:]],
            [*item[:-1], word()],
            [*item[:mid], word(), *item[mid + 1 :]],
            [*item[:-edge], *(word() for _ in range(edge))],
            [*(word() for _ in range(edge)), *item[edge:]],
            [*item[:edge], word(), *item[edge:]],
            [*item[: edge + 1], *item[edge + 2 :]],
        ):
            rows.append([*(word() for _ in range(20)), *changed, *(word() for _ in range(20))])
        rows.append([*(word() for _ in range(20)), *item[:-edge]])
        rows.append([*(word() for _ in range(20)), *item[:-cut]])
        rows.append([*item[edge:], *(word() for _ in range(20))])
    rows = [(i, " ".join(r)) for i, r in enumerate(rows)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): (r.similarity, -r.first_word) for r in decontaminate.find_leaks(docs, bench).collect()}
    want = {(d, i): best for d, text in rows for i, best in best_windows(text, items).items()}
    assert len(want) > 250 and got == want


def test_a_leak_exactly_at_the_threshold_is_found(spark):
    """The item's rarest shingles weigh a fifth of it and are the ones that the document lacks."""
    item = [f"{a}{b}" for a in "abcd" for b in "klmnop"]
    bench = [(0, " ".join(item))] + [(k, " ".join(item[:-4])) for k in (1, 2)]
    text = " ".join(item[:-4])
    docs = spark.createDataFrame([(0, text)], "doc_id bigint, text string")
    found = decontaminate.find_leaks(docs, spark.createDataFrame(bench, "item_id bigint, text string")).collect()
    assert {(r.item_id, r.similarity) for r in found} == {(0, 0.8), (1, 1.0), (2, 1.0)}
