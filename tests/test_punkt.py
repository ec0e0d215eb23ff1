import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from penprint.operators import punkt as pk


def plain_tokens(text):
    out = []
    for piece in (text or "").split():
        bare = piece
        while bare and not (bare[-1].isalnum() or bare[-1] in ".!?…"):
            bare = bare[:-1]
        tail = piece[len(bare) :]
        word = bare.rstrip(".!?…")
        marks = bare[len(word) :]
        while word and not word[0].isalnum():
            word = word[1:]
        while word and not word[-1].isalnum():
            word = word[:-1]
        typ = pk.NUMBER if re.fullmatch(r"\d[\d.,]*", word) else word.lower()
        letter = "u" if word[:1].isupper() else "l" if word[:1].islower() else "o"
        if not marks:
            mark = ""
        elif any(c not in "\"'”’»)]" for c in tail):
            mark = "," if marks == "." else ""
        else:
            mark = "." if marks == "." else "!" if set(marks) & set("!?") else "…"
        out.append((piece, typ, letter, mark))
    return out


def bernoulli(k, n, p):
    return (k * math.log(max(p, 1e-300)) if k else 0) + ((n - k) * math.log(max(1 - p, 1e-300)) if n - k else 0)


def tied(c1, c2, both, n):
    p, p1, p2 = c2 / n, both / c1, (c2 - both) / max(n - c1, 1)
    return -2 * (bernoulli(both, c1, p) + bernoulli(c2 - both, n - c1, p) - bernoulli(both, c1, p1) - bernoulli(c2 - both, n - c1, p2))


class Plain:
    """The method over lists of tokens."""

    def __init__(self, texts):
        texts = [plain_tokens(t) for t in texts]
        count, dotted, total = Counter(), Counter(), 0
        for tokens in texts:
            for _, typ, _, mark in tokens:
                total += 1
                count[typ] += 1
                dotted[typ] += mark in (".", ",")
        periods = sum(dotted.values())
        self.score = {}
        for typ, n in count.items():
            if dotted[typ] and typ != pk.NUMBER and any(c.isalpha() for c in typ):
                k, inner = dotted[typ], typ.count(".")
                ratio = -2 * (bernoulli(k, n, periods / total) - bernoulli(k, n, 0.99))
                self.score[typ] = ratio * math.exp(inner - len(typ)) * (inner + 1) / (len(typ) - inner) ** (n - k)
        self.abbr = {t for t, s in self.score.items() if s >= 0.3}
        case, at_break, pair, breaks = defaultdict(Counter), Counter(), Counter(), 0
        for tokens in texts:
            for i, (_, typ, letter, mark) in enumerate(tokens):
                before, before_mark = (tokens[i - 1][1], tokens[i - 1][3]) if i else ("", "!")
                broken = before_mark == "." and before not in self.abbr
                loose = before == pk.NUMBER or (len(before) == 1 and before.isalpha())
                place = "start" if before_mark == "!" or broken else "mid" if before_mark in ("", ",") else "unknown"
                case[typ][letter, place] += 1
                at_break[typ] += broken and not loose
                breaks += mark == "." and typ not in self.abbr
                if before_mark == "." and (before in self.abbr or loose) and typ not in ("", pk.NUMBER):
                    pair[before, typ] += 1
        total_of = lambda typ, letter: sum(n for (x, _), n in case[typ].items() if x == letter)
        self.opens = {t for t in count if total_of(t, "l") and not case[t]["u", "mid"]}
        self.small_start = {t for t in count if case[t]["l", "start"] and not total_of(t, "u")}
        self.ever_small = {t for t in count if total_of(t, "l")}
        self.starters = {
            t for t, n in at_break.items()
            if n and t not in ("", pk.NUMBER) and n * total > count[t] * breaks and tied(breaks, count[t], n, total) >= 30
        }
        self.tied = {
            (a, b) for (a, b), n in pair.items()
            if n > 1 and a and b not in self.starters and n * total > count[a] * count[b] and tied(count[a], count[b], n, total) >= 7.88
        }

    def ends(self, typ, mark, after, letter):
        if mark == "!":
            return True
        if mark not in (".", "…"):
            return False
        initial, number, abbr = mark == "." and len(typ) == 1 and typ.isalpha(), mark == "." and typ == pk.NUMBER, mark == "." and typ in self.abbr
        if mark == "." and (typ, after) in self.tied:
            return False
        starts = letter == "u" and after in self.opens
        if (abbr or mark == "…") and not initial:
            return starts or (letter == "u" and after in self.starters)
        if (initial or number) and letter == "l" and after not in self.small_start:
            return False
        if initial and letter == "u" and not starts and after not in self.ever_small:
            return False
        return starts or not abbr

    def split(self, text):
        tokens = plain_tokens(text)
        raws = re.findall(r"\S+\s*", text or "")
        out, held = [], ""
        for i, (_, typ, _, mark) in enumerate(tokens):
            held += raws[i]
            if i + 1 == len(tokens) or self.ends(typ, mark, tokens[i + 1][1], tokens[i + 1][2]):
                out.append(held.strip())
                held = ""
        return out


def invented(seed, n):
    rng = random.Random(seed)
    words = ["".join(rng.choices("aeioubdfglmnrst", k=rng.randrange(4, 9))) for _ in range(250)]
    names = [w.capitalize() for w in words[:40]]
    short = ["Dr. {n}", "e.g. {w}", "approx. {w}", "z. B. {w}", "J. {n}", "Prof. {n}", "etc. {w}", "(cf. {n})", "3. {w}", "No. 7", "{w}... {w}", "St. {n},", "u.s.w. {w}"]
    texts = []
    for _ in range(n):
        text = []
        for _ in range(rng.randrange(1, 9)):
            parts = [rng.choice(words) for _ in range(rng.randrange(3, 12))]
            for _ in range(rng.randrange(3)):
                parts.insert(rng.randrange(1, len(parts)), rng.choice(short).format(n=rng.choice(names), w=rng.choice(words)))
            text.append(" ".join(parts).capitalize() if rng.random() < 0.1 else parts[0].capitalize() + " " + " ".join(parts[1:]) + rng.choice([".", ".", ".", "!", "?", '."', "...", ".)"]))
        texts.append(rng.choice([" ", "  ", "\n"]).join(text))
    return texts


@pytest.fixture(scope="module")
def corpus():
    rows = [("x", i, t) for i, t in enumerate(invented(1, 300))] + [("y", i, t) for i, t in enumerate(invented(2, 200))]
    return rows + [("x", 900, None), ("x", 901, ""), (None, 902, " \n "), (None, 903, "Alone. here we are"), ("x", 3, "Equal key. Other text, etc. more.")]


def plain_models(rows):
    groups = defaultdict(list)
    for lang, _, text in rows:
        groups[lang].append(text)
    return {lang: Plain(texts) for lang, texts in groups.items()}


def test_learned_table_and_sentences_against_plain_python(spark, corpus):
    frame = spark.createDataFrame(corpus, "lang string, id int, text string").repartition(6)
    counts = pk.punkt_counts(frame, by=["lang"]).persist()
    models = plain_models(corpus)
    types = pk.punkt_types(counts, ["lang"]).collect()
    for r in types:
        want = models[r.lang].score.get(r.typ)
        assert (r.score is None) == (want is None), r
        assert want is None or math.isclose(r.score, want, rel_tol=1e-6, abs_tol=1e-12), r
        assert r.is_abbr == (r.typ in models[r.lang].abbr)
    words, collocations = pk.punkt_model(counts, ["lang"])
    for r in words.collect():
        m = models[r.lang]
        assert (r.is_starter, r.opens, r.small_start, r.ever_small) == tuple(r.typ in s for s in (m.starters, m.opens, m.small_start, m.ever_small)), r
    assert {tuple(r) for r in collocations.collect()} == {(lang, *pair) for lang, m in models.items() for pair in m.tied}
    got = sorted(map(tuple, pk.punkt_sentences(frame, words, collocations, ["id"], by=["lang"]).collect()), key=repr)
    want = [(lang, i, n, s) for lang, i, t in corpus for n, s in enumerate(models[lang].split(t))]
    assert got == sorted(want, key=repr)
    assert {"dr", "prof", "e.g", "approx"} <= models["x"].abbr


def test_known_abbreviations_do_not_split(spark, corpus):
    frame = spark.createDataFrame(corpus, "lang string, id int, text string")
    model = pk.punkt_model(pk.punkt_counts(frame))
    new = [(1, "We met Dr. Unseen today. It was fine."), (2, "Wir sahen z. B. anderes. Gut so."), (3, "He came, etc. and left. Then e.g. nothing!")]
    got = defaultdict(list)
    for r in pk.punkt_sentences(spark.createDataFrame(new, "id int, text string"), *model, ["id"]).orderBy("id", "sent_id").collect():
        got[r.id].append(r.sentence)
    assert got == {
        1: ["We met Dr. Unseen today.", "It was fine."],
        2: ["Wir sahen z. B. anderes.", "Gut so."],
        3: ["He came, etc. and left.", "Then e.g. nothing!"],
    }


def test_empty_table_and_extra_columns(spark):
    empty = spark.createDataFrame([], "text string, id int")
    counts = pk.punkt_counts(empty)
    assert counts.collect() == []
    assert pk.punkt_sentences(empty, *pk.punkt_model(counts), ["id"]).collect() == []
    clash = spark.createDataFrame([("One. Two three.", 1)], "text string, id int").withColumns({c: F.lit("q") for c in ("typ", "n", "at", "mark", "t")})
    assert [r.sentence for r in pk.punkt_sentences(clash, *pk.punkt_model(pk.punkt_counts(clash)), ["id"]).orderBy("sent_id").collect()] == ["One.", "Two three."]


def test_counts_look_at_every_distinct_piece_once(spark, tmp_path):
    """Pieces repeat; their counts are kept, and later readers do not split the texts again."""
    texts = ["Dr. Who came. Dr. Who left! No… yes 3.5 km (approx.) \"end.\" ", "Dr. Who came. ", "", None, " . .. x\t\n!? ab,. c"] * 3
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    counts = pk.punkt_counts(df)
    wanted: dict = {}
    for row in df.select(pk.tokens_of(F.coalesce("text", F.lit(""))).alias("t")).collect():
        for i, x in enumerate(row.t):
            last = row.t[i - 1] if i else None
            stop = last is not None and last.mark in (".", "…")
            context = "start" if last is None or last.mark == "!" else last.mark if stop else "mid"
            key = (last.typ if stop else "", context, x.typ, x.letter, x.mark)
            wanted[key] = wanted.get(key, 0) + 1
    assert {tuple(r[:5]): r.n for r in counts.collect()} == wanted
    assert counts.inputFiles()


def test_texts_are_split_without_expressions(spark):
    df = spark.createDataFrame([(1, "Dr. No came. He left."), (1, "Dr. No came. He left."), (2, None)], "doc_id long, text string")
    counts = pk.punkt_counts(df)
    assert counts.agg({"n": "sum"}).first()[0] == 10
    sents = pk.punkt_sentences(df, *pk.punkt_model(counts), ["doc_id"])
    plan = sents._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "regexp_extract_all" not in plan
    assert sorted(r.sentence for r in sents.collect()).count("He left.") == 2
