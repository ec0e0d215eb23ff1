import numpy as np
import pytest

from penprint.llm import dom, html_text, skins


def test_blocks_spaces_and_references():
    page = dom.parse(
        "<!DOCTYPE html><title>no</title><script>var t='</p>';</script><article><h1>A &amp;  B&nbsp;c</h1>"
        "<p>one<br>two <b>bold</b>\n\t<a href='x>y'>link</a><p>unclosed &lt;tag&gt; 5 < 6<!-- <p>no --><div>x</div>tail"
        "<ul><li>1<li>2</ul></article><style>p{}"
    )
    assert [t for _, t in page.runs] == ["A & B c", "one two bold link", "unclosed <tag> 5 < 6", "x", "tail", "1", "2"]
    assert dom.parse("").runs == [] and dom.parse("just text").runs == [(0, "just text")]
    assert len(dom.features(page)[0]) == len(dom.NAMES)


def test_only_raw_text_is_skipped_and_never_past_an_empty_tag():
    texts = lambda source: [t for _, t in dom.parse(source).runs]
    for tag in ("svg", "math", "object", "button", "audio", "video", "canvas", "select"):
        for one in (f"<{tag} class='x'/>", f"<{tag}>", f"<{tag}></{tag}>"):
            assert texts(f"<article><p>one {one}two<p>three</article><p>four<{tag}></{tag}>") == ["one two", "three", "four"]
        assert texts(f"<p>a <{tag}>inner <b>text</b></{tag}> b") == ["a inner text b"]
    for tag in ("script", "style", "noscript", "title", "textarea", "iframe"):
        assert texts(f"<p>one<{tag} src='a>b' /><p>two<{tag}>no</{tag}><p>three<{tag}/>") == ["one", "two", "three"]
        assert texts(f"<p>one<{tag} src=/a/></{tag}><p>two<{tag} src='a/>b'>no</{tag}><{tag}/>no</{tag}> tail") == ["one", "two tail"]
        assert texts(f"<p>one<{tag}>no<p>no") == ["one"]
    assert texts("<p>one<template><p>no</template><p>two<template>three<template/>four") == ["one", "twothreefour"]
    assert texts("<p><select><option>a<option>b</option></select>c") == ["a b c"]
    assert texts("<p>x <svg viewBox='0 0 1 1'><title>no</title><path d='M0'/></svg>y") == ["x y"]


def test_decoding_keeps_nothing_below_a_dropped_node():
    page = dom.parse("<div><p>aaaa</p><div><p>bbbb</p><p>cccc</p></div></div>")
    tags = [n.tag for n in page.nodes]
    assert tags == ["root", "div", "p", "div", "p", "p"]
    rng = np.random.default_rng(1)
    for _ in range(200):
        p = rng.random(5)
        kept = dom.decide(page, p)
        assert all(kept[n.parent] or not kept[i] for i, n in enumerate(page.nodes) if i)

        def score(choice):
            w = [1 + np.log1p(n.own) for n in page.nodes]
            return sum(w[i] * np.log(p[i - 1] if choice[i] else 1 - p[i - 1]) for i in range(1, 6))

        allowed = [c for c in ([True, *(bool(x >> k & 1) for k in range(5))] for x in range(32)) if all(c[n.parent] or not c[i] for i, n in enumerate(page.nodes) if i)]
        assert np.isclose(score(kept), max(map(score, allowed)))


@pytest.fixture(scope="module")
def trees(spark, sf):
    return html_text.fit(spark.read.parquet(f"{sf}/pages.parquet"))


def test_given_pages_and_layouts_not_seen_in_training(spark, sf, trees):
    rows = spark.read.parquet(f"{sf}/pages.parquet").collect()
    pages = spark.createDataFrame([(r.page_id, r.url, r.html) for r in rows], "page_id bigint, url string, html string")
    got = {r.page_id: r.text for r in html_text.main_text(pages, trees).collect()}
    for r in rows:
        blocks, _ = skins.content_of(dom.parse(r.html))
        assert got[r.page_id] == "\n".join(t for _, t in blocks)
    right = wrong = missed = 0
    for r in rows[-40:]:
        source = skins.render(r.html, 9_999_999 + r.page_id)
        if not source:
            continue
        page = dom.parse(source)
        kept = dom.decide(page, trees.probabilities(np.array(dom.features(page))))
        marks = [None] * len(page.nodes)
        for i, node in enumerate(page.nodes[1:], 1):
            marks[i] = node.keep or marks[node.parent]
        for i, text in page.runs:
            right += len(text) * (kept[i] and marks[i] == "1")
            wrong += len(text) * (kept[i] and marks[i] != "1")
            missed += len(text) * (not kept[i] and marks[i] == "1")
    assert right / (right + wrong) > 0.95 and right / (right + missed) > 0.95


def test_an_article_around_empty_and_unclosed_elements_is_whole(spark, sf, trees):
    row = spark.read.parquet(f"{sf}/pages.parquet").where("html like '%</p>%</article>%'").orderBy("page_id").first()
    head, body = row.html.split("<article", 1)
    marks = ["<svg class='i'/>", "<math/>", "<button>", "<object data='x'>", "<video src='v'>", "<canvas>"]
    pages = [(i, "u", head + "<article" + body.replace("</p>", m + "</p>", 1)) for i, m in enumerate(["", *marks])]
    pages = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    got = {r.page_id: r.text for r in html_text.main_text(pages, trees).collect()}
    assert got[0] and set(got.values()) == {got[0]}


def test_long_pages_fill_the_sample_if_there_are_no_shorter_ones(spark, sf, monkeypatch):
    pages = spark.read.parquet(f"{sf}/pages.parquet").orderBy("page_id").limit(30)
    monkeypatch.setattr(html_text, "SAMPLE_CHARS", 100)
    trees = html_text.fit(pages)
    assert trees is not None and all(r.text for r in html_text.main_text(pages, trees).collect())


def test_trees_score_as_spark_does(spark, sf):
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = html_text.training_rows(spark.read.parquet(f"{sf}/pages.parquet").limit(20)).limit(800)
    vectors = rows.select(array_to_vector("features").alias("features"), "label", rows.features.alias("x"))
    model = GBTClassifier(maxIter=4, maxDepth=html_text.DEPTH, seed=1).fit(vectors)
    scored = model.transform(vectors).select("x", vector_to_array("probability")[1].alias("p")).collect()
    mine = html_text.Trees(model).probabilities(np.array([r.x for r in scored]))
    assert np.allclose(mine, [r.p for r in scored])


def test_edges(spark, trees):
    rows = [(None, None, None), (1, "u", ""), (2, "u", "   "), (3, "u", "<p>unclosed"), (4, "u", "<article><p>" + "Long words here. " * 60_000), (1, "u", ""), (5, "u", "\x00<>&#0;&#xD800;<a")]
    pages = spark.createDataFrame([(*r, "c") for r in rows], "page_id bigint, url string, html string, text string")
    found = html_text.main_text(pages, trees).collect()
    assert len(found) == len(rows) and all(r.text is not None for r in found)
    assert [len(r.text) for r in found if r.page_id == 4] == [60_000 * 17 - 1]
    assert html_text.fit(pages.limit(0)) is None and html_text.main_text(pages.limit(0), None).count() == 0
