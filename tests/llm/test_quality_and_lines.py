import re

from penprint.llm import line_dedup, quality_rules


def brute_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    seen = {}
    for i, w in enumerate(windows):
        seen.setdefault(w, []).append(i)
    covered = {p for at in seen.values() if len(at) > 1 for i in at for p in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed)


def test_counts_against_brute_force(edge_docs, edge_rows, as_rows):
    got = quality_rules.judge(edge_docs.select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"
    )
    assert as_rows(got) == sorted(((r[0], *brute_counts(r[1])) for r in edge_rows), key=repr)


def test_lines_that_fail_are_removed_and_losers_rejected(spark):
    good = "One fine sentence stands here, and it goes on for quite a few words until the end of the line."
    menu = "Home | News | Sport | Weather | Contact | About | Jobs | Login | Help | Terms"
    more = "Another sentence follows it with words of its own, so that no window of eight repeats."
    docs = spark.createDataFrame(
        [(1, f"{menu}\n{good}\n{more}"), (2, f"{menu}\nMusic | Film | Books | Travel | Cars | Food | Games | Art | Law | Tax | Maps | Shop\nshort text."), (3, good + "\n" + good)],
        "doc_id bigint, text string",
    )
    found = {r.doc_id: r for r in quality_rules.judge(docs).collect()}
    assert found[1].kept and found[1].clean_text == f"{good}\n{more}"
    assert not found[2].kept and not found[2].base_failed
    assert found[3].base_failed and found[3].n_dup_lines == 1


def test_clean_documents_keeps_columns_and_empty_tables(edge_docs, no_docs):
    out = quality_rules.clean_documents(edge_docs)
    assert out.columns == edge_docs.columns
    assert {r.doc_id for r in out.collect()} == {None, 4, 5}
    assert all(r.n_chars == len(r.text) and r.n_words == 1 for r in out.collect())
    assert quality_rules.clean_documents(no_docs).count() == 0


def test_boilerplate_stays_once(spark, as_rows):
    rows = [(i, f"  Cookies help us. \nText number {i}.\n\nCookies help us.", f"site{i}") for i in range(9)]
    rows += [(i, "Only on two sites.", f"site{i % 2}") for i in range(20, 40)] + [(99, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    out = {r.doc_id: r for r in line_dedup.dedup_lines(docs, min_sites=8, counts=True).collect()}
    assert out[0].text == "  Cookies help us. \nText number 0.\n" and out[0].n_removed == 1
    assert out[5].text == "Text number 5.\n" and (out[5].n_lines, out[5].n_removed) == (4, 2)
    assert out[21].n_removed == 0 and out[99].text is None and out[99].n_lines == 0


def test_lines_near_the_threshold_are_counted_exactly(spark):
    rows = [(n * 100 + i, f"line on {n} sites", f"site{i}") for n in range(5, 13) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    found = line_dedup.boilerplate(docs, min_sites=9)
    assert found.count() == 4  # on 9, 10, 11 and 12 sites


def test_line_dedup_edges(edge_docs, no_docs, as_rows):
    out = line_dedup.dedup_lines(edge_docs)
    assert out.columns == edge_docs.columns and as_rows(out) == as_rows(edge_docs)
    assert line_dedup.dedup_lines(no_docs).count() == 0
