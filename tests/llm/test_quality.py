from collections import Counter

from pyspark.sql import functions as F

from ebbtide.llm.jobs import JOBS
from ebbtide.llm.quality import base_counts, boilerplate, quality_rules
from tests.llm.helpers import FOLDER, awkward, needs_tables, table, words


def brute(text):
    text = text or ""
    found = words(text)
    windows = [tuple(found[k : k + 3]) for k in range(len(found) - 2)]
    often = Counter(windows)
    inside = {k + d for k, w in enumerate(windows) if often[w] > 1 for d in range(3)}
    lines = [line for line in text.split("\n") if words(line)]
    failed = len(found) < 50 or 100 * len(inside) > 50 * len(found)
    symbols = sum(text.count(c) for c in "#*$%&|<>")
    return len(found), sum(map(len, found)), symbols, len(lines) - len(set(lines)), len(inside), failed


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


@needs_tables
def test_base_counts_of_whole_table(spark):
    got = {r[0]: tuple(r)[1:] for r in JOBS["op1_quality_rules"](spark, FOLDER).select("doc_id", *COUNTS).collect()}
    assert got == {i: brute(t) for i, t in table("documents", "doc_id, text")}


def test_awkward_rows(spark):
    frame = awkward(spark)
    rows = quality_rules(frame, texts=0, share=0.9).collect()
    assert len(rows) == frame.count()
    assert sorted((r.doc_id or 0, *[r[c] for c in COUNTS]) for r in rows) == sorted(
        (i or 0, *brute(t)) for i, t in ((r.doc_id, r.text) for r in frame.collect())
    )
    assert not any(r.kept for r in rows if not r.text)
    assert quality_rules(frame.limit(0)).count() == 0
    assert [c for c in frame.columns if c != "kept"] == quality_rules(frame).columns[: len(frame.columns) - 1]


def test_repeats_overlap_and_touch(spark):
    texts = ["a b c a b c", "a a a a", "a b c d a b c e b c d", "a b c x b c x y", "a b"]
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    got = {r.text: r.n_repeat_words for r in base_counts(frame).collect()}
    assert got == {t: brute(t)[4] for t in texts}


def test_lines_counted_once_per_text_and_host(spark):
    body = " ".join(f"w{k}" for k in range(60))
    rows = [(i, f"Menu  HOME\nown{i} {body}", "h1") for i in range(6)]
    rows += [(i, f"menu home\nother{i} {body}", "h2") for i in range(10, 12)]
    rows += [(20, "copy line\n" + body, "h1")] * 9 + [(30, "menu home", "h1"), (31, None, "h1"), (32, f"only {body}", None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = {r.host: len(r.lines) for r in boilerplate(frame, texts=3, share=0.5).collect()}
    assert found == {"h1": 1}
    got = {r.doc_id: r for r in quality_rules(frame, texts=3, share=0.5).collect()}
    assert got[0].text == f"own0 {body}" and got[0].n_removed_words == 2 and got[0].kept
    assert got[10].text.startswith("menu home\n") and got[20].n_removed_lines == 0 and got[20].kept
    assert got[30].text == "" and not got[30].kept and got[31].text is None and got[32].kept


def test_depleted_documents_go(spark):
    banner = " ".join(f"b{k}" for k in range(40))
    rows = [(i, f"{banner}\n" + " ".join(f"x{i}{k}" for k in range(60 if i else 20)), "h") for i in range(5)]
    got = quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string"), texts=2, share=0.5)
    assert {r.doc_id: r.kept for r in got.collect()} == {0: False, 1: True, 2: True, 3: True, 4: True}
    assert got.agg(F.sum("n_removed_words")).first()[0] == 200
