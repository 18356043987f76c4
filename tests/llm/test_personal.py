import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ebbtide.llm import personal
from ebbtide.llm.jobs import JOBS
from ebbtide.llm.personal import base_spans, find_personal, joined_spans, mask_personal
from tests.llm.helpers import FOLDER, awkward, needs_tables, table

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def brute(text):
    found = []
    for order, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text or "", re.ASCII):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True,
                "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else False,
                "card": 14 <= len(digits) <= 19 and luhn(digits),
                "phone": 10 <= len(digits) <= 15,
            }[kind]
            if good:
                found.append((m.start(), order, m.end(), kind))
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(found))


ODD = [
    "a@b.c_d@e.f-g.h, x@y a@b..c @a.b x@a-.b. é@é.fr zé.a@b.co",
    "1.2.3.4.5.6.7.8 256.1.1.1 0001.0.0.255 01.2.3.0000256 9.9.9.9",
    "4111 1111 1111 1111 4111-1111-1111-1111 41111111111111111 0000 0000 0000 00  4111  1111 1111 1111",
    "+1 (234) 567-8901 +12 +1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 +44 20 7946 0958.) ++33123456789",
    "\U0001f600 a@b.cd \U0001f600 10.0.0.1 " * 3,
    "x" * 20000 + "@" + "1" * 5000,
]


def test_odd_texts(spark):
    frame = spark.createDataFrame([(t,) for t in ODD], "text string")
    got = {r[0]: r[1] for r in frame.select("text", joined_spans(base_spans(F.col("text")))).collect()}
    for text, spans in got.items():
        assert spans == brute(text), text[:80]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet="ab1290.@-+ ()%é", max_size=60), min_size=20, max_size=60))
def test_any_text(spark, texts):
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    for text, spans in frame.select("text", joined_spans(base_spans(F.col("text")))).collect():
        assert spans == brute(text), text


@needs_tables
def test_base_of_whole_table(spark):
    rows = JOBS["op7_personal"](spark, FOLDER).collect()
    expected = {i: brute(t) for i, t in table("documents", "doc_id, text")}
    assert {r.doc_id: r.base_sha256 for r in rows} == {i: hashlib.sha256(s.encode()).hexdigest() for i, s in expected.items()}
    for r in rows:
        base = [s for s in r.spans.split(",") if s and not s.startswith("id:")]
        assert ",".join(base) == expected[r.doc_id]
        for kind in PLAIN:
            assert r[f"n_{kind}"] == sum(s.startswith(kind + ":") for s in base)
    assert sum(r.n_email for r in rows) > 0


def corpus(spark):
    rows = [(i, f"Text {'abcdefgh'[i]} says please write to user{i}@mail.example.com soon and member number +1 222 333 44{i}5 ends.") for i in range(8)]
    rows += [(20, "And please write to desk77-front soon, as member number ZX-88213, ends well."), (21, "In the year 1999 please do not"),
             (22, "Version 3.0 of the licence is in the year 2004 of the text")]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_contexts_find_unseen_identifiers(spark):
    got = {r.doc_id: r for r in find_personal(corpus(spark)).collect()}
    added = {i: [s.value for s in r.spans if s.kind == "id"] for i, r in got.items() if r.n_id}
    assert added == {20: ["desk77-front", "ZX-88213"]}
    span = next(s for s in got[20].spans if s.kind == "id")
    assert got[20].text[span.start : span.end] == "desk77-front"


def test_masking(spark):
    got = {r.doc_id: r.text for r in mask_personal(corpus(spark)).collect()}
    assert got[20] == "And please write to <ID> soon, as member number <ID>, ends well."
    assert got[3] == "Text d says please write to <EMAIL> soon and member number <PHONE> ends."
    assert got[22] == "Version 3.0 of the licence is in the year 2004 of the text"


def test_places_count_all_texts(spark):
    docs = spark.createDataFrame([("to the 5 x to the y",), ("TO the z to the",), (None,), ("",), ("a",), ("b _ c",)], "text string")
    wanted = spark.createDataFrame([("L to the _",), ("B the _ x",), ("B b _ c",)], "pattern string")
    for small in (True, False):
        found = personal.pattern_places(docs, wanted, small).collect()
        assert {r.pattern: r.places for r in found} == {"L to the _": 3, "B the _ x": 1, "B b _ c": 1}


def test_awkward_rows(spark, monkeypatch):
    frame = awkward(spark).withColumn("Spans", F.lit(1))
    out = find_personal(frame)
    assert out.columns == [c for c in frame.columns if c != "Spans"] + list(personal.FIELDS)
    assert out.count() == frame.count() and find_personal(frame.limit(0)).count() == 0
    kept = mask_personal(awkward(spark))
    assert kept.columns == awkward(spark).columns
    assert sorted(map(repr, kept.collect())) == sorted(map(repr, awkward(spark).collect()))
    monkeypatch.setattr(personal, "BROADCAST_ROWS", -1)
    assert find_personal(corpus(spark)).agg(F.sum("n_id")).first()[0] == 2


def test_words_beside_a_place(spark, monkeypatch):
    monkeypatch.setattr(personal, "NEAR", 6)
    text = "long" * 9 + " ab " + "y" * 30 + " 12 " + "z" * 40 + " end"
    at = text.index("12")
    frame = spark.createDataFrame([(text, at, at + 2)], "text string, a int, b int")
    row = frame.select(
        personal._before(F.col("text"), F.col("a")).alias("l"), personal._after(F.col("text"), F.col("b")).alias("r")
    ).first()
    assert row.l[-2:] == ["ab", "y" * 30] and row.r[0] == "z" * 40


def test_texts_are_cut_once(spark):
    """Nothing that cuts a text stands in a filter below an explode, where it would be worked out again and again."""
    docs = corpus(spark).withColumnsRenamed({"doc_id": "id"}).withColumn("body", F.xxhash64("text"))
    wanted = spark.createDataFrame([("L to the _",)], "pattern string")
    for frame, cut in (
        (personal.pattern_places(docs, wanted, True), "array_remove("),
        (personal.occurrences(docs.withColumn("base", base_spans(F.col("text")))), personal.TOKEN),
    ):
        plan = frame._jdf.queryExecution().optimizedPlan().toString()
        below = plan[plan.index("Generate") :]
        assert cut in below
        assert not [line for line in below.splitlines() if "Filter" in line and cut in line]
