import math
import zlib
from collections import Counter, defaultdict

import numpy as np

from ebbtide.llm.jobs import JOBS
from ebbtide.llm.langid import _runs, grow_trees, learn_languages, predict_languages
from tests.llm.helpers import FOLDER, awkward, needs_tables, table


def plain_cost(counts, size, run):
    """Bits of the last symbol by escapes from context to context, with exclusion of what was seen before."""
    excluded, bits = set(), 0.0
    for order in (3, 2, 1, 0):
        context = run[3 - order : 3]
        after = Counter({s: n for s, n in counts[context].items() if s not in excluded})
        if order == 3 and not after:
            continue
        total, kinds = sum(after.values()), len(after)
        if run[3] in after:
            return bits - math.log2(after[run[3]] / (total + kinds))
        if kinds:
            bits -= math.log2(kinds / (total + kinds))
        excluded |= set(after)
    return bits + math.log2(size - len(excluded))


def test_costs_equal_plain_coding():
    texts = [b"abracadabra abba", b"a cab a bad cab", b"", b"d"]
    symbols = np.zeros(256, np.int64)
    for k, c in enumerate(b"abcdr \n"):
        symbols[c] = k + 1
    runs, lengths = _runs(texts, symbols)
    assert lengths.sum() == len(runs)
    keys, times = np.unique(runs, return_counts=True)
    trees = grow_trees({"x": (keys, times)}, symbols)
    counts = defaultdict(Counter)
    def parts(key):
        return tuple(int(key) // 8**k % 8 for k in (3, 2, 1, 0))

    for key, n in zip(keys, times, strict=True):
        run = parts(key)
        for order in range(4):
            counts[run[3 - order : 3]][run[3]] += int(n)
    for key in range(0, 8**4, 7):
        own = trees.of_runs(np.array([key]))[0, 0]
        if key in keys:
            own = trees.costs[np.searchsorted(keys, key), 0]
        assert math.isclose(own, plain_cost(counts, 8, parts(key)), abs_tol=1e-4), parts(key)


@needs_tables
def test_held_out_accuracy(spark):
    rows = JOBS["op9_language"](spark, FOLDER).collect()
    truth = {i: (lang, text) for i, lang, text in table("documents", "doc_id, lang, text")}
    assert len(rows) == len(truth) and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    tested = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == truth[r.doc_id][0] for r in tested]) > 0.95


def test_signs_and_number_forms_are_no_letters(spark):
    trees = learn_languages(awkward(spark))
    rows = [(k, t) for k, t in enumerate(["²½Ⅷ ٣ १", "12 3_4", "!?", "ª", "я", "½ b", "中"])]
    got = {r.doc_id: r.lang_pred for r in predict_languages(spark.createDataFrame(rows, "doc_id long, text string"), trees).collect()}
    assert [got[k] == "und" for k in range(7)] == [True, True, True, False, False, False, False]


def test_awkward_rows(spark):
    frame = awkward(spark)
    trees = learn_languages(frame)
    assert trees.languages == ["de", "en"]
    out = predict_languages(frame, trees)
    assert out.columns == [*frame.columns, "lang_pred", "score", "bits"] and out.count() == frame.count()
    got = {r.doc_id: (r.lang_pred, r.score) for r in out.collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0) and got[8][0] == "en" and got[7][0] == "de"
    nothing = learn_languages(frame.limit(0))
    assert {r.lang_pred for r in predict_languages(frame, nothing).collect()} == {"und"}
    assert predict_languages(frame.limit(0), trees).count() == 0


def test_rarest_runs_are_left_out_beyond_the_bound(spark):
    frame = spark.createDataFrame([("the cat and the hat " * 9 + "zq", "en"), ("der hut und die kuh " * 9, "de")], "text string, lang string")
    trees = learn_languages(frame, most=40)
    assert 0 < len(trees.runs) <= 40
    assert [r.lang_pred for r in predict_languages(frame, trees).collect()] == ["en", "de"]


def test_scripts_that_are_rare_in_the_corpus_are_told_apart(spark):
    english = [f"The quick brown fox jumps over {k} lazy dogs, and (as ever) 'boxes' = \"{k * 37}\" & more; why? #{k}/{k + 1}: yes!" for k in range(400)]
    others = {
        "ru": ["собака лежит у двери дома и ждёт хозяина", "сегодня хорошая погода и мы идём в лес", "она читает новую книгу о море"],
        "el": ["ο σκύλος κάθεται στην πόρτα του σπιτιού", "σήμερα ο καιρός είναι καλός και πάμε στο δάσος", "διαβάζει ένα νέο βιβλίο για τη θάλασσα"],
        "he": ["הכלב יושב ליד הדלת של הבית", "היום מזג האוויר טוב ואנחנו הולכים ליער", "היא קוראת ספר חדש על הים"],
        "ko": ["개가 집 문 앞에서 주인을 기다린다", "오늘은 날씨가 좋아서 우리는 숲에 간다", "그녀는 바다에 관한 새 책을 읽는다"],
    }
    rows = [(t, "en") for t in english] + [(t, name) for name, texts in others.items() for t in texts[:2]]
    trees = learn_languages(spark.createDataFrame(rows, "text string, lang string"))
    asked = spark.createDataFrame([(texts[2], name) for name, texts in others.items()], "text string, lang string")
    assert {r.lang: r.lang_pred for r in predict_languages(asked, trees).collect()} == {name: name for name in others}
