import random

import pytest

import corpus_pipeline
from ebbtide.llm.jobs import PIECES
from tests.llm.helpers import AWKWARD, FOLDER, needs_tables, table
from tests.llm.test_decontaminate import brute as contaminated
from tests.llm.test_jaccard import plain_set
from tests.llm.test_personal import brute as personal


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def linked(docs):
    """Smallest id of the group of each document, by pairs."""
    sets = [(i, plain_set(t, 5)) for i, t in sorted(docs)]
    root = {i: i for i, _ in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and 5 * len(a & b) >= 4 * len(a | b):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return {i: find(i) for i in root}


def masked(text):
    out, at = "", 0
    for kind, start, end in (s.split(":") for s in personal(text).split(",") if s):
        if int(start) >= at:
            out += text[at : int(start)] + f"<{kind.upper()}>"
        at = max(at, int(end))
    return out + text[at:]


@needs_tables
def test_every_stage_on_its_own_input(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for n, (name, function) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r.text for r in docs.collect()}
        function(spark, docs, FOLDER).write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        if n < len(corpus_pipeline.STAGES) - 1:
            assert after.columns == docs.columns
            kept = {r.doc_id: r.text for r in after.collect()}
            assert len(kept) == after.count() and all(r.n_chars == len(r.text) for r in after.collect())
        if name == "quality_rules":
            assert 0 < len(kept) < len(before)
        elif name == "ngram_jaccard":
            assert kept == {i: before[i] for i in set(linked(before.items()).values())} and len(kept) < len(before)
        elif name == "decontamination":
            bad = {d for d, _ in contaminated(before.items(), table("benchmark", "item_id, text"))}
            assert bad and set(kept) == set(before) - bad
        elif name == "personal_data":
            assert kept == {i: masked(t) for i, t in before.items()} != before
        else:
            import sentencepiece

            library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
            got = {r.doc_id: r.ids for r in after.collect()}
            assert got == {i: library.encode(t, add_bos=True, add_eos=True) for i, t in before.items()}
        docs = after


@needs_tables
def test_run(spark):
    out = corpus_pipeline.run(spark, FOLDER)
    assert out.columns == ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"] and out.count() > 50


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_awkward_rows(spark, name):
    rng = random.Random(1)
    long = [(100 + k, " ".join(rng.choices(["x", "yy", "zzz", "w\nw"], k=80)), "en", "a", 7) for k in range(3)]
    rows = [(*r, len(r[1] or "")) for r in AWKWARD] + long
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for docs in (frame, frame.limit(0)):
        out = stage(name)(spark, docs, FOLDER)
        assert out.count() <= docs.count()
        if name != "pieces":
            assert out.columns == docs.columns
