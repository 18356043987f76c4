import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from ebbtide.llm.jobs import JOBS
from ebbtide.llm.manifest import dataset_manifest
from tests.llm.helpers import FOLDER, awkward, needs_tables, table

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(values):
    return h(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def tree(nodes, run):
    """Root, and for each leaf what lies left and right of its way on every level."""
    ways, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for way, place in zip(ways, at, strict=True):
            low = place - place % run
            way.append((nodes[low:place], nodes[place + 1 : low + run]))
        nodes = [h(*nodes[i : i + run]) for i in range(0, len(nodes), run)]
        at = [place // run for place in at]
    return nodes[0], ways


def plain(rows, run=2, changed=lambda row: row):
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append(row)
    names = sorted(groups, key=lambda g: b"" if g is None else b"=" + g.encode())
    lower = {}
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        lower[g] = tree([leaf(r) for r in groups[g]], run)
    root, upper = tree([lower[g][0] for g in names], run)
    out = []
    for g, above in zip(names, upper, strict=True):
        for row, way in zip(groups[g], lower[g][1], strict=True):
            folded, proof = leaf(changed(row)), ""
            for left, right in way + above:
                folded, proof = h(*left, folded, *right), proof + "".join(left + right)
            out.append((row[0], leaf(row), lower[g][0], root, h(proof), folded, folded == root))
    return sorted(out, key=repr)


def tampered(row):
    hit = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0 and row[3] is not None
    return (*row[:3], row[3] + 1, row[4]) if hit else row


def got(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


@needs_tables
def test_whole_table_equals_a_plain_tree(spark):
    rows = table("documents", ", ".join(FIELDS))
    found = got(JOBS["op13_manifest"](spark, FOLDER))
    assert found == plain(rows, changed=tampered)
    assert 0 < sum(not r[-1] for r in found) < len(found)


@pytest.mark.parametrize("run, sizes", [(2, (1, 2, 257, 600)), (3, (1, 3, 10, 82)), (5, (6, 1, 31))])
def test_runs_and_sizes(spark, run, sizes):
    rows = [(i * 7 % n, f"s{i % 3}", f"g{n}" if n > 1 else None, i, f"text {i}") for n in sizes for i in range(n)]
    frame = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    altered = {"n_chars": F.when(F.col("doc_id") == 2, F.col("n_chars") + 1).otherwise(F.col("n_chars"))}
    found = got(dataset_manifest(frame, FIELDS, run=run, altered=altered))
    assert found == plain(rows, run, lambda r: (*r[:3], r[3] + (r[0] == 2), r[4]))


def test_awkward_rows(spark):
    frame = awkward(spark)
    rows = [tuple(r) for r in frame.select(*FIELDS).collect()]
    assert got(dataset_manifest(frame, FIELDS)) == plain(rows)
    assert dataset_manifest(frame.limit(0), FIELDS).collect() == []
    one = dataset_manifest(frame.where("doc_id = 4"), FIELDS).collect()[0]
    assert one.leaf == one.subroot == one.root == one.folded_root and one.proof_sha256 == h("") and one.verified
    assert dataset_manifest(frame, FIELDS).columns[0] == "doc_id"
