import math
import random
from itertools import combinations

import pytest
from pyspark.ml.functions import vector_to_array

from ebbtide.operators import model
from ebbtide.operators.attribution import leaves_of, saved_nodes, tree_attribution

FEATURES = ["FF_A", "FF_B", "FF_R"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(4)
    data = []
    for k in range(400):
        a, b, r = rng.random(), rng.random(), rng.choice(["x", "y", "z"])
        churn = rng.random() < (0.8 if (a > 0.5) != (r == "x") else 0.2)
        data.append((k, 4 + k % 3, a if rng.random() < 0.85 else None, b, r, churn))
    return spark.createDataFrame(
        data, "PK long, SCENARIO_DATE int, FF_A double, FF_B double, FF_R string, CHURN boolean"
    ).persist()


@pytest.fixture(scope="module")
def fitted(rows):
    return model.fit(rows, "CHURN", FEATURES, model.classifier({"maxIter": 5, "maxDepth": 4}))


def expected(nodes, x, known, at=0):
    """Mean of a tree over the training rows that agree with ``x`` on the known positions."""
    node = nodes[at]
    if node.leftChild < 0:
        return node.prediction
    split, sides = node.split, (node.leftChild, node.rightChild)
    if split["featureIndex"] in known:
        cut, value = split["leftCategoriesOrThreshold"], x[split["featureIndex"]]
        left = value in list(cut) if split["numCategories"] >= 0 else value <= cut[0]
        return expected(nodes, x, known, sides[0 if left else 1])
    return sum(nodes[s].rawCount / node.rawCount * expected(nodes, x, known, s) for s in sides)


def test_equals_the_mean_over_all_subsets_and_adds_up(spark, rows, fitted):
    frame = rows.where("PK < 25")
    got = {}
    for r in tree_attribution(fitted, frame, FEATURES).collect():
        got.setdefault(r.PK, {})[r.FEATURE] = r.ATTRIBUTION
        got[r.PK]["base"], got[r.PK]["margin"] = r.BASE, r.MARGIN
    nodes = saved_nodes(spark, fitted.stages[-1])
    weights = fitted.stages[-1].treeWeights
    trees = {t: {n.id: n for n in part.itertuples()} for t, part in nodes.groupby("treeID")}
    owner = {0: "FF_A", 1: "FF_A", 2: "FF_B", 3: "FF_B", 4: "FF_R"}
    assert any(len(leaf.steps) > 2 for leaf in leaves_of(nodes, weights)) and len(got) == 25
    for r in fitted.transform(frame).select("PK", vector_to_array("features").alias("x")).collect():
        value = {
            known: sum(weights[t] * expected(tree, r.x, known) for t, tree in trees.items())
            for n in range(6) for known in combinations(range(5), n)
        }
        want = dict.fromkeys(FEATURES, 0.0)
        for p in range(5):
            others = [q for q in range(5) if q != p]
            for n in range(5):
                share = math.factorial(n) * math.factorial(4 - n) / math.factorial(5)
                for known in combinations(others, n):
                    want[owner[p]] += share * (value[tuple(sorted((*known, p)))] - value[known])
        mine = got[r.PK]
        assert all(mine[c] == pytest.approx(want[c], abs=1e-9) for c in FEATURES)
        assert mine["base"] == pytest.approx(value[()]) and mine["base"] + sum(want.values()) == pytest.approx(mine["margin"])


def test_first_rows_and_empty_frames(rows, fitted):
    found = tree_attribution(fitted, rows, FEATURES, first=7).collect()
    chosen = sorted((r.SCENARIO_DATE, r.PK) for r in rows.collect())[:7]
    assert sorted((r.SCENARIO_DATE, r.PK) for r in found) == sorted(chosen * 3)
    assert tree_attribution(fitted, rows.where("false"), FEATURES).collect() == []
    assert tree_attribution(fitted, rows, FEATURES, first=None).count() == 1200
