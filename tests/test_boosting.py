"""Boosted trees against a plain row-by-row version."""

import math
import pickle
import random

import numpy as np
import pytest

from colscope.operators import boosting as bo
from colscope.operators import models as ml


def plain_fit(rows, y, k, edges, keys, trees, leaves, depth, least_rows, least_hessian, feature_share, row_share, row_every, rate, seed):
    """One row and one cut after the other. ``rows`` hold bin numbers."""
    n, f = len(rows), len(edges)
    counts = [y.count(c) for c in range(k)]
    scores = [[math.log(c / n) for c in counts] for _ in rows]
    rng, out = np.random.default_rng(seed), []
    for r in range(trees):
        drawn = [i for i in range(n) if bo.in_bag(np.array([keys[i]]), r // row_every, row_share, seed)[0]]
        p = []
        for s in scores:
            e = [math.exp(v - max(s)) for v in s]
            p.append([v / sum(e) for v in e])
        size, grown = max(1, round(feature_share * f)), []
        choices = [sorted(rng.choice(f, size, replace=False).tolist()) for _ in range(k)]
        for c in range(k):
            g = {i: p[i][c] - (y[i] == c) for i in drawn}
            h = {i: max(k / (k - 1) * p[i][c] * (1 - p[i][c]), 1e-16) for i in drawn}
            parts, levels, splits, done = [drawn], [0], [], {}

            def score(members):
                return sum(g[i] for i in members) ** 2 / max(sum(h[i] for i in members), 1e-16)

            def best(members):
                found = None
                for x in choices[c]:
                    for missing_left in (True, False):
                        if not missing_left and not any(rows[i][x] == 0 for i in members):
                            continue
                        for cut in range(1, 255):
                            left = [i for i in members if (rows[i][x] == 0 and missing_left) or 0 < rows[i][x] <= cut]
                            right = [i for i in members if i not in set(left)]
                            if min(len(left), len(right)) < least_rows or min(sum(h[i] for i in left), sum(h[i] for i in right)) < least_hessian:
                                continue
                            gain = score(left) + score(right) - score(members)
                            if gain > 1e-9 and (found is None or gain > found[0] + 1e-12):
                                found = (gain, x, cut, missing_left, left, right)
                return found

            while len(parts) < leaves:
                for j, part in enumerate(parts):
                    if j not in done and levels[j] < depth:
                        done[j] = best(part)
                able = [j for j in done if done[j]]
                if not able:
                    break
                j = max(able, key=lambda j: done[j][0])
                _, x, cut, missing_left, left, right = done[j]
                splits.append((j, x, cut, missing_left))
                levels[j] += 1
                parts[j] = left
                parts.append(right)
                levels.append(levels[j])
                del done[j]
            values = [-rate * sum(g[i] for i in q) / max(sum(h[i] for i in q), 1e-16) for q in parts] if splits else [0.0]
            grown.append((splits, values))
        if not any(s for s, _ in grown):
            break
        out.append(grown)
        for i in range(n):
            for c, (splits, values) in enumerate(grown):
                at = 0
                for new, (j, x, cut, missing_left) in enumerate(splits, 1):
                    b = rows[i][x]
                    if at == j and (b > cut or (b == 0 and not missing_left)):
                        at = new
                scores[i][c] += values[at]
    return out, scores


@pytest.mark.parametrize("leaves,depth,classes", [(3, 2, 3), (4, 2, 2), (5, 4, 2)])
def test_equals_plain_version(spark, leaves, depth, classes):
    rng = random.Random(leaves)
    data = []
    for _ in range(90):
        a, b = rng.randrange(9), rng.choice([None, rng.randrange(5), float("nan")])
        data.append((float(a), None if b is None else float(b), rng.random() // 0.2, f"c{(a + (b if b and b == b else 0)) % classes if rng.random() < 0.8 else rng.randrange(classes):.0f}"))
    df = spark.createDataFrame(data, "a double, b double, `odd name` double, kind string").coalesce(1)
    features, options = ["a", "b", "odd name"], dict(trees=7, leaves=leaves, depth=depth, least_rows=4, least_hessian=0.5, row_every=2, refresh=3)
    model = bo.fit(df, features, "kind", **options)
    edges = bo.bin_edges(df, features)
    rows = [[0 if v is None or v != v else int(np.searchsorted(e, v)) + 1 for v, e in zip(r, edges)] for r in data]
    labels = sorted({r[3] for r in data})
    keys = [r[0] for r in df.select(bo.F.monotonically_increasing_id()).collect()]
    want, scores = plain_fit(rows, [labels.index(r[3]) for r in data], len(labels), edges, keys, 7, leaves, depth, 4, 0.5, 0.8, 0.8, 2, 0.1, 100)
    assert len(model.rounds) == len(want)
    for trees, plain in zip(model.rounds, want):
        for tree, (splits, values) in zip(trees, plain):
            assert list(zip(tree.leaf, tree.feature, tree.bin, tree.missing_left)) == splits and np.allclose(tree.value, values)
    got = model.transform(df).collect()
    for r, s in zip(got, scores):
        e = np.exp(np.array(s) - max(s))
        assert np.allclose(r.probability, e / e.sum()) and r.prediction == np.argmax(np.round(r.probability, 12)) and labels[int(r.label)] == r.kind


def test_odd_training_tables(spark, tmp_path):
    schema = "a double, b double, kind string"
    assert ml.predict(bo.fit(spark.createDataFrame([(1.0, None, "x"), (2.0, None, "x"), (3.0, 1.0, None)], schema), ["a", "b"], "kind"),
                      spark.createDataFrame([(None, None, "new")], schema), 1).first().predicted_trace_type == "x"
    with pytest.raises(ValueError):
        bo.fit(spark.createDataFrame([(1.0, 2.0, None)], schema), ["a", "b"], "kind")
    rows = [(float(i % 50), None, "big" if i % 50 > 30 else "small") for i in range(2000)]
    model = bo.fit(spark.createDataFrame(rows, schema), ["a", "b"], "kind", trees=20)
    assert all(f == 0 for trees in model.rounds for t in trees for f in t.feature) and model.importances()[0] == 1.0
    model.save(spark, f"{tmp_path}/model")
    again = bo.BoostedModel.load(spark, f"{tmp_path}/model")
    test = spark.createDataFrame([(10.0, 1.0, "small"), (45.0, None, "big"), (None, None, "other")], schema)
    scored = ml.score(again, test).collect()
    assert [r.label for r in scored] == [1.0, 0.0, 2.0] and [r.prediction for r in scored][:2] == [1.0, 0.0]
    assert scored == ml.score(model, test).collect()


def test_table_in_many_pieces(spark):
    rows = [(float(i % 97), float(i % 13), "abc"[(i % 97) // 33]) for i in range(30_000)]
    df = spark.createDataFrame(rows, "a double, b double, kind string").repartition(40)
    model = bo.fit(df, ["a", "b"], "kind", trees=30, refresh=10)
    assert ml.evaluate_model(model, df).first().acc > 0.99 and len(model.rounds) == 30


def test_the_driver_sees_splits_only(spark, monkeypatch):
    rows = [(float(i % 97), float(i % 13), "abc"[(i % 97) // 33]) for i in range(6_000)]
    df = spark.createDataFrame(rows, "a double, b double, kind string").repartition(12)
    collect, sizes = bo.RDD.collect, []

    def weighed(rdd):
        got = collect(rdd)
        sizes.append(len(pickle.dumps(got)))
        return got

    monkeypatch.setattr(bo.RDD, "collect", weighed)
    model = bo.fit(df, ["a", "b"], "kind", trees=3)
    assert len(model.rounds) == 3 and len(sizes) >= 6 and max(sizes) < 20_000


def test_no_pass_walks_many_rounds_again(spark, monkeypatch):
    walked, best = [], bo._best_splits
    monkeypatch.setattr(bo, "_best_splits", lambda blocks, rounds, *rest: walked.append(len(rounds)) or best(blocks, rounds, *rest))
    df = spark.createDataFrame([(float(i % 97), float(i % 13), "ab"[i % 97 > 33]) for i in range(2_000)], "a double, b double, kind string")
    assert len(bo.fit(df, ["a", "b"], "kind", trees=12).rounds) == 12 and max(walked) <= 5


def test_rows_are_drawn_once_for_all_passes_of_a_draw(spark, monkeypatch):
    draws, read, draw, best = [], [], bo.drawn_rows, bo._best_splits
    monkeypatch.setattr(bo, "drawn_rows", lambda blocks, bag, *rest: draws.append(bag) or draw(blocks, bag, *rest))
    monkeypatch.setattr(bo, "_best_splits", lambda rows, *rest: read.append(rows.is_cached and sum(len(b.key) for b in rows.collect())) or best(rows, *rest))
    df = spark.createDataFrame([(float(i % 97), float(i % 13), "ab"[i % 97 > 33]) for i in range(2_000)], "a double, b double, kind string")
    bo.fit(df, ["a", "b"], "kind", trees=12, row_every=4, refresh=6)
    assert draws == [0, 1, 1, 2] and len(read) > 12 and set(read) == {0}
