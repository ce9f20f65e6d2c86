"""Operators on a small graph and on numbers worked out by hand."""

import os
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from likegraph.functions.process import clipped_process, combine, noop_process, piecewise_process, scaled_process, sigmoid_process
from likegraph.operators import distance, evaluate, explore, features, hierarchy, kmeans, reduce
from likegraph.operators.frames import Blocks, FeatureFrame, of_vectors
from likegraph.plans import workflow
from likegraph.sources.graph import Graph, bodies
from likegraph.sources.store import load_features, save_features


def graph(spark, nodes, edges, regions=("EB(L)", "EB(R)", "F")):
    rows = [(b, t, s, c, json.dumps(r)) for b, t, s, c, r in nodes]
    lines = [(a, b, w, json.dumps(r)) for a, b, w, r in edges]
    return Graph(
        spark.createDataFrame(rows, "bodyId long, type string, status string, cropped boolean, roiInfo string"),
        spark.createDataFrame(lines, "src long, dst long, weight long, roiInfo string"),
        spark.createDataFrame([(list(regions),)], "superLevelRois array<string>"),
    )


def raw(spark, rows, n=3):
    return Blocks(bodies(spark, list(range(1, n + 1))), spark.createDataFrame(rows, "bodyid long, direction string, feature string, value double"))


def values(frame):
    return {(r["bodyid"], r["block"], r["feature"]): r["value"] for r in frame.values.collect()}


def test_each_value(spark):
    b = raw(spark, [(1, "in", "a", 0.0), (1, "in", "b", 20.0), (1, "in", "c", 30.0), (1, "out", "d", 150.0)], 1)
    got = sigmoid_process(10, 30, 1, 1)(b)
    assert got.defaults["in"] == pytest.approx(0.0179862, abs=1e-6)
    assert values(got)[1, "in", "b"] == pytest.approx(0.5)
    assert values(got)[1, "in", "c"] == pytest.approx(0.8807971)
    assert values(piecewise_process(wgt_in=1, wgt_out=1)(b))[1, "out", "d"] == pytest.approx(105)
    c = values(clipped_process(wgt_in=1, wgt_out=1)(raw(spark, [(1, "in", "a", 2.0), (1, "in", "b", 3.0), (1, "in", "c", 60.0)], 1)))
    assert [c[1, "in", x] for x in "abc"] == [0, 3, 50]
    assert {k[1] for k in values(noop_process(1, 0)(b))} == {"in"}
    with pytest.raises(ValueError):
        noop_process(0, 0)(b)


def test_scaled(spark):
    b = raw(spark, [(1, "in", "a", 4.0), (1, "in", "b", 4.0), (2, "in", "a", 2.0), (2, "in", "c", 2.0), (1, "out", "x", 5.0), (2, "out", "y", 10.0), (3, "out", "x", 1.0), (3, "out", "y", 3.0)])
    frame = scaled_process(0.5, 0.5, [0.66, 0, 0.33])(b)
    got = {(r["b1"], r["b2"]): r["dist"] for r in distance.compute_distance_matrix(frame).collect()}
    assert got == {(1, 2): pytest.approx(1.13338, abs=2e-5), (1, 3): pytest.approx(1.14694, abs=2e-5), (2, 3): pytest.approx(0.96375, abs=2e-5)}
    v = values(scaled_process(0.5, 0.5, [1, 0, 1])(b))
    assert v[1, "share.in", "a"] == pytest.approx(0.408248, abs=1e-6)
    assert v[1, "size", "post"] == pytest.approx(1.224745, abs=1e-6)
    dense = scaled_process(1, 1, [0, 1, 0])(b)
    norm = {}
    for (body, _, _), x in values(dense).items():
        norm[body] = norm.get(body, 0) + x * x
    assert all(n == pytest.approx(1) for n in norm.values())


def test_overlap_and_rank_slots(spark):
    nodes = [(1, "T", "Traced", False, {"EB(L)": {"pre": 3, "post": 2}, "EB(R)": {"pre": 1}, "other": {"pre": 9}}), *((b, t, "Anchor", None, {}) for b, t in ((2, "T"), (3, "put_T_pct"), (4, "T"), (5, None), (6, "")))]
    edges = [(2, 1, 3, {}), (3, 1, 9, {}), (4, 1, 5, {}), (5, 1, 7, {}), (6, 1, 2, {}), (1, 1, 50, {})]
    g = graph(spark, nodes, edges)
    got = {(r["direction"], r["feature"]): r["value"] for r in features.roi_overlap_blocks(g, [1, 99]).values.collect()}
    assert got == {("in", "EB<="): 4.0, ("out", "EB=>"): 10.0}
    who, rows = features.connections(g, [1])
    assert {r["feature"]: r["value"] for r in features.connection_blocks(who, rows).values.collect()} == {"c-T#1=>": 9, "c-T#2=>": 5, "c-T#3=>": 3, "c-5=>": 7}
    assert {r["feature"]: r["value"] for r in features.connection_blocks(who, rows, sort_types=False).values.collect()} == {"c-T=>": 17, "c-5=>": 7}
    assert {r["feature"] for r in features.connection_blocks(who, rows, pattern_only=True).values.collect()} == {f"c-ph#{k}=>" for k in (1, 2, 3, 4)}
    assert {r["feature"] for r in features.connection_blocks(who, rows, customtypes={5: "X_a"}, morph_only=True).values.collect()} >= {"c-X#1=>"}
    assert {r["bodyid"] for r in features.extract_neighbors(g, [2]).collect()} == {1, 2}


def test_projection(spark):
    g = graph(spark, [(1, None, "Anchor", None, {}), (2, None, "Traced", None, {"EB(L)": {"pre": 2, "post": 1}, "F": {"pre": 2, "post": 3}})], [(2, 1, 5, {"F": {"post": 4}, "EB(R)": {"post": 2}})])
    got = {r["feature"]: r["value"] for r in features.projection_blocks(g, [1]).values.collect()}
    assert got == {"F<=(EB<=)#1": 2.0, "F<=(F<=)#1": 2.0, "F<=(EB=>)#1": 1.0, "F<=(F=>)#1": 3.0}


def test_importance(spark):
    nodes = [(1, "A", "Traced", False, {})] + [(10 + i, f"P{i}", "Traced", False, {}) for i in range(8)] + [(30, None, "Traced", True, {})]
    edges = [(1, 10 + i, w, {}) for i, w in enumerate((40, 30, 10, 5, 5, 4, 4, 3))] + [(1, 30, 90, {})]
    _, out = explore.connection_differences(graph(spark, nodes, edges), [1])
    rows = [r for r in out.collect() if r["bodyid"] == 1]
    assert sorted(r["weight"] for r in rows) == [4, 5, 5, 10, 30, 40]
    assert len([r for r in out.collect() if r["bodyid"] is None]) == 6


def test_truth(spark):
    truth = spark.createDataFrame([(1, "A"), (2, "A"), (3, "B"), (4, "B"), (5, "C")], "bodyid long, type string")
    best = spark.createDataFrame([(1, 2), (2, 1), (3, 1), (4, 3), (5, 1)], "bodyid long, match long")
    rate, wrong = evaluate.agreement_rate(best, truth)
    assert rate.first()["rate"] == 75
    assert [tuple(r) for r in wrong.collect()] == [(3, "B", 1, "A")]
    alone = spark.createDataFrame([(i, str(i)) for i in range(1, 6)], "bodyid long, type string")
    assert evaluate.agreement_rate(best, alone)[0].first()["rate"] is None
    labels = spark.createDataFrame([(i, t) for i, t in zip(range(4), (0, 0, 1, 1), strict=True)], "bodyid long, type int")
    gt = spark.createDataFrame([(i, t) for i, t in zip(range(4), "AAAB", strict=True)], "bodyid long, type string")
    summary, table = evaluate.compute_vi(labels, gt)
    assert summary.first()["merge"] == pytest.approx(0.5) and summary.first()["split"] == pytest.approx(0.688722, abs=1e-6)
    a = table.filter("type = 'A'").first()
    assert (a["VI"], a["VI_norm"], a["false_merge"], a["false_split"]) == tuple(pytest.approx(x, abs=1e-6) for x in (0.938722, 0.312907, 0.25, 0.688722))
    assert evaluate.compute_vi(gt, gt)[0].first()["merge"] == 0
    p1 = spark.createDataFrame([(1, 0), (2, 0), (3, 0)], "bodyid long, type int")
    p2 = spark.createDataFrame([(1, 0), (2, 0), (3, 1)], "bodyid long, type int")
    first, second = evaluate.report_diffs(p1, p2)
    assert [tuple(r) for r in first.collect()] == [(2, 3), (1, 3)] and second.count() == 0


def naive_ward(d):
    d = d.astype(float).copy()
    live, size, out = list(range(len(d))), [1] * len(d), []
    while len(live) > 1:
        h, a, b = min((d[i, j], i, j) for x, i in enumerate(live) for j in live[x + 1 :])
        for k in live:
            if k not in (a, b):
                d[a, k] = d[k, a] = math.sqrt(max(0, ((size[k] + size[a]) * d[a, k] ** 2 + (size[k] + size[b]) * d[b, k] ** 2 - size[k] * h * h) / (size[a] + size[b] + size[k])))
        size[a] += size[b]
        live.remove(b)
        out.append(h)
    return out


def test_ward_against_naive():
    rng = np.random.default_rng(1)
    for n in (2, 3, 7, 20):
        d = hierarchy.pair_matrix(rng.normal(size=(n, 3)))
        z = hierarchy.ward(d)
        assert np.allclose(sorted(z[:, 2]), sorted(naive_ward(d)))
        assert (np.diff(z[:, 2]) >= 0).all() and z[-1, 3] == n
        assert sorted(hierarchy.leaf_order(z, n)) == list(range(n))


def test_clusters(spark):
    rng = np.random.default_rng(2)
    points = [(i, (rng.normal(size=2) * 0.1 + 10 * np.array([i % 3, i % 2])).tolist()) for i in range(24)]
    frame = of_vectors(spark.createDataFrame(points, "id long, v array<double>"), "id", "v")
    truth = spark.createDataFrame([(i, f"{i % 6}") for i in range(24)], "bodyid long, type string")
    tree = hierarchy.hierarchical_cluster(frame)
    assert tree.get_partitions(6).select("type").distinct().count() == 6
    assert tree.get_partitions(0).select("type").distinct().count() == 1
    merge, split, _, k = tree.compute_vi(truth)
    assert (merge, split, k) == (0, 0, 6)
    assert tree.compute_vi(truth, 6)[3] == 6
    _, width, _ = tree.get_partitions(6, return_max=True)
    assert tree.get_partitions_dist_constraint(width + 1e-9).select("type").distinct().count() == 6
    assert tree.get_partitions_dist_constraint(-1) is None
    assert width == pytest.approx(evaluate.cluster_diameter(truth, frame).first()["dist"])
    got = kmeans.kmeans_cluster(frame, 6)
    assert got.get_partitions().filter("ord = 0").count() == got.rows.select("type").distinct().count()
    assert {r["match"] % 6 == r["bodyid"] % 6 for r in distance.get_strongest_matches(frame).collect()} == {True}
    assert distance.find_closest_neurons(3, frame).first()["bodyid"] == 3
    flat, explained = reduce.reduce_features(frame, 2)
    assert explained == pytest.approx(1)
    m = np.array([p[1] for p in points])
    first = {r["bodyid"]: r["value"] for r in flat.values.filter("feature = '00000'").collect()}
    u = np.linalg.svd(m - m.mean(axis=0), full_matrices=False)
    assert np.allclose(np.abs([first[i] for i in range(24)]), np.abs(u[0][:, 0] * u[1][0]))
    assert reduce.nonlinear_reduce_features(frame).count() == 24
    assert hierarchy.sort_distance_matrix(frame).count() == 24


def test_frames(spark, tmp_path):
    rows = spark.createDataFrame([(1, "x", "a", 5.0), (2, "x", "a", 1.0), (2, "y", "a", 4.0)], "bodyid long, block string, feature string, value double")
    frame = FeatureFrame(bodies(spark, [2, 1, 3]), rows, {"x": 0.5})
    save_features(frame, str(tmp_path / "f"))
    back = load_features(spark, str(tmp_path / "f"))
    assert values(back) == values(frame) and back.defaults == frame.defaults
    assert explore.find_max_variance(frame, 1).values.count() == 2
    top = explore.find_max_differences(frame, 1, 2, 1).collect()
    assert [(r["kind"], r["block"], r["diff"]) for r in top] == [("difference", "x", 4.0), ("sum", "x", 4.0)]
    assert explore.features_compareheatmap(frame).count() == 6
    assert combine([(frame, 2.0, "p"), (frame, 0.0, "q")]).defaults == {"p.x": 1.0}
    none = FeatureFrame(bodies(spark, []), rows.limit(0))
    assert distance.compute_distance_matrix(none).count() == 0
    with pytest.raises(ValueError):
        distance.get_strongest_matches(none)
    d = {(r["b1"], r["b2"]): r["dist"] for r in distance.compute_distance_matrix(frame).collect()}
    assert d[2, 3] == pytest.approx(math.sqrt(0.25 + 16), abs=1e-5)
    assert frame.values.select(F.sum("value")).first()[0] == 10


def test_workflows(spark):
    rng = np.random.default_rng(3)
    nodes = [(b, None, "Anchor" if b % 2 else "Traced", False, {"F": {"pre": 5, "post": 5}}) for b in range(1, 31)]
    edges = [(a, b, int(rng.integers(3, 20)), {"F": {"post": 4}}) for a in range(1, 31) for b in range(1, 31) if a != b and (a + b) % 3 == 0]
    g = graph(spark, nodes, edges)
    for mode in ("conn", "pro"):
        out = workflow.refining_workflow_simple(g, list(range(1, 13)), 4, premode=mode, iterations=2, cluster_neighbors=mode == "conn")
        assert out.values.select("bodyid").distinct().count() == 12
    assert workflow.refining_workflow(g, list(range(1, 13)), 100, iterations=2, customtypes={1: "a"}).values.count() > 0


def random_frame(spark, n, width=12, seed=0, twins=0):
    r = np.random.default_rng(seed)
    vectors = r.normal(0, 1, (n, width))
    vectors[:twins] = vectors[n - twins :][::-1]
    rows = [(1000 + 7 * k, [float(x) for x in v]) for k, v in enumerate(vectors)]
    return of_vectors(spark.createDataFrame(rows, "id long, v array<double>"), "id", "v"), vectors


@pytest.mark.parametrize(("n", "most"), [(50, 6), (120, 30)])
def test_trees_in_rounds(spark, n, most):
    """A tree that is merged in rounds of nearest pairs is the one that a single task builds from all distances."""
    frame, vectors = random_frame(spark, n, seed=n)
    whole, parts = (hierarchy.hierarchical_cluster(frame, most=m) for m in (10**6, most))
    a, b = (t.merges.orderBy("step").toPandas() for t in (whole, parts))
    assert a.columns.tolist() == b.columns.tolist() and a.dtypes.tolist() == b.dtypes.tolist()
    for c in ("step", "left", "right", "size"):
        assert (a[c] == b[c]).all(), c
    assert np.allclose(a.height, b.height, atol=2e-4) and np.allclose(a.diameter, b.diameter)
    pair = lambda t: [tuple(sorted(x)) for x in t[["far1", "far2"]].to_numpy().tolist()]
    assert pair(a) == pair(b)
    key = lambda p: {r["bodyid"]: r["type"] for r in p.collect()}
    assert key(whole.get_partitions(9)) == key(parts.get_partitions(9))
    order = lambda m: [r["bodyid"] for r in hierarchy.sort_distance_matrix(frame, most=m).orderBy("ord").collect()]
    assert order(10**6) == order(most)


def test_trees_of_twins_in_rounds(spark):
    """Equal rows: every one is merged, at height 0 first."""
    frame, _ = random_frame(spark, 60, seed=5, twins=25)
    merges = hierarchy.hierarchical_cluster(frame, most=4).merges.orderBy("step").toPandas()
    assert len(merges) == 59 and merges["size"].iloc[-1] == 60 and (merges.height.iloc[:25] == 0).all() and merges.height.iloc[25] > 0


def test_distance_constraint_with_its_pair(spark):
    frame, vectors = random_frame(spark, 40, seed=2)
    tree = hierarchy.hierarchical_cluster(frame)
    part, dist, pair = tree.get_partitions_dist_constraint(3.0, return_max=True)
    of = {r["bodyid"]: r["type"] for r in part.collect()}
    far = max((float(np.linalg.norm(vectors[i] - vectors[j])), 1000 + 7 * i, 1000 + 7 * j) for i in range(40) for j in range(i) if of[1000 + 7 * i] == of[1000 + 7 * j])
    assert dist == pytest.approx(far[0]) and dist <= 3.0 and set(pair) == set(far[1:])
    assert tree.get_partitions_dist_constraint(-1) is None and tree.get_partitions_dist_constraint(-1, return_max=True) == (None, 0.0, (None, None))
    alone, dist, pair = tree.get_partitions_dist_constraint(0.0, return_max=True)
    assert alone.select("type").distinct().count() == 40 and dist == 0 and pair == (None, None)


def test_pairs_in_blocks(spark, monkeypatch):
    from likegraph.operators import pairs

    monkeypatch.setattr(pairs, "SMALL", 5)
    frame, vectors = random_frame(spark, 63, seed=3, twins=4)
    d = np.round(np.sqrt(((vectors[:, None] - vectors[None]) ** 2).sum(axis=2)), 5)
    got = {(r["b1"], r["b2"]): r["dist"] for r in distance.compute_distance_matrix(frame).collect()}
    assert len(got) == 63 * 62 // 2 and all(got[1000 + 7 * i, 1000 + 7 * j] == pytest.approx(d[i, j], abs=1e-9) for i in range(63) for j in range(i + 1, 63))
    k = {r["k"]: r["dist"] for r in distance.compute_distance_matrix(frame, condense=True).collect()}
    assert [k[x] for x in range(len(k))] == pytest.approx(d[np.triu_indices(63, 1)].tolist(), abs=1e-9)
    near = {r["bodyid"]: r["match"] for r in distance.get_strongest_matches(frame).collect()}
    np.fill_diagonal(d, np.inf)
    assert near == {1000 + 7 * i: 1000 + 7 * int(d[i].argmin()) for i in range(63)}


def test_positions_of_many_ids(spark, monkeypatch):
    from likegraph.sources import graph

    monkeypatch.setattr(graph, "RANGE", 10)
    ids = [5813027103 + 977 * k * k for k in range(85)]
    got = graph.bodies(spark, spark.createDataFrame([(i,) for i in ids[::-1] + ids], "bodyid long")).orderBy("pos").collect()
    assert [(r["bodyid"], r["pos"]) for r in got] == [(b, k) for k, b in enumerate(ids)]


def test_feather(spark, tmp_path):
    from likegraph.sources.store import load_feather, save_feather

    frame = FeatureFrame(spark.createDataFrame([(7, 0), (3, 1), (5, 2)], "bodyid long, pos int"), spark.createDataFrame([(7, "a", "x", 1.5), (3, "b", "x", 2.0), (3, "a", "y", -1.0)], "bodyid long, block string, feature string, value double"), {"b": 0.25})
    save_feather(frame, str(tmp_path / "f"))
    back = load_feather(spark, str(tmp_path / "f"))
    assert [tuple(r) for r in back.bodies.orderBy("pos").collect()] == [(7, 0), (3, 1), (5, 2)]
    assert sorted(map(tuple, back.values.collect())) == [(3, "a", "y", -1.0), (3, "b", "x", 2.0), (5, "b", "x", 0.25), (7, "a", "x", 1.5), (7, "b", "x", 0.25)]


def test_embeddings_keep_groups(spark):
    """Three groups far apart stay apart in each embedding; frames of two columns are taken as they are."""
    r = np.random.default_rng(0)
    vectors = np.concatenate([r.normal(20 * g, 1, (40, 6)) for g in range(3)])
    frame = of_vectors(spark.createDataFrame([(k, [float(x) for x in v]) for k, v in enumerate(vectors)], "id long, v array<double>"), "id", "v")
    for tsne in (True, False):
        got = explore.features_scatterplot2d(frame, tsne=tsne).orderBy("bodyid").toPandas()
        assert got.columns.tolist() == ["bodyid", "x", "y", "x2", "y2", "cluster", "truth"]
        for c in (["x", "y"], ["x2", "y2"]):
            y = got[c].to_numpy()
            d = np.sqrt(((y[:, None] - y[None]) ** 2).sum(axis=2))
            np.fill_diagonal(d, np.inf)
            assert (d.argmin(axis=1) // 40 == np.arange(120) // 40).all()
    flat = of_vectors(spark.createDataFrame([(k, [float(k), 2.0]) for k in range(4)], "id long, v array<double>"), "id", "v")
    assert [(r["x"], r["y"], r["x2"], r["y2"]) for r in explore.features_scatterplot2d(flat).orderBy("bodyid").collect()] == [(float(k), 2.0, float(k), 2.0) for k in range(4)]


def test_scores_with_many_columns(spark, monkeypatch):
    """Columns that are too many to send to each task are joined, to the same scores."""
    from likegraph.functions import process

    rows = [(1, "in", "a", 4.0), (1, "in", "b", 4.0), (1, "out", "x", 5.0), (2, "in", "a", 2.0), (2, "in", "c", 2.0), (2, "out", "y", 10.0), (3, "out", "x", 1.0), (3, "out", "y", 3.0)]
    read = lambda f: {(r["bodyid"], r["block"], r["feature"]): r["value"] for r in f.values.collect()}
    few = read(scaled_process(0.5, 0.7, [0.3, 0.4, 0.3])(raw(spark, rows)))
    monkeypatch.setattr(process, "MOST_COLUMNS", 2)
    many = read(scaled_process(0.5, 0.7, [0.3, 0.4, 0.3])(raw(spark, rows)))
    assert few.keys() == many.keys() and all(few[k] == pytest.approx(many[k], abs=1e-12) for k in few)


def test_one_rule_of_merging_with_ties(spark, monkeypatch):
    """Equal rows, equal distances and rows apart: tiles of four give the very merges of one task, heights included."""
    from likegraph.operators import merging

    r = np.random.default_rng(6)
    square = [[float(x), float(y)] for x in range(4) for y in range(4)]
    rows = [*square, *(r.normal(20, 3, 2).tolist() for _ in range(9)), *([[5.0, 5.0]] * 7), [0.0, 0.0]]
    frame = of_vectors(spark.createDataFrame(list(enumerate(rows)), "id long, v array<double>"), "id", "v")
    whole = hierarchy.hierarchical_cluster(frame).merges.orderBy("step").toPandas()
    monkeypatch.setattr(merging, "TILE", 4)
    for most in (1, 12):
        assert hierarchy.hierarchical_cluster(frame, most=most).merges.orderBy("step").toPandas().equals(whole)
    assert sorted(whole.height) == pytest.approx(sorted(hierarchy.ward(hierarchy.pair_matrix(np.array(rows)))[:, 2]), abs=1e-4)
    assert (whole.height.diff().dropna() >= 0).all() and whole["size"].iloc[-1] == len(rows)


def test_no_sums_of_all_pairs_are_stored(spark, monkeypatch):
    """More bodies than one task holds: what is written grows with the bodies, and rounding that makes many distances equal gives the tree of one task."""
    from likegraph.operators import merging

    sizes, kept = [], merging.written

    def measured(df, what):
        table = kept(df, what)
        sizes.append(sum(os.path.getsize(f.removeprefix("file:")) for f in table.inputFiles()))
        return table

    monkeypatch.setattr(merging, "written", measured)
    x = np.random.default_rng(12).normal(size=(400, 3)) * 3e-4
    frame = of_vectors(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, v array<double>"), "id", "v")
    tiled = hierarchy.tree(merging.merges_in_tiles(frame.vectors(), 250, True), 400)
    whole = hierarchy.hierarchical_cluster(frame).merges.orderBy("step").toPandas()
    assert (tiled[:, :4] == whole[["left", "right", "height", "size"]].to_numpy()).all()
    assert sizes and max(sizes) < 400 * 400 / 2  # sums of all pairs were eight times that


def test_ties_don_t_add_rounds(spark):
    """Half of all bodies equal, or near enough to be equal at five decimals, or all equally far apart: about the rounds of random ones."""
    from likegraph.operators import merging
    from likegraph.operators.pairs import of_matrix

    r = np.random.default_rng(1)
    x = r.normal(size=(600, 8))
    ones = lambda n: merging.Clusters(np.ones(n), np.zeros(n), np.arange(n))
    counted = {}
    for name in ("random", "near", "tied"):
        if name == "near":
            x[:300] = x[0] + r.normal(size=(300, 8)) * 1e-8
        sums = np.ones((600, 600)) if name == "tied" else merging.squared(of_matrix(x), of_matrix(x), True)
        counted[name] = []
        found = merging.rounds(sums, ones(600), True, counted[name])
        assert len(found) == 599 and len({b for _, b, _ in found}) == 599
    assert len(counted["near"]) < 3 * len(counted["random"]) and len(counted["tied"]) < 4 * len(counted["random"])
    x[:200] = x[0]  # exactly equal rows are one cluster before the first round
    rows = [(k, v.tolist()) for k, v in enumerate(x[:260])]
    frame = of_vectors(spark.createDataFrame(rows, "id long, v array<double>"), "id", "v")
    tiles = []
    found = merging.merges_in_tiles(frame.vectors(), 2, True, tiles)
    assert len(found) == 259 and tiles[0] == 61 and len(tiles) < 30


def test_wide_rows(spark, monkeypatch):
    """Dot products are summed over columns that fit, and blocks have the bodies whose values fit."""
    from likegraph.operators import pairs

    r = np.random.default_rng(7)
    rows = [(k, [float(v) if r.random() < 0.2 else 0.0 for v in r.normal(size=200)]) for k in range(40)] + [(40, [0.0] * 200)]
    m = np.array([v for _, v in rows])
    want = np.round(np.sqrt(((m[:, None] - m[None]) ** 2).sum(axis=2)), 5)
    frame = of_vectors(spark.createDataFrame(rows, "id long, v array<double>"), "id", "v")
    monkeypatch.setattr(pairs, "COLUMNS", 7)
    monkeypatch.setattr(pairs, "VALUES", 400)
    assert pairs.block_size(41, frame.vectors().agg(F.sum(F.size("at"))).first()[0]) < 12
    got = {(r["b1"], r["b2"]): r["dist"] for r in distance.compute_distance_matrix(frame).collect()}
    sparse = pairs.of_matrix(m)
    assert np.allclose(pairs.squares(sparse, sparse), want**2, atol=1e-3)
    assert len(got) == 41 * 20 and all(got[i, j] == pytest.approx(want[i, j], abs=1e-9) for i, j in got)


def test_a_million_columns_in_bounded_memory():
    """1,024 bodies of 2,000 values each among a million columns: dense, the two sides of a block would be 16 GB."""
    import tracemalloc

    from likegraph.operators import pairs

    r = np.random.default_rng(8)
    columns = np.concatenate([np.sort(r.choice(1_000_000, 2000, replace=False)) for _ in range(1024)])
    rows = pairs.Rows(np.arange(1025) * 2000, columns, r.normal(size=len(columns)))
    tracemalloc.start()
    got = pairs.squares(rows, rows)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 1_000_000_000 and (np.diag(got) == 0).all()
    a, b = (dict(zip(columns[k * 2000 : k * 2000 + 2000].tolist(), rows.values[k * 2000 : k * 2000 + 2000].tolist(), strict=True)) for k in (3, 900))
    assert got[3, 900] == pytest.approx(sum((a.get(c, 0) - b.get(c, 0)) ** 2 for c in {*a, *b}))


def partner_graph(spark):
    """Thirty nodes that are each other's partners."""
    rng = np.random.default_rng(3)
    nodes = [(b, None, "Anchor" if b % 2 else "Traced", False, {"F": {"pre": 5, "post": 5}}) for b in range(1, 31)]
    edges = [(a, b, int(rng.integers(3, 20)), {"F": {"post": 4}}) for a in range(1, 31) for b in range(1, 31) if a != b and (a + b) % 3 == 0]
    return graph(spark, nodes, edges)


def test_clusters_act_on_the_next_round(spark, monkeypatch):
    """Another partition gives other features: clusters are the types of the next round."""
    g, ids = partner_graph(spark), list(range(1, 31))
    got = lambda: {(r["bodyid"], r["block"], r["feature"]): r["value"] for r in workflow.refining_workflow_simple(g, ids, 5, premode="conn", iterations=1).values.collect()}
    real = got()

    class Halves:
        def __init__(self, frame):
            self.bodies = frame.bodies

        def get_partitions(self, k, return_max=False):
            part = self.bodies.select("bodyid", (F.col("bodyid") % 2).cast("int").alias("type"))
            return (part, 1.0, (None, None)) if return_max else part

    monkeypatch.setattr(workflow, "hierarchical_cluster", Halves)
    halves = got()
    assert halves != real and {f.split("#")[0] for _, _, f in halves if "#" in f} == {"c-cluster:0:1"}  # only odd partners have the status
    # by hand: ranks among the odd partners of each body and direction
    raws = features.connection_blocks(*features.connections(g, ids), use_saved_types=False, customtypes={b: f"cluster:0:{b % 2}" for b in ids})
    by_hand = scaled_process(0.5, 0.5, [0.9, 0.0, 0.1])(raws)
    assert halves == {(r["bodyid"], r["block"], r["feature"]): pytest.approx(r["value"], abs=1e-12) for r in by_hand.values.collect()}


def test_only_changed_types_are_ranked_anew(spark):
    """Ranks round by round are those of all rows at once; a type that is renamed stays, one that gains or loses a partner is sorted."""
    g = partner_graph(spark)
    who, rows = features.connections(g, list(range(1, 31)))
    partners = rows.select("partner", "saved").distinct()
    ranked = features.unranked(rows)
    odd = list(range(1, 31, 2))
    rounds = [{b: f"a{b % 3}" for b in odd}, {b: f"new{b % 3}" for b in odd}, {b: f"a{b % 3}" for b in odd if b != 7} | {7: "own"}, {b: f"a{b % 3}" for b in odd if b > 9}]
    fresh = []
    for types in rounds:
        ranked = features.rank_again(ranked, features.partner_types(partners, False, types)).persist()
        want = features.connection_blocks(who, rows, use_saved_types=False, customtypes=types).values
        key = lambda df: sorted(map(tuple, df.select("bodyid", "direction", "feature", "value").collect()))
        assert key(features.ranked_blocks(who, ranked).values) == key(want)
        fresh.append({r["kind"] for r in ranked.filter("fresh").select("kind").distinct().collect()})
        ranked = ranked.drop("kind", "fresh")
    assert fresh == [{"a0", "a1", "a2"}, set(), {"a1", "own"}, {None, "a0", "a1", "a2"}]


def test_cuts_of_trees_of_any_shape(spark, monkeypatch):
    """A chain, halves, and equal rows: cuts by tables are those of walking up, with links sent and with links joined."""
    r = np.random.default_rng(9)
    rows = [[float(3**k), 0.0] for k in range(9)] + [[float(x), 50.0] for x in r.normal(size=8)] + [[7.0, 7.0]] * 6
    frame = of_vectors(spark.createDataFrame(list(enumerate(rows)), "id long, v array<double>"), "id", "v")
    tree = hierarchy.hierarchical_cluster(frame)
    n, merges = len(rows), tree.merges.orderBy("step").collect()
    for most in (10**6, 0):
        monkeypatch.setattr(hierarchy, "MOST_SENT", most)
        for parts in (1, 4, 11) if most else (4,):
            up = {}
            for m in merges[: n - parts]:
                up[m["left"]] = up[m["right"]] = n + m["step"]
            tops = []
            for k in range(n):
                while k in up:
                    k = up[k]
                tops.append(k)
            want = {k: list(dict.fromkeys(tops)).index(t) for k, t in enumerate(tops)}
            part, width, pair = tree.get_partitions(parts, return_max=True)
            assert {x["bodyid"]: x["type"] for x in part.collect()} == want
            assert width == pytest.approx(max(math.dist(rows[i], rows[j]) for i in range(n) for j in range(n) if tops[i] == tops[j]))
            assert width == pytest.approx(math.dist(rows[pair[0]], rows[pair[1]]))


def test_only_own_tables_are_dropped(spark, tmp_path):
    from likegraph.stored import drop_written, written

    spark.range(3).write.parquet(str(tmp_path / "input"))
    with pytest.raises(ValueError):
        drop_written(spark.read.parquet(str(tmp_path / "input")))
    assert spark.read.parquet(str(tmp_path / "input")).count() == 3
    own = written(spark.range(2).toDF("a"), "own")
    drop_written(own)
    assert not any((tmp_path / "own").glob("*"))


def test_nearest_by_pivots(spark):
    """Groups, equal bodies, one far off and one of zeros: the matches of all pairs, and most pairs of blocks never met."""
    from likegraph.operators import pairs, pivots

    r = np.random.default_rng(10)
    centres = r.normal(0, 40, (12, 5))
    vectors = np.concatenate([c + r.normal(size=(40, 5)) for c in centres] + [np.tile(centres[3] + 1, (30, 1)), [[900.0] * 5], np.zeros((1, 5))])
    frame = of_vectors(spark.createDataFrame([(3 * k, v.tolist()) for k, v in enumerate(vectors)], "id long, v array<double>"), "id", "v")
    apart = lambda x, y: distance.to_five(np.sqrt(pairs.squares(x.vectors, y.vectors)))
    counted = {}
    key = lambda df: sorted(map(tuple, df.select("bodyid", "dist", "lo", "hi", "other").collect()))
    got = key(pivots.nearest_by_pivots(frame, apart, 16, 8, counted))
    assert got == key(pairs.nearest(distance.placed(frame, None), apart)) and len(got) == len(vectors)
    assert counted["met"] < 0.4 * counted["all"]
    random, _ = random_frame(spark, 90, width=20, seed=4)  # nothing can be ruled out, and nothing is lost
    match = lambda m: sorted(map(tuple, distance.get_strongest_matches(random, pivots_from=m).collect()))
    assert match(1) == match(10**6)


def test_lloyd(spark):
    """Steps by hand, with a centre that loses its bodies and a feature that only some have."""
    r = np.random.default_rng(11)
    x = np.where(r.random((60, 9)) < 0.5, r.normal(0, 3, (60, 9)), 0.0)
    x[2] = x[1] = x[0]  # equal seeds: the first takes all
    frame = of_vectors(spark.createDataFrame(list(enumerate(x.tolist())), "id long, v array<double>"), "id", "v")
    centres = x[:5].copy()
    for _ in range(50):
        d = ((x[:, None] - centres[None]) ** 2).sum(axis=2)
        own = np.round(d, 9).argmin(axis=1)
        new = np.array([x[own == k].mean(axis=0) if (own == k).any() else centres[k] for k in range(5)])
        if ((new - centres) ** 2).sum() <= 1e-4:
            break
        centres = new
    got = {r["bodyid"]: r["type"] for r in kmeans.lloyd(frame, frame.bodies.orderBy("pos").limit(5), 50).collect()}
    assert got == dict(enumerate(np.round(((x[:, None] - new[None]) ** 2).sum(axis=2), 9).argmin(axis=1).tolist()))


def test_pairs_told_apart(spark):
    """A cluster of a third of all bodies, labels of many and of few bodies: all pairs that differ, once."""
    r = np.random.default_rng(12)
    rows = [(k, str(k % 3) if k < 90 else f"c{k}", "big" if k % 2 else f"o{r.integers(12)}") for k in range(140)]
    both = spark.createDataFrame(rows, "bodyid long, c string, o string")
    want = sorted((a, b) for a, ca, oa in rows for b, cb, ob in rows if a < b and ca == cb and oa != ob)
    for size in (4, 256):
        assert sorted(map(tuple, evaluate._told_apart(both, size).collect())) == want


def test_labels_that_some_bodies_lack(spark):
    some = spark.createDataFrame([(1, "a")], "bodyid long, type string")
    got = explore.with_labels(spark.createDataFrame([(1,), (2,)], "bodyid long"), some, None)
    assert sorted(map(tuple, got.collect())) == [(1, "a", None), (2, None, None)]
    frame = FeatureFrame(bodies(spark, [1, 2]), spark.createDataFrame([(1, "b", "f", 2.0)], "bodyid long, block string, feature string, value double"))
    assert [(r["bodyid"], r["type"], r["value"]) for r in explore.features_radarchart(frame, some).collect()] == [(2, None, 0.0), (1, "a", 2.0)]


def test_kmeans_fits_over_a_table(spark):
    """Spark ML samples and ends early: below it there is no Python and no join whose sorted rows may be gone by then."""
    frame = of_vectors(spark.createDataFrame([(k, [float(k % 3), float(k)]) for k in range(30)], "id long, v array<double>"), "id", "v")
    rows = kmeans.kmeans_cluster(frame, 3).rows
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and "Join" not in plan and rows.count() == 30


def test_blocks_are_sent_a_few_times(spark, monkeypatch):
    """However many bodies there are, a block goes to about a dozen others, and pieces meet inside: the same pairs, nearest and tree."""
    from likegraph.operators import pairs

    assert -(-10**6 // pairs.part_size(10**6)) <= 12 and -(-(10**6) // pairs.part_size(10**6, 64 * 10**6)) <= 64
    r = np.random.default_rng(3)
    x = r.normal(size=(150, 4))
    frame = of_vectors(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, v array<double>"), "id", "v")
    monkeypatch.setattr(pairs, "BLOCK", 7)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    assert {(r["b1"], r["b2"]): r["dist"] for r in distance.compute_distance_matrix(frame).collect()} == {(i, j): pytest.approx(d[i, j], abs=1e-5) for i in range(150) for j in range(i + 1, 150)}
    np.fill_diagonal(d, np.inf)
    assert {r["bodyid"]: r["match"] for r in distance.get_strongest_matches(frame).collect()} == dict(enumerate(d.argmin(axis=1).tolist()))
    whole, tiled = (hierarchy.hierarchical_cluster(frame, most=m).merges.drop("height").orderBy("step").collect() for m in (4096, 20))
    assert [(*r[:4], round(r[4], 9), *r[5:]) for r in whole] == [(*r[:4], round(r[4], 9), *r[5:]) for r in tiled]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_graph_of_colliding_numbers(spark, tmp_path):
    """Line items move to their supplier once; suppliers that have numbers of products and customers, and types beyond the known ones, give the SQL's edges and nodes."""
    import duckdb

    from likegraph.queries import QUERIES
    from likegraph.sources.tables import graph_of_tables
    from likegraph.sql import SQL

    source, con = "/root/testdata/sf0.001", duckdb.connect()
    change = {
        "lineitem": "select * replace (case l_suppkey % 3 when 0 then 1000110 + l_suppkey % 40 when 1 then 2000010 + l_suppkey % 40 else l_suppkey end as l_suppkey, case when l_orderkey % 7 > 0 then l_linestatus end as l_linestatus)",
        "customer": "select * replace (case when c_custkey % 4 > 0 then c_mktsegment when c_custkey % 8 > 0 then 'OTHER' end as c_mktsegment)",
    }
    for name in ("supplier", "customer", "part", "orders", "lineitem", "nation", "region"):
        con.sql(f"copy ({change.get(name, 'select *')} from '{source}/{name}.parquet') to '{tmp_path}/{name}.parquet' (format parquet)")
        con.sql(f"create view {name} as select * from '{tmp_path}/{name}.parquet'")
    for query in ("graph_edges", "graph_nodes_roi"):
        rows = QUERIES[query](spark, str(tmp_path))
        columns = ", ".join(rows.columns)
        assert sorted(map(tuple, rows.collect())) == sorted(con.sql(f"select {columns} from ({SQL[query]})").fetchall())
    edges = graph_of_tables(spark, str(tmp_path)).edges
    assert "hashpartitioning(s#" in edges._jdf.queryExecution().executedPlan().toString()
    spark.catalog.clearCache()


def test_embeddings_in_parts(spark):
    """Neighbours of many blocks and pieces are those of all distances, ties and equal rows included; every pair pushes; groups stay apart, and t-SNE ends near where one task ends."""
    from likegraph.operators import layout

    r = np.random.default_rng(3)
    vectors = np.concatenate([r.normal(6 * g, 1, (100, 5)) for g in range(3)])
    vectors[120:140] = vectors[100]
    frame = of_vectors(spark.createDataFrame([(1000 - k, [float(x) for x in v]) for k, v in enumerate(vectors[::-1])], "id long, v array<double>"), "id", "v")
    order = np.array([701 + k for k in range(300)])
    assert [x["bodyid"] for x in frame.bodies.orderBy("pos").collect()] == order.tolist()
    near = layout.nearest_table(frame.vectors(), 300, 1500, 20)
    at, far = reduce.neighbours(vectors, 20)
    rows = near.orderBy("piece").collect()
    assert len(rows) == 5
    got = np.concatenate([np.frombuffer(x["far"], "<f8").reshape(-1, 20) for x in rows])
    assert np.abs(got - far).max() < 1e-6
    assert (np.concatenate([np.frombuffer(x["at"], "<i4").reshape(-1, 20) for x in rows]) == at)[100:].mean() > 0.99

    y = r.normal(0, 12, (500, 2))
    d = y[:, None] - y[None]
    q = 1 / (1 + (d**2).sum(axis=2))
    push, total = layout.repulsion(y)
    exact = (q[..., None] ** 2 * d).sum(axis=1)
    assert abs(total / (q.sum() - 500) - 1) < 0.01 and np.linalg.norm(push - exact) < 0.04 * np.linalg.norm(exact)

    for methods in ([("tsne", {"perplexity": 12.0, "rounds": 300})], [("fuzzy", {"seed": 0, "rounds": 60}), ("fuzzy", {"seed": 1, "rounds": 60})]):
        got = reduce.embedding(frame, methods, most=100).orderBy("bodyid").collect()
        assert [x["bodyid"] for x in got] == order.tolist()
        for m in range(len(methods)):
            y = np.array([x["coords"][m] for x in got])
            d = np.sqrt(((y[:, None] - y[None]) ** 2).sum(axis=2))
            np.fill_diagonal(d, np.inf)
            assert np.isfinite(y).all() and (d.argmin(axis=1) // 100 == np.arange(300) // 100).all()


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_plans_stay_small(spark):
    """What reads a frame of the tables' graph has no plan of that graph or of raw features in its own, nor anything cached; a frame that is released leaves no files."""
    from likegraph.queries import QUERIES, _conn

    frame = _conn(spark, "/root/testdata/sf0.001")
    for rows in (explore.find_max_differences(frame, 1, 2), distance.find_closest_neurons(1, frame), QUERIES["non_iterative"](spark, "/root/testdata/sf0.001")):
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "InMemoryTableScan" not in plan and "lineitem" not in plan and len(plan) < 200_000
    files = [f.removeprefix("file://") for f in frame.values.inputFiles()]
    assert files and all(map(os.path.exists, files))
    frame.release()
    assert not any(map(os.path.exists, files))


def test_dense_scores_apart(spark):
    """Distances between bodies with scores in all columns come from the few values that are stored, and are those of the dense rows; equal bodies, empty ones and constant columns included."""
    r = np.random.default_rng(5)
    rows = [(b, d, f"f{c}", float(r.integers(1, 9))) for b in range(1, 31) for d in ("in", "out") for c in r.choice(300, 6, replace=False)]
    rows += [(32, d, f, v) for b, d, f, v in rows if b == 7] + [(b, "in", "all", 2.0) for b in range(1, 33) if b != 31]
    frame = scaled_process(0.5, 0.5, [0.4, 0.4, 0.2])(raw(spark, rows, 33))
    dense = FeatureFrame(frame.bodies, frame.values)
    assert frame.stored() < dense.stored() / 10
    got, want = ({(x["b1"], x["b2"]): x["dist"] for x in distance.compute_distance_matrix(f, exact=True).collect()} for f in (frame, dense))
    assert got.keys() == want.keys() and len(want) == 33 * 32 // 2 and got[31, 33] == got[7, 32] == 0
    assert max(abs(got[k] ** 2 - want[k] ** 2) for k in want) < 1e-12
    first, second = (hierarchy.hierarchical_cluster(f).merges.select("left", "right", "height").orderBy("step").collect() for f in (frame, dense))
    assert first == second
