"""Near vectors and hard negatives, against all pairs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from likegraph.llm import hard_negatives, near_vectors, queries
from likegraph.workers import let_workers_import

SCHEMA = "vec_id long, embedding array<float>, label int"


@pytest.fixture(scope="module", autouse=True)
def workers(spark):
    let_workers_import(spark)


def some_vectors(n=400, d=24, seed=2):
    """Unrelated vectors, chains and groups of near ones, equal rows, scaled ones, ties, and odd rows."""
    r = np.random.default_rng(seed)
    x = r.standard_normal((n, d))
    for i in range(0, 60):  # a group of near copies of one vector, all of one label
        x[i] = x[0] + r.standard_normal(d) * 0.08
    for i in range(100, 130):  # a chain
        x[i] = x[i - 1] + r.standard_normal(d) * 0.25
    x[200:230] = x[200]
    x[231] = 3 * x[230]
    rows = [(i, [float(v) for v in x[i]], 1 if i < 130 else int(r.integers(3))) for i in range(n)]
    for i in range(200, 230):
        rows[i] = (i, rows[200][1], i % 2)
    rows += [(n, None, 1), (n + 1, rows[0][1], None), (n + 2, [0.0] * d, 1), (n + 3, [float("nan")] + [0.5] * (d - 1), 1), (n + 4, [None] + [0.5] * (d - 1), 1), (n + 5, [math.inf] * d, 1), (n + 6, [], 1), (n + 7, rows[1][1][:5], 1), (n + 8, rows[1][1][:5], 1), (5, rows[5][1], 1), (7, rows[300][1], 2), (None, rows[3][1], 1), (None, rows[200][1], 0)]
    return rows


def usable(v):
    return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v)


def all_pairs(rows, cosine=0.93):
    """(vec_id, n_links, component_id, kept) of every row."""
    at = [i for i, (_, v, k) in enumerate(rows) if k is not None and usable(v) and any(v)]
    f = {i: np.array(rows[i][1], np.float32).astype(float) for i in at}
    near = {i: [j for j in at if j != i and rows[i][2] == rows[j][2] and len(f[i]) == len(f[j]) and f[i] @ f[j] >= cosine * np.linalg.norm(f[i]) * np.linalg.norm(f[j])] for i in at}
    out = []
    for i, (vec, _, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in near.get(todo.pop(), []):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        least = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out.append((vec, len(near.get(i, [])), least, vec == least))
    return out


def ordered(rows):
    return sorted(rows, key=lambda t: tuple((x is None, x or 0) for x in t))


@pytest.mark.parametrize(("bucket", "block"), [(8192, 1024), (40, 16)])
def test_near_vectors(spark, monkeypatch, bucket, block):
    """All in one bucket, and in many tables of small ones."""
    monkeypatch.setattr(near_vectors, "BLOCK", block)
    rows = some_vectors()
    table = spark.createDataFrame(rows, SCHEMA).withColumns({"c": F.lit(1), "n": F.lit(2), "root": F.lit("x"), "h1": F.lit(0)}).repartition(3)
    got = near_vectors.near_vectors(table, bucket=bucket)
    assert [c for c, _ in got.dtypes] == ["vec_id", "n_links", "component_id", "kept"]
    assert ordered(map(tuple, got.collect())) == ordered(all_pairs(rows))


def test_near_vectors_of_nothing(spark):
    assert near_vectors.near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0
    assert [tuple(r) for r in near_vectors.near_vectors(spark.createDataFrame([(4, None, 1)], SCHEMA)).collect()] == [(4, 0, 4, True)]


def test_estimates_are_unbiased_and_bounded():
    r = np.random.default_rng(1)
    d, n = 64, 3000
    unit = lambda x: x / np.linalg.norm(x, axis=1)[:, None]
    a = unit(r.standard_normal((n, d)))
    z = r.standard_normal((n, d))
    z = unit(z - (z * a).sum(axis=1)[:, None] * a)
    for cosine in (0.0, 0.5, 0.93, 0.99):
        b = cosine * a + math.sqrt(1 - cosine**2) * z
        x, y = near_vectors.code(a), near_vectors.code(b)
        got = np.concatenate([np.diag(near_vectors.estimate({k: v[i : i + 100] for k, v in x.items()}, {k: v[i : i + 100] for k, v in y.items()}, d)) for i in range(0, n, 100)])
        assert abs(got.mean() - cosine) < 0.01
        if cosine >= 0.93:
            least = np.concatenate([np.diag(near_vectors.least_estimate({k: v[i : i + 100] for k, v in x.items()}, {k: v[i : i + 100] for k, v in y.items()}, d, 0.93)) for i in range(0, n, 100)])
            assert (got >= least).all()
        elif cosine == 0.0:
            assert (got < 0.6).all()  # what has nothing in common is never worked out


def test_tables_miss_few():
    """Pairs at the threshold share a key as often as is promised."""
    r = np.random.default_rng(3)
    d, bits = 64, 8
    t = near_vectors.tables_for(bits, 0.93, 1e-6)
    a = r.standard_normal((4000, d))
    a /= np.linalg.norm(a, axis=1)[:, None]
    z = r.standard_normal((4000, d))
    z -= (z * a).sum(axis=1)[:, None] * a
    z /= np.linalg.norm(z, axis=1)[:, None]
    keys = [(x @ near_vectors.planes(d, t, bits) > 0).reshape(len(x), t, bits) for x in (a, 0.93 * a + math.sqrt(1 - 0.93**2) * z)]
    assert (keys[0] == keys[1]).all(axis=2).any(axis=1).all()


def mined(rows):
    """The query by hand: integers, and labels moved on by one for every seventh id."""
    own = []
    for i, v, k in rows:
        if i is not None and k is not None and usable(v):
            own.append((i, (k + 1) % 10 if i % 7 == 0 else k, [math.floor(256 * float(np.float32(x))) for x in v]))
    score = lambda x, y: sum(a * b for a, b in zip(x, y, strict=True))
    out = []
    for n, (a, la, va) in enumerate(own):
        if a % 100:
            continue
        pairs = sorted(((-score(va, v), i, m, k) for m, (i, k, v) in enumerate(own) if m != n and len(v) == len(va)))
        for s, p, _, _ in [x for x in pairs if x[3] == la][:5]:
            far = [x for x in pairs if x[3] != la and 30 * -s <= 100 * -x[0] <= 90 * -s][:10]
            out += [(a, p, rank + 1, q, -s, -t) for rank, (t, q, _, _) in enumerate(far)]
    return out


@pytest.mark.parametrize("small", [False, True])
def test_hard_negatives(spark, tmp_path, monkeypatch, small):
    """Whole query, with one block of anchors and with blocks of two, batches that fill and candidates ranked at once."""
    if small:
        monkeypatch.setattr(hard_negatives, "ANCHORS", 2)
    rows = some_vectors(700) + [(800 + i, [1.0] * 24, i % 4) for i in range(40)]
    spark.createDataFrame(rows, SCHEMA).withColumns({"r": F.lit(1), "d": F.lit(2), "goal": F.lit(3)}).repartition(3).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = queries.op13_hard_negatives(spark, str(tmp_path))
    assert got.dtypes == [("anchor_id", "bigint"), ("positive_id", "bigint"), ("rank", "int"), ("negative_id", "bigint"), ("positive_score", "bigint"), ("negative_score", "bigint")]
    assert sorted(map(tuple, got.collect())) == sorted(mined(rows))


def test_hard_negatives_of_nothing(spark):
    assert hard_negatives.mine(spark.createDataFrame([], SCHEMA)).count() == 0


def test_products_end_early():
    """Few pairs out of reach are worked out, and none within reach is lost."""
    r = np.random.default_rng(4)
    v = np.floor(256 * (r.standard_normal((500, 32)) * np.geomspace(2, 0.05, 32))).astype(np.int64)
    turn = np.linalg.eigh(v.T.astype(float) @ v)[1][:, ::-1]
    t = hard_negatives.Turned(v, turn)
    whole = v @ v.T
    least = np.sort(whole, axis=1)[:, -6].astype(float)
    seen = []
    i, j = hard_negatives.survivors(t, np.arange(500), t, np.ones((500, 500), bool), least, np.full(500, np.inf), seen)
    alive = np.zeros((500, 500), bool)
    alive[i, j] = True
    assert alive[whole >= least[:, None]].all() and alive.sum() < 0.1 * alive.size
    assert seen == sorted(seen, reverse=True)


def test_products_that_need_more_bits():
    with pytest.raises(OverflowError):
        hard_negatives.products(np.array([[1 << 40]]), np.array([[1 << 40]]))
