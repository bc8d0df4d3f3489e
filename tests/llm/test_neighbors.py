import numpy as np
import pyarrow as pa
import pytest
from conftest import rows

from citegrid.llm.neighbors import Forest, Router, candidates, pack, similar_vectors, unit, unpack

SCHEMA = "cid string, v array<float>, id int, nbrs string"


def brute(items, k):
    best = {}
    for i, v in items:
        best.setdefault(i, []).append(np.asarray(v, np.float64) / np.linalg.norm(v))
    ids = sorted(best)
    out = set()
    for a in ids:
        got = sorted((-round(float(max(x @ y for x in best[a] for y in best[b])), 6), b) for b in ids if b != a)
        out |= {(a, b, r + 1) for r, (_, b) in enumerate(got[:k])}
    return out


def run(spark, items, k=3, **kw):
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in items], SCHEMA)
    return similar_vectors(df, "cid", "v", dim=4, k=k, **kw)


def test_small_exact(spark):
    rng = np.random.default_rng(0)
    items = [(f"c{i:03d}", [float(x) for x in rng.standard_normal(4).astype(np.float32)]) for i in range(60)]
    items += [items[3], items[5]]  # written twice
    items += [("d1", items[7][1]), ("d2", [2 * x for x in items[7][1]])]
    got = set(rows(run(spark, items), "id", "neighbor", "rank"))
    assert got == brute(items, 3)


def test_group_of_equal_vectors(spark):
    one, two = [1.0, 0.0, 0.0, 0.0], [0.0, 1.0, 0.0, 0.0]
    items = [(f"a{i:02d}", one) for i in range(30)] + [("z", two), ("y", [0.9, 0.1, 0.0, 0.0])]
    assert set(rows(run(spark, items), "id", "neighbor", "rank")) == brute(items, 3)


def test_unusable_vectors(spark):
    items = [("a", [1.0, 0.0, 0.0, 0.0]), ("b", [1.0, 1.0, 0.0, 0.0]), ("n", None), ("e", []), ("z", [0.0] * 4), ("s", [1.0]), ("m", [1.0, None, 0.0, 0.0]), ("q", [float("nan")] * 4), ("i", [float("inf"), 0.0, 0.0, 0.0]), (None, [1.0, 0.0, 0.0, 0.0])]
    assert rows(run(spark, items), "id", "neighbor", "rank") == [("a", "b", 1), ("b", "a", 1)]


@pytest.mark.parametrize("items", [[], [("a", [1.0, 0.0, 0.0, 0.0])]])
def test_empty_and_alone(spark, items):
    assert run(spark, items).count() == 0


def test_sharded_recall(spark):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((60, 4))
    items = [(f"c{i:04d}", [float(x) for x in (centres[i % 60] + 0.02 * rng.standard_normal(4)).astype(np.float32)]) for i in range(1200)]
    want = {(a, b) for a, b, _ in brute(items, 5)}
    got = {(a, b) for a, b in rows(run(spark, items, k=5, shard_rows=200, sample_rows=400), "id", "neighbor")}
    assert len(want & got) / len(want) > 0.9


def test_packing_is_lossless():
    x = np.random.default_rng(0).standard_normal((7, 5)).astype(np.float32)
    assert np.array_equal(unpack(pack(x)), x)


def test_queue_opens_every_leaf_if_asked():
    x = unit(np.random.default_rng(0).standard_normal((300, 6))).astype(np.float32)
    f = Forest(x, 2, 32, np.random.default_rng(0))
    c, _ = candidates(f, x, x[:20], 10_000, 300)
    assert all(set(r) >= set(range(300)) for r in c.tolist())


def test_router_visits_what_a_walk_over_all_planes_finds():
    x = unit(np.random.default_rng(1).standard_normal((400, 6))).astype(np.float32)
    r = Router(x, 7)
    whole = Router(x, 3)
    whole.graft({0: Router(x, 4), 2: Router(x[:0], 1)})
    assert whole.leaves == 6
    for tree in (r, whole):
        tree.fit_tau(x, 2.0)
        margins = np.full((len(x), tree.leaves), -9, np.float32)

        def walk(node, p, tree=tree, margins=margins):
            if node < 0:
                margins[:, ~node] = p
                return
            w, t, a, b = tree.planes[node]
            m = x @ w - t
            walk(a, np.minimum(p, -m))
            walk(b, np.minimum(p, m))

        walk(tree.root, np.full(len(x), np.inf, np.float32))
        row, leaf, home = tree.visit(x)
        want = margins > -tree.tau
        want[np.arange(len(x)), margins.argmax(1)] = True
        got = np.zeros_like(want)
        got[row, leaf] = True
        assert np.array_equal(got, want) and len(row) == want.sum() and 1.5 < len(row) / len(x) <= 2.0
        assert home.sum() == len(x) and np.array_equal(leaf[home][np.argsort(row[home])], margins.argmax(1))
    alone = Router(x, 1)
    alone.graft({0: Router(x, 4)})
    assert alone.leaves == 4 and alone.visit(x)[2].sum() == len(x)


def test_recall_with_trees_below_the_first_cells(spark):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((80, 4))
    items = [(f"c{i:04d}", [float(x) for x in (centres[i % 80] + 0.02 * rng.standard_normal(4)).astype(np.float32)]) for i in range(1600)]
    want = {(a, b) for a, b, _ in brute(items, 5)}
    got = {(a, b) for a, b in rows(run(spark, items, k=5, shard_rows=100, sample_rows=400, top_cells=4), "id", "neighbor")}
    assert len(want & got) / len(want) > 0.9


def test_crowds_of_similar_vectors(spark):
    """Each vector has 749 others about as near: its 10 nearest are spread over many leaves."""
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((16, 96)).astype(np.float32)
    x = np.repeat(centres / np.linalg.norm(centres, axis=1)[:, None], 750, 0)
    noise = rng.standard_normal(x.shape).astype(np.float32)
    x = (x + 0.31 * noise / np.linalg.norm(noise, axis=1)[:, None])[rng.permutation(len(x))]
    df = spark.createDataFrame(pa.table({"id": [str(i) for i in range(len(x))], "v": pa.array(list(x), pa.list_(pa.float32()))}))
    found = set(rows(similar_vectors(df, "id", "v", dim=96), "id", "neighbor"))
    u = x / np.linalg.norm(x, axis=1)[:, None]
    s = u[:1000] @ u.T
    s[np.arange(1000), np.arange(1000)] = -9
    true = {(str(i), str(j)) for i, r in enumerate(np.argpartition(-s, 10, axis=1)[:, :10]) for j in r}
    assert len(true & found) > 0.995 * len(true)
