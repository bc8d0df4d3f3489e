"""The k most similar vectors of every vector: a forest of random-projection trees searched through a shared priority queue.

Two levels of trees. A routing tree, sent to every task, cuts the space into shards of about `shard_rows` rows; each vector is indexed in
its home shard and travels as a query to the further shards that the routing queue ranks next (margin to the splitting planes
within `tau`, fitted so that `mean_probes` shards are visited on average). A row walks down the tree only where a margin is within
tau, so routing costs the logarithm of the number of shards.
In a shard a local forest is grown over all its rows. The priority of a leaf is the smallest margin on its path; the queue is
shared by all trees, so a query opens the `probes` best leaves of the whole forest. Popping a best-first queue visits leaves in
exactly the order of that priority, as it never rises along a path, hence the queue is evaluated for a block of queries at once
with matrix products. Candidates are reranked by exact cosine in double precision.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut_lineage, small

NEIGHBOR = "array<struct<d:double,id:string>>"


# ---------------------------------------------------------------- vectors as bytes


def pack(x: np.ndarray) -> np.ndarray:
    """float32 rows as bytes, all first bytes of a row before all second bytes and so on: the block compression of a shuffle then
    finds the redundancy of short mantissas and narrow exponents. Lossless."""
    return np.ascontiguousarray(x, dtype="<f4").view(np.uint8).reshape(len(x), -1, 4).transpose(0, 2, 1).reshape(len(x), -1)


def unpack(b: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(b.reshape(len(b), 4, -1).transpose(0, 2, 1)).view("<f4").reshape(len(b), -1)


def matrix(col: pa.ListArray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the usable vectors (`dim` finite numbers, not all zero) and their values."""
    n = len(col)
    size = np.asarray(col.value_lengths().fill_null(-1))
    at = np.flatnonzero(size == dim)
    if not len(at):
        return at, np.empty((0, dim), np.float32)
    flat = col.values
    starts = np.asarray(col.offsets)[:n][at]
    take = (starts[:, None] + np.arange(dim)).ravel()
    values = flat.cast(pa.float32()).to_numpy(zero_copy_only=False)[take].reshape(-1, dim)
    good = np.isfinite(values).all(1) & (values != 0).any(1)
    return at[good], np.ascontiguousarray(values[good])


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1. The largest element is divided out first, so that tiny and huge vectors keep their direction."""
    x = x.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


# ---------------------------------------------------------------- trees


def direction(sample: np.ndarray, rng: np.random.Generator, rounds: int = 6) -> np.ndarray:
    """Normal of a plane between two random centres, moved a few rounds to the means of their sides; random where all rows are equal."""
    u, v = sample[rng.integers(0, len(sample), 2)]
    for _ in range(rounds):
        left = sample @ (u - v) >= 0.5 * (u @ u - v @ v)
        if left.all() or not left.any():
            break
        u, v = sample[left].mean(0), sample[~left].mean(0)
    w = u - v
    size = np.linalg.norm(w)
    if size < 1e-9:
        w = rng.standard_normal(sample.shape[1])
        size = np.linalg.norm(w)
    return (w / size).astype(np.float32)


def split_at(p: np.ndarray, share: float, slack: float) -> tuple[np.ndarray, int, float]:
    """Order of the projections p, the first position right of the split and the threshold: the widest gap within `slack` of the share."""
    order = np.argsort(p, kind="stable")
    s, n = p[order], len(p)
    if n < 2:
        return order, n, float(s[-1]) if n else 0.0
    lo, hi = max(0, int((share - slack) * n)), min(n - 1, int((share + slack) * n))
    gaps = np.diff(s[lo : hi + 1])
    h = lo + int(np.argmax(gaps)) + 1 if len(gaps) else max(1, min(n - 1, int(share * n)))
    return order, h, float((s[h] + s[h - 1]) / 2)


class Router:
    """A tree with `leaves` leaves over the space, fitted on a bounded sample. A plane is (normal, threshold, left, right); a leaf is the
    complement of its number."""

    def __init__(self, sample: np.ndarray, leaves: int, seed: int = 17):
        self.planes: list[tuple] = []
        self.leaves, self.tau = 0, -1.0
        rng = np.random.default_rng(seed)

        def grow(idx: np.ndarray, n: int) -> int:
            if n == 1:
                self.leaves += 1
                return ~(self.leaves - 1)
            share = (n // 2) / n
            if len(idx) < 2:
                w, t, left = direction(sample if len(sample) else np.ones((1, 1), np.float32), rng), 0.0, np.zeros(len(idx), bool)
            else:
                w = direction(sample[idx], rng)
                p = sample[idx] @ w
                _, _, t = split_at(p, share, 0.12)
                left = p < t
            at = len(self.planes)
            self.planes.append(())
            self.planes[at] = (w, np.float32(t), grow(idx[left], n // 2), grow(idx[~left], n - n // 2))
            return at

        self.root = grow(np.arange(len(sample)), max(1, leaves))

    def graft(self, trees: dict[int, Router]) -> None:
        """Puts a tree in the place of leaves; other leaves stay. Leaves are numbered anew."""
        planes, count = list(self.planes), 0
        placed: dict[int, int] = {}
        for leaf in range(self.leaves):
            tree = trees.get(leaf)
            if tree is None or not tree.planes:
                placed[leaf] = ~count
                count += 1
                continue
            base, first = len(planes), count
            move = lambda c, base=base, first=first: ~(~c + first) if c < 0 else c + base
            planes += [(w, t, move(a), move(b)) for w, t, a, b in tree.planes]
            placed[leaf] = base + tree.root
            count += tree.leaves
        for i, (w, t, a, b) in enumerate(planes[: len(self.planes)]):
            planes[i] = (w, t, placed[~a] if a < 0 else a, placed[~b] if b < 0 else b)
        self.root = placed[0] if self.root < 0 else self.root
        self.planes, self.leaves = planes, count

    def visit(self, x: np.ndarray, tau: float | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, leaf, home): every row's own leaf, and the leaves whose margin, the smallest on their path, is within tau. Margins only fall on the way down, so
        a subtree beyond tau is not entered: the cost of a row is the depth of the leaves it visits, not their number in the tree."""
        tau = np.float32(self.tau if tau is None else tau)
        out: list[tuple] = []
        todo = [(self.root, np.arange(len(x)), np.full(len(x), np.inf, np.float32), np.ones(len(x), bool))]
        while todo:
            node, rows, p, home = todo.pop()
            if node < 0:
                out.append((rows, np.full(len(rows), ~node, np.int32), home))
                continue
            w, t, a, b = self.planes[node]
            m = x[rows] @ w - t
            for child, q, own in ((a, np.minimum(p, -m), home & (m < 0)), (b, np.minimum(p, m), home & (m >= 0))):
                go = own | (q > -tau)
                if go.any():
                    todo.append((child, rows[go], q[go], own[go]))
        return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, bool))

    def fit_tau(self, sample: np.ndarray, mean_probes: float, rounds: int = 14) -> None:
        """The margin within which the rows of the sample visit `mean_probes` leaves on average, found by bisection."""
        if self.leaves < 2 or not len(sample) or mean_probes <= 1:
            return
        low, high = 0.0, 2.0  # rows and normals have length 1
        for _ in range(rounds):
            mid = (low + high) / 2
            low, high = (low, mid) if len(self.visit(sample, mid)[0]) > mean_probes * len(sample) else (mid, high)
        self.tau = low


class Forest:
    """Trees over the rows of one shard; every leaf holds about `leaf` rows."""

    def __init__(self, x: np.ndarray, trees: int, leaf: int, rng: np.random.Generator, sample: int = 256):
        self.depth = max(0, math.ceil(math.log2(max(1, len(x) / leaf))))
        self.trees = []
        for _ in range(trees):
            idx, bounds, levels = rng.permutation(len(x)), [0, len(x)], []
            for _ in range(self.depth):
                nxt, ws, ts, new = [0], [], [], np.empty_like(idx)
                for a, b in zip(bounds, bounds[1:]):
                    seg = idx[a:b]
                    if len(seg):
                        w = direction(x[seg[rng.integers(0, len(seg), min(len(seg), sample))]], rng)
                        order, h, t = split_at(x[seg] @ w, 0.5, 0.2)
                        new[a:b] = seg[order]
                    else:
                        w, h, t = np.zeros(x.shape[1], np.float32), 0, 0.0
                    nxt += [a + h, b]
                    ws.append(w)
                    ts.append(t)
                idx, bounds = new, nxt
                levels.append((np.stack(ws), np.array(ts, np.float32)))
            self.trees.append((idx, np.array(bounds), levels))

    def queue(self, q: np.ndarray) -> np.ndarray:
        """Priority of every leaf of every tree for each query."""
        out = []
        for _, _, levels in self.trees:
            p = np.full((len(q), 1), np.inf, np.float32)
            for w, t in levels:
                m = q @ w.T - t
                p = np.stack([np.minimum(p, -m), np.minimum(p, m)], 2).reshape(len(q), -1)
            out.append(p)
        return np.concatenate(out, 1)

    def members(self) -> tuple[np.ndarray, np.ndarray]:
        """Rows of each leaf, padded, and their number."""
        sizes = np.concatenate([np.diff(b) for _, b, _ in self.trees])
        width = -(-max(1, int(sizes.max())) // FOLD) * FOLD
        mem = np.full((len(sizes), width), -1, np.int32)
        at = 0
        for idx, b, _ in self.trees:
            for i in range(len(b) - 1):
                mem[at, : b[i + 1] - b[i]] = idx[b[i] : b[i + 1]]
                at += 1
        return mem, sizes


#: Scores that `largest` folds into one.
FOLD = 8


def largest(score: np.ndarray, take: int) -> np.ndarray:
    """Positions of the `take` largest of each row. They are in the `take` groups of FOLD whose own largest are largest, so long rows are
    selected from by groups first."""
    n, w = score.shape
    last = lambda s: np.argpartition(s, s.shape[1] - take, axis=1)[:, s.shape[1] - take :]
    if w % FOLD or w < 4 * FOLD * take:
        return last(score)
    groups = w // FOLD
    g = last(score.reshape(n, FOLD, groups).max(1))
    at = (g[:, None, :] + (np.arange(FOLD) * groups)[None, :, None]).reshape(n, -1)
    return np.take_along_axis(at, last(np.take_along_axis(score, at, 1)), 1)


def candidates(forest: Forest, x: np.ndarray, q: np.ndarray, probes: int, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of x in the `probes` leaves that the shared queue ranks first: the best distinct `keep` by single-precision product. x and q have rows
    of length 1."""
    mem, sizes = forest.members()
    pri = forest.queue(q)
    probes = min(probes, pri.shape[1])
    top = np.argpartition(-pri, probes - 1, axis=1)[:, :probes] if probes < pri.shape[1] else np.tile(np.arange(probes), (len(q), 1))
    flat = top.ravel()
    order = np.argsort(flat, kind="stable")
    leaves, rows, slots = flat[order], (order // probes).astype(np.int64), order % probes
    score = np.full((len(q), probes, mem.shape[1]), -3.0, np.float32)
    cut = np.flatnonzero(np.diff(leaves)) + 1
    for a, b in zip(np.r_[0, cut], np.r_[cut, len(leaves)]):
        n = sizes[leaves[a]]
        if n:
            score[rows[a:b], slots[a:b], :n] = q[rows[a:b]] @ x[mem[leaves[a], :n]].T
    score = score.reshape(len(q), -1)
    best = largest(score, min(keep * len(forest.trees), score.shape[1]))  # a row is at most once in each tree
    score, cand = np.take_along_axis(score, best, 1), mem[np.take_along_axis(top, best // mem.shape[1], 1), best % mem.shape[1]]
    order = np.argsort(cand, axis=1, kind="stable")
    cand, score = np.take_along_axis(cand, order, 1), np.take_along_axis(score, order, 1)
    again = np.zeros(cand.shape, bool)
    again[:, 1:] = cand[:, 1:] == cand[:, :-1]
    score[again | (cand < 0)] = -3.0
    take = min(keep, score.shape[1])
    if take < score.shape[1]:
        best = largest(score, take)
        score, cand = np.take_along_axis(score, best, 1), np.take_along_axis(cand, best, 1)
    return np.where(score > -2.5, cand, -1), score


# ---------------------------------------------------------------- one shard


def search_shard(table: pa.Table, dim: int, k: int, trees: int, leaf: int, probes: int, seed: int, block: int = 512) -> pa.Table:
    """Rows of one shard (ids: up to k+1 smallest ids of equal vectors, vec: bytes, home: indexed here) -> (id, nbrs)."""
    schema = pa.schema([("id", pa.string()), ("nbrs", pa.list_(pa.struct([("d", pa.float64()), ("id", pa.string())])))])
    ids = table.column("ids").combine_chunks()
    raw = unpack(np.frombuffer(b"".join(table.column("vec").to_pylist()), np.uint8).reshape(table.num_rows, -1))
    home = np.asarray(table.column("home").combine_chunks())
    # equal vectors of all batches become one; its ids are the k+1 smallest
    keys = raw.view([("", raw.dtype)] * dim).ravel()
    _, first, group = np.unique(keys, return_index=True, return_inverse=True)
    offs, names = np.asarray(ids.offsets), np.asarray(ids.values.to_pylist(), dtype=object)
    names_sorted, code = np.unique(names.astype(str), return_inverse=True)
    row_of = np.repeat(np.arange(table.num_rows), np.diff(offs))
    code = code[offs[0] : offs[-1]]
    pair = np.unique(np.stack([group[row_of], code], 1), axis=0)
    start = np.searchsorted(pair[:, 0], np.arange(len(first) + 1))
    is_home = np.zeros(len(first), bool)
    np.logical_or.at(is_home, group, home)
    exact = unit(raw[first])
    x = exact.astype(np.float32)
    idx = np.flatnonzero(is_home)
    if not len(idx):
        return schema.empty_table()
    xs = np.ascontiguousarray(x[idx])
    forest = Forest(xs, trees, leaf, np.random.default_rng(seed))
    width = np.minimum(np.diff(start), k + 1)
    out_id, out_len, out_d, out_code = [], [], [], []
    keep = k + 1 + 4
    for a in range(0, len(x), block):
        rows = np.arange(a, min(a + block, len(x)))
        cand, _ = candidates(forest, xs, x[rows], probes, keep)
        cand = np.where(cand >= 0, idx[cand], -1)
        sim = np.round(np.einsum("qd,qcd->qc", exact[rows], exact[cand]), 6)
        sim[cand < 0] = -9.0
        # ids behind each candidate, the query's own group included with similarity 1
        lone = (width[rows] == 1) & (np.where(cand >= 0, width[cand], 1) == 1).all(1)
        q = np.flatnonzero(lone)
        if len(q):
            c, s = cand[q], sim[q].copy()
            s[c == rows[q][:, None]] = -9.0
            cd = np.where(c >= 0, pair[start[np.maximum(c, 0)], 1], -1)
            own = pair[start[rows[q]], 1]
            s[cd == own[:, None]] = -9.0  # the same id under another vector
            o = np.lexsort((cd, -s), axis=1)[:, :k]
            s, cd = np.take_along_axis(s, o, 1), np.take_along_axis(cd, o, 1)
            ok = s > -5
            out_id.append(own)
            out_len.append(ok.sum(1))
            out_d.append(-s[ok])
            out_code.append(cd[ok])
        for i in np.flatnonzero(~lone):
            g = rows[i]
            best: dict[int, float] = {}
            for c, s in zip(cand[i], sim[i]):
                if c >= 0 and c != g:
                    for z in pair[start[c] : start[c] + width[c], 1]:
                        best[z] = max(s, best.get(z, -9.0))
            mine = pair[start[g] : start[g] + width[g], 1]
            for z in mine:
                best[z] = 1.0
            ranked = sorted((-s, z) for z, s in best.items())[: k + len(mine) + 1]
            for z in mine:
                got = [r for r in ranked if r[1] != z][:k]
                out_id.append(np.array([z]))
                out_len.append(np.array([len(got)]))
                out_d.append(np.array([r[0] for r in got]))
                out_code.append(np.array([r[1] for r in got], dtype=np.int64))
    lens = np.concatenate(out_len)
    names_pa = pa.array(names_sorted, pa.string())
    nb = pa.StructArray.from_arrays(
        [pa.array(np.concatenate(out_d), pa.float64()), names_pa.take(pa.array(np.concatenate(out_code).astype(np.int64)))], ["d", "id"]
    )
    lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(lens)].astype(np.int32)), nb)
    who = names_pa.take(pa.array(np.concatenate(out_id).astype(np.int64)))
    return pa.Table.from_arrays([who, lists], schema=schema)


# ---------------------------------------------------------------- the operator


def similar_vectors(
    df: DataFrame,
    id_col: str,
    vec_col: str,
    dim: int,
    k: int = 10,
    shard_rows: int = 26_000,
    sample_rows: int = 16_384,
    mean_probes: float | None = None,
    trees: int = 2,
    leaf: int = 512,
    probes: int = 16,
    top_cells: int = 256,
    seed: int = 17,
) -> DataFrame:
    """(id, neighbor, similarity, rank): the k most similar vectors of each vector, by cosine rounded to 6 digits, then by id.

    Takes part: rows with a non-null id whose vector has `dim` finite numbers, not all zero. Nulls, other lengths, null elements,
    NaN and infinities are left out; an id given twice counts once, and under different vectors takes the best of them. A vector
    alone in the collection has no row. Empty table: no rows. Other columns, whatever their names, are not read.
    A leaf holds many rows, so that the leaves opened cover a crowd of some hundred vectors alike: of such a crowd small leaves see a part.
    The routing tree is fitted on about `sample_rows` rows (bounded, chosen by a hash of the id), and beyond `top_cells` shards, cell by cell,
    on 64 rows for each shard; every row is indexed. Equal
    vectors collapse within each batch before the shuffle, keeping the k+1 smallest ids; the further members of such a group are
    answered from those ids alone, as k+1 equal vectors fill any list of k.
    """
    base = df.select(F.col(id_col).cast("string").alias("id"), F.col(vec_col).cast("array<float>").alias("v")).where(
        F.col("id").isNotNull() & (F.size("v") == dim)
    )
    total = df.select(id_col).count()
    shards = max(1, math.ceil(total / shard_rows))
    router = _fit(base, dim, total, shards, shard_rows, sample_rows, top_cells, mean_probes or 1 + 0.6 * math.log2(max(2, shards)), seed)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _joined(batches, ROUTED):
            at, values = matrix(batch.column(1), dim)
            if not len(at):
                continue
            values = values + np.float32(0)  # -0.0 and 0.0 are one number
            names = np.asarray(batch.column(0).take(pa.array(at)).to_pylist(), dtype=str)
            keys = values.view([("", values.dtype)] * dim).ravel()
            _, first, group = np.unique(keys, return_index=True, return_inverse=True)
            order = np.lexsort((names, group))
            g, nm = group[order], names[order]
            fresh = np.r_[True, (g[1:] != g[:-1]) | (nm[1:] != nm[:-1])]
            g, nm = g[fresh], nm[fresh]
            starts = np.searchsorted(g, np.arange(len(first)))
            few = np.arange(len(g)) - starts[g] <= k
            g, nm = g[few], nm[few]
            offsets = np.searchsorted(g, np.arange(len(first) + 1))
            ids = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(nm, pa.string()))
            row, shard, home = router.visit(unit(values[first]).astype(np.float32))
            packed = pack(values[first])
            vec = pa.array([r.tobytes() for r in packed], pa.binary())
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [pa.array(shard), pa.array(home), ids.take(take), vec.take(take)], names=["shard", "home", "ids", "vec"]
            )

    def shard_search(table: pa.Table) -> pa.Table:
        return search_shard(table, dim, k, trees, leaf, probes, seed)

    routed = base.mapInArrow(route, "shard int, home boolean, ids array<string>, vec binary")
    if shards > 1:  # a task for each shard, but for the few whose numbers fall together
        routed = routed.repartition(3 * router.leaves, "shard")
    found = routed.groupBy("shard").applyInArrow(shard_search, f"id string, nbrs {NEIGHBOR}")
    merged = _merge(found, k).select("id", F.posexplode("nbrs").alias("at", "n"))
    direct = merged.select("id", F.col("n.id").alias("neighbor"), (-F.col("n.d")).alias("similarity"), (F.col("at") + 1).alias("rank"))
    crowded = _crowded(base, k)
    return direct if crowded is None else direct.unionByName(crowded)


#: Rows that are routed together: a tree of many planes is walked once for all of them.
ROUTED = 50_000


def _joined(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Batches put together until they have at least so many rows."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= rows:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def _sample(base: DataFrame, rate: float, salt: int) -> DataFrame:
    return base.where(F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(1_000_000)) < math.ceil(rate * 1_000_000)).select("v")


def _units(col: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    values = matrix(col, dim)[1] if len(col) else np.empty((0, dim), np.float32)
    return unit(values).astype(np.float32) if len(values) else np.empty((0, dim), np.float32)


def _fit(base: DataFrame, dim: int, total: int, shards: int, shard_rows: int, sample_rows: int, top_cells: int, mean_probes: float, seed: int) -> Router:
    """The routing tree. Its first `top_cells` leaves are fitted on a bounded sample on the driver. Where more shards are wanted, each of them is
    split by a tree of its own, fitted by a task on about SPLIT_ROWS rows for each of its shards, with shards in proportion to what it holds;
    the driver gets the planes, one for each shard."""
    if shards == 1:
        return Router(np.empty((0, dim), np.float32), 1, seed)
    sample = _units(_sample(base, min(1.0, sample_rows / max(1, total)), 0).toArrow().column("v"), dim)
    if not len(sample):
        return Router(sample, 1, seed)
    router = Router(sample, min(shards, top_cells), seed)
    if shards > top_cells:
        rate = min(1.0, SPLIT_ROWS / shard_rows)

        def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in _joined(batches, ROUTED):
                x = _units(b.column(0), dim)
                row, cell, _ = router.visit(x, -1.0)
                vec = pa.array([r.tobytes() for r in x[row]], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(cell), vec], names=["cell", "vec"])

        def split(key: tuple, rows: pa.Table) -> pa.Table:
            x = np.frombuffer(b"".join(rows.column("vec").to_pylist()), np.float32).reshape(-1, dim)
            cell = key[0].as_py()
            tree = Router(x, max(1, round(len(x) / rate / shard_rows)), seed + 1 + cell)
            return pa.table({"cell": pa.array([cell], pa.int32()), "tree": pa.array([pickle.dumps((tree.planes, tree.root, tree.leaves))], pa.binary())})

        parts = _sample(base, rate, 1).mapInArrow(cells, "cell int, vec binary").groupBy("cell").applyInArrow(split, "cell int, tree binary")
        trees = {}
        for r in parts.collect():  # at most top_cells rows
            tree = Router.__new__(Router)
            tree.planes, tree.root, tree.leaves = pickle.loads(r["tree"])
            trees[r["cell"]] = tree
        router.graft(trees)
    router.fit_tau(sample, mean_probes)
    return router


#: Rows of the second sample for each shard.
SPLIT_ROWS = 64


def _merge(found: DataFrame, k: int) -> DataFrame:
    """Lists of one id from all its shards -> its k best, each neighbor once."""
    every = F.array_sort(F.flatten(F.collect_list("nbrs")))
    merged = found.groupBy("id").agg(every.alias("all"))
    return merged.select("id", F.slice(_once(F.col("all")), 1, k).alias("nbrs"))


def _once(sorted_nbrs: Column) -> Column:
    """Keeps the first entry of each id in a sorted list; shards overlap only in queries, so repeats are rare."""
    ids = F.transform(sorted_nbrs, lambda x: x["id"])
    firsts = F.filter(sorted_nbrs, lambda x, i: F.array_position(ids, x["id"]) == i + 1)
    return F.when(F.size(F.array_distinct(ids)) < F.size(ids), firsts).otherwise(sorted_nbrs)


def _crowded(base: DataFrame, k: int, salts: int = 16) -> DataFrame | None:
    """Answers for ids beyond the k+1 smallest of a group of equal vectors: the k smallest ids of the group, similarity 1. None where there is no
    such group: then one scan of the vectors has told so."""
    top, low, inf = F.array_max("v"), F.array_min("v"), F.lit(float("inf"))
    usable = (top < inf) & (low > -inf) & ((top != 0) | (low != 0)) & (F.size(F.array_compact("v")) == F.size("v"))
    rows = base.where(usable).select(
        "id", F.struct(F.xxhash64("v"), F.hash("v")).alias("h"), F.pmod(F.hash("id"), F.lit(salts)).alias("salt")
    )
    big = cut_lineage(rows.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > k + 1).select("h"))
    if big.isEmpty():
        return None
    inside = cut_lineage(rows.join(small(big), "h", "left_semi"))
    ranked = inside.withColumn("r", F.dense_rank().over(W.partitionBy("h", "salt").orderBy("id"))).where(F.col("r") <= k + 1)
    heads = ranked.select("h", "id").distinct().withColumn("r", F.row_number().over(W.partitionBy("h").orderBy("id"))).where(F.col("r") <= k + 1)
    heads = heads.groupBy("h").agg(F.sort_array(F.collect_list("id")).alias("first")).where(F.size("first") == k + 1)
    spread = heads.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(salts)])))
    rest = inside.join(spread, ["h", "salt"]).where(F.col("id") > F.element_at("first", k + 1)).dropDuplicates(["id"])
    out = rest.select("id", F.posexplode(F.slice("first", 1, k)).alias("at", "neighbor"))
    return out.select("id", "neighbor", F.lit(1.0).alias("similarity"), (F.col("at") + 1).alias("rank"))
