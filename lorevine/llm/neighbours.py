"""Most similar vectors for every vector, by learned partitions.

Fitting: a bounded sample of vectors is linked to its nearest neighbours, the neighbour graph is cut into balanced parts (seeded parts grown and
refined by moving vectors to the part most of their neighbours are in, under a capacity), and a softmax classifier learns the part from the vector. Searching: the
classifier routes each vector to its likeliest part, where it can be found, and to its ``probes`` likeliest parts, where it asks; within each part all vectors that ask are compared exactly with all that can be found, in blocks, and the
best of all parts are kept.

Every vector is indexed and every vector asks; the sample only shapes the partition. Its size is ``SAMPLE_PER_PART`` vectors a part. Up to ``MAX_PARTS`` parts are fitted at once on the
driver. A larger collection is parted twice: into about the square root of the parts wanted, and each of these, in a task of its own and on its own sample, into leaves; at most
``MAX_LEAVES`` in all, which bounds the classifiers sent to the executors (about 400 bytes a leaf for 96 numbers). Parts that the sample shows to be larger than the target, or to be asked by more, are cut into blocks of bounded
size on either side, all of which are compared, so a part may hold a third of all vectors and be asked by all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorevine.runtime import cut

#: Vectors a part is meant to hold, sample vectors for each part, the most parts of one fit (so 65,536 sample vectors at most), and the most leaves.
PART_SIZE, SAMPLE_PER_PART, MAX_PARTS, MAX_LEAVES = 1500, 64, 1024, 65_536
#: Neighbours in the sample's graph, and passes of refinement.
GRAPH_K, PASSES = 8, 8
#: Parts asked for each vector.
PROBES = 3
#: Vectors in a block of a part that is larger than meant.
BLOCK = 6000


def usable(vector: Column, dims: int) -> Column:
    """Whether an array column has ``dims`` finite numbers that are not all zero."""
    return vector.isNotNull() & (F.size(vector) == dims) & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(vector, lambda x: x != 0)


def _matrix(column) -> np.ndarray:
    """Unit rows of an Arrow list column of equal lengths."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float32)
    m = flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1), np.float32)
    big = np.abs(m).max(axis=1, keepdims=True)
    m = m / np.where(big > 0, big, 1)  # numbers near the limits of float neither overflow nor vanish
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-30)


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """Indices of the ``k`` most similar other rows of each row, in blocks."""
    k = min(k, len(x) - 1)
    out = np.empty((len(x), k), dtype=np.int32)
    for at in range(0, len(x), 1024):
        s = x[at:at + 1024] @ x.T
        s[np.arange(len(s)), np.arange(at, at + len(s))] = -2
        out[at:at + len(s)] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, seed: int = 7) -> np.ndarray:
    """A part for each sample vector: balanced cells around seeds, then moves along the neighbour graph that cut fewer links, within capacity."""
    rng = np.random.default_rng(seed)
    capacity = int(np.ceil(len(x) / parts * 1.15))
    centres = x[rng.choice(len(x), parts, replace=False)]
    label = np.zeros(len(x), dtype=np.int64)
    for _ in range(6):
        sims = x @ centres.T
        order = np.argsort(-sims, axis=1)[:, :16]
        label[:] = -1
        load = np.zeros(parts, dtype=np.int64)
        # the clearest first
        for i in np.argsort(-sims[np.arange(len(x)), order[:, 0]]):
            free = order[i][load[order[i]] < capacity]
            p = free[0] if len(free) else int(np.argmin(load))
            label[i] = p
            load[p] += 1
        sums = np.zeros_like(centres)
        np.add.at(sums, label, x)
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    back = np.concatenate([np.repeat(np.arange(len(x)), graph.shape[1]), graph.ravel()])
    forth = np.concatenate([graph.ravel(), np.repeat(np.arange(len(x)), graph.shape[1])])
    order = np.argsort(back, kind="stable")
    forth, starts = forth[order], np.searchsorted(back[order], np.arange(len(x) + 1))
    load = np.bincount(label, minlength=parts)
    for _ in range(PASSES):
        moved = 0
        for i in rng.permutation(len(x)):
            near, n = np.unique(label[forth[starts[i]:starts[i + 1]]], return_counts=True)
            n = np.where((near == label[i]) | (load[near] < capacity), n, -1)
            own = n[near == label[i]]
            best = int(n.argmax())
            if n[best] > (own[0] if len(own) else 0):
                load[label[i]] -= 1
                label[i] = near[best]
                load[label[i]] += 1
                moved += 1
        if moved < len(x) / 200:
            break
    return label


def train(x: np.ndarray, label: np.ndarray, parts: int, epochs: int = 25, seed: int = 7) -> np.ndarray:
    """Weights ``(dims + 1, parts)`` of a softmax classifier, by mini-batch Adam from the parts' means."""
    rng = np.random.default_rng(seed)
    xs = np.hstack([x, np.ones((len(x), 1), np.float32)])
    w = np.zeros((xs.shape[1], parts), dtype=np.float32)
    means = np.zeros((parts, x.shape[1]), np.float32)
    np.add.at(means, label, x)
    w[:-1] = 12 * (means / np.maximum(np.linalg.norm(means, axis=1, keepdims=True), 1e-12)).T
    m, v, step = np.zeros_like(w), np.zeros_like(w), 0
    for epoch in range(epochs):
        for at in np.array_split(rng.permutation(len(x)), max(1, len(x) // 512)):
            z = xs[at] @ w
            z -= z.max(axis=1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(at)), label[at]] -= 1
            g = xs[at].T @ p / len(at) + 1e-5 * w
            step += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w -= 0.05 * 0.9**epoch * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w


def _logits(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Log-probabilities of the parts."""
    z = x @ weights[:-1] + weights[-1]
    z -= z.max(axis=1, keepdims=True)
    return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def _top(z: np.ndarray, k: int) -> np.ndarray:
    k = min(k, z.shape[1])
    top = np.argpartition(-z, k - 1, axis=1)[:, :k]
    return np.take_along_axis(top, np.argsort(-np.take_along_axis(z, top, axis=1), axis=1), axis=1)


class Router:
    """The fitted classifier, or a first one and one for the leaves of each of its parts; and, for each part or leaf, into how many blocks those that can be found in it and those that ask it are cut."""

    def __init__(self, weights: np.ndarray, blocks: np.ndarray, askers: np.ndarray, leaves: list[np.ndarray] | None = None):
        self.weights, self.blocks, self.askers, self.leaves = weights, blocks, askers, leaves
        if leaves:
            self.first = np.concatenate([[0], np.cumsum([w.shape[1] for w in leaves])])

    def parts(self, x: np.ndarray, probes: int) -> np.ndarray:
        """The ``probes`` likeliest parts of each row, likeliest first; missing ones are -1."""
        z = _logits(x, self.weights)
        top = _top(z, probes)
        if not self.leaves:
            return top
        score = np.full((len(x), top.shape[1] * probes), -np.inf)
        leaf = np.full(score.shape, -1, dtype=np.int64)
        for j in range(top.shape[1]):
            for g in np.unique(top[:, j]):
                rows = np.flatnonzero(top[:, j] == g)
                zz = _logits(x[rows], self.leaves[g])
                best = _top(zz, probes)
                at = j * probes + np.arange(best.shape[1])
                score[rows[:, None], at] = np.take_along_axis(zz, best, axis=1) + z[rows, g][:, None]
                leaf[rows[:, None], at] = self.first[g] + best
        return np.take_along_axis(leaf, _top(score, probes), axis=1)


def _fitted(x: np.ndarray, parts: int) -> np.ndarray:
    """Classifier weights of ``parts`` parts learned on ``x``."""
    if parts <= 1 or len(x) <= 2 * parts:
        return np.zeros((x.shape[1] + 1, 1), np.float32)
    return train(x, balanced_parts(x, neighbour_graph(x, GRAPH_K), parts), parts)


def _sampled(vectors: DataFrame, want: int, total: int) -> tuple[DataFrame, float]:
    """About ``want`` vectors, those whose keys hash low, and their share of all."""
    share = min(1.0, 1.05 * want / total)
    return vectors.where(F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < int(share * (1 << 30)) + 1), share


def _ordered(table) -> np.ndarray:
    x = _matrix(table.column("v").combine_chunks())
    return x[np.argsort(table.column("key").to_numpy(), kind="stable")]


def fit(vectors: DataFrame, total: int, part_size: int = PART_SIZE, probes: int = PROBES) -> Router:
    """Fit on the vectors with the smallest hashes of their keys; what comes to the driver is bounded (see the module's constants)."""
    wanted = max(1, round(total / part_size))
    parts = int(wanted if wanted <= MAX_PARTS else min(MAX_PARTS, np.ceil(np.sqrt(wanted))))
    sample, _ = _sampled(vectors, parts * SAMPLE_PER_PART, total)
    x = _ordered(sample.limit(2 * parts * SAMPLE_PER_PART).toArrow())
    router = Router(_fitted(x, parts), np.ones(1, dtype=np.int64), np.ones(1, dtype=np.int64))
    if wanted > MAX_PARTS:
        return _with_leaves(router, vectors, total, min(wanted, MAX_LEAVES), part_size, probes)
    count = router.weights.shape[1]
    at = router.parts(x, probes)
    router.blocks, router.askers = _blocks(np.bincount(at[:, 0], minlength=count) / len(x) * total), _blocks(np.bincount(at.ravel(), minlength=count) / len(x) * total)
    return router


def _blocks(expected: np.ndarray) -> np.ndarray:
    """Blocks that hold ``BLOCK`` vectors each of as many as the sample lets expect."""
    return np.maximum(1, np.ceil(expected / BLOCK)).astype(np.int64)


def _with_leaves(top: Router, vectors: DataFrame, total: int, wanted: int, part_size: int, probes: int) -> Router:
    """A router with a classifier of leaves for each part of ``top``, fitted where the part's sample lies."""
    sample, share = _sampled(vectors, wanted * SAMPLE_PER_PART, total)
    most, size = MAX_PARTS * SAMPLE_PER_PART, max(part_size, total / wanted)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                part = top.parts(_matrix(batch.column("v")), 1)[:, 0].astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(part), batch.column("key"), batch.column("v")], names=["part", "key", "v"])

    def leaves(table: pa.Table) -> pa.Table:
        here = table.num_rows / share
        x = _ordered(table.slice(0, most))
        w = _fitted(x, int(min(MAX_PARTS, max(1, round(here / size)))))
        best = _top(_logits(x, w), probes)
        # those that ask from other parts are taken to be as many as those of this one
        load, asks = np.bincount(best[:, 0], minlength=w.shape[1]) / len(x) * here, np.bincount(best.ravel(), minlength=w.shape[1]) / len(x) * 2 * here
        return pa.table({"part": table.column("part").slice(0, 1), "weights": [w.astype(np.float32).tobytes()], "load": [load.astype(np.float64).tobytes()], "asks": [asks.astype(np.float64).tobytes()]})

    fitted = sample.select("key", "v").mapInArrow(assign, "part long, key long, v array<float>").groupBy("part").applyInArrow(leaves, "part long, weights binary, load binary, asks binary")
    dims = top.weights.shape[0]
    models = [np.zeros((dims, 1), np.float32)] * top.weights.shape[1]
    loads, asks = [np.zeros(1)] * top.weights.shape[1], [np.zeros(1)] * top.weights.shape[1]
    for row in fitted.collect():  # one row for each part, at most MAX_LEAVES classifier columns in all
        models[row.part] = np.frombuffer(row.weights, dtype=np.float32).reshape(dims, -1)
        loads[row.part], asks[row.part] = np.frombuffer(row.load, dtype=np.float64), np.frombuffer(row.asks, dtype=np.float64)
    return Router(top.weights, _blocks(np.concatenate(loads)), _blocks(np.concatenate(asks)), models)


_ROUTED = pa.schema([("part", pa.int64()), ("key", pa.int64()), ("owner", pa.int64()), ("asks", pa.int8()), ("v", pa.binary())])


def _route(shared, probes: int):
    """Rows of a grid for each part, blocks of askers by blocks of what can be found: one in each cell where a vector can be found, and one in each where it asks; both in one row where they meet."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        router = shared.value
        base = np.concatenate([[0], np.cumsum(router.blocks * router.askers)])
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("v"))
            key, owner = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "owner"))
            at = router.parts(x, probes)
            raw = pa.array([r.tobytes() for r in x], pa.binary())
            mixed = (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
            part, row, asks = [], [], []
            for j in range(at.shape[1]):
                blocks, askers = (np.where(at[:, j] >= 0, n[at[:, j]], 0) for n in (router.blocks, router.askers))  # no such part, no row
                found, asking = mixed % np.maximum(blocks, 1), mixed // 7919 % np.maximum(askers, 1)
                for b in range(int(blocks.max())):
                    has = np.flatnonzero(blocks > b)
                    part.append(base[at[has, j]] + asking[has] * blocks[has] + b)
                    row.append(has)
                    asks.append(np.where((j == 0) & (found[has] == b), 2, 1))
                if j == 0:
                    for a in range(int(askers.max())):
                        has = np.flatnonzero((askers > a) & (asking != a))
                        part.append(base[at[has, 0]] + a * blocks[has] + found[has])
                        row.append(has)
                        asks.append(np.zeros(len(has), np.int64))
            part, row, asks = np.concatenate(part), np.concatenate(row), np.concatenate(asks)
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(key[row]), pa.array(owner[row]), pa.array(asks.astype(np.int8)), raw.take(pa.array(row))], schema=_ROUTED)
    return run


def best_in_block(q: np.ndarray, q_key: np.ndarray, q_owner: np.ndarray, x: np.ndarray, x_key: np.ndarray, x_owner: np.ndarray, k: int, least: float):
    """Of ``x`` (sorted by key) the ``k`` most similar to each ``q`` with another owner and similarity ``>= least``; ties to the smaller key."""
    out_q, out_x, out_s = [], [], []
    for at in range(0, len(q), 512):
        s = q[at:at + 512] @ x.T
        hit_q, hit_x = np.nonzero(s >= least)
        other = q_owner[at + hit_q] != x_owner[hit_x]
        hit_q, hit_x = hit_q[other], hit_x[other]
        value = s[hit_q, hit_x]
        order = np.lexsort((hit_x, -value, hit_q))
        hit_q, hit_x, value = hit_q[order], hit_x[order], value[order]
        first = np.searchsorted(hit_q, hit_q)
        keep = np.arange(len(hit_q)) - first < k
        out_q.append(q_key[at + hit_q[keep]])
        out_x.append(x_key[hit_x[keep]])
        out_s.append(value[keep])
    if not out_q:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
    return np.concatenate(out_q), np.concatenate(out_x), np.concatenate(out_s)


def nearest(vectors: DataFrame, k: int, least: float = -1.0, probes: int = PROBES, part_size: int = PART_SIZE) -> DataFrame:
    """``(key, near, similarity)``: for every row of ``vectors(key long, owner long, v array<float>)`` its up to ``k`` most similar rows of other owners.

    Keys must be unique and vectors usable (see ``usable``) and of one length. ``least`` leaves out less similar ones; ties go to the smaller key. An empty table gives an empty result.
    Approximate: a neighbour is missed when it lies in none of the parts asked.
    """
    total = vectors.count()
    if not total:
        return vectors.sparkSession.createDataFrame([], "key long, near long, similarity double")
    router = vectors.sparkSession.sparkContext.broadcast(fit(vectors, total, part_size, probes))
    routed = vectors.select("key", "owner", "v").mapInArrow(_route(router, probes), "part long, key long, owner long, asks byte, v binary")

    def search(table: pa.Table) -> pa.Table:
        key, owner, asks = (table.column(c).to_numpy() for c in ("key", "owner", "asks"))
        x = np.frombuffer(b"".join(table.column("v").to_pylist()), dtype=np.float32).reshape(len(key), -1)
        found, asking = np.flatnonzero(asks != 1), np.flatnonzero(asks != 0)
        found = found[np.argsort(key[found], kind="stable")]
        a, b, s = best_in_block(x[asking], key[asking], owner[asking], x[found], key[found], owner[found], k, least)
        return pa.table({"key": a, "near": b, "similarity": s.astype(np.float64)})

    hits = cut(routed.groupBy("part").applyInArrow(search, "key long, near long, similarity double"), "hits")
    # a pair that one side has found is known to the other as well
    both = hits.unionByName(hits.select(F.col("near").alias("key"), F.col("key").alias("near"), "similarity"))
    once = both.groupBy("key", "near").agg(F.max("similarity").alias("similarity"))
    place = F.row_number().over(Window.partitionBy("key").orderBy(F.col("similarity").desc(), F.col("near")))
    return once.withColumn("place", place).where(F.col("place") <= k).drop("place")


def entry_vectors(entries: DataFrame, dims: int) -> DataFrame:
    """``(key, owner, v)``: usable vectors of the embedding cache, keyed ``entry_id * 100 + slot``; the owner is a hash of the note id.

    Slot 0 is the entry's embedding, 1, 2, ... its chunks in order. Null ids are one owner.
    """
    slots = F.concat(F.array(F.col("embedding")), F.coalesce(F.col("chunk_embeddings"), F.array().cast("array<array<float>>")))
    rows = entries.where(F.col("entry_id").isNotNull()).select("entry_id", F.xxhash64(F.coalesce("id", F.lit(""))).alias("owner"), F.posexplode(slots).alias("slot", "v"))
    return rows.where(usable(F.col("v"), dims)).select((F.col("entry_id") * 100 + F.col("slot")).alias("key"), "owner", "v")
