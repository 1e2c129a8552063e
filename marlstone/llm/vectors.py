"""Most similar vectors for every vector: balanced posting lists (problem 1).

A balanced tree over a bounded sample gives centroids; they are searched by a
best-first walk over an in-memory neighbour graph. Every vector goes to its
nearest lists and, near a boundary, to further ones: those whose distance is
within a ratio of the nearest. Vectors meet inside lists only, so the work is
rows times list length, and one shuffle of the replicated rows is all that
moves. Where a sample gives too few lists for the rows, each list is parted
once more, by a sample of its own rows and on the executors; a walk over the
first level then opens some lists and compares with the second level of those.
Lists that are still long are cut into tiles (query block times data block), so
that no task holds more than two blocks.

Exact copies: only the k+1 smallest keys of a class of equal vectors can be
among anyone's k nearest, ties going to the smaller key. Further copies are
left out of the lists and get their answer, the k smallest of their class,
from a narrow join. So a third of all rows being copies costs no more.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of the fitting sample per model at most; with LEAST_FIT sample rows a list, it bounds the centroids that are broadcast.
FIT_ROWS, LEAST_FIT = 65_536, 8
#: Second level: sample rows a list, lists under one of the first level and of a model at most (which bounds what is collected and broadcast), lists of the first level that a walk opens.
SUB_FIT, SUB_LISTS, ALL_LISTS, OPENED = 16, 1_024, 131_072, 12
#: Vectors a list holds before replication; rows of a tile's block.
LIST_ROWS, BLOCK_ROWS = 256, 4_096


def usable(vector: Column, dim: Column) -> Column:
    """Not null, as long as dim says, only finite numbers, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & (F.size(vector) == dim) & finite & F.exists(vector, lambda x: x != 0)


@dataclass
class Lists:
    """One model's centroids, their neighbour graph and how many blocks each list is cut into."""

    centroids: np.ndarray
    graph: np.ndarray
    pivots: np.ndarray
    blocks: np.ndarray
    share: np.ndarray
    sub: np.ndarray | None = None
    begins: np.ndarray | None = None

    def nearest(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, cosines) of about the `beam` nearest lists of each row, best first."""
        if self.sub is None:
            return self.walk(q, beam)
        tops = self.walk(q, OPENED)[0]
        sizes = np.diff(self.begins)
        width = int(sizes[tops].sum(1).max())
        ids, sims = np.zeros((len(q), width), np.int64), np.full((len(q), width), -np.inf, np.float32)
        room = np.cumsum(sizes[tops], axis=1) - sizes[tops]
        for top in np.unique(tops):
            r, j = np.nonzero(tops == top)
            a, b = self.begins[top], self.begins[top + 1]
            at = room[r, j][:, None] + np.arange(b - a)
            ids[r[:, None], at] = np.arange(a, b)
            sims[r[:, None], at] = q[r] @ self.sub[a:b].T
        beam = min(beam, int(sizes[tops].sum(1).min()))
        best = np.argpartition(-sims, beam - 1, axis=1)[:, :beam]
        order = np.take_along_axis(best, np.argsort(-np.take_along_axis(sims, best, 1), axis=1, kind="stable"), 1)
        return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)

    def walk(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, cosines) of about the `beam` nearest centroids of the first level, best first.

        A best-first walk over the graph for all rows at once: each round
        expands each row's best open nodes and keeps the best `beam` seen.
        """
        c, n, m = self.centroids, len(q), len(self.centroids)
        beam = min(beam, m)
        if m <= 4 * beam:  # every node is within two steps of a pivot: the walk would see them all
            s = q @ c.T
            ids = np.argsort(-s, axis=1, kind="stable")[:, :beam]
            return ids, np.take_along_axis(s, ids, 1)
        rows = np.arange(n)[:, None]
        s = q @ c[self.pivots].T
        top = np.argpartition(-s, beam - 1, axis=1)[:, :beam] if s.shape[1] > beam else np.broadcast_to(np.arange(s.shape[1]), s.shape)
        ids, sims = self.pivots[top], np.take_along_axis(s, top, 1)
        seen, open_ = np.zeros((n, m), bool), np.ones(ids.shape, bool)
        seen[rows, ids] = True
        while True:
            live = np.flatnonzero(open_.any(1))
            if not len(live):
                break
            at = np.where(open_[live], sims[live], -np.inf)
            pick = np.argpartition(-at, 1, axis=1)[:, :2]
            valid = np.take_along_axis(at, pick, 1) > -np.inf
            open_[live[:, None], pick] = False
            nodes = np.take_along_axis(ids[live], pick, 1)
            new = self.graph[nodes].reshape(len(live), -1)
            fresh = ~seen[live[:, None], new] & np.repeat(valid, self.graph.shape[1], axis=1)
            order = np.argsort(new, axis=1, kind="stable")  # a node reached twice in a round counts once
            again = np.zeros_like(fresh)
            sorted_new = np.take_along_axis(new, order, 1)
            np.put_along_axis(again, order[:, 1:], sorted_new[:, 1:] == sorted_new[:, :-1], 1)
            fresh &= ~again
            seen[live[:, None], new] |= True
            ns = np.where(fresh, np.einsum("rd,rkd->rk", q[live], c[new]), -np.inf)
            all_s = np.concatenate([sims[live], ns], 1)
            all_i = np.concatenate([ids[live], new], 1)
            all_o = np.concatenate([open_[live], fresh], 1)
            width = ids.shape[1]
            keep = np.argpartition(-all_s, min(beam, all_s.shape[1]) - 1, axis=1)[:, :width]
            sims[live], ids[live], open_[live] = (np.take_along_axis(x, keep, 1) for x in (all_s, all_i, all_o))
        order = np.argsort(-sims, axis=1, kind="stable")
        return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def _leaves(x: np.ndarray, n: int, rng: np.random.Generator) -> list[np.ndarray]:
    """Cut the rows into n equal leaves: again and again along the axis of two means, at the matching quantile."""
    todo, out = [(np.arange(len(x)), n)], []
    while todo:
        rows, k = todo.pop()
        if k == 1 or len(rows) < 2:
            out.append(rows)
            continue
        sub = x[rows[rng.permutation(len(rows))[:2048]]]
        a, b = sub[0], sub[-1]
        for _ in range(6):
            side = sub @ (a - b) > 0
            if side.all() or not side.any():
                break
            a, b = sub[side].mean(0), sub[~side].mean(0)
        order = np.argsort(x[rows] @ (b - a), kind="stable")
        left = k // 2
        at = len(rows) * left // k
        todo += [(rows[order[:at]], left), (rows[order[at:]], k - left)]
    return [r for r in out if len(r)]


def fit(sample: np.ndarray, rows: int, *, list_rows: int = LIST_ROWS, degree: int = 16, seed: int = 7) -> Lists:
    """Lists for `rows` vectors from a sample of them (unit rows)."""
    rng = np.random.default_rng(seed)
    n = max(1, min(-(-rows // list_rows), len(sample) // LEAST_FIT))
    leaves = _leaves(sample, n, rng)
    cent = np.stack([sample[r].mean(0) for r in leaves])
    for _ in range(2):
        owner = np.concatenate([np.argmax(sample[i : i + 4096] @ cent.T, axis=1) for i in range(0, len(sample), 4096)])
        sums = np.zeros_like(cent)
        np.add.at(sums, owner, sample)
        cent = np.where(np.abs(sums).sum(1, keepdims=True) > 0, sums, cent)
        cent = cent / np.maximum(np.linalg.norm(cent, axis=1, keepdims=True), 1e-12)
    cent = cent.astype(np.float32)
    m = len(cent)
    near = min(degree, m - 1)
    graph = np.zeros((m, near + 4), np.int64)
    for i in range(0, m, 2048):
        s = cent[i : i + 2048] @ cent.T
        s[np.arange(len(s)), np.arange(i, i + len(s))] = -np.inf
        if near:
            graph[i : i + 2048, :near] = np.argpartition(-s, near - 1, axis=1)[:, :near]
    graph[:, near:] = rng.integers(0, m, (m, 4))  # far links keep the graph in one piece
    pivots = np.sort(rng.permutation(m)[: max(32, int(2 * m**0.5))])
    share = np.bincount(owner, minlength=m) / len(sample)
    blocks = np.maximum(1, np.ceil(share * rows * 2 / BLOCK_ROWS)).astype(np.int64)  # 2: room for replicas
    return Lists(cent, graph, pivots, blocks, share)


def _space() -> Column:
    """One space of vectors: model and length."""
    return F.concat_ws("\u0001", F.coalesce("model", F.lit("\u0000")), F.col("dim"))


def build_index(vectors: DataFrame, *, fit_rows: int = FIT_ROWS, list_rows: int = LIST_ROWS) -> dict:
    """Lists of each model, fitted on at most about fit_rows rows of it, chosen by a hash of the key.

    vectors: model, id_a, id_b, vector, dim. Repeated keys and unusable vectors
    do no harm, so the rows may come straight from the scan: counting reads no
    vectors, and the sample is drawn before anything is shuffled. A model of
    which the sample holds no usable vector is fitted on some of its usable
    ones, so only a model without any is absent.
    """
    counts = {r["model"]: r["n"] for r in vectors.groupBy(_space().alias("model")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return {}
    share = F.lit(None).cast("double")
    for m, n in counts.items():
        share = F.when(_space() == m, F.lit(min(1.0, fit_rows / n))).otherwise(share)
    drawn = vectors.where(F.pmod(F.xxhash64("id_a", "id_b"), F.lit(1_000_000)) < share * 1_000_000).where(usable(F.col("vector"), F.col("dim")))
    picked = drawn.select(_space().alias("model"), F.col("vector").cast("array<float>").alias("vector")).toArrow()
    out = {}
    models = np.array(picked["model"].to_pylist(), dtype=object)
    sampled = set(models.tolist())
    missed = [m for m, n in counts.items() if m not in sampled and n > fit_rows]
    if missed:  # few usable among many: count those, and draw from them alone
        usable_rows = vectors.where(_space().isin(missed)).where(usable(F.col("vector"), F.col("dim"))).where("id_a is not null and id_b is not null")
        few = {r["model"]: r["n"] for r in usable_rows.groupBy(_space().alias("model")).agg(F.count(F.lit(1)).alias("n")).collect()}
        for m, n in few.items():
            own = usable_rows.where(_space() == m).limit(fit_rows).select(_space().alias("model"), F.col("vector").cast("array<float>").alias("vector")).toArrow()
            picked = pa.concat_tables([picked, own])
            counts[m] = n
        models = np.array(picked["model"].to_pylist(), dtype=object)
    for m, n in counts.items():
        at = np.flatnonzero(models == m)
        if not len(at):  # no usable vector among all its rows
            continue
        vec = picked["vector"].combine_chunks().take(pa.array(at))
        x = vec.flatten().to_numpy(zero_copy_only=False).reshape(len(at), -1)
        out[m] = fit(_unit(x), n, list_rows=list_rows)
    _deepen(vectors, out, counts, list_rows)
    return out


def _deepen(vectors: DataFrame, index: dict, counts: dict, list_rows: int) -> None:
    """Part the lists of models with over twice as many rows as their lists are meant for once more."""
    want = {m: np.minimum(SUB_LISTS, np.ceil(x.share * counts[m] / list_rows)).astype(np.int64) for m, x in index.items() if counts[m] > 2 * len(x.centroids) * list_rows}
    want = {m: np.maximum(1, k * ALL_LISTS // max(ALL_LISTS, int(k.sum()))) for m, k in want.items()}
    if not want:
        return
    rate = {m: np.minimum(1.0, SUB_FIT * k / np.maximum(1.0, index[m].share * counts[m])) for m, k in want.items()}
    most = F.lit(None).cast("double")
    for m, r in rate.items():
        most = F.when(_space() == m, F.lit(float(r.max()))).otherwise(most)
    place = F.pmod(F.xxhash64(F.lit(2), "id_a", "id_b"), F.lit(1_000_000)) / 1_000_000
    drawn = vectors.withColumn("place", place).where(F.col("place") < most).where(usable(F.col("vector"), F.col("dim"))).select(_space().alias("model"), "place", F.col("vector").cast("array<float>").alias("vector"))
    names = sorted(want)
    tops = {m: index[m] for m in names}

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            model, where = np.array(batch["model"].to_pylist(), dtype=object), batch["place"].to_numpy(zero_copy_only=False)
            for i, m in enumerate(names):
                at = np.flatnonzero(model == m)
                if len(at):
                    x = _unit(batch["vector"].take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), -1))
                    top = tops[m].walk(x, 8)[0][:, 0]
                    ok = where[at] < rate[m][top]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(ok.sum(), i, np.int32)), pa.array(top[ok]), pa.array([v.tobytes() for v in x[ok]], pa.binary())], names=["model_no", "top", "v"])

    def part(t: pa.Table) -> pa.Table:
        i, top = t["model_no"][0].as_py(), t["top"][0].as_py()
        x = np.frombuffer(b"".join(t["v"].to_pylist()), np.float32).reshape(t.num_rows, -1)
        leaves = _leaves(x, int(min(want[names[i]][top], max(1, len(x) // 4))), np.random.default_rng([7, top]))
        cent = np.stack([x[r].mean(0) for r in leaves])
        cent /= np.maximum(np.linalg.norm(cent, axis=1, keepdims=True), 1e-12)
        return pa.table([pa.array([i], pa.int32()), pa.array([top], pa.int64()), pa.array([cent.astype(np.float32).tobytes()], pa.binary())], names=["model_no", "top", "c"])

    rows = drawn.mapInArrow(assign, "model_no int, top bigint, v binary").groupBy("model_no", "top").applyInArrow(part, "model_no int, top bigint, c binary").collect()  # ALL_LISTS centroids a model at most
    for i, m in enumerate(names):
        lists = index[m]
        dim, own = lists.centroids.shape[1], {r["top"]: np.frombuffer(r["c"], np.float32) for r in rows if r["model_no"] == i}
        parts = [own[j].reshape(-1, dim) if j in own else lists.centroids[j : j + 1] for j in range(len(lists.centroids))]
        sizes = np.array([len(p) for p in parts])
        lists.sub, lists.begins = np.concatenate(parts), np.concatenate([[0], np.cumsum(sizes)])
        lists.blocks = np.repeat(np.maximum(1, np.ceil(lists.share * counts[m] * 2 / sizes / BLOCK_ROWS)).astype(np.int64), sizes)


def _spread(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of the key that cuts lists into blocks."""
    with np.errstate(over="ignore"):
        h = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        h ^= h >> np.uint64(29)
        return ((h * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(33)).astype(np.int64)


def _drop_surplus(a: np.ndarray, b: np.ndarray, x: np.ndarray, most: int) -> np.ndarray:
    """Mask of the rows that are among the `most` smallest keys of their equal vectors."""
    raw = np.ascontiguousarray(x).view(np.dtype((np.void, x.dtype.itemsize * x.shape[1]))).ravel()
    order = np.lexsort((b, a))
    _, cls = np.unique(raw, return_inverse=True)
    cls = cls.ravel()
    if np.bincount(cls).max() <= most:
        return np.ones(len(a), bool)
    by = order[np.argsort(cls[order], kind="stable")]
    c = cls[by]
    start = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])
    rank = np.arange(len(c)) - np.repeat(start, np.diff(np.r_[start, len(c)]))
    keep = np.empty(len(a), bool)
    keep[by] = rank < most
    return keep


_ROUTED = pa.schema([("model_no", pa.int32()), ("list_no", pa.int64()), ("q_block", pa.int32()), ("d_block", pa.int32()), ("role", pa.int8()), ("id_a", pa.int64()), ("id_b", pa.int64()), ("v", pa.binary())])
_HITS = pa.schema([("q_a", pa.int64()), ("q_b", pa.int64()), ("d_a", pa.int64()), ("d_b", pa.int64()), ("cosine", pa.float64())])
_DATA, _QUERY = 1, 2


def _route(index: dict, models: list, k: int, replicas: int, probes: int, ratio: float, self_join: bool):
    number = {m: i for i, m in enumerate(models)}
    beam = max(replicas, probes) + 8

    def tiles(lists: Lists, pick: np.ndarray, rows: np.ndarray, block: np.ndarray, role: int) -> Iterator[tuple]:
        """(row, list, query block, data block, role) for the chosen lists of each row."""
        nb = lists.blocks[pick]
        b = block[rows] % nb
        base = pick.astype(np.int64)
        one = nb == 1
        none = np.zeros(one.sum(), np.int32)
        yield rows[one], base[one], none, none, np.full(one.sum(), role, np.int8)
        for n in np.unique(nb[~one]):
            at = np.flatnonzero(nb == n)
            other = np.arange(n)
            if role & _DATA:  # a data row meets every query block
                q, d = np.broadcast_to(other, (len(at), n)), np.repeat(b[at][:, None], n, 1)
                r = np.where(q == d, role, _DATA) if role & _QUERY else np.full(q.shape, _DATA)
                yield np.repeat(rows[at], n), np.repeat(base[at], n), q.ravel().astype(np.int32), d.ravel().astype(np.int32), r.astype(np.int8).ravel()
            if role & _QUERY:  # a query row meets every data block
                q, d = np.repeat(b[at][:, None], n, 1), np.broadcast_to(other, (len(at), n))
                ok = (q != d) if role & _DATA else np.ones(q.shape, bool)
                yield np.repeat(rows[at][:, None], n, 1)[ok], np.repeat(base[at][:, None], n, 1)[ok], q[ok].astype(np.int32), d[ok].astype(np.int32), np.full(ok.sum(), _QUERY, np.int8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                model = np.array(part["model"].to_pylist(), dtype=object)
                a, b = (part[c].to_numpy(zero_copy_only=False) for c in ("id_a", "id_b"))
                asks = part["is_query"].to_numpy(zero_copy_only=False).astype(bool)
                for m in set(model.tolist()):
                    if m not in index:
                        continue
                    at = np.flatnonzero(model == m)
                    x = part["vector"].take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), -1).astype(np.float32)
                    ia, ib, ask = a[at], b[at], asks[at]
                    keep = _drop_surplus(ia, ib, x, k + 1)
                    x, ia, ib, ask = x[keep], ia[keep], ib[keep], ask[keep]
                    lists, unit, block = index[m], _unit(x), _spread(ia, ib)
                    ids, sims = lists.nearest(unit, beam)
                    dist = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * sims))
                    within = dist <= dist[:, :1] * ratio + 1e-6
                    jobs = []
                    if self_join:
                        jobs.append((within[:, :replicas], _DATA | _QUERY))
                    else:
                        jobs += [(within[:, :replicas], _DATA), ((np.arange(ids.shape[1])[None] < probes) & ask[:, None], _QUERY)]
                    for mask, role in jobs:
                        r, j = np.nonzero(mask)
                        for rows, list_no, qb, db, roles in tiles(lists, ids[r, j], r, block, role):
                            if len(rows):
                                raw = np.ascontiguousarray(unit[rows])
                                size = raw.shape[1] * 4
                                off = pa.py_buffer(np.arange(0, (len(rows) + 1) * size, size, dtype=np.int32))
                                vec = pa.Array.from_buffers(pa.binary(), len(rows), [None, off, pa.py_buffer(raw)])
                                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), number[m], np.int32)), pa.array(list_no), pa.array(qb), pa.array(db), pa.array(roles), pa.array(ia[rows]), pa.array(ib[rows]), vec], schema=_ROUTED)

    return run


def _meet(k: int, least: float | None):
    def run(t: pa.Table) -> pa.Table:
        role = t["role"].to_numpy()
        a, b = t["id_a"].to_numpy(), t["id_b"].to_numpy()
        raw = t["v"].combine_chunks()
        raw = raw.chunk(0) if isinstance(raw, pa.ChunkedArray) else raw
        x = np.frombuffer(b"".join(raw.to_pylist()), np.float32).reshape(len(role), -1)
        order = np.lexsort((b, a))
        role, a, b, x = role[order], a[order], b[order], x[order]
        q, d = np.flatnonzero(role & _QUERY), np.flatnonzero(role & _DATA)
        if len(d):
            d = d[_drop_surplus(a[d], b[d], x[d], k + 1)]
        hits = []
        for i in range(0, len(q) if len(d) else 0, 1024):
            rows = q[i : i + 1024]
            s = x[rows] @ x[d].T
            s[(a[rows][:, None] == a[d][None]) & (b[rows][:, None] == b[d][None])] = -2.0
            floor = np.full(len(rows), -1.5 if least is None else least - 1e-6, np.float32)
            if len(d) > k and least is None:
                floor = np.maximum(floor, np.partition(s, -k, axis=1)[:, -k])
            r, c = np.nonzero(s >= floor[:, None])
            if not len(r):
                continue
            sim = np.einsum("ij,ij->i", x[rows[r]].astype(np.float64), x[d[c]].astype(np.float64))
            if least is not None:
                ok = sim >= least
                r, c, sim = r[ok], c[ok], sim[ok]
            by = np.lexsort((c, -sim, r))  # data rows are in key order: ties go to the smaller key
            r, c, sim = r[by], c[by], sim[by]
            first = np.searchsorted(r, r)
            ok = np.arange(len(r)) - first < k
            hits.append((rows[r[ok]], d[c[ok]], sim[ok]))
        qi, di, sims = (np.concatenate([h[j] for h in hits]) for j in range(3)) if hits else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table([a[qi], b[qi], a[di], b[di], np.minimum(sims, 1.0)], schema=_HITS)

    return run


def most_similar(vectors: DataFrame, *, k: int = 10, least: float | None = None, queries: Column | None = None, replicas: int = 4, probes: int = 4, ratio: float = 1.15, fit_rows: int = FIT_ROWS, list_rows: int = LIST_ROWS, index: dict | None = None) -> DataFrame:
    """(q_a, q_b, d_a, d_b, cosine, rank): the k most similar vectors of the same model for every vector.

    vectors: model, id_a, id_b (one row a key), vector, dim; other columns are
    ignored. Unusable vectors (see `usable`) and null keys are left out, also
    as neighbours. `least`: only neighbours of at least that cosine. `queries`:
    a condition on the input's columns that says which rows ask (all do).
    Every row is indexed. Ties in cosine go to the smaller key. An empty table,
    or a model with one vector, gives no rows. Of equal vectors see the
    module's text.
    """
    asks = F.lit(True) if queries is None else F.coalesce(queries, F.lit(False))
    base = vectors.where("id_a is not null and id_b is not null").where(usable(F.col("vector"), F.col("dim"))).select("model", F.col("id_a").cast("bigint").alias("id_a"), F.col("id_b").cast("bigint").alias("id_b"), "dim", F.col("vector").cast("array<float>").alias("vector"), asks.alias("is_query"))
    base = base.withColumn("model", _space())
    index = build_index(vectors, fit_rows=fit_rows, list_rows=list_rows) if index is None else index
    models = sorted(index)
    routed = base.select("model", "id_a", "id_b", "vector", "is_query").mapInArrow(_route(index, models, k, replicas, probes, ratio, queries is None), "model_no int, list_no bigint, q_block int, d_block int, role tinyint, id_a bigint, id_b bigint, v binary")
    hits = routed.groupBy("model_no", "list_no", "q_block", "d_block").applyInArrow(_meet(k, least), "q_a bigint, q_b bigint, d_a bigint, d_b bigint, cosine double")
    narrow = base.select("model", "id_a", "id_b", "is_query", F.xxhash64("vector").alias("h"), F.hash("vector").alias("h2"))
    cls = ["model", "h", "h2"]
    large = narrow.groupBy(*cls).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > k + 1).select(*cls)
    members = narrow.join(large, cls, "left_semi")
    first = members.withColumn("r", F.row_number().over(Window.partitionBy(*cls).orderBy("id_a", "id_b"))).where(F.col("r") <= k + 1)
    ends = first.groupBy(*cls).agg(F.sort_array(F.collect_list(F.struct("id_a", "id_b"))).alias("firsts"))  # k+1 at most
    copies = members.where("is_query").join(ends, cls).select(F.col("id_a").alias("q_a"), F.col("id_b").alias("q_b"), F.explode("firsts").alias("f"))
    copies = copies.select("q_a", "q_b", F.col("f.id_a").alias("d_a"), F.col("f.id_b").alias("d_b"), F.lit(1.0).alias("cosine")).where("not (q_a = d_a and q_b = d_b)")
    best = hits.union(copies).groupBy("q_a", "q_b", "d_a", "d_b").agg(F.max("cosine").alias("cosine"))
    rank = F.row_number().over(Window.partitionBy("q_a", "q_b").orderBy(F.desc("cosine"), "d_a", "d_b"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k)


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for dim in set(batch["dim"].to_pylist()):
            part = batch.filter(pa.array(np.array(batch["dim"].to_pylist()) == dim))
            raw = _unit(part["vector"].flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, dim))
            yield pa.RecordBatch.from_arrays([part["model"], part["id_a"], part["id_b"], part["is_query"], pa.array([r.tobytes() for r in raw], pa.binary())], names=["model", "id_a", "id_b", "is_query", "v"])


def exact_similar(vectors: DataFrame, *, k: int = 10, queries: Column, query_block: int = 4_096, data_block: int = 16_384) -> DataFrame:
    """As most_similar, by comparing a stated set of queries with all rows, block by block; the measure of what the lists lose."""
    base = vectors.where("id_a is not null and id_b is not null").where(usable(F.col("vector"), F.col("dim"))).select(_space().alias("model"), F.col("id_a").cast("bigint").alias("id_a"), F.col("id_b").cast("bigint").alias("id_b"), F.coalesce(queries, F.lit(False)).alias("is_query"), "dim", F.col("vector").cast("array<float>").alias("vector"))
    n, asked = base.agg(F.count(F.lit(1)), F.count_if("is_query")).first()
    nq, nd = max(1, -(-asked // query_block)), max(1, -(-n // data_block))
    unit = base.mapInArrow(_units, "model string, id_a bigint, id_b bigint, is_query boolean, v binary")
    own = lambda m, salt: F.pmod(F.xxhash64("id_a", "id_b", F.lit(salt)), F.lit(m)).cast("int")
    data = unit.select("model", F.explode(F.sequence(F.lit(0), F.lit(nq - 1))).alias("q"), own(nd, 1).alias("d"), F.lit(_DATA).cast("tinyint").alias("role"), "id_a", "id_b", "v")
    query = unit.where("is_query").select("model", own(nq, 2).alias("q"), F.explode(F.sequence(F.lit(0), F.lit(nd - 1))).alias("d"), F.lit(_QUERY).cast("tinyint").alias("role"), "id_a", "id_b", "v")
    hits = data.union(query).groupBy("model", "q", "d").applyInArrow(_meet(k, None), "q_a bigint, q_b bigint, d_a bigint, d_b bigint, cosine double")
    rank = F.row_number().over(Window.partitionBy("q_a", "q_b").orderBy(F.desc("cosine"), "d_a", "d_b"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k)


def recall(found: DataFrame, exact: DataFrame, *, close: float = 0.90) -> DataFrame:
    """(n_queries, n_pairs, recall, n_close, recall_close): the share of exact neighbours that were found, of all and of those of at least the cosine `close`."""
    j = exact.select("q_a", "q_b", "d_a", "d_b", "cosine").join(found.select("q_a", "q_b", "d_a", "d_b", F.lit(1).alias("hit")), ["q_a", "q_b", "d_a", "d_b"], "left")
    near, hit = F.col("cosine") >= close, F.coalesce("hit", F.lit(0))
    return j.agg(
        F.count_distinct("q_a", "q_b").alias("n_queries"), F.count(F.lit(1)).alias("n_pairs"), F.round(F.avg(hit), 6).alias("recall"),
        F.count_if(near).alias("n_close"), F.round(F.avg(F.when(near, hit)), 6).alias("recall_close"),
    )


def similar_pairs(vectors: DataFrame, *, k: int = 10, least: float = 0.90, **how) -> DataFrame:
    """(node_a, chunk_a, node_b, chunk_b, cosine): pairs of which one is among the k most similar of the other, smaller key first."""
    nn = most_similar(vectors, k=k, least=least, **how)
    fwd = F.struct(F.col("q_a").alias("a"), F.col("q_b").alias("b"))
    bwd = F.struct(F.col("d_a").alias("a"), F.col("d_b").alias("b"))
    pairs = nn.select(F.least(fwd, bwd).alias("x"), F.greatest(fwd, bwd).alias("y"), "cosine")
    return pairs.groupBy("x", "y").agg(F.max("cosine").alias("cosine")).select(F.col("x.a").alias("node_a"), F.col("x.b").alias("chunk_a"), F.col("y.a").alias("node_b"), F.col("y.b").alias("chunk_b"), "cosine")


def latest_chunks(chunks: DataFrame, *columns: str) -> DataFrame:
    """The row with the latest updated_at of each key; among equal times the last in the order of the values."""
    value = F.struct(*columns)
    return chunks.groupBy("node_id", "chunk_idx").agg(F.max_by(value, F.struct("updated_at", F.xxhash64(*columns))).alias("v")).select("node_id", "chunk_idx", *[F.col(f"v.{c}").alias(c) for c in columns])
