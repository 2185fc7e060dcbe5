"""Exact search for the highest inner products, pruned by segment statistics of several resolutions."""

from __future__ import annotations

import math
from operator import mul

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.session import materialize

QUERY_BLOCK = 1024  # queries that a task compares at once
VECTOR_BLOCK = 8192  # vectors that a task compares them with
SEGMENTS = (8, 16, 32)  # coarse to fine
POOL = 128  # rows with the highest bounds that set a query's threshold
DENSE = 16  # a level is computed for all pairs of a step while more than one in DENSE survives
STRIP = 1 << 20  # pairs whose coarse bounds one numpy step holds
PAIRS = 1 << 15  # pairs whose vectors it holds
LONG = (1 << 63) - 1


def integers(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): the vectors that take part, whose components count as floor(256 * x).

    Rows without an id, NULL and empty vectors, and vectors with a NULL or non-finite component are left out. Components
    below 2**53 come floored, as (whole) doubles divided by 256; larger ones are multiples of 1 / 256 as they are.
    """
    value = F.col("v")
    wide = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    floored = lambda x: F.when(F.abs(x) < F.lit(2.0**53), F.floor(x * 256) / 256).otherwise(x)
    wide = wide.where("id IS NOT NULL AND v IS NOT NULL AND size(v) > 0").where(finite)
    return wide.select("id", F.transform(value, floored).alias("v"))


def far(score: int) -> str:
    """A text that sorts the numbers beyond 64 bits from high to low, for scores that a long cannot tell apart; else empty."""
    if abs(score) < LONG:
        return ""
    digits = str(abs(score))
    text = f"{len(digits):04d}{digits}"
    return text if score < 0 else text.translate(str.maketrans("0123456789", "9876543210"))


def search_large(q_ids: np.ndarray, q: np.ndarray, x_ids: np.ndarray, x: np.ndarray, k: int) -> tuple[list, ...]:
    """(query, id, score, far) as ``search``, for vectors (not yet times 256) whose products may leave 64 bits.

    Products of doubles with a bound of their rounding pick the pairs that may be among the best ``k``; theirs are then
    added up in whole numbers of any size. A score beyond 64 bits is the nearest long, and ``far`` orders it.
    """
    whole = lambda row: [int(c * 256) if abs(c) < 2.0**1000 else int(c) * 256 for c in row.tolist()]
    out: tuple[list, ...] = ([], [], [], [])
    with np.errstate(over="ignore", invalid="ignore"):
        for own, row in zip(q_ids, q):
            others = np.flatnonzero(x_ids != own)
            near, slack = x[others] @ row, (np.abs(x[others]) @ np.abs(row)) * (len(row) + 2) * 2.0**-52
            least = near - slack
            if len(others) > k:
                last = np.sort(np.where(np.isnan(least), -np.inf, least))[-k]
                others = others[~(near + slack < last)]  # what is no number stays
            a = whole(row)
            found = sorted(((-sum(map(mul, a, whole(x[j]))), int(x_ids[j])) for j in others))[:k]
            for negative, other in found:
                out[0].append(int(own))
                out[1].append(other)
                out[2].append(max(-LONG, min(LONG, -negative)))
                out[3].append(far(-negative))
    return out


def _segments(x: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sizes, means and deviations (times the root of the size) of ``parts`` runs of the components."""
    edges = np.linspace(0, x.shape[1], min(parts, x.shape[1]) + 1).astype(int)
    sizes = np.diff(edges).astype(float)
    mean = np.add.reduceat(x, edges[:-1], axis=1) / sizes
    square = np.add.reduceat(x * x, edges[:-1], axis=1)
    return sizes, mean, np.sqrt(np.maximum(square - sizes * mean * mean, 0))


def bounds(q: np.ndarray, x: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Features whose inner product is at least that of the vectors.

    In a segment of n components with means m and centred norms s, q.x = n m m' + (centred q).(centred x), and by
    Cauchy and Schwarz the second term is at most s s'. With |q - x|^2 = |q|^2 + |x|^2 - 2 q.x this is the lower bound
    of the distance by segment means and deviations.
    """
    n, qm, qs = _segments(q, parts)
    _, xm, xs = _segments(x, parts)
    return np.hstack((qm * np.sqrt(n), qs)), np.hstack((xm * np.sqrt(n), xs))


def products(a: np.ndarray, i: np.ndarray, b: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner products of the rows ``a[i]`` and ``b[j]``."""
    parts = [np.einsum("ij,ij->i", a[i[s : s + PAIRS]], b[j[s : s + PAIRS]]) for s in range(0, len(i), PAIRS)]
    return np.concatenate(parts) if parts else np.zeros(0, dtype=a.dtype)


def search(q_ids: np.ndarray, q: np.ndarray, x_ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """(query, id, score) of the best ``k`` other rows of ``x`` for each query; ties go to the smaller id.

    On each level, from coarse to fine, the exact products with the rows of the highest bounds raise the query's
    threshold, and only pairs whose bound reaches it go on. Pairs that survive all levels get their exact product.
    """
    qf, xf = q.astype(float), x.astype(float)
    most = (np.abs(qf).max(initial=0) + 1) * (np.abs(xf).max(initial=0) + 1) * q.shape[1]
    slack = 1e-9 * most + 1e-3
    exact = (qf, xf) if most < 2**52 else (q, x)  # products of these floats are exact, too
    levels = [bounds(qf, xf, parts) for parts in SEGMENTS]
    out = []
    height = max(1, STRIP // max(1, len(x)))
    for top in range(0, len(q), height):
        rows = slice(top, top + height)
        own, features = q_ids[rows], exact[0][rows]
        alive = own[:, None] != x_ids
        least = np.full(len(own), -np.inf)
        pairs = None
        for qb, xb in levels:
            if pairs is None and np.count_nonzero(alive) * DENSE < alive.size:
                pairs = np.nonzero(alive)
            if pairs is not None:
                reach = products(qb[rows], pairs[0], xb, pairs[1]) >= least[pairs[0]] - slack
                pairs = pairs[0][reach], pairs[1][reach]
                continue
            bound = np.where(alive, qb[rows] @ xb.T, -np.inf)
            pool = min(max(POOL, k), len(x))
            best = np.argpartition(-bound, pool - 1, axis=1)[:, :pool]
            scores = np.einsum("ijk,ik->ij", exact[1][best], features).astype(float)
            scores[~np.take_along_axis(alive, best, 1)] = -np.inf
            if pool >= k:
                least = np.maximum(least, -np.partition(-scores, k - 1, axis=1)[:, k - 1])
            alive &= bound >= least[:, None] - slack
        if pairs is None:
            score = np.where(alive, features @ exact[1].T, -np.inf) if exact[0] is qf else None
            if score is None:
                pairs = np.nonzero(alive)
            else:
                last = -np.partition(-score, min(k, len(x)) - 1, axis=1)[:, min(k, len(x)) - 1]
                pairs = np.nonzero(alive & (score >= last[:, None]))
        qi, xi = pairs
        score = products(q[rows], qi, x, xi)
        order = np.lexsort((x_ids[xi], -score, qi))
        qi, xi, score = qi[order], xi[order], score[order]
        begins = np.flatnonzero(np.diff(qi, prepend=-1))
        rank = np.arange(len(qi)) - np.repeat(begins, np.diff(np.append(begins, len(qi))))
        best = rank < k
        out.append((own[qi[best]], x_ids[xi[best]], score[best]))
    return tuple(np.concatenate(c) for c in zip(*out))


def top_k(queries: DataFrame, vectors: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` highest integer products of each query with the other rows.

    Both inputs are (id, v) of ``integers()``. Vectors meet queries of the same number of components only. Queries and
    vectors are dealt by a hash into blocks of bounded size, each pair of blocks is one task's work and hands on at most
    ``k`` rows per query; ties go to the smaller id, and a query never meets rows of its own id. Blocks whose products
    may leave 64 bits go another, exact way (``search_large``); a score beyond 64 bits is returned as the nearest long.
    """
    queries, vectors = materialize(queries, "queries"), materialize(vectors, "vectors")
    sized = [d.groupBy(F.size("v").alias("n")).count() for d in (queries, vectors)]
    grid = sized[0].withColumnRenamed("count", "nq").join(sized[1].withColumnRenamed("count", "nx"), "n").select(
        "n", F.ceil(F.col("nq") / QUERY_BLOCK).cast("int").alias("rows"), F.ceil(F.col("nx") / VECTOR_BLOCK).cast("int").alias("columns")
    )

    def dealt(rows: DataFrame, own: str, other: str) -> DataFrame:
        block = F.pmod(F.xxhash64("id"), F.col(own)).cast("int").alias(own)
        return rows.withColumn("n", F.size("v")).join(grid, "n").select(
            "n", block, F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(other), "id", "v"
        ).select("n", "rows", "columns", "id", "v")

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        found = [np.zeros(0, np.int64)] * 3
        marks = None
        if left.num_rows and right.num_rows:
            n = left.column("n")[0].as_py()
            (qi, q), (xi, x) = ((_numbers(t, "id"), _numbers(t, "v").reshape(-1, n)) for t in (left, right))
            most = [np.abs(v).max(initial=0) * 256 + 1 for v in (q, x)]
            if max(most) < 2.0**52 and most[0] * most[1] * n < 2.0**62:
                found = search(qi, (q * 256).astype(np.int64), xi, (x * 256).astype(np.int64), k)
            else:
                *found, marks = search_large(qi, q, xi, x, k)
        found = [pa.array(c, pa.int64()) for c in found]
        return pa.table([*found, pa.array(marks if marks is not None else [""] * len(found[0]), pa.string())], ["query_id", "vec_id", "score", "far"])

    keys = ["n", "rows", "columns"]
    pairs = dealt(queries, "rows", "columns").groupBy(*keys).cogroup(dealt(vectors, "columns", "rows").groupBy(*keys))
    found = pairs.applyInArrow(compare, "query_id long, vec_id long, score long, far string")
    best = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "far", "vec_id"))), 1, k)
    rows = found.groupBy("query_id").agg(best.alias("best")).select("query_id", F.posexplode("best").alias("rank", "b"))
    return rows.select("query_id", (F.col("rank") + 1).alias("rank"), F.col("b.vec_id").alias("vec_id"), (-F.col("b.s")).alias("score"))


def _numbers(table: pa.Table, name: str) -> np.ndarray:
    column = table.column(name).combine_chunks()
    column = column.flatten() if pa.types.is_list(column.type) else column
    return column.to_numpy(zero_copy_only=False)
