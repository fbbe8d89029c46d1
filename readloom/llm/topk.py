"""Exact top-k search by inner product, score at a time.

The vectors are dealt into blocks. In a block each dimension has postings
grouped into segments of equal quantised value; a segment's impact for a query
is the query's component times that value. Segments of all dimensions are
processed in the order of falling impact, each adding its impact to the scores
of its vectors. After every stretch of segments the k-th best lower bound is
compared with what the unread segments and the quantisation can still add; the
scan stops only when that proves that the vectors still in question are few, and these are
rescored exactly. Results are the same as those of a full scan.

Queries reach the blocks in blocks of their own (a stated query set against all
rows); every block returns k rows for each query, and one window merges them.

Pairs in which a vector has components too large for sums in 64 bits are left out
of the index: rounded scores with a bound of their error choose few of them, and
these are scored in whole numbers of any size.

Defined results: vectors that are null, empty or hold a null or non-finite
component take no part, nor do those whose vec_id is null; a score among a
query's k best that does not fit 64 bits raises; rows that share a vec_id are one vector, the
least of them; a query never meets its own vec_id; only vectors of the query's
length are candidates; ties go to the smaller vec_id; a query with fewer than
k candidates gets all of them; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from readloom.session import ship

_LEVELS = 16
_RESULT = "query_id bigint, vec_id bigint, score bigint"


def quantised(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 1024) -> DataFrame:
    """(vec_id, v): v holds floor(scale * x) of each component x as a double."""
    # From 2^52 on a double has no fraction.
    floor = lambda y: F.when(F.abs(y) < float(1 << 52), F.floor(y).cast("double")).otherwise(y)
    scaled = F.transform(F.col(vector_col), lambda x: floor(x.cast("double") * float(scale)))
    fine = F.forall(F.col(vector_col), lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    valid = F.col(vector_col).isNotNull() & (F.size(vector_col) > 0) & fine & F.col(id_col).isNotNull()
    kept = df.where(valid).select(F.col(id_col).cast("bigint").alias("vec_id"), scaled.alias("v"))
    return kept.groupBy("vec_id").agg(F.min("v").alias("v"))


class ImpactIndex:
    """Segments of a block: for each dimension, rows by quantised value."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        n, dims = vectors.shape
        low, high = vectors.min(axis=0), vectors.max(axis=0)
        self.low = low
        self.step = np.maximum(1, -(-(high - low + 1) // _LEVELS))
        level = (vectors - low) // self.step
        self.rows = np.argsort(level, axis=0, kind="stable")
        ordered = np.take_along_axis(level, self.rows, axis=0)
        self.bounds = np.stack([np.searchsorted(ordered[:, d], np.arange(_LEVELS + 1)) for d in range(dims)])

    def search(self, q: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(rows, scores) of the k best vectors."""
        n, dims = self.vectors.shape
        # Impacts of the levels, as gains over the least that the dimension can give.
        value = self.low[:, None] + self.step[:, None] * np.arange(_LEVELS)
        ends = q[:, None] * np.stack([value, value + self.step[:, None] - 1])
        least, most = ends.min(axis=0), ends.max(axis=0)
        filled = np.diff(self.bounds, axis=1) > 0
        floor = np.where(filled, least, np.iinfo(np.int64).max).min(axis=1)
        dim, level = np.nonzero(filled)
        gain, slack = (least - floor[:, None])[dim, level], (most - least)[dim, level]
        order = np.argsort(-gain, kind="stable")
        dim, level, gain = dim[order], level[order], gain[order]
        slack_all = np.zeros(dims, dtype=np.int64)
        np.maximum.at(slack_all, dim, slack[order])
        score = np.zeros(n, dtype=np.int64)  # over sum(floor): a lower bound of what has been read
        unread = np.where(filled, least - floor[:, None], 0)
        others = self.ids != own
        few = max(4 * k, 64)
        stretch = max(1, len(dim) // 12)
        alive = np.flatnonzero(others)
        for start in range(0, len(dim), stretch):
            for d, lv, g in zip(dim[start : start + stretch], level[start : start + stretch], gain[start : start + stretch]):
                if g:
                    score[self.rows[self.bounds[d, lv] : self.bounds[d, lv + 1], d]] += g
                unread[d, lv] = 0
            if len(alive) <= k:
                break
            rest = int(unread.max(axis=1).sum() + slack_all.sum())
            bar = np.partition(score[alive], len(alive) - k)[len(alive) - k]
            alive = alive[score[alive] + rest >= bar]
            if len(alive) <= few:
                break
        exact = self.vectors[alive] @ q
        best = np.lexsort((self.ids[alive], -exact))[:k]
        return alive[best], exact[best]


def _unpack(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(frame["vec_id"].to_numpy(), kind="stable")
    ids = frame["vec_id"].to_numpy()[order]
    return ids, np.stack([np.asarray(frame["v"].iloc[i], dtype=np.float64) for i in order])


def fits(vectors: np.ndarray) -> np.ndarray:
    """Which vectors the index can take: its sums over all components stay below 2^63."""
    bits = min(26, (60 - int(vectors.shape[1] - 1).bit_length()) // 2)
    return np.abs(vectors).max(axis=1) < float(1 << bits)


def exact_best(ids: np.ndarray, vectors: np.ndarray, q: np.ndarray, own: int, k: int) -> tuple[np.ndarray, list[int]]:
    """(rows, scores) of the k best vectors, for components of any size."""
    if not (np.isfinite(q).all() and np.isfinite(vectors).all()):
        raise OverflowError("a scaled component does not fit a double")
    alive = np.flatnonzero(ids != own)
    if len(alive) > k:
        with np.errstate(over="ignore", invalid="ignore"):
            rough = vectors[alive] @ q
            error = (np.abs(vectors[alive]) @ np.abs(q)) * ((len(q) + 2) * 2.0**-52)
            low, high = rough - error, rough + error
        if np.isfinite(low).all() and np.isfinite(high).all():
            alive = alive[high >= np.partition(low, len(low) - k)[len(low) - k]]
    whole = [int(x) for x in q]
    scored = sorted((-sum(int(x) * y for x, y in zip(vectors[i], whole)), int(ids[i]), i) for i in alive)[:k]
    return np.array([i for _, _, i in scored], dtype=np.int64), [-s for s, _, _ in scored]


def search(queries: DataFrame, vectors: DataFrame, k: int = 10, block_cells: int = 1 << 20, query_rows: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best vectors but itself."""
    ship(vectors.sparkSession)
    cells = vectors.agg(F.sum(F.size("v").cast("bigint"))).first()[0] or 0
    n_blocks = max(1, -(-int(cells) // block_cells))
    n_sets = max(1, -(-queries.count() // query_rows))
    deal = lambda c, n: F.pmod(F.xxhash64(c, F.lit(3)), F.lit(n)).cast("int")
    left = (
        queries.select("vec_id", "v", F.size("v").alias("d"), deal("vec_id", n_sets).alias("qb"))
        .withColumn("vb", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
        .groupBy("d", "vb", "qb")
    )
    right = (
        vectors.select("vec_id", "v", F.size("v").alias("d"), deal("vec_id", n_blocks).alias("vb"))
        .withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(n_sets - 1))))
        .groupBy("d", "vb", "qb")
    )

    def match(qs: pd.DataFrame, vs: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "vec_id": [], "score": []}
        if len(qs) and len(vs):
            ids, matrix = _unpack(vs)
            small = fits(matrix)
            large_ids, large = ids[~small], matrix[~small]
            small_ids, index = ids[small], None
            if len(small_ids):
                index = ImpactIndex(small_ids, matrix[small].astype(np.int64))
            query_ids, queries_ = _unpack(qs)
            for own, q, is_small in zip(query_ids, queries_, fits(queries_)):
                found = []
                if not is_small:
                    found.append((ids, *exact_best(ids, matrix, q, own, k)))
                else:
                    if index is not None:
                        rows, scores = index.search(q.astype(np.int64), own, k)
                        found.append((small_ids, rows, scores.tolist()))
                    if len(large_ids):
                        found.append((large_ids, *exact_best(large_ids, large, q, own, k)))
                for of, rows, scores in found:
                    if any(s >= 1 << 63 for s in scores):
                        raise OverflowError(f"a score of query {own} does not fit 64 bits")
                    out["query_id"].extend([own] * len(rows))
                    out["vec_id"].extend(of[rows].tolist())
                    # Below 64 bits: null sorts last, and raises only if it is among the k best of all blocks.
                    out["score"].extend(s if s >= -(1 << 63) else None for s in scores)
        return pd.DataFrame({name: pd.array(x, dtype="Int64") for name, x in out.items()})

    found = left.cogroup(right).applyInPandas(match, _RESULT)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", F.coalesce("score", F.raise_error(F.lit("a score does not fit 64 bits")).cast("bigint")).alias("score")
    )
