"""Exact top-k by inner product with multi-resolution segment statistics.

Vectors become integers (floor(256 x)).  For any cut of the dimensions into
segments, the squared distance of two vectors is at least
sum(length * ((mean - mean')^2 + (dev - dev')^2)) over the segments; with the
exact squared norms this bounds the inner product from above by
sum(length * (mean * mean' + dev * dev')).  Bounds are taken from few segments
to many; queries and candidates of a chunk that are in no pair which can still
beat the query's k-th best exact score drop out, and only the survivors get
exact integer scores.

Queries (``id % every == 0``) and candidates meet in a grid of blocks: a
query block and a candidate block of bounded size form one cell, and each cell
returns at most k rows per query, so nothing larger than a block is ever held
and no cell depends on how many rows share anything.

Defined cases: vectors that are null, empty of dimensions, of another length
than the query, or hold null or non-finite components take no part; ties go to
the smaller id; rows with a null id take no part; rows with equal ids all take
part, as candidates of every other id, and as queries they share the one list
of their id; an empty table gives no rows; components so large that a score might pass 2^53 are scored with Python integers (saturating as long).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored

K = 5
EVERY = 50
QUERY_BLOCK = 1024
CANDIDATE_BLOCK = 8192
CHUNK = 2048  # candidates scored at a time
LEVELS = (2, 8, 16, 32)  # segments, coarse to fine
LEAST_GAIN, RETRY = 0.1, 16  # when a level is worth its cost; only speed depends on it


def segment_stats(x: np.ndarray, segments: int) -> np.ndarray:
    """Per row, sqrt(length) times mean and deviation of each segment, so that
    the bound is one inner product of these."""
    cols = []
    for part in np.array_split(np.arange(x.shape[1]), min(segments, x.shape[1])):
        s = x[:, part]
        cols += [s.mean(axis=1) * np.sqrt(len(part)), s.std(axis=1) * np.sqrt(len(part))]
    return np.stack(cols, axis=1)


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    return np.lexsort((ids, -score))[:k]


def cell_top(qid: np.ndarray, q: np.ndarray, cid: np.ndarray, c: np.ndarray, k: int):
    """(query place, id, score) of each query's k best among the candidates."""
    dims = max(1, q.shape[1])
    exact_in_float = dims * max(1.0, np.abs(q).max(initial=0)) * max(1.0, np.abs(c).max(initial=0)) < 2.0 ** 53
    if not exact_in_float:
        for i in range(len(qid)):
            row = [int(v) for v in q[i]]
            s = [sum(a * int(b) for a, b in zip(row, r, strict=True)) for r in c]
            order = sorted((j for j in range(len(cid)) if cid[j] != qid[i]), key=lambda j: (-s[j], cid[j]))[:k]
            for j in order:
                yield i, int(cid[j]), s[j]
        return
    order = np.argsort(-(c * c).sum(axis=1), kind="stable")  # long vectors first: high scores early
    cid, c = cid[order], c[order]
    top_score = np.full((len(qid), k), -np.inf)
    top_id = np.full((len(qid), k), np.iinfo(np.int64).max)
    q_stats = [segment_stats(q, n) for n in LEVELS]
    own = {}
    for i, v in enumerate(qid.tolist()):
        own.setdefault(v, []).append(i)
    last_gain = [1.0] * len(LEVELS)
    for turn, lo in enumerate(range(0, len(cid), CHUNK)):
        ids, x = cid[lo:lo + CHUNK], c[lo:lo + CHUNK]
        rows, cols = np.arange(len(qid)), np.arange(len(ids))
        worst = top_score[:, -1]
        if np.isfinite(worst).all():
            # a level that lately left nearly all rows and columns alive is only tried now and then
            for n, level in enumerate(LEVELS):
                if (last_gain[n] < LEAST_GAIN and turn % RETRY) or not len(rows) or not len(cols):
                    continue
                bound = q_stats[n][rows] @ segment_stats(x[cols], level).T
                bound += 1e-6 * (1.0 + np.abs(bound))  # rounding of the bound itself
                live = bound >= worst[rows, None]
                was = live.size
                rows, cols = rows[live.any(axis=1)], cols[live.any(axis=0)]
                last_gain[n] = 1.0 - len(rows) * len(cols) / was
        if not len(rows) or not len(cols):
            continue
        exact = q[rows] @ x[cols].T
        for j, v in enumerate(ids[cols].tolist()):
            if v in own:
                exact[np.isin(rows, own[v]), j] = -np.inf
        use = (exact >= worst[rows, None]) & (exact > -np.inf)
        hit = np.flatnonzero(use.any(axis=1))
        if not np.isfinite(worst).all() and exact.shape[1] > 4 * k:  # the first chunk: only its k best, ties included
            use &= exact >= np.partition(exact, exact.shape[1] - k, axis=1)[:, exact.shape[1] - k][:, None]
        for r in hit.tolist():
            j = np.flatnonzero(use[r])
            s = np.concatenate([top_score[rows[r]], exact[r, j]])
            i = np.concatenate([top_id[rows[r]], ids[cols[j]]])
            b = _best(s, i, k)
            top_score[rows[r]], top_id[rows[r]] = s[b], i[b]
    for i in range(len(qid)):
        for s, j in zip(top_score[i].tolist(), top_id[i].tolist(), strict=True):
            if s > -np.inf:
                yield i, j, int(s)


def _matrix(col: pd.Series) -> np.ndarray:
    return np.stack(col.to_numpy()).astype(np.float64)


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY, id_col: str = "vec_id",
          vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) for every row whose id is divisible by
    ``every``, against all other rows."""
    finite = F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = (vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col))
            .filter(F.col("vec_id").isNotNull() & F.col(vec_col).isNotNull() & (F.size(vec_col) > 0) & finite)
            .select("vec_id", F.transform(vec_col, lambda x: F.floor(x.cast("double") * 256.0).cast("double")).alias("v"),
                    F.monotonically_increasing_id().alias("row")))
    rows = stored(rows, "vectors")
    n = rows.count()
    c_blocks = max(1, -(-n // CANDIDATE_BLOCK))
    is_query = F.col("vec_id") % every == 0
    n_queries = rows.filter(is_query).count()
    q_blocks = max(1, -(-n_queries // QUERY_BLOCK))
    spread = F.pmod(F.xxhash64("row"), F.lit(1 << 40))  # by row: repeated rows fill no block
    cand = rows.select("vec_id", "v", (spread % c_blocks).cast("int").alias("cb"),
                       F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))).alias("qb"))
    ask = rows.filter(is_query).select("vec_id", "v", (spread % q_blocks).cast("int").alias("qb"),
                                       F.explode(F.sequence(F.lit(0), F.lit(c_blocks - 1))).alias("cb"))

    def cell(qs: pa.Table, cs: pa.Table) -> pa.Table:
        out: tuple[list, list, list] = ([], [], [])
        if qs.num_rows and cs.num_rows:
            qs, cs = qs.to_pandas(), cs.to_pandas()
            q_len, c_len = qs["v"].map(len), cs["v"].map(len)
            for d in sorted(set(q_len)):
                q, c = qs[q_len == d], cs[c_len == d]
                if len(c):
                    qid = q["vec_id"].to_numpy()
                    for i, j, s in cell_top(qid, _matrix(q["v"]), c["vec_id"].to_numpy(), _matrix(c["v"]), k):
                        out[0].append(int(qid[i]))
                        out[1].append(j)
                        out[2].append(max(-(1 << 63), min((1 << 63) - 1, s)))
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()),
                         "score": pa.array(out[2], pa.int64())})

    cells = ask.groupBy("qb", "cb").cogroup(cand.groupBy("qb", "cb")).applyInArrow(
        cell, "query_id long, vec_id long, score long")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (cells.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
