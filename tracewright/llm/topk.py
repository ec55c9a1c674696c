"""Exact top-k search by inner product with pivot-table elimination.

The components are integers, floor(scale * x). With |q - v|^2 = |q|^2 + |v|^2 - 2 q.v a lower bound of the
distance is an upper bound of the score. A table of distances to pivots gives such bounds without
touching the vectors: |d(q, p) - d(v, p)| <= |q - v| for every pivot p, and the greatest over the pivots
is the bound. For each query the candidates are evaluated in the order of their bounds until no bound
left reaches the k-th score found, which makes the answer exact.

Queries and candidates are dealt into blocks of bounded bytes; a task holds one block of each and returns
k rows a query, and a second step ranks what the blocks return. A query starts with a floor, its k-th
score among the rows the pivots were chosen from, so that no block begins without a threshold. Each pair
of blocks meets once: with blocks of b bytes, n vectors and q queries of w bytes, n * q * w^2 * 2 / b bytes
are shuffled. How much the bounds save is up to the data (README).

Defined cases: a vector that is null, or holds a null or a component that is not finite, takes no part;
rows with a null id take no part; vectors of different length are compared as if zeros followed; the
empty vector scores 0 with every other. Ties go to the smaller id. Rows that repeat an id are candidates
each, and never of a query with their own id; a query id that is repeated is answered once, from its
first vector in order of components. No candidates, no rows. Every finite vector takes part: those with
components beyond 2^31 / sqrt(length) are compared in Python's integers, whatever their size. Only a score
among a query's k best that doesn't fit a long is an error. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of a block of queries and of a block of candidates.
QUERY_BYTES, CANDIDATE_BYTES = 16 << 20, 4 << 20
#: Pivots, chosen from so many rows.
PIVOTS, PIVOT_SAMPLE = 32, 2048
#: Candidates evaluated at once, in order of their bounds.
STEP = 256
#: No floor; a score too low for a long, which is an error only where it is among a query's k best.
LOWEST, BELOW = -(2**62), -(2**63)
HITS = "query_id long, vec_id long, score long"


def quantised(vector: str, scale: int) -> Column:
    """floor(scale * x) of each component, whole numbers held by doubles (scale is a power of two); null where the vector takes no part."""
    x = F.transform(F.col(vector), lambda v: v.cast("double"))
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    scaled = lambda v: v * F.lit(float(scale))
    # Doubles from 2^52 on are whole.
    whole = lambda v: F.when(F.abs(scaled(v)) < 2.0**52, F.floor(scaled(v)).cast("double")).otherwise(scaled(v))
    return F.when(F.col(vector).isNotNull() & finite, F.transform(x, whole))


def is_large(x: list[int]) -> bool:
    """Whether products of the vector could exceed 2^62, or its components a double's whole numbers."""
    return len(x) > 0 and max(abs(int(y)) for y in (min(x), max(x))) * len(x) ** 0.5 >= 2.0**31


def spread_pivots(rows: list[list[int]], count: int) -> np.ndarray:
    """Rows far from one another: each next is the farthest from those chosen."""
    width = max(map(len, rows), default=0)
    x = padded(rows, width)
    if not len(x):
        return np.zeros((0, 0))
    chosen, near = [0], ((x - x[0]) ** 2).sum(axis=1)
    while len(chosen) < min(count, len(x)) and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
    return x[chosen]


def padded(rows: list, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width), np.float64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    width = max(x.shape[1], pivots.shape[1])
    x, p = (np.pad(a, ((0, 0), (0, width - a.shape[1]))) for a in (x, pivots))
    return np.sqrt(np.maximum(0, (x**2).sum(axis=1)[:, None] + (p**2).sum(axis=1)[None] - 2 * x @ p.T))


def block_search(q_ids: np.ndarray, q: np.ndarray, floors: np.ndarray, ids: np.ndarray, v: np.ndarray, pivots: np.ndarray, k: int) -> pd.DataFrame:
    """The k best candidates of this block for each of these queries, of those that reach the query's floor."""
    order = np.argsort(ids, kind="stable")
    ids, v = ids[order], v[order]
    q_norm, v_norm = (q**2).sum(axis=1), (v**2).sum(axis=1)
    q_far, v_far = distances(q, pivots), distances(v, pivots)
    # What rounding can take from a bound, amply.
    slack = 1e-6 * (q_norm.max(initial=1) + v_norm.max(initial=1)) + 1
    exact = v if max(q_norm.max(initial=0), v_norm.max(initial=0)) < 2**52 else v.astype(np.int64)
    out: list[tuple[int, int, int]] = []
    for i in range(len(q_ids)):
        gap = np.zeros(len(v))
        for p in range(v_far.shape[1]):
            np.maximum(gap, np.abs(v_far[:, p] - q_far[i, p]), out=gap)
        bound = (q_norm[i] + v_norm - gap**2) / 2 + slack
        by_bound = np.argsort(-bound, kind="stable")
        own = q[i] if exact is v else q[i].astype(np.int64)
        best: list[tuple[int, int]] = []  # (-score, id)
        for at in range(0, len(by_bound), STEP):
            take = by_bound[at : at + STEP]
            least = max(floors[i], -best[-1][0] if len(best) == k else floors[i])
            if bound[take[0]] < least:
                break  # no candidate left can reach the k-th score
            take = take[(ids[take] != q_ids[i]) & (bound[take] >= least)]
            scores = (exact[take] @ own).astype(np.int64)
            take, scores = take[scores >= least], scores[scores >= least]
            near = np.lexsort((ids[take], -scores))[:k]
            best = sorted([*best, *zip((-scores[near]).tolist(), ids[take[near]].tolist(), strict=True)])[:k]
        out += [(int(q_ids[i]), c, -s) for s, c in best]
    return pd.DataFrame(out, columns=["query_id", "vec_id", "score"], dtype="int64")


def floor_scores(q_ids: np.ndarray, q: list, sample: tuple[np.ndarray, np.ndarray], k: int) -> list[int]:
    """Each query's k-th score among the sample's rows of other ids, or the least long."""
    ids, v = sample
    out = []
    for i, x in zip(q_ids, q, strict=True):
        others = v[ids != i]
        if is_large(x) or len(others) < k:
            out.append(LOWEST)
            continue
        own = np.zeros(max(v.shape[1], len(x)))
        own[: len(x)] = x
        scores = others @ own[: v.shape[1]]
        # Less what rounding can add; never above the true k-th score.
        out.append(max(LOWEST, int(np.partition(scores, -k)[-k] - 1 - 1e-9 * np.abs(scores).max())))
    return out


def exact_search(q_ids: list[int], q: list, ids: list[int], v: list, k: int) -> pd.DataFrame:
    """The same for vectors of any size, pair by pair in Python's integers."""
    out: list[tuple[int, int, int]] = []
    v = [[int(y) for y in x] for x in v]
    for query, x in zip(q_ids, q, strict=True):
        x = [int(y) for y in x]
        scores = [(-sum(a * b for a, b in zip(x, y, strict=False)), i) for i, y in zip(ids, v, strict=True) if i != query]
        best = sorted(scores)[:k]
        # Of the scores that are too high for a long one is certainly among the k best of all.
        if any(-s >= 2**63 for s, _ in best):
            raise OverflowError(f"a score of vector {query} doesn't fit a long")
        out += [(query, i, max(-s, BELOW)) for s, i in best]
    return pd.DataFrame(out, columns=["query_id", "vec_id", "score"], dtype="int64")


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k best other rows for each row of is_query."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), quantised(vector, scale).alias("x"), F.coalesce(is_query, F.lit(False)).alias("asks")).where("id is not null and x is not null")
    n = rows.agg(F.count("*").alias("n"), F.count_if("asks").alias("q"), F.max(F.size("x")).alias("width")).first()
    wide = 8 * max(1, n.width or 0)
    q_blocks, v_blocks = (max(1, -(-rows_of * wide // size)) for rows_of, size in ((n.q, QUERY_BYTES), (n.n, CANDIDATE_BYTES)))
    found = rows.select("id", "x", F.xxhash64("id", "x").alias("h")).orderBy("h").limit(PIVOT_SAMPLE).collect()
    found = [r for r in found if not is_large(r.x)]
    sample = (np.array([r.id for r in found], np.int64), padded([r.x for r in found], max((len(r.x) for r in found), default=0)))
    pivots, sample = spark.sparkContext.broadcast(spread_pivots([r.x for r in found], PIVOTS)), spark.sparkContext.broadcast(sample)

    @F.pandas_udf("long")
    def floor(ids: pd.Series, x: pd.Series) -> pd.Series:
        return pd.Series(floor_scores(ids.to_numpy("int64"), list(x), sample.value, k), dtype="int64")

    mix = F.xxhash64(F.lit(17), "id", "x")
    asked = rows.where("asks").groupBy("id").agg(F.min("x").alias("x"))
    pairs_of = lambda name, n: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    # Not deterministic as far as the optimiser knows: else it would be worked out again for each block.
    asked = asked.select("id", "x", floor.asNondeterministic()("id", "x").alias("floor"))
    queries = asked.select(F.lit(True).alias("asks"), "id", "x", "floor", F.pmod(mix, F.lit(q_blocks)).cast("int").alias("qb"), pairs_of("vb", v_blocks))
    candidates = rows.select(F.lit(False).alias("asks"), "id", "x", F.lit(0).cast("long").alias("floor"), pairs_of("qb", q_blocks), F.pmod(mix, F.lit(v_blocks)).cast("int").alias("vb"))

    def search(part: pd.DataFrame) -> pd.DataFrame:
        asks, large = part["asks"].to_numpy(bool), np.array([is_large(x) for x in part["x"]], bool)
        some = part["x"][~large]
        x, ids = padded(list(some), max(map(len, some), default=0)), part["id"].to_numpy("int64")
        own, asked, floors = ids[~large], asks[~large], part["floor"].to_numpy("int64")[~large]
        found = block_search(own[asked], x[asked], floors[asked], own[~asked], x[~asked], pivots.value, k)
        if not large.any():
            return found
        rows = lambda mask: (ids[mask].tolist(), list(part["x"][mask]))
        more = [exact_search(*rows(asks & large), *rows(~asks), k), exact_search(*rows(asks & ~large), *rows(~asks & large), k)]
        return pd.concat([found, *more], ignore_index=True)

    hits = queries.unionByName(candidates.select(queries.columns)).repartition(q_blocks * v_blocks, "qb", "vb").groupBy("qb", "vb").applyInPandas(search, HITS)
    # k rows a query and block of candidates: keep k as they come together.
    best = F.slice(F.array_sort(F.collect_list(F.struct((-(F.col("score") + 1)).alias("r"), F.col("vec_id").alias("v"), F.col("score").alias("s")))), 1, k)
    score = F.when(F.col("hit.s") == BELOW, F.raise_error(F.lit("a score doesn't fit a long")).cast("long")).otherwise(F.col("hit.s"))
    ranked = hits.groupBy("query_id").agg(best.alias("best")).select("query_id", F.posexplode("best").alias("at", "hit"))
    return ranked.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("hit.v").alias("vec_id"), score.alias("score"))
