"""Exact top-k search by inner product: Fagin's threshold algorithm over sorted per-dimension lists.

Vectors are dealt by a hash of their id into blocks of `BLOCK` rows at most, about; queries travel to all blocks, vectors
never do. A block's vectors come first and its queries after them, so a task sorts each list once a block, holds one block,
and streams queries past it. Each dimension has its list of vectors, sorted by component. A query walks all lists at once,
from the end that its own sign favours; new vectors are scored in full; the bound is the score of a vector that stood at
the current depth in every list. The walk ends once the bound cannot beat, nor tie, the k-th result. Each block yields k
rows a query at most, merged by one ranking.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, documents_only, table

BLOCK, LEAST_BLOCK, STEP = 16_384, 2_048, 32


def best_of(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores, ties to smaller ids, in order."""
    if len(ids) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        ids, scores = ids[scores >= least], scores[scores >= least]
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def threshold_search(ids: np.ndarray, rows: np.ndarray, lists: np.ndarray, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of rows (integers) other than id `own`; lists: for each dimension, row numbers by rising component."""
    n = len(rows)
    dims = np.flatnonzero(query != 0)
    if not len(dims):
        found = ids[ids != own]
        return best_of(found, np.zeros(len(found), rows.dtype), k)
    part, positive = query[dims], query[dims] > 0
    seen = np.zeros(n, bool)
    top_ids, top = np.empty(0, ids.dtype), np.empty(0, rows.dtype)
    depth, step = 0, STEP
    while depth < n:
        upto = min(n, depth + step)
        ranks = np.where(positive, n - 1 - np.arange(depth, upto)[:, None], np.arange(depth, upto)[:, None])
        new = np.zeros(n, bool)
        new[lists[ranks, dims]] = True
        new &= ~seen
        seen |= new
        met = np.flatnonzero(new)
        met = met[ids[met] != own]
        top_ids, top = best_of(np.append(top_ids, ids[met]), np.append(top, rows[met][:, dims] @ part), k)
        at = np.where(positive, n - upto, upto - 1)
        if len(top) == k and (rows[lists[at, dims], dims] * part).sum() < top[-1]:
            break
        depth, step = upto, step * 2
    return top_ids, top


class Block:
    """Vectors of one length, their lists, and what a query finds among them."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray) -> None:
        if len(np.unique(ids)) < len(ids):  # a repeated row counts once
            _, first = np.unique(np.column_stack([ids.view(np.float64), rows]).view(np.uint64), axis=0, return_index=True)
            ids, rows = ids[np.sort(first)], rows[np.sort(first)]
        self.ids, self.rows, self.lists = ids, rows, np.argsort(rows, axis=0, kind="stable").astype(np.int32)
        self.largest = np.abs(rows).max(initial=0) + 1
        self.whole: np.ndarray | None = None

    def best(self, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        rows = self.rows
        if rows.shape[1] * self.largest * (np.abs(query).max(initial=0) + 1) >= 2.0**53:  # sums that doubles can't hold
            if self.whole is None:
                self.whole = np.array([[int(x) for x in row] for row in rows], object).reshape(rows.shape)
            rows, query = self.whole, np.array([int(x) for x in query], object)
        return threshold_search(self.ids, rows, self.lists, query, own, k)


def _blocks(k: int):  # noqa: ANN202
    """Rows (block, dim, asked, id, v), sorted by the first four -> query_id, key, vec_id, score; a query that is repeated counts once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        block, at, last, asked_of_last = None, None, None, set()
        for batch in batches:
            place = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)])
            ids, lists = batch.column(3).to_numpy(), batch.column(4)
            edges = [0, *(np.flatnonzero((place[1:] != place[:-1]).any(axis=1)) + 1).tolist(), len(place)]
            out: list[tuple[int, str, np.ndarray, np.ndarray]] = []
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                if lo == hi:
                    continue
                number, dim, asked = place[lo].tolist()
                rows = np.floor(256 * lists.slice(lo, hi - lo).flatten().to_numpy(zero_copy_only=False).reshape(hi - lo, dim))
                if at != (number, dim):
                    held, block, at, last = [], None, (number, dim), None
                if not asked:
                    held.append((ids[lo:hi], rows))
                    continue
                if held:
                    block, held = Block(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])), []
                for own, query in zip(ids[lo:hi].tolist(), rows, strict=True) if block is not None else ():
                    if own != last:
                        last, asked_of_last = own, set()
                    key = ",".join(str(int(x)) for x in query)
                    if key not in asked_of_last:
                        asked_of_last.add(key)
                        out.append((own, key, *block.best(query, own, k)))
            sizes = [len(o[2]) for o in out]
            take = pa.array(np.repeat(np.arange(len(out)), sizes))
            found, scores = [i for o in out for i in o[2].tolist()], [int(s) for o in out for s in o[3]]
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()).take(take), pa.array([o[1] for o in out], pa.string()).take(take), pa.array(found, pa.int64()), pa.array(scores, pa.int64())], ["query_id", "key", "vec_id", "score"])

    return run


def search(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """vectors, queries (id, v array<double>) -> query_id, rank (from 1), vec_id, score, of integers floor(256 * component).

    Rows with a null id, a null vector, an empty one, or a null or non-finite component take no part; a query meets vectors
    of its own length, other than those of its own id; a repeated row (id and components) counts once. Scores beyond 64 bits
    are an error.
    """

    def usable(df: DataFrame) -> DataFrame:
        v = F.col("v").cast("array<double>")
        fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        return df.select(F.col("id").cast("long").alias("id"), v.alias("v")).where("id is not null and size(v) > 0").where(fine).withColumn("dim", F.size("v"))

    vectors, queries = usable(vectors), usable(queries)
    n = vectors.count()
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    n_blocks = max(1, -(-n // BLOCK), min(2 * cores, n // LEAST_BLOCK))
    left = vectors.select(F.pmod(F.xxhash64("id"), F.lit(n_blocks)).cast("int").alias("block"), "dim", F.lit(0).alias("asked"), "id", "v")
    right = queries.select(F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"), "dim", F.lit(1).alias("asked"), "id", "v")
    dealt = left.unionByName(right).repartitionById(n_blocks, "block").sortWithinPartitions("block", "dim", "asked", "id")
    found = dealt.mapInArrow(_blocks(k), "query_id long, key string, vec_id long, score long")
    order = Window.partitionBy("query_id", "key").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents_only(table(spark, sf_dir, "embeddings"), "vec_id", "embedding").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return search(rows, rows.where("id % 50 = 0"))


SQL = {
    "op2_threshold": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(list_dot_product(q.e, v.e) AS BIGINT) AS score FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
""",
}
