"""Exact top-k inner product (8): the threshold algorithm over sorted per-dimension lists.

Vectors become integers (floor of 1024 times each component) and are packed in blocks; a block's lists are its
rows in the order of each dimension. For a query the lists are read from the end that its sign favours, all to
the same depth; rows met for the first time are scored in full. The bound at a depth is the sum over dimensions of
the query's component times the value reached, and no unseen row scores above it, so reading ends once the bound is
below the k-th score. Blocks, and chunks of queries, are written to the shared folder once; what is shuffled is the numbers
of pairs of a block and a chunk, and the k results of each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plusminus.llm.common import few_rows, released, saved, table
from plusminus.llm.lookup import ranges, read_range

K, SCALE, EVERY = 10, 1024, 100
#: Vectors of a block and queries of a chunk on average: a few MB in a task, however large the tables are.
BLOCK, CHUNK = 8192, 256
#: Depth of the first step; each later step goes twice as deep.
DEPTH = 32
#: Below this, sums of products are exact in doubles; below the next, in 64-bit integers.
EXACT, LONG = float(1 << 53), float(1 << 63)


def scores(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products as exact integers; those beyond 64 bits are cut to the range of a long."""
    top = np.abs(query).sum(dtype=np.float64) * float(np.abs(rows).max(initial=0.0))
    if top < EXACT:
        return (rows.astype(np.float64) @ query.astype(np.float64)).astype(np.int64)
    whole = [sum(int(a) * int(b) for a, b in zip(r, query, strict=True)) for r in rows]
    return np.array([max(-(1 << 63), min((1 << 63) - 1, x)) for x in whole], np.int64)


class Lists:
    """A block of vectors (as integral doubles, rows by dimensions) and its sorted lists."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        self.order = np.argsort(-vectors, axis=0, kind="stable")
        self.sorted = np.take_along_axis(vectors, self.order, 0)
        self.order_up, self.sorted_up = self.order[::-1], self.sorted[::-1]

    def search(self, query: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray, int]:
        """Rows and scores of the k best by (score, then smaller id); own marks the query's own row. And the rows scored."""
        n = len(self.vectors)
        best, score, met, depth, step = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(n, bool), 0, DEPTH
        down = np.flatnonzero(query > 0)
        up = np.flatnonzero(query < 0)
        if not len(down) and not len(up):  # every row scores zero
            met[:] = True
            best = np.flatnonzero(~own)
            score, depth = np.zeros(len(best), np.int64), n
        while depth < n:
            end = min(n, depth + step)
            new = np.zeros(n, bool)
            new[self.order[depth:end, down]] = True
            new[self.order_up[depth:end, up]] = True
            new &= ~met
            met |= new
            at = np.flatnonzero(new & ~own)
            best, score = np.concatenate([best, at]), np.concatenate([score, scores(query, self.vectors[at])])
            if len(best) > k:
                keep = np.lexsort((ids[best], -score))[:k]
                best, score = best[keep], score[keep]
            depth, step = end, 2 * step
            if depth < n and len(best) >= k:
                terms = np.concatenate([query[down] * self.sorted[depth - 1, down], query[up] * self.sorted_up[depth - 1, up]])
                if terms.sum() + np.abs(terms).sum() * 1e-12 < float(score.min()):  # at equality a smaller id may still come
                    break
            if met.all():
                break
        keep = np.lexsort((ids[best], -score))[:k]
        return best[keep], score[keep], int(met.sum())


def _search(blocks: list[tuple[str, int, int]], chunks: list[tuple[str, int, int]], k: int):
    def read(files: list[tuple[str, int, int]], place: int) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        rows = read_range(files, "place", place, place)
        if rows is None or not len(rows):
            return None
        vectors = rows.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)
        return rows.column("id").to_numpy(), rows.column("row").to_numpy(), vectors.astype(np.float64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held, lists = None, None, None
        for batch in batches:
            for block, chunk in zip(batch.column("block").to_pylist(), batch.column("chunk").to_pylist(), strict=True):
                if block != last:  # pairs of one block follow one another
                    last, held = block, read(blocks, block)
                    lists = Lists(held[2]) if held else None
                asked = read(chunks, chunk)
                if not held or not asked:
                    continue
                out: list[list] = [[], [], [], []]
                for query_id, row, query in zip(asked[0].tolist(), asked[1].tolist(), asked[2], strict=True):
                    at, score, _ = lists.search(query, held[0], held[1] == row, k)
                    for c, v in zip(out, ([query_id] * len(at), [row] * len(at), held[0][at], score), strict=True):
                        c.extend(v)
                yield pa.record_batch([pa.array(c, pa.int64()) for c in out], ["query_id", "query_row", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, is_query, k: int = K, scale: float = SCALE, block: int = BLOCK, chunk: int = CHUNK) -> DataFrame:
    """The k best rows of vectors (vec_id, embedding) for each of its rows where is_query holds.

    Columns query_id, rank (from 1), vec_id, score; ties go to the smaller vec_id. A row is never its own result, but
    another row of the same vec_id can be. Rows without vec_id, and vectors that are null, empty or hold a null or
    non-finite component, take no part. Vectors of another length than the query's are no candidates for it. Scores
    are exact; those beyond a long are cut to its range. With fewer than k candidates all are returned.
    """
    scaled = lambda e: F.lit(float(scale)) * e.cast("double")
    # Doubles of 2 ** 53 and more are integers already, and floor() would leave the range of a long.
    x = F.transform("embedding", lambda e: F.when(F.abs(scaled(e)) < 2.0**53, F.floor(scaled(e)).cast("double")).otherwise(scaled(e)))
    whole = F.forall("embedding", lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(scaled(e)) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("id"), F.monotonically_increasing_id().alias("row"), F.col("embedding"), is_query.alias("asks"))
    rows = rows.filter(F.col("id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & whole)
    rows = saved(rows.select("id", "row", F.size("embedding").alias("size"), x.alias("v"), "asks"), "vectors")
    # One row for each vector length there is.
    n = {r["size"]: (max(1, -(-r["n"] // block)), max(1, -(-r["q"] // chunk))) for r in rows.groupBy("size").agg(F.count("*").alias("n"), F.count_if("asks").alias("q")).collect()}
    spark, starts, first_block, first_chunk = vectors.sparkSession, [], 0, 0
    for size, (b, c) in sorted(n.items()):  # numbers of blocks and chunks run on over the lengths
        starts.append((size, first_block, b, first_chunk, c))
        first_block, first_chunk = first_block + b, first_chunk + c
    plan = few_rows(spark, starts, "size int, first_block long, blocks long, first_chunk long, chunks long")
    placed, mixed = rows.join(F.broadcast(plan), "size"), F.xxhash64("row")
    blocks = ranges(placed.select((F.col("first_block") + F.pmod(mixed, "blocks")).alias("place"), "id", "row", "v"), "place")
    chunks = ranges(placed.filter("asks").select((F.col("first_chunk") + F.pmod(mixed, "chunks")).alias("place"), "id", "row", "v"), "place")
    pairs = plan.select(F.explode(F.sequence(F.col("first_block"), F.col("first_block") + F.col("blocks") - 1)).alias("block"), "first_chunk", "chunks")
    # Each block is a row by now: many tasks make its pairs.
    pairs = pairs.repartition("block").select("block", F.explode(F.sequence(F.col("first_chunk"), F.col("first_chunk") + F.col("chunks") - 1)).alias("chunk"))
    total = sum(b * c for _, _, b, _, c in starts)
    tasks = min(max(total, 1), 4 * spark.sparkContext.defaultParallelism + total // 64)
    dealt = pairs.repartition(tasks, "block", "chunk").sortWithinPartitions("block", "chunk")
    found = dealt.mapInArrow(released(_search(blocks, chunks, k)), "query_id long, query_row long, vec_id long, score long")
    ranked = Window.partitionBy("query_row").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % EVERY == 0)


OP8_SQL = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % {EVERY} = 0
), ranked AS (
  SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank FROM pairs
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= {K}
"""
