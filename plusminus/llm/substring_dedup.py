"""Substring dedup (9): content-defined chunks by a gear rolling hash, deduplicated by digest.

The gear hash h = 2 h + gear[byte] runs over a text whose white space is folded to single spaces; a chunk ends
at the end of a word if CUT_BITS bits of h are zero. Those bits depend on the last few words only, so a cut comes
at the same places of a passage wherever the passage stands, and an insertion moves none but its neighbours. A
chunk has at most MOST_WORDS words. Whoever holds a passage of MIN_WORDS words or more holds its inner chunks.

A chunk is repeated if the same digest occurs earlier, in the order of (doc_id, place in the input, position).
Runs of repeated chunks that follow one another are joined; a run of RUN_WORDS words or more is a repeated passage.
RUN_WORDS is lower than MIN_WORDS because a passage loses the chunks that reach over its ends.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plusminus.llm import lookup
from plusminus.llm.common import columns_of, fresh, pieces, released, saved, slices, table
from plusminus.llm.lookup import looked_up

#: Passages of so many words are to be found; runs of whole repeated chunks count from RUN_WORDS.
MIN_WORDS, RUN_WORDS = 50, 25
#: A chunk ends at one word in 2 ** CUT_BITS on average, and after MOST_WORDS words at the latest.
CUT_BITS, MOST_WORDS = 2, 16
#: Chunks of so many words or more can be the ends of a repeated passage.
LONG_CHUNK = 4
#: The cut is decided by bits LOW_BIT and up of the hash, which depend on the last LOW_BIT + CUT_BITS bytes.
LOW_BIT = 14
SEED = 9

#: place and words, and start and length, share a long each: these rows are most of what is shuffled.
CHUNKS = "doc_id long, row long, place_words long, start_size long, digest long"
WORDS_IN, SIZE_IN = 1 << 8, 1 << 31


@functools.cache
def gear(seed: int = SEED) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 32, 256, np.uint32)


def rolling(data: np.ndarray, table256: np.ndarray) -> np.ndarray:
    """The gear hash after each byte, modulo 2 ** 32, by doubling the window: 1, 2, 4, 8, 16, 32 bytes."""
    h = table256[data]
    for width in (1, 2, 4, 8, 16):
        h[width:] += h[:-width] << np.uint32(width)
    return h


def _spans(piece: bytes, cut_bits: int, most_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, bytes, np.ndarray, np.ndarray]:
    """First and last word of each chunk (exclusive), the words' starts and ends in piece; the folded bytes and their ends."""
    raw = np.frombuffer(piece, np.uint8)
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    edge = np.diff(np.concatenate([[True], space, [True]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none, none, starts, b"", ends, none
    folded = b" ".join(piece.split())
    ends_folded = np.cumsum(ends - starts + 1) - 1
    h = rolling(np.frombuffer(folded, np.uint8), gear())[ends_folded - 1]
    cut = (h >> np.uint32(LOW_BIT)) & np.uint32((1 << cut_bits) - 1) == 0
    cut[-1] = True
    last = np.flatnonzero(cut) + 1
    first = np.concatenate([[0], last[:-1]])
    long = np.flatnonzero(last - first > most_words)
    if len(long):  # forced cuts, counted from the chunk's first word
        extra = np.concatenate([np.arange(first[i] + most_words, last[i], most_words) for i in long])
        last = np.sort(np.concatenate([last, extra]))
        first = np.concatenate([[0], last[:-1]])
    return first, last, starts, folded, ends, ends_folded


def chunks_of(data: bytes, cut_bits: int = CUT_BITS, most_words: int = MOST_WORDS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each piece of a UTF-8 text: starts and stops in code points, words and digests (signed 64-bit XXH3) of its chunks."""
    before = 0
    for piece in pieces(data):
        first, last, starts, folded, ends, ends_folded = _spans(piece, cut_bits, most_words)
        raw = np.frombuffer(piece, np.uint8)
        points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
        if len(first):
            a = np.where(first > 0, ends_folded[first - 1] + 1, 0).tolist()
            digests = np.array([xxhash.xxh3_64_intdigest(folded[i:j]) for i, j in zip(a, ends_folded[last - 1].tolist(), strict=True)], np.uint64).view(np.int64)
            yield before + points[starts[first]], before + points[ends[last - 1]], last - first, digests
        before += int(points[-1])


def chunks(docs: DataFrame, cut_bits: int = CUT_BITS, most_words: int = MOST_WORDS) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            for doc, row, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "row", "text")), strict=True):
                place = 0
                for start, stop, words, digest in chunks_of((text or "").encode("utf-8", "surrogatepass"), cut_bits, most_words):
                    n = len(words)
                    packed = [np.full(n, row), np.arange(place, place + n) * WORDS_IN + words, start * SIZE_IN + stop - start, digest]
                    place += n
                    ids = pa.array(np.full(n, doc if doc is not None else 0), pa.int64(), mask=np.full(n, doc is None))
                    yield pa.record_batch([ids, *(pa.array(c, pa.int64()) for c in packed)], ["doc_id", "row", "place_words", "start_size", "digest"])

    return docs.mapInArrow(released(run), CHUNKS)


def numbered(docs: DataFrame) -> DataFrame:
    """doc_id, text and row, the number of the row in its files, which tells rows of one doc_id apart."""
    row = fresh("row")
    return lookup.numbered(docs, row).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(row).alias("row"), F.col("text").cast("string").alias("text"))


def repeated_spans(rows: DataFrame, run_words: int = RUN_WORDS, cut_bits: int = CUT_BITS, most_words: int = MOST_WORDS) -> DataFrame:
    """row, start, stop (code points) and words of each repeated passage; the first occurrence of a passage isn't one.

    rows: what numbered() gives.
    """
    found = chunks(rows, cut_bits, most_words)
    at = F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc"), "row", "place_words")
    # A digest of very many occurrences is aggregated before the shuffle; the join back is one that Spark can split.
    first = found.groupBy("digest").agg(F.count("*").alias("n"), F.min(at).alias("first")).filter("n > 1")
    first = first.select("digest", F.col("first.row").alias("first_row"), F.col("first.place_words").alias("first_place"))
    again = found.select("digest", "row", "place_words", "start_size").join(first, "digest").filter("row != first_row or place_words != first_place").select("row", "place_words", "start_size")
    start = F.shiftright("start_size", 31)
    up, down = (Window.partitionBy("row").orderBy(x) for x in (F.col("place_words"), F.col("place_words").desc()))
    so_far = (Window.unboundedPreceding, Window.currentRow)
    # Chunks of a few words recur by chance: at the ends of a run they aren't part of the passage, only between longer ones.
    words = F.col("place_words") % WORDS_IN
    runs = again.withColumn("run", F.shiftright("place_words", 8) - F.row_number().over(up)).withColumn("long_run", F.when(words >= LONG_CHUNK, F.col("run")))
    runs = runs.withColumn("before", F.last("long_run", True).over(up.rowsBetween(*so_far))).withColumn("after", F.last("long_run", True).over(down.rowsBetween(*so_far)))
    inside = F.coalesce((F.col("before") == F.col("run")) & (F.col("after") == F.col("run")), F.lit(False))
    runs = runs.withColumn("inside", inside).groupBy("row", "run")
    stop = start + F.col("start_size") % SIZE_IN

    def within(total, x):
        return F.coalesce(total(F.when(F.col("inside"), x)), total(x))  # a run of short chunks alone counts whole

    runs = runs.agg(within(F.min, start).alias("start"), within(F.max, stop).alias("stop"), within(F.sum, words).alias("words"), F.sum(words).alias("all_words"))
    return runs.filter(F.col("all_words") >= run_words).drop("run", "all_words")


def mark_repeats(docs: DataFrame, run_words: int = RUN_WORDS, cut_bits: int = CUT_BITS, most_words: int = MOST_WORDS) -> DataFrame:
    """For each row of docs: doc_id, n_spans, repeated_words and spans ("start:stop,..." in code points, in order).

    A null, empty or blank text has no chunk and so no span. Of equal rows and equal texts the one with the smallest
    (doc_id, place in the input) keeps its passages; a null doc_id comes first. An empty table gives no rows.
    """
    rows = numbered(docs)
    spans = repeated_spans(rows, run_words, cut_bits, most_words)
    each = F.array_sort(F.collect_list(F.struct("start", "stop")))
    by_row = spans.groupBy("row").agg(each.alias("at"), F.sum("words").alias("repeated_words"))
    text = F.array_join(F.transform("at", lambda s: F.concat_ws(":", s["start"], s["stop"])), ",")
    joined = rows.select("doc_id", "row").join(by_row, "row", "left")
    return joined.select("doc_id", F.coalesce(F.size("at").cast("long"), F.lit(0).cast("long")).alias("n_spans"), F.coalesce("repeated_words", F.lit(0)).cast("long").alias("repeated_words"), F.coalesce(text, F.lit("")).alias("spans"))


def without_repeats(docs: DataFrame, run_words: int = RUN_WORDS) -> DataFrame:
    """docs with the repeated passages cut out of text; other columns and all rows stay. A null text stays null.

    Of equal texts the one with the smallest (doc_id, row number) keeps its passages. Texts are cut where they are read;
    only chunks and passages, as numbers, are shuffled. An empty table gives no rows.
    """
    row, spans = fresh("row"), fresh("spans")
    rows = lookup.numbered(docs, row)
    found = repeated_spans(rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(row).alias("row"), F.col("text").cast("string").alias("text")), run_words)
    found = saved(found.groupBy(F.col("row").alias(row)).agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias(spans)), "passages")
    text, place = F.col("text"), F.col(spans)
    # What stands between the passages, each part cut once: before the first, between neighbours, after the last.
    begin = lambda i: F.when(i > 0, F.get(place, i - 1)["stop"]).otherwise(0).cast("int")
    between = F.transform(place, lambda s, i: F.substring(text, begin(i) + 1, s["start"].cast("int") - begin(i)))
    left = F.concat(F.array_join(between, ""), F.substring(text, F.element_at(place, -1)["stop"].cast("int") + 1, F.lit((1 << 31) - 1)))
    joined = looked_up(rows, row, found, spans)
    return joined.withColumn("text", F.when(place.isNull(), text).otherwise(left)).select(*columns_of(docs))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mark_repeats(table(spark, sf_dir, "documents"))
