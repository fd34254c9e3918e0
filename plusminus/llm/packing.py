"""Packing (7): first-fit decreasing with a tournament tree, in randomised groups of documents.

Each document's ids are cut at multiples of the sequence length; a full piece is a sequence of its own,
the rest goes through first-fit decreasing. Tokenising is map-side and only rows of a few numbers are
shuffled, to groups of about GROUP_ROWS documents that are drawn by a hash of the row's place, so no
key decides where rows go and a group never grows with the input.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plusminus.llm.common import released, saved, slices, table, text_of
from plusminus.llm.word_tokens import END_ID, KEPT, default_path, encoder, forget

LENGTH = 2048
#: Documents of one group on average. More give less padding: the last bins of a group are the ones with room.
GROUP_ROWS = 4096
SEED = 7


class Bins:
    """Bins of one capacity in a tournament tree: each inner node has the larger free room of its two children."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.size, self.count = capacity, 1 << max(0, most - 1).bit_length(), 0
        self.free = [capacity] * (2 * self.size)

    def first_fit(self, need: int) -> tuple[int, int]:
        """The first bin with room for need, and the offset there; bins not yet used have full room."""
        free, node = self.free, 1
        while node < self.size:
            node *= 2
            if free[node] < need:
                node += 1
        offset, at = self.capacity - free[node], node - self.size
        free[node] -= need
        self.count = max(self.count, at + 1)
        while node > 1:
            node //= 2
            most = max(free[2 * node], free[2 * node + 1])
            if free[node] == most:
                break
            free[node] = most
        return at, offset


def first_fit_decreasing(lengths: list[int], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of each piece; longer pieces are placed first, equal ones in the order given."""
    bins, placed = Bins(capacity, max(1, len(lengths))), [(0, 0)] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        placed[i] = bins.first_fit(lengths[i])
    return placed


PIECES = "doc_id long, row long, start long, length long, ids_crc32 long, doc_tokens long"
PACKED = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _cut(path: str, capacity: int, end_id: int, kept: int, forgets: bool):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from cut(batches)
        finally:
            if forgets:
                forget()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(path, kept)
        for batch in slices(batches, 4096):
            rows = []
            found = code.encode_column(batch.column("text"))
            for doc, row, ids in zip(batch.column("doc_id").to_pylist(), batch.column("row").to_pylist(), found, strict=True):
                ids += end
                n = len(ids) // 4
                rows += [(doc, row, s, min(capacity, n - s), zlib.crc32(ids[4 * s : 4 * (s + capacity)]), n) for s in range(0, n, capacity)]
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            yield pa.record_batch([pa.array(list(c), pa.int64()) for c in columns], ["doc_id", "row", "start", "length", "ids_crc32", "doc_tokens"])

    return run


def _pack(capacity: int):
    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("row", "ascending"), ("start", "ascending")])
        lengths = group.column("length").to_pylist()
        placed = first_fit_decreasing(lengths, capacity)
        first = (group.column("bucket")[0].as_py() if lengths else 0) << 32
        return pa.table(
            {c: group.column(c) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")}
            | {"sequence_id": pa.array([first + b for b, _ in placed], pa.int64()), "offset": pa.array([o for _, o in placed], pa.int64())}
        )

    return run


def pack(docs: DataFrame, path: str | None = None, capacity: int = LENGTH, group_rows: int = GROUP_ROWS, seed: int = SEED, end_id: int = END_ID, kept: int = KEPT, forgets: bool = False) -> DataFrame:
    """One row for each piece of each document: where its ids are and which place of which sequence they take.

    A null or empty text is the end id alone. Rows with a null or repeated doc_id are packed like any other.
    An empty table gives no rows. Sequence ids are unique over all groups; offsets have no gaps. The ids of a
    document of n tokens make ceil(n / capacity) pieces. kept: bytes of words with their ids that a Python worker
    remembers; with forgets only until its task ends.
    """
    groups = max(1, -(-docs.count() // group_rows))
    rows = text_of(docs).withColumn("row", F.monotonically_increasing_id())
    cut = saved(rows.mapInArrow(released(_cut(path or default_path(), capacity, end_id, kept, forgets)), PIECES), "pieces")
    bucket = F.pmod(F.xxhash64(F.lit(seed), "row"), F.lit(groups))
    return cut.withColumn("bucket", bucket).groupBy("bucket").applyInArrow(_pack(capacity), PACKED)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
