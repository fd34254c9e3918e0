"""Row numbers that every scan gives alike, and a column found by them without moving the rows.

A row's number is its file's place among the table's files and its place in the file. It doesn't depend on how a scan
is split, so it is the same when executors were lost or added between two scans, and in a task that is run again.

A join by row number would shuffle every text. In looked_up() the other side, a few numbers for some of the rows, is
written to the shared folder in ranges of the key, and tasks read the ranges of the rows they have. A list of the files
with their first and last key, one entry a file, goes to the tasks; nothing of the rows does. A lost executor's tasks
read the files again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from plusminus.llm.common import columns_of, few_rows, file_system, fresh, saved, shared_path, small_batches

#: A row's place in its file takes the bits below this one.
FILE_BITS = 40
#: Keys are looked up in blocks of so many bits: what a task holds at once is bounded for any file.
BLOCK_BITS = 17
#: Bytes of a row group of the ranges' files: a task reads few others besides the ones it asks for.
ROW_GROUP = 1 << 20
#: What a plan over files may hold for its rows to be rows of the files.
ROW_BY_ROW = {"LogicalRelation", "Project", "Filter", "SubqueryAlias"}


def _of_files(docs: DataFrame) -> bool:
    """Whether docs are rows of Parquet files, each at most once, by the same rule in every scan."""
    plans = [docs._jdf.queryExecution().analyzed()]
    if not plans[0].deterministic():
        return False
    while plans:
        plan = plans.pop()
        if plan.nodeName() not in ROW_BY_ROW or plan.nodeName() == "LogicalRelation" and "parquet" not in plan.toString().lower():
            return False
        plans += [plan.children().apply(i) for i in range(plan.children().size())]
    return True


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """docs with a long column `name`, a number for each row that every scan of the result gives alike.

    Rows of Parquet files are numbered as they are read, in one pass without a shuffle; other docs are written to the shared
    folder first. What is broadcast is the list of files, which the driver's list of the table holds already.
    """
    docs = docs if _of_files(docs) else saved(docs, "rows")
    spark, path, at, number = docs.sparkSession, fresh("path"), fresh("at"), fresh("number")
    meta = docs.metadataColumn("_metadata")
    files = sorted(r[0] for r in docs.select(meta["file_path"]).distinct().collect())
    placed = docs.select(*columns_of(docs), meta["file_path"].alias(path), meta["row_index"].alias(at))
    numbers = few_rows(spark, [(f, i) for i, f in enumerate(files)], f"{path} string, {number} long")
    return placed.join(F.broadcast(numbers), path).select(*columns_of(docs), (F.shiftleft(number, FILE_BITS) + F.col(at)).alias(name))


def ranges(table: DataFrame, key: str, row_group: int = ROW_GROUP) -> list[tuple[str, int, int]]:
    """Writes table to the shared folder in ranges of key; gives each file's path, first and last key, one entry a file."""
    path = shared_path(table.sparkSession, "ranges")
    with small_batches(table.sparkSession):
        table.repartitionByRange(key).sortWithinPartitions(key).write.option("parquet.block.size", row_group).parquet(path)
    written = table.sparkSession.read.schema(table.schema).parquet(path).select(F.col(key).alias("key"), F.col("_metadata.file_path").alias("path"))
    return [(r["path"], r["first"], r["last"]) for r in written.groupBy("path").agg(F.min("key").alias("first"), F.max("key").alias("last")).collect()]


def read_range(files: list[tuple[str, int, int]], key: str, low: int, high: int) -> pa.Table | None:
    """The rows with keys from low to high of what ranges() wrote, in order of key; None if no file can have any."""
    parts = []
    for path, first, last in files:
        if first <= high and low <= last:
            fs, local = file_system(path)
            with fs.open_input_file(local) as stream:
                parts.append(pq.read_table(stream, filters=[(key, ">=", low), (key, "<=", high)], use_threads=False))
    return pa.concat_tables(parts).sort_by(key) if parts else None


class Found:
    """A column by row number: take() gives the values of keys, null where there is none; keys of a block are read at once."""

    def __init__(self, files: list[tuple[str, int, int]], kind: DataType):
        self.files, self.target, self.block = files, to_arrow_type(kind), None
        self.there, self.values = np.zeros(0, np.int64), pa.array([], self.target)

    def _load(self, block: int) -> None:
        self.block = block
        whole = read_range(self.files, "key", block << BLOCK_BITS, (block + 1 << BLOCK_BITS) - 1)
        if whole is None:
            self.there, self.values = np.zeros(0, np.int64), pa.array([], self.target)
        else:
            self.there, self.values = whole.column("key").to_numpy(), whole.column("value").combine_chunks().cast(self.target)

    def take(self, keys: pa.Array) -> pa.Array:
        asked, out = keys.to_numpy(zero_copy_only=False).astype(np.int64), []
        for part in np.split(asked, np.flatnonzero(np.diff(asked >> BLOCK_BITS)) + 1):
            if len(part) and self.block != int(part[0]) >> BLOCK_BITS:
                self._load(int(part[0]) >> BLOCK_BITS)
            at = np.searchsorted(self.there, part)
            hit = at < len(self.there)
            hit[hit] = self.there[at[hit]] == part[hit]
            out.append(self.values.take(pa.array(np.where(hit, at, 0), pa.int64(), mask=~hit)))
        return pa.concat_arrays(out) if out else pa.array([], self.target)


def written(found: DataFrame, key: str, value: str) -> tuple[list[tuple[str, int, int]], DataType]:
    """What Found needs of found: key at most once each and never null, and value, of any type that Parquet holds."""
    narrow = found.select(F.col(key).alias("key"), F.col(value).alias("value"))
    return ranges(narrow, "key"), narrow.schema["value"].dataType


def looked_up(rows: DataFrame, key: str, found: DataFrame, value: str) -> DataFrame:
    """rows and the column value of found where key is the same, null elsewhere; no row of rows is moved.

    rows: key is a number that numbered() gave. found: key, at most once each and never null, and value; other columns
    are left out. An empty found gives nulls.
    """
    files, kind = written(found, key, value)

    def find(keys: Iterator[pa.Array]) -> Iterator[pa.Array]:
        there = Found(files, kind)
        for batch in keys:
            yield there.take(batch)

    result = fresh("found")
    return rows.withColumn(result, F.arrow_udf(find, kind)(F.col(key))).withColumnRenamed(result, value)
