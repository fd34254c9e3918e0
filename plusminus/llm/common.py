"""What the operators of this subpackage share: the shared folder, slices of Arrow batches, words."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: ASCII white space: what bytes.split() splits on.
SPACE = re.compile(rb"[\x20\x09-\x0D]")
#: Texts are worked on in pieces of about this many bytes, so that memory stays bounded for any length.
PIECE = 1 << 20
#: Rows and bytes of an Arrow batch, and rows of a reader's batch, of texts: an executor's buffers, and the workers', keep
#: the size of the largest one.
SMALL_BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "2m", "spark.sql.parquet.columnarReaderBatchSize": "512"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Set here only where it is unset and Spark is one process (tests)."""
    context = spark.sparkContext
    if found := context.getConf().get("spark.checkpoint.dir"):
        return found.rstrip("/")
    if not context.getCheckpointDir():
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="plusminus-"))
    return context.getCheckpointDir().rstrip("/")


def shared_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs run inside send texts to Python a few MB at a time; the session's own settings hold again afterwards."""
    before = {k: spark.conf.get(k) for k in SMALL_BATCHES}
    try:
        for k, v in SMALL_BATCHES.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def saved(df: DataFrame, what: str, path: str | None = None) -> DataFrame:
    """df, written to the shared folder and read again: lineage is cut and a lost executor costs no recomputation."""
    path = path or shared_path(df.sparkSession, what)
    with small_batches(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Removes what saved() wrote to a path that nothing reads any more."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    found.getFileSystem(spark._jsc.hadoopConfiguration()).delete(found, True)


def few_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few rows of the driver, sent by Arrow: from a list, Spark would start Python workers on the executors to read them."""
    kind = StructType.fromDDL(schema)
    columns = list(zip(*rows, strict=True)) or [()] * len(kind)
    fields = to_arrow_schema(kind)
    return spark.createDataFrame(pa.Table.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, fields, strict=True)], schema=fields), schema=kind)


def columns_of(df: DataFrame) -> list[Column]:
    """The columns of df as they are, whatever their names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def fresh(name: str) -> str:
    """A column name that no input has."""
    return f"__{name}_{uuid.uuid4().hex}"


def text_of(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id as long and text alone; other columns, whatever their names, stay out."""
    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))


def released(run: Callable) -> Callable:
    """run, giving free memory back when a task ends: Python workers wait for later tasks, of other stages too."""

    def task(batches):
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # not the GNU C library
                ctypes.CDLL(None).malloc_trim(0)

    return task


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut to few rows, as Python copies of the texts take several times their size."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def per_text(make: Callable[[], Callable[[str | None], tuple]], fields: list[tuple[str, pa.DataType]]) -> Callable:
    """A function for mapInArrow that turns (doc_id, text) into doc_id and the named fields; make runs once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = make()
        for batch in slices(batches):
            found = [one(x) for x in batch.column("text").to_pylist()]
            columns = zip(*found, strict=True) if found else [[] for _ in fields]
            yield pa.record_batch([batch.column("doc_id"), *(pa.array(list(c), t) for c, (_, t) in zip(columns, fields, strict=True))], ["doc_id", *(n for n, _ in fields)])

    return run


def pieces(data: bytes, size: int = PIECE) -> Iterator[bytes]:
    """data, cut before white space into pieces of size bytes or a little more; no word is cut."""
    start = 0
    while start < len(data):
        at = SPACE.search(data, start + size) if start + size < len(data) else None
        end = at.start() if at else len(data)
        yield data[start:end] if start or at else data
        start = end


def word_lists(data: bytes) -> Iterator[list[bytes]]:
    """The words [^\\x20\\x09-\\x0D]+ of a text, list by list, in order."""
    for piece in pieces(data):
        if words := piece.split():
            yield words
