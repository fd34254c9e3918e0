"""Token-ID files (4): independent zstandard frames, a trailing seek table and a checksum for each frame.

A file holds documents in ascending doc_id order. Each document is one or more zstandard frames of little-endian
ids; the last data frame is the index (an Arrow stream of doc_id, frames and tokens); the seek table of the public
"zstd seekable format" follows as a skippable frame. A reader takes the footer, the seek table and the index, and
then decompresses the frames of the documents that are asked for and no others. Any zstandard tool can read the file.
"""

from __future__ import annotations

import io
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plusminus.llm.common import few_rows, file_system, shared_path, slices, table, text_of
from plusminus.llm.word_tokens import END_ID, default_path, encoder

#: Fixed values of the zstd seekable format.
SKIPPABLE_MAGIC, SEEKABLE_MAGIC, HAS_CHECKSUMS = 0x184D2A5E, 0x8F92EAB1, 0x80
FOOTER = struct.Struct("<IBI")
ENTRY = struct.Struct("<III")
#: Ids of one frame at most: longer documents take several frames.
FRAME_IDS = 1 << 20
LEVEL = 3
#: Documents of one file on average, up to MOST_FILES files; then files grow, as each is a reduce partition and a manifest row.
FILE_ROWS, MOST_FILES = 8192, 20_000


class FileWriter:
    """Writes one file to a stream. width is 2 or 4 bytes an id."""

    def __init__(self, out, width: int):
        self.out, self.width, self.entries = out, width, []
        self.pack = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True, write_content_size=True)
        self.index: dict[str, list] = {"doc_id": [], "frames": [], "tokens": []}

    def _frame(self, data: bytes) -> None:
        packed = self.pack.compress(data)
        self.out.write(packed)
        self.entries.append((len(packed), len(data), xxhash.xxh64_intdigest(data) & 0xFFFFFFFF))

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        ids, first = ids.astype(f"<u{self.width}"), len(self.entries)
        for start in range(0, max(1, len(ids)), FRAME_IDS):
            self._frame(ids[start : start + FRAME_IDS].tobytes())
        for k, v in (("doc_id", doc_id), ("frames", len(self.entries) - first), ("tokens", len(ids))):
            self.index[k].append(v)

    def close(self) -> None:
        sink = pa.BufferOutputStream()
        rows = pa.table({k: pa.array(v, pa.int64()) for k, v in self.index.items()}).replace_schema_metadata({"width": str(self.width)})
        with pa.ipc.new_stream(sink, rows.schema) as stream:
            stream.write_table(rows)
        self._frame(sink.getvalue().to_pybytes())
        body = b"".join(ENTRY.pack(*e) for e in self.entries) + FOOTER.pack(len(self.entries), HAS_CHECKSUMS, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body)


class FileReader:
    """Random access to one file by document; decompresses requested frames only and checks each one's checksum."""

    def __init__(self, stream):
        self.stream, size = stream, stream.seek(0, io.SEEK_END)
        count, flags, magic = FOOTER.unpack(self._at(size - FOOTER.size, FOOTER.size))
        if magic != SEEKABLE_MAGIC or flags != HAS_CHECKSUMS:
            raise ValueError("no seek table")
        entries = np.frombuffer(self._at(size - FOOTER.size - count * ENTRY.size, count * ENTRY.size), "<u4").reshape(-1, 3).astype(np.int64)
        self.entries, self.offsets, self.bytes_read = entries, np.concatenate([[0], np.cumsum(entries[:, 0])]), 0
        self.unpack = zstandard.ZstdDecompressor()
        index = pa.ipc.open_stream(self._frame(count - 1)).read_all()
        self.width = int(index.schema.metadata[b"width"])
        self.doc_ids, frames = index.column("doc_id").to_pylist(), index.column("frames").to_numpy()
        self.tokens = index.column("tokens").to_pylist()
        self.first = np.concatenate([[0], np.cumsum(frames)]).astype(np.int64)

    def _at(self, offset: int, size: int) -> bytes:
        self.stream.seek(int(offset))
        return self.stream.read(int(size))

    def _frame(self, k: int) -> bytes:
        packed, size, check = self.entries[k].tolist()
        self.bytes_read += packed
        data = self.unpack.decompress(self._at(self.offsets[k], packed), max_output_size=size)
        if len(data) != size or xxhash.xxh64_intdigest(data) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {k} is damaged")
        return data

    def ids(self, place: int) -> Iterator[np.ndarray]:
        """The ids of the document at a place of the file, frame by frame, as unsigned 32-bit."""
        for k in range(self.first[place], self.first[place + 1]):
            yield np.frombuffer(self._frame(k), f"<u{self.width}").astype("<u4")

    def find(self, doc_ids: Iterable[int]) -> dict[int, np.ndarray]:
        wanted = set(doc_ids)
        return {d: np.concatenate(list(self.ids(i))) for i, d in enumerate(self.doc_ids) if d in wanted}


MANIFEST = "part int, path string, documents long, tokens long, first_doc long, last_doc long"
READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _write(folder: str, path: str, end_id: int):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Each attempt of a task has its own file; only the one whose manifest row Spark commits is ever read.
        code, part, out, file = encoder(path), TaskContext.get().partitionId(), None, None
        where = f"{folder}/ids-{part:06d}-{uuid.uuid4().hex}.zst"
        for batch in slices(batches, 4096):
            for doc, ids in zip(batch.column("doc_id").to_pylist(), code.encode_column(batch.column("text")), strict=True):
                if out is None:
                    fs, local = file_system(where)
                    fs.create_dir(local.rpartition("/")[0], recursive=True)
                    out = fs.open_output_stream(local, compression=None)
                    file = FileWriter(out, 2 if code.size <= 1 << 16 and end_id < 1 << 16 else 4)
                file.add(doc, np.frombuffer(ids + end, "<u4"))
        if out is not None:
            file.close()
            out.close()
            ids = file.index["doc_id"]
            first = next((d for d in ids if d is not None), None)  # null ids come first
            row = {"part": [part], "path": [where], "documents": [len(ids)], "tokens": [sum(file.index["tokens"])], "first_doc": [first], "last_doc": [ids[-1]]}
            yield pa.RecordBatch.from_pydict(row, pa.schema([("part", pa.int32()), ("path", pa.string()), *((c, pa.int64()) for c in ("documents", "tokens", "first_doc", "last_doc"))]))

    return run


def write_files(docs: DataFrame, folder: str, path: str | None = None, file_rows: int = FILE_ROWS, end_id: int = END_ID) -> DataFrame:
    """Writes the files under folder and returns their manifest, a row for each file, read from folder/manifest.

    Documents go to files by ranges of (doc_id, place in the input), so one repeated doc_id fills many files
    rather than one; null ids come first. A null text is empty; each document ends with the end id. An empty table
    gives an empty manifest.
    """
    files = min(MOST_FILES, max(1, -(-docs.count() // file_rows)))
    rows = text_of(docs).withColumn("row", F.monotonically_increasing_id())
    order = [F.col("doc_id").asc_nulls_first(), F.col("row").asc()]
    manifest = rows.repartitionByRange(files, *order).sortWithinPartitions(*order).drop("row").mapInArrow(_write(folder, path or default_path(), end_id), MANIFEST)
    manifest.write.parquet(f"{folder}/manifest")
    return docs.sparkSession.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def read_files(manifest: DataFrame) -> DataFrame:
    """Every document of the files, from the files: its doc_id, the ids before it, their number and CRC-32.

    Documents come as they were written: null ids first, repeated ones each on its own, a null or empty text as its end id
    alone. An empty manifest gives no rows. A damaged frame is an error.
    """
    spark, before, rows = manifest.sparkSession, 0, []
    for r in sorted(manifest.select("part", "path", "tokens").collect()):  # a row for each file, MOST_FILES at most
        rows.append((r.path, before))
        before += r.tokens
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                fs, local = file_system(uri)
                with fs.open_input_file(local) as stream:
                    file, crcs = FileReader(stream), []
                    for place in range(len(file.doc_ids)):
                        crc = 0
                        for ids in file.ids(place):
                            crc = zlib.crc32(ids.tobytes(), crc)
                        crcs.append(crc)
                n = np.array(file.tokens, np.int64)
                starts = start + np.cumsum(n) - n
                yield pa.record_batch([pa.array(file.doc_ids, pa.int64()), pa.array(starts), pa.array(n), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    tasks = min(max(1, len(rows)), 8 * spark.sparkContext.defaultParallelism + len(rows) // 8)
    return few_rows(spark, rows, "path string, start long").repartition(tasks).mapInArrow(read, READ)


def read_documents(manifest: DataFrame, doc_ids: list[int]) -> dict[int, np.ndarray]:
    """The ids of a few documents, on the driver: opens only files whose range can hold them.

    Ids that aren't there have no entry; of rows with one doc_id the last one's ids are given; null ids can't be asked for.
    """
    found: dict[int, np.ndarray] = {}
    if not doc_ids:
        return found
    low, high = min(doc_ids), max(doc_ids)
    for r in manifest.filter((F.col("first_doc") <= high) & (F.col("last_doc") >= low)).orderBy("part").select("path").collect():
        fs, local = file_system(r.path)
        with fs.open_input_file(local) as stream:
            found |= FileReader(stream).find(doc_ids)
    return found


def op4_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_path(spark, "token-files")
    return read_files(write_files(table(spark, sf_dir, "documents"), folder))
