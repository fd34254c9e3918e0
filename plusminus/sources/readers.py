"""Sources: text lines, records between marks, access logs, page views and wiki dumps.

All are Spark's own text reader, so compressed files are read as they are. A file is the natural cluster.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plusminus.functions import text as T
from plusminus.functions import wiki as W


def lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(value, file, block_start): text lines with the file and the start of the split they come from."""
    return spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block_start"))


def between(spark: SparkSession, path: str | list[str], start: str, end: str) -> DataFrame:
    """(value, file): records from a start mark to the next end mark, marks included; what is between records is left out.

    A record that the end of a file breaks off is left out, and with it any record of that file with just the same text.
    """
    if not start or not end:
        raise ValueError("a start and an end mark are needed")
    pieces = spark.read.option("lineSep", end).text(path).select("value", F.col("_metadata.file_path").alias("file"))
    at = F.instr("value", start)
    # The reader takes the end mark off; a piece without a start mark is what follows the last record.
    records = pieces.filter(F.col("value").contains(start))
    for file, rest in _broken_off(spark, pieces.inputFiles(), start.encode(), end.encode()):
        records = records.filter(~((F.col("file") == file) & (F.col("value").cast("binary") == F.lit(rest))))
    return records.select(F.concat(F.substr("value", at.cast("int")), F.lit(end)).alias("value"), "file")


def _broken_off(spark: SparkSession, files: list[str], start: bytes, end: bytes, step: int = 1 << 16) -> Iterator[tuple[str, bytes]]:
    """Files that end inside a record, and what they hold after their last end mark: only ends of files are read."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    codecs = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf)
    for file in files:
        path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(file))
        if codecs.getCodec(path) is not None:  # a compressed file that breaks off can't be read at all
            continue
        fs = path.getFileSystem(conf)
        size, tail, back = fs.getFileStatus(path).getLen(), b"", 0
        while end not in tail and back < size:
            back = min(size, max(step, 2 * back))
            stream = fs.open(path)
            try:
                stream.seek(size - back)
                tail = bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, back))
            finally:
                stream.close()
        rest = tail.rpartition(end)[2]
        if start in rest:
            yield jvm.org.apache.hadoop.fs.Path(path.toString()).toUri().toString(), rest  # as _metadata.file_path has it


def access_log(df: DataFrame, line: Column | str = "value") -> DataFrame:
    """df with the fields of a combined log; `parsed` is false where a line is no record, and the line stays."""
    return df.withColumns(T.parse_log(F.col(line) if isinstance(line, str) else line))


def page_views(df: DataFrame, line: Column | str = "value") -> DataFrame:
    """df with date, hour, project, page, size and parsed."""
    return df.withColumns(T.parse_view(F.col(line) if isinstance(line, str) else line))


def wiki_pages(df: DataFrame, page: Column | str = "value", lang: str = "en") -> DataFrame:
    """df with the columns of a wiki page: docid, title, language, markup, flags and links."""
    p = F.col(page) if isinstance(page, str) else page
    columns = {"docid": W.page_id(p), "title": W.title(p), "language": F.lit(W.language(lang).code), "markup": W.markup(p), "is_article": W.is_article(p)}
    columns |= {"is_redirect": W.is_redirect(p, lang), "is_disambig": W.is_disambiguation(p, lang), "is_stub": W.is_stub(p), "is_empty": W.is_empty(p), "links": W.links(p)}
    return df.withColumns(columns)


def wiki_dump(spark: SparkSession, path: str | list[str], lang: str = "en") -> DataFrame:
    return wiki_pages(between(spark, path, "<page>", "</page>"), "value", lang)
