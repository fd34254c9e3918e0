"""Quality rules (3): compression bands.

A document is compressed whole and in fixed chunks of its UTF-8 bytes; the ratio is compressed over raw bytes.
Repetitive text has a low ratio, random or encoded text a high one. The limits depend on the length, as a short
text can hardly be compressed and a long one shares more. A document goes if its whole ratio leaves its band, or
if more than half of its chunks leave theirs. The last chunk is the last CHUNK bytes, so that no byte is left out; a
text of fewer bytes is its own chunk. Texts of under 128 bytes get no verdict: frame headers decide their ratio.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession

from plusminus.llm.common import per_text, table, text_of, word_lists

LEVEL, CHUNK = 3, 4096
#: (from this many bytes, least ratio, largest ratio); below the first row there is no verdict. The limits are about 0.6
#: and 1.3 times the median ratio of the documents of a length that pass the base rules (sf0.1: 0.72, 0.63, 0.57, 0.51,
#: 0.48, 0.45, 0.44, 0.42 from the first row on), the last rows carried on from those before.
BANDS = (
    (128, 0.42, 0.94), (256, 0.38, 0.82), (512, 0.34, 0.74), (1024, 0.31, 0.66), (2048, 0.29, 0.62), (4096, 0.27, 0.59),
    (8192, 0.26, 0.57), (16384, 0.25, 0.55), (65536, 0.23, 0.54), (1 << 20, 0.20, 0.53),
)
#: The chunks' own band: all are CHUNK bytes.
CHUNK_BAND = (0.27, 0.59)
BAD_CHUNKS = 0.5
#: Base rules.
LEAST_WORDS, WINDOW, MOST_REPEATED_PERCENT = 20, 8, 30
SYMBOLS = b"#*$%&|<>"
_NO_SPACE = bytes(b for b in range(256) if b not in b" \t\n\x0b\f\r")
FIELDS = [("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("ratio", pa.float64()), ("bad_chunks", pa.int64()), ("n_chunks", pa.int64())]
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double, bad_chunks long, n_chunks long"


def repeated_words(ids: np.ndarray, window: int = WINDOW) -> int:
    """Words that lie in a window of so many words found twice or more in the text; ids: a number for each word."""
    n = len(ids) - window + 1
    if n < 2:
        return 0
    weights = np.random.default_rng(3).integers(1, 1 << 62, window, np.uint64) * np.uint64(2) + np.uint64(1)
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    h = np.zeros(n, np.uint64)
    for k in range(window):
        h += mixed[k : k + n] * weights[k]
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    at = np.flatnonzero(same)
    for k in range(window):  # equal hashes are compared word by word
        at = at[ids[order[at] + k] == ids[order[at + 1] + k]]
    covered = np.zeros(len(ids) + 1, np.int64)
    found = np.unique(np.concatenate([order[at], order[at + 1]]))
    np.add.at(covered, found, 1)
    np.add.at(covered, found + window, -1)
    return int((np.cumsum(covered)[:-1] > 0).sum())


def base_measures(data: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a UTF-8 text."""
    number: dict[bytes, int] = {}
    ids: list[int] = []
    for words in word_lists(data):
        ids += [number.setdefault(w, len(number)) for w in words]
    bytes_of_words = data.translate(None, b" \t\n\x0b\f\r")
    inner = len(bytes_of_words.translate(None, bytes(range(0x80, 0xC0))))
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    lines = [x for x in data.split(b"\n") if x.strip(b" \t\x0b\f\r")]
    return len(ids), inner, symbols, len(lines) - len(set(lines)), repeated_words(np.array(ids, np.int64)) if len(number) < len(ids) else 0


def band(size: int) -> tuple[float, float] | None:
    return next(((low, high) for least, low, high in reversed(BANDS) if size >= least), None)


class Bands:
    def __init__(self, level: int = LEVEL, chunk: int = CHUNK):
        self.pack, self.chunk = zstandard.ZstdCompressor(level=level, write_checksum=False, write_content_size=False), chunk

    def ratio(self, data: bytes) -> float:
        return len(self.pack.compress(data)) / len(data)

    def verdict(self, data: bytes) -> tuple[bool, float | None, int, int]:
        """kept, the ratio of the whole, chunks outside their band, chunks."""
        if not (limits := band(len(data))):
            return True, None, 0, 0
        whole, bad, n = self.ratio(data), 0, 0
        for start in range(0, len(data), self.chunk) if len(data) >= self.chunk else ():
            start, n = min(start, len(data) - self.chunk), n + 1
            bad += not CHUNK_BAND[0] <= self.ratio(data[start : start + self.chunk]) <= CHUNK_BAND[1]
        return limits[0] <= whole <= limits[1] and bad <= BAD_CHUNKS * n, whole, bad, n


def measures(level: int = LEVEL, chunk: int = CHUNK):
    bands = Bands(level, chunk)

    def one(text: str | None) -> tuple:
        data = (text or "").encode("utf-8", "surrogatepass")
        base = base_measures(data)
        failed = base[0] < LEAST_WORDS or 100 * base[4] > MOST_REPEATED_PERCENT * base[0]
        kept, ratio, bad, n = bands.verdict(data)
        return (*base, failed, kept and not failed, ratio, bad, n)

    return one


def quality(docs: DataFrame) -> DataFrame:
    """For each row of docs: the base measures, base_failed, kept, and the compression ratio and chunks behind it.

    A null text has no words and fails, as an empty one does; its ratio is null. Each row is judged on its own, so
    repeated rows and ids change nothing; a null doc_id stays null. An empty table gives no rows.
    """
    return text_of(docs).mapInArrow(per_text(measures, FIELDS), SCHEMA)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"))
