"""Language ID (2): error-correcting output codes.

Each language has a codeword of bits. For each bit a binary classifier over hashed character n-grams of lower-case
letters says, with a margin, which half of the languages a text belongs to: its weight of an n-gram is the log ratio
of the n-gram's shares in the two halves. Decoding takes the language whose codeword has the least loss against the
margins, each bit weighted by how well it separates the training texts; a second-best language nearly as close
makes the answer ambiguous.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plusminus.llm.common import columns_of, fresh, released, saved, slices, table, text_of
from plusminus.llm.lookup import looked_up, numbered

ORDERS, BUCKETS = (1, 2, 3, 4), 1 << 14
#: Labelled texts for training, of all languages together, and the characters of one: the bound of the sample. Of a longer
#: text a part of this length is trained on, its place drawn by hash. Every whole text is predicted.
SAMPLE_ROWS, SAMPLE_CHARS = 3000, 20_000
#: Up to so many languages have all distinct splits as bits; more have random codewords of LONG_CODE bits.
EXHAUSTIVE, LONG_CODE = 6, 48
SMOOTHING, SHARPNESS = 0.5, 6.0
#: The share of the decoding weight that the best language needs, or the answer counts as ambiguous.
CLEAR = 0.5
UNKNOWN = "und"
SCHEMA = "doc_id long, lang_pred string, score double, ambiguous boolean"
#: Characters of one array computation.
SPAN = 1 << 18


@functools.cache
def letters() -> np.ndarray:
    """For each code point its lower-case form if it is a letter, otherwise a blank."""
    out = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        if chr(c).isalpha():
            out[c] = ord(chr(c).lower()[0])
    return out


def plain(text: str) -> np.ndarray:
    """The letters of a text in lower case, with one blank around each run of them; empty without a letter."""
    x = letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    letter = x != 32
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    x = x[keep]
    return np.concatenate([np.array([32], np.uint32), x]) if letter.any() else x[:0]


def grams(x: np.ndarray) -> Iterator[np.ndarray]:
    """For each order the buckets of the n-grams of x, as rows of the weight table."""
    h = np.zeros(len(x), np.uint32)
    for k, order in enumerate(ORDERS):
        h = h[: len(x) - order + 1] * np.uint32(0x01000193) + (x[order - 1 :] + np.uint32(1)) * np.uint32(0x9E3779B1) if len(x) >= order else h[:0]
        yield ((h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B) >> np.uint32(18)).astype(np.int64) % BUCKETS + k * BUCKETS


def codewords(n: int, seed: int = 2) -> np.ndarray:
    """n rows of bits as -1 and 1, with rows far apart."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= EXHAUSTIVE:
        return np.array([[1, *c] for c in itertools.product((1, -1), repeat=n - 1) if -1 in c]).T.astype(float)
    rng = np.random.default_rng(seed)
    tries = [np.where(rng.random((n, LONG_CODE)) < 0.5, 1.0, -1.0) for _ in range(50)]
    return max(tries, key=lambda c: -(c @ c.T - 2 * LONG_CODE * np.eye(n)).max())


@dataclass
class Model:
    languages: list[str]
    codes: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    scale: np.ndarray
    trust: np.ndarray

    def margins(self, x: np.ndarray) -> np.ndarray:
        """Mean weight of the n-grams of a text for each bit, from all of the text."""
        total, n = np.zeros(self.codes.shape[1]), 0
        for start in range(0, len(x), SPAN):
            part = x[start : start + SPAN + max(ORDERS) - 1]
            for k, rows in enumerate(grams(part)):
                rows = rows[:SPAN]
                total += np.bincount(rows - k * BUCKETS, minlength=BUCKETS) @ self.weights[k * BUCKETS : (k + 1) * BUCKETS] if len(rows) > BUCKETS else self.weights[rows].sum(0, dtype=np.float64)
                n += len(rows)
        return (total / max(n, 1) - self.bias) / self.scale

    def decode(self, margins: np.ndarray) -> tuple[str, float, bool]:
        loss = np.logaddexp(0, -SHARPNESS * self.codes * margins) @ self.trust
        share = np.exp(-(loss - loss.min()))
        share /= share.sum()
        best = int(np.argmin(loss))
        return self.languages[best], float(share[best]), bool(share[best] < CLEAR)

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        x = plain(text or "")
        if not len(x) or not self.languages:
            return UNKNOWN, 0.0, True
        return self.decode(self.margins(x))


def fit(texts: list[str], langs: list[str]) -> Model:
    languages = sorted(set(langs))
    codes = codewords(len(languages))
    if not languages:
        return Model([], codes, np.zeros((len(ORDERS) * BUCKETS, 1), np.float32), np.zeros(1), np.ones(1), np.ones(1))
    counts = np.zeros((len(languages), len(ORDERS) * BUCKETS))
    rows = [(plain(t), languages.index(g)) for t, g in zip(texts, langs, strict=True)]
    for x, g in rows:
        for k, at in enumerate(grams(x)):
            counts[g, k * BUCKETS : (k + 1) * BUCKETS] += np.bincount(at - k * BUCKETS, minlength=BUCKETS)
    # Each language has the same say, however many texts it has.
    shares = np.stack([counts[:, k * BUCKETS : (k + 1) * BUCKETS] for k in range(len(ORDERS))], 1)
    totals = shares.sum(2, keepdims=True)
    shares = ((shares + SMOOTHING) / (totals + SMOOTHING * BUCKETS)).reshape(len(languages), -1)
    weights = np.zeros((counts.shape[1], codes.shape[1]), np.float32)
    for b in range(codes.shape[1]):
        one, other = shares[codes[:, b] > 0], shares[codes[:, b] < 0]
        weights[:, b] = np.log(one.mean(0)) - np.log(other.mean(0)) if len(one) and len(other) else 0
    bits = codes.shape[1]
    model = Model(languages, codes, weights, np.zeros(bits), np.ones(bits), np.ones(bits))
    known = [(model.margins(x), g) for x, g in rows if len(x)]
    if known and len(languages) > 1:
        margins, signs = np.array([m for m, _ in known]), codes[[g for _, g in known]]
        high, low = ([np.median(margins[signs[:, b] == s, b]) if (signs[:, b] == s).any() else s for b in range(bits)] for s in (1, -1))
        model.bias = (np.array(high) + np.array(low)) / 2
        model.scale = np.maximum((np.array(high) - np.array(low)) / 2, 1e-6)
        right = (((margins - model.bias) * signs > 0).sum(0) + 1) / (len(known) + 2)
        model.trust = np.clip(np.log(right / (1 - right)), 0.1, 5.0)
        model.trust /= model.trust.mean()
    return model


def held_out(doc_id="doc_id"):
    """crc32 of the id as text, modulo 4, is 2; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, rows: int = SAMPLE_ROWS, most_chars: int = SAMPLE_CHARS) -> Model:
    """A model of the labelled rows of docs that aren't held out: about rows of them, drawn by hash, evenly by language.

    A language with few texts gives all of them; 2 * rows are never exceeded. Without a labelled row the model knows no
    language. Languages beyond the `rows` most frequent ones are not learned.
    """
    known = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    known = known.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(rows).collect()}
    if not counts:
        return fit([], [])
    each = max(1, rows // len(counts))
    share = F.create_map(*(F.lit(v) for g, n in counts.items() for v in (g, min(1.0, each / n))))
    drawn = known.withColumn("h", F.xxhash64(F.lit("draw"), "doc_id", "text"))
    drawn = drawn.filter(F.pmod("h", F.lit(1 << 20)) < F.element_at(share, F.col("lang")) * float(1 << 20))
    place = F.pmod(F.shiftrightunsigned("h", 20), F.greatest(F.char_length("text") - most_chars, F.lit(0)) + 1).cast("int") + 1
    drawn = drawn.select(F.substring("text", place, F.lit(most_chars)).alias("text"), "lang", "h").orderBy("h", "text").limit(2 * rows).collect()
    return fit([r["text"] for r in drawn], [r["lang"] for r in drawn])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """For each row of docs: doc_id, lang_pred, score and ambiguous; only the text is read for it.

    A null, empty or blank text, and one without a letter, is `und` with score 0, and ambiguous. Repeated rows get
    the same answer. An empty table gives no rows. A model without a language answers `und` alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [model.predict(x) for x in batch.column("text").to_pylist()]
            langs, scores, flags = zip(*found, strict=True) if found else ((), (), ())
            yield pa.record_batch([batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(flags, pa.bool_())], ["doc_id", "lang_pred", "score", "ambiguous"])

    return text_of(docs).mapInArrow(released(run), SCHEMA)


def recognised(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs whose text has a letter and a language whose codeword is clearly the nearest; columns stay as they are.

    A null, empty or blank text goes, and so does a text in no known language. Repeated rows share one answer. An empty
    table gives no rows.
    """
    row, goes = fresh("row"), fresh("goes")
    rows = numbered(docs, row)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = map(model.predict, batch.column("text").to_pylist())
            batch = batch.filter(pa.array([lang == UNKNOWN or ambiguous for lang, _, ambiguous in found], pa.bool_()))
            yield pa.record_batch([batch.column("row"), pa.array([True] * batch.num_rows, pa.bool_())], ["row", "goes"])

    texts = rows.select(F.col(row).alias("row"), F.col("text").cast("string").alias("text"))
    gone = saved(texts.mapInArrow(released(run), "row long, goes boolean"), "gone")
    marked = looked_up(rows, row, gone.select(F.col("row").alias(row), F.col("goes").alias(goes)), goes)
    return marked.filter(F.col(goes).isNull()).select(*columns_of(docs))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, train(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "ambiguous")
