"""SentencePiece encoding and decoding (1): suffix-array matching.

The distinct units of a batch are put one after the other, with a mark between them that no piece holds. A suffix array
over the first characters of every suffix (as many as the longest piece has) is sorted once. Every piece is then searched
in it: the first and last suffix that begin with it are found by binary search, for all pieces at once, and these
suffixes are the piece's occurrences. Occurrences are the edges of a lattice; sorted by how far from the start of their unit they
end, they are relaxed in one pass, all edges of one distance together (lockstep.States).

Texts are sequences of units (pieces.Vocabulary.units), between which no piece can lie, so a unit is encoded once a
batch, and one that was met lately is remembered. A unit of very many characters is matched in tiles of positions.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from plusminus.llm.common import slices, table, text_of
from plusminus.llm.lockstep import ALONE, Kept, Pairs, States, chained
from plusminus.llm.pieces import Vocabulary, default_path, vocabulary

#: Rows of one batch and characters of its concatenated units; more units make a further array.
ROWS, CHARACTERS = 1024, 1 << 19
#: Bytes of units with their ids that a Python worker keeps, in each of two generations.
KEPT = 64 << 20
#: Stands between units; no code point and so in no piece.
BETWEEN = 0x110000
SCHEMA = "doc_id long, n_tokens long, ids_crc32 long, n_byte_tokens long, decoded_crc32 long, round_trip boolean"


class SuffixArray:
    """The suffixes of a text (code points as numbers) in the order of their first width characters."""

    def __init__(self, codes: np.ndarray, width: int):
        self.codes, self.width = codes, width
        self.symbols, dense = np.unique(codes, return_inverse=True)
        # As many symbols as fit into a key are sorted at once, 0 standing after the end; then the sorted width is doubled.
        rank, size, base = dense.astype(np.int64) + 1, 1, len(self.symbols) + 1
        key = rank
        while size < width and base ** (size + 1) < 1 << 62:
            key = key * base
            key[: max(0, len(key) - size)] += rank[size:]
            size += 1
        self.order = np.argsort(key)
        while size < width:
            rank = self._ranks(key)
            after = np.zeros(len(rank), np.int64)
            after[: max(0, len(rank) - size)] = rank[size:]
            key = rank * (len(rank) + 1) + after
            self.order = np.argsort(key)
            size *= 2

    def _ranks(self, key: np.ndarray) -> np.ndarray:
        ordered, rank = key[self.order], np.empty(len(key), np.int64)
        if len(key):
            rank[self.order] = np.cumsum(np.concatenate([[1], ordered[1:] != ordered[:-1]]))
        return rank

    def ranges(self, patterns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """For each pattern the range [low, high) of the suffixes that begin with it: binary searches, all side by side."""
        n, codes = len(self.codes), np.concatenate([self.codes, np.zeros(self.width + 1, self.codes.dtype)])
        sizes = np.array([len(p) for p in patterns], np.int64)
        grid = np.zeros((len(patterns), self.width), codes.dtype)
        for i, p in enumerate(patterns):
            grid[i, : len(p)] = p[: self.width]

        def search(upper: bool) -> np.ndarray:
            low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), n, np.int64)
            while len(open_ := np.flatnonzero(low < high)):
                mid = (low[open_] + high[open_]) // 2
                less, equal = np.zeros(len(open_), bool), np.ones(len(open_), bool)
                at = self.order[mid]
                for k in range(int(sizes[open_].max())):
                    inside = equal & (k < sizes[open_])
                    c, g = codes[at + k], grid[open_, k]
                    less |= inside & (c < g)
                    equal &= ~inside | (c == g)
                right = less | equal if upper else less
                low[open_[right]] = mid[right] + 1
                high[open_[~right]] = mid[~right]
            return low

        return search(False), search(True)


class SuffixEncoder:
    def __init__(self, words: Vocabulary):
        self.words, self.pairs = words, Pairs(words)
        self.patterns = [np.frombuffer(p.encode("utf-32-le", "surrogatepass"), np.uint32) for p in words.ids]
        # Pieces side by side, so that those with a symbol the batch lacks are left out at once.
        self.sizes = np.array([len(p) for p in self.patterns])
        self.flat = np.concatenate(self.patterns) if self.patterns else np.zeros(0, np.uint32)
        self.of = np.repeat(np.arange(len(self.patterns)), self.sizes)
        self.numbered = np.array(list(words.ids.values()) or [0], np.int64)
        self.kept = Kept(KEPT)

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        units = [self.words.units(t) for t in texts]
        waiting, start = self.kept.missing(set().union(*units)), 0
        for unit in (u for u in waiting if len(u) > ALONE):
            found = chained(unit, self.words.longest, self.pairs, self.edges)
            self.kept.put([unit], [self._ids(found, found)[0].astype("<u4").tobytes()])
        waiting = [u for u in waiting if len(u) <= ALONE]
        while start < len(waiting):
            end, size = start, 0
            while end < len(waiting) and (end == start or size + len(waiting[end]) <= CHARACTERS):
                size += len(waiting[end]) + 1
                end += 1
            self._learn(waiting[start:end])
            start = end
        known = self.kept.young.__getitem__
        return [b"".join(map(known, us)) for us in units]

    def edges(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and numbers of all occurrences of all pieces."""
        array = SuffixArray(codes, self.words.longest)
        there = np.isin(self.flat, array.symbols)
        asked = np.flatnonzero(np.bincount(self.of[there], minlength=len(self.sizes)) == self.sizes)
        low, high = array.ranges([self.patterns[i] for i in asked])
        count = high - low
        place = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(count.sum())
        starts = array.order[place]
        return starts, starts + np.repeat(self.sizes[asked], count), np.repeat(asked, count)

    def _ids(self, pieces: np.ndarray, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces, and the unit of each id; a character without a piece has an id for each of its bytes."""
        known = pieces < len(self.numbered)
        if known.all():
            return self.numbered[pieces], units
        lists = [self.words.ids_of(self.pairs.names[p]) for p in pieces[~known].tolist()]
        count = np.ones(len(pieces), np.int64)
        count[~known] = [len(x) for x in lists]
        ids, is_known = np.repeat(self.numbered[np.where(known, pieces, 0)], count), np.repeat(known, count)
        ids[~is_known] = [i for x in lists for i in x]
        return ids, np.repeat(units, count)

    def _learn(self, units: list[str]) -> None:
        n, sizes = len(units), np.array([len(u) for u in units])
        begins = np.cumsum(sizes + 1) - sizes - 1
        codes = np.frombuffer("\0".join(units).encode("utf-32-le", "surrogatepass"), np.uint32).copy()
        codes[(begins - 1)[1:]] = BETWEEN
        starts, ends, piece = self.edges(codes)
        # A character that no piece covers has an edge of its own.
        single = codes == BETWEEN
        single[starts[ends - starts == 1]] = True
        lone = np.flatnonzero(~single)
        numbers = np.array([self.pairs.number(chr(c)) for c in codes[lone].tolist()], np.int64)
        starts, ends, piece = np.concatenate([starts, lone]), np.concatenate([ends, lone + 1]), np.concatenate([piece, numbers])
        # Row begins[i] + k stands for the first k characters of unit i; edges are sorted by k, then by end, the longest first.
        depth = ends - np.repeat(begins, sizes + 1)[starts]
        order = np.argsort((depth * (len(codes) + 1) + ends) * (self.words.longest + 1) + self.words.longest - (ends - starts))
        starts, ends, piece = starts[order], ends[order], piece[order]
        bounds = np.searchsorted(depth[order], np.arange(1, sizes.max() + 2))
        states = States(len(codes) + 1, self.pairs)
        states.begin(begins)
        for i, j in zip(bounds.tolist(), bounds[1:].tolist(), strict=False):
            states.relax(starts[i:j], piece[i:j], ends[i:j])
        # Back from the ends of all units at once.
        unit, at, rounds = np.arange(n), begins + sizes, []
        while len(unit):
            rounds.append((unit, states.last[at]))
            at = states.before[at]
            going = at > begins[unit]
            unit, at = unit[going], at[going]
        back = np.concatenate([np.full(len(u), -k) for k, (u, _) in enumerate(rounds)])
        of_unit, found = (np.concatenate(x) for x in zip(*rounds, strict=True))
        order = np.lexsort((back, of_unit))
        ids, of_unit = self._ids(found[order], of_unit[order])
        packed = ids.astype("<u4").tobytes()
        cuts = (np.concatenate([[0], np.cumsum(np.bincount(of_unit, minlength=n))]) * 4).tolist()
        self.kept.put(units, [packed[i:j] for i, j in zip(cuts, cuts[1:], strict=False)])


_ENCODERS: dict[str, SuffixEncoder] = {}


def encoder(path: str) -> SuffixEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = SuffixEncoder(vocabulary(path))
    return _ENCODERS[path]


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and ids of each row of docs: the ids of the library's encode().

    A null or empty text has no ids. Each row is encoded on its own; a null doc_id stays null; an empty table gives no rows.
    """
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(path)
        for batch in slices(batches, ROWS):
            ids = [np.frombuffer(x, "<u4").astype(np.int32) for x in code.encode_batch(batch.column("text").to_pylist())]
            yield pa.record_batch([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return text_of(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode(rows: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text of rows of doc_id and ids: the text of the library's decode().

    Null or no ids give an empty text. Each row, repeated ones too, is decoded on its own; an empty table gives no rows.
    """
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        for batch in slices(batches, ROWS):
            yield pa.record_batch([batch.column("doc_id"), pa.array([words.decode(i or []) for i in batch.column("ids").to_pylist()], pa.string())], ["doc_id", "text"])

    return rows.mapInArrow(run, "doc_id long, text string")


def round_trips(docs: DataFrame, path: str | None = None) -> DataFrame:
    """For each row of docs: tokens, their CRC-32 (little-endian unsigned 32-bit), byte tokens, the CRC-32 of the decoded text, and whether it is the text.

    A null text counts as empty. Each row, repeated ones too, is encoded on its own; a null doc_id stays null; an empty
    table gives no rows.
    """
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(path)
        is_byte = np.zeros(code.words.library.vocab_size(), bool)
        is_byte[list(code.words.byte_of)] = True
        for batch in slices(batches, ROWS):
            texts = batch.column("text").to_pylist()
            rows = []
            for text, packed in zip(texts, code.encode_batch(texts), strict=True):
                ids = np.frombuffer(packed, "<u4")
                back = code.words.decode(ids.tolist())
                rows.append((len(ids), zlib.crc32(packed), int(is_byte[ids].sum()), zlib.crc32(back.encode("utf-8", "surrogatepass")), back == (text or "")))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = [pa.int64()] * 4 + [pa.bool_()]
            yield pa.record_batch([batch.column("doc_id"), *(pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", "n_tokens", "ids_crc32", "n_byte_tokens", "decoded_crc32", "round_trip"])

    return text_of(docs).mapInArrow(run, SCHEMA)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trips(table(spark, sf_dir, "documents"))
