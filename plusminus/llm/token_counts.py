"""Token counts (5): forward scores over a trie of pre-tokens.

The distinct pre-tokens of a batch (pieces.Vocabulary.units) make a trie. A node stands for a prefix, and its forward
state - the score of the best way to it, the tokens of that way, its last piece - is computed once, from the states of
its ancestors, however many pre-tokens share the prefix: the pieces that end at a node are those among the last
characters of its path. A pre-token's count is that of the node where it ends, and is kept for later batches.

The trie is held as arrays. With the pre-tokens sorted, the prefix of length k of one is a new node where it differs
from that of the one before; nodes of one depth are computed together. A pre-token of very many characters is a path of
its own, whose states are computed one after the other (lockstep.Chain).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from plusminus.llm.common import slices, table, text_of
from plusminus.llm.lockstep import ALONE, Kept, Pairs, States, chained
from plusminus.llm.pieces import Vocabulary, default_path, vocabulary

#: Rows of one batch, and bytes of pre-tokens with their counts that a Python worker keeps, in each of two generations.
ROWS, KEPT = 1024, 48 << 20
#: Characters of the pre-tokens of one trie, as a matrix of equally wide rows; more make a further trie.
CELLS = 1 << 21
SCHEMA = "doc_id long, n_units long, n_tokens long, n_chars long"
BASE = np.uint64(0x9E3779B97F4A7C15)


class PieceTable:
    """Pieces by length and hash; a hash that is found is compared character by character."""

    def __init__(self, words: Vocabulary):
        self.by_size: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        sizes: dict[int, list[tuple[int, np.ndarray]]] = {}
        for i, piece in enumerate(words.ids):
            sizes.setdefault(len(piece), []).append((i, np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), np.uint32)))
        for size, rows in sizes.items():
            grid, numbers = np.stack([r for _, r in rows]), np.array([i for i, _ in rows])
            h = np.zeros(len(rows), np.uint64)
            for k in range(size):
                h = h * BASE + grid[:, k].astype(np.uint64) + np.uint64(1)
            order = np.argsort(h)
            self.by_size[size] = (h[order], numbers[order], grid[order])
        self.longest = max(self.by_size, default=1)

    def edges(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and numbers of all pieces in an array of code points."""
        sums, starts, ends, found = np.zeros(len(codes) + 1, np.uint64), [], [], []
        for size in range(1, min(self.longest, len(codes)) + 1):
            sums = sums[:-1] * BASE + codes[size - 1 :].astype(np.uint64) + np.uint64(1)  # of the size characters from each place on
            if size in self.by_size:
                piece = self.find(size, sums, np.lib.stride_tricks.sliding_window_view(codes, size))
                hit = np.flatnonzero(piece >= 0)
                starts.append(hit)
                ends.append(hit + size)
                found.append(piece[hit])
        none = [np.zeros(0, np.int64)]
        return np.concatenate(starts or none), np.concatenate(ends or none), np.concatenate(found or none)

    def find(self, size: int, h: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """The number of the piece of each row of chars, by its hash; -1 for none."""
        out = np.full(len(h), -1, np.int64)
        if size in self.by_size:
            hashes, numbers, grid = self.by_size[size]
            at = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            hit = np.flatnonzero(hashes[at] == h)
            hit = hit[(grid[at[hit]] == chars[hit]).all(1)]
            out[hit] = numbers[at[hit]]
        return out


class TrieCounter:
    def __init__(self, words: Vocabulary):
        self.words, self.pairs, self.table, self.kept = words, Pairs(words), PieceTable(words), Kept(KEPT)
        self.nodes = 0  # computed so far
        self.extra: dict[int, int] = {}

    def count_batch(self, texts: list[str | None]) -> list[tuple[int, int]]:
        """Units and tokens of each text."""
        units = [self.words.units(t) for t in texts]
        waiting, start = sorted(self.kept.missing(set().union(*units)), key=len), 0
        while waiting and len(waiting[-1]) > ALONE:
            unit = waiting.pop()
            found = chained(unit, self.table.longest, self.pairs, self.table.edges)
            self.nodes += len(unit)
            self.kept.put([unit], [len(found) + int(self._more(found).sum())])
        while start < len(waiting):  # of like lengths, so that rows of the matrix are about full
            end = start + 1
            while end < len(waiting) and (end + 1 - start) * len(waiting[end]) <= CELLS and len(waiting[end]) <= 2 * len(waiting[start]) + 8:
                end += 1
            self._learn(sorted(waiting[start:end]))
            start = end
        known = self.kept.young.__getitem__
        return [(len(us), sum(map(known, us))) for us in units]

    def _more(self, pieces: np.ndarray) -> np.ndarray:
        """Ids beyond the first of each piece: a character without a piece is as many ids as it has bytes."""
        out = np.zeros(len(pieces), np.int64)
        for i in np.flatnonzero(pieces >= len(self.words.ids)).tolist():
            number = int(pieces[i])
            if number not in self.extra:
                self.extra[number] = len(self.words.ids_of(self.pairs.names[number])) - 1
            out[i] = self.extra[number]
        return out

    def _learn(self, units: list[str]) -> None:
        """Counts of sorted distinct units, by one trie."""
        n, sizes = len(units), np.array([len(u) for u in units])
        width = int(sizes.max())
        chars = np.zeros((n, width), np.uint32)
        chars[np.arange(width) < sizes[:, None]] = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32)
        differ = np.ones((n, width), bool)
        differ[1:] = np.logical_or.accumulate(chars[1:] != chars[:-1], axis=1)
        new = differ & (np.arange(width) < sizes[:, None])  # row i, column k: its prefix of k + 1 characters is a new node
        rows = int(new.sum()) + 1
        states, counts = States(rows, self.pairs), np.zeros(rows, np.int64)
        states.begin(0)
        # For the last depths: the node of each unit's prefix, and the prefix's hash; depth 0 is the root.
        node_of, hash_of = {0: np.zeros(n, np.int64)}, {0: np.zeros(n, np.uint64)}
        powers = [np.uint64(1)]
        for _ in range(self.table.longest):
            powers.append(np.uint64(int(powers[-1]) * int(BASE) & (1 << 64) - 1))
        made, tokens = 1, np.zeros(n, np.int64)
        for depth in range(1, width + 1):
            fresh = new[:, depth - 1]
            # A unit shorter than this has some other unit's node here and is never asked for it.
            node_of[depth] = np.maximum(np.cumsum(fresh) - 1, 0) + made
            hash_of[depth] = hash_of[depth - 1] * BASE + chars[:, depth - 1].astype(np.uint64) + np.uint64(1)
            at = np.flatnonzero(fresh)
            target = node_of[depth][at]
            sources, found, targets, places = [], [], [], []
            for size in range(min(depth, self.table.longest), 0, -1):
                h = hash_of[depth][at] - hash_of[depth - size][at] * powers[size]
                piece = self.table.find(size, h, chars[at, depth - size : depth])
                if size == 1 and (piece < 0).any():
                    lone = np.flatnonzero(piece < 0)
                    piece[lone] = [self.pairs.number(chr(c)) for c in chars[at[lone], depth - 1].tolist()]
                hit = np.flatnonzero(piece >= 0)
                sources.append(node_of[depth - size][at[hit]])
                found.append(piece[hit])
                targets.append(target[hit])
                places.append(hit)
            order = np.argsort(np.concatenate(places), kind="stable")  # by target, the longest first
            states.relax(*(np.concatenate(x)[order] for x in (sources, found, targets)))
            counts[target] = counts[states.before[target]] + 1 + self._more(states.last[target])
            ends = np.flatnonzero(sizes == depth)
            tokens[ends] = counts[node_of[depth][ends]]
            made += len(at)
            node_of.pop(depth - self.table.longest, None)
            hash_of.pop(depth - self.table.longest, None)
        self.nodes += rows - 1
        self.kept.put(units, tokens.tolist())


_COUNTERS: dict[str, TrieCounter] = {}


def counter(path: str) -> TrieCounter:
    if path not in _COUNTERS:
        _COUNTERS[path] = TrieCounter(vocabulary(path))
    return _COUNTERS[path]


def count_tokens(docs: DataFrame, path: str | None = None) -> DataFrame:
    """For each row of docs: doc_id, n_units (pre-tokens), n_tokens, equal to the length of the library's encode(), and n_chars.

    A null or empty text has none of them. Each row is counted on its own; a null doc_id stays null; an empty table gives no rows.
    """
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = counter(path)
        for batch in slices(batches, ROWS):
            texts = batch.column("text").to_pylist()
            found = [(*c, len(t or "")) for t, c in zip(texts, counts.count_batch(texts), strict=True)]
            columns = list(zip(*found, strict=True)) or [[]] * 3
            yield pa.record_batch([batch.column("doc_id"), *(pa.array(list(c), pa.int64()) for c in columns)], ["doc_id", "n_units", "n_tokens", "n_chars"])

    return text_of(docs).mapInArrow(run, SCHEMA)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
