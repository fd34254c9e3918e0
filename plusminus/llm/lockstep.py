"""The recurrence of pieces.Vocabulary for many prefixes at once, in arrays.

A prefix is a row with the last piece of its best encoding and its score. Candidate edges (row before, piece, row) are
given by either operator - from a suffix array or from a trie - in the order of the prefixes' lengths. The prefixes of one
unit depend on each other, so a unit of very many characters is relaxed edge by edge (Chain), in tiles of positions.
"""

from __future__ import annotations

import numpy as np

from plusminus.llm.pieces import BPE, Vocabulary

#: No piece: the start of a text.
START = -1
#: Slots of the table of pairs, as a power of two.
SLOT_BITS = 20
#: Units of more characters are relaxed on their own, and positions whose edges are held at once.
ALONE, TILE = 256, 1 << 16
#: What an entry of Kept takes besides its own characters, about.
ENTRY = 200


class Pairs:
    """Whether one piece can follow another in a merge model: a table of slots by hash, filled as pairs are met.

    Pieces are numbers: a known piece its place in the list, any other character a number from len(list) on.
    """

    def __init__(self, words: Vocabulary):
        self.words, self.names = words, list(words.ids)
        self.numbers = {p: i for i, p in enumerate(self.names)}
        self.scores = np.array([words.scores[words.ids[p]] for p in self.names] or [0.0])
        self.keys = np.full(1 << SLOT_BITS, -1, np.int64)
        self.values = np.zeros(1 << SLOT_BITS, bool)

    def number(self, piece: str) -> int:
        """The number of a piece or of a character that is none."""
        if piece not in self.numbers:
            self.numbers[piece] = len(self.names)
            self.names.append(piece)
        return self.numbers[piece]

    def score(self, pieces: np.ndarray) -> np.ndarray:
        known = pieces < len(self.scores)
        return np.where(known, self.scores[np.where(known, pieces, 0)], self.words.unknown_score)

    def follow(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """For each pair whether second can follow first; anything can follow START."""
        key = (first.astype(np.int64) + 1) << 32 | second.astype(np.int64)
        slot = self._slots(key)
        out = self.values[slot]
        new = self.keys[slot] != key
        if new.any():
            at = np.flatnonzero(new)
            unique, back = np.unique(key[at], return_inverse=True)
            names, follows = self.names, self.words.follows
            answers = np.array([k >> 32 == 0 or follows(names[(k >> 32) - 1], names[k & 0xFFFFFFFF]) for k in unique.tolist()], bool)
            out[at] = answers[back]
            slot = self._slots(unique)  # of two pairs of one slot the later one stays, in both arrays
            self.keys[slot], self.values[slot] = unique, answers
        return out

    @staticmethod
    def _slots(key: np.ndarray) -> np.ndarray:
        return ((key * np.int64(-7046029254386353131)) >> np.int64(64 - SLOT_BITS)) & np.int64((1 << SLOT_BITS) - 1)


class Kept:
    """What is known of distinct units, in two generations of at most so many bytes: units that don't come again are forgotten."""

    def __init__(self, most: int):
        self.most, self.size, self.young, self.old = most, 0, {}, {}

    def put(self, units: list[str], values: list) -> None:
        self.young.update(zip(units, values, strict=True))
        self.size += sum(map(len, units)) + sum(len(v) for v in values if isinstance(v, bytes)) + ENTRY * len(units)

    def missing(self, units: set[str]) -> list[str]:
        """The units of which nothing is known; the others are all in `young` afterwards."""
        if self.size > self.most:
            self.old, self.young, self.size = self.young, {}, 0
        new = [u for u in units if u not in self.young]
        again = [u for u in new if u in self.old]
        self.put(again, list(map(self.old.__getitem__, again)))
        return [u for u in new if u not in self.young]


class Chain:
    """The prefixes of one unit of n characters, one after the other: add() gets the edges of a tile, by end, the longest first."""

    def __init__(self, n: int, pairs: Pairs):
        self.n, self.pairs, self.merge = n, pairs, pairs.words.kind == BPE
        self.last, self.before, self.score = [-2] * (n + 1), [-1] * (n + 1), [-np.inf] * (n + 1)
        self.last[0], self.score[0] = START, 0.0

    def add(self, starts: np.ndarray, pieces: np.ndarray, ends: np.ndarray) -> None:
        last, before, score, names, follows = self.last, self.before, self.score, self.pairs.names, self.pairs.words.follows
        if self.merge:
            for s, p, e in zip(starts.tolist(), pieces.tolist(), ends.tolist(), strict=True):
                if last[e] == -2 and last[s] != -2 and (last[s] == START or follows(names[last[s]], names[p])):
                    last[e], before[e] = p, s
            return
        for s, p, e, x in zip(starts.tolist(), pieces.tolist(), ends.tolist(), self.pairs.score(pieces).tolist(), strict=True):
            if last[s] != -2 and score[s] + x > score[e]:
                last[e], before[e], score[e] = p, s, score[s] + x

    def pieces(self) -> np.ndarray:
        """The pieces of the whole unit, in order."""
        out, at = [], self.n
        while at > 0:
            out.append(self.last[at])
            at = self.before[at]
        return np.array(out[::-1], np.int64)


def with_lone(starts: np.ndarray, ends: np.ndarray, pieces: np.ndarray, codes: np.ndarray, pairs: Pairs) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges by end, the longest first, with one more for each character that no piece of one character covers."""
    single = np.zeros(len(codes), bool)
    single[starts[ends - starts == 1]] = True
    lone = np.flatnonzero(~single)
    numbers = np.array([pairs.number(chr(c)) for c in codes[lone].tolist()], np.int64)
    starts, ends, pieces = np.concatenate([starts, lone]), np.concatenate([ends, lone + 1]), np.concatenate([pieces, numbers])
    order = np.lexsort((starts, ends))
    return starts[order], ends[order], pieces[order]


def chained(unit: str, longest: int, pairs: Pairs, edges) -> np.ndarray:
    """The pieces of a unit of any length; edges gives starts, ends and numbers of the pieces in an array of code points."""
    codes = np.frombuffer(unit.encode("utf-32-le", "surrogatepass"), np.uint32)
    chain = Chain(len(codes), pairs)
    for done in range(0, len(codes), TILE):
        first = max(0, done - longest)  # edges that end in this tile may start before it
        part = codes[first : done + TILE]
        starts, ends, pieces = with_lone(*edges(part), part, pairs)
        new = ends + first > done
        chain.add(starts[new] + first, pieces[new], ends[new] + first)
    return chain.pieces()


class States:
    """Arrays over rows: last piece (-2 where there is no way), score and the row before."""

    def __init__(self, rows: int, pairs: Pairs):
        self.pairs, self.merge = pairs, pairs.words.kind == BPE
        self.last = np.full(rows, -2, np.int64)
        self.score = np.full(rows, -np.inf)
        self.before = np.full(rows, -1, np.int64)

    def begin(self, rows) -> None:
        self.last[rows], self.score[rows] = START, 0.0

    def relax(self, source: np.ndarray, piece: np.ndarray, target: np.ndarray) -> None:
        """Edges whose sources are final. Of several edges to a target the best one holds, the longest first among equals.

        Edges of a target come in the order of their length, longest first.
        """
        ok = self.last[source] != -2
        source, piece, target = source[ok], piece[ok], target[ok]
        if self.merge:
            good = self.pairs.follow(self.last[source], piece)
            source, piece, target = source[good], piece[good], target[good]
            self.last[target], self.before[target], self.score[target] = piece, source, 0.0
            return
        score = self.score[source] + self.pairs.score(piece)
        order = np.lexsort((np.arange(len(score)), -score, target))
        first = np.ones(len(order), bool)
        first[1:] = target[order[1:]] != target[order[:-1]]
        best = order[first]
        self.last[target[best]], self.before[target[best]], self.score[target[best]] = piece[best], source[best], score[best]
