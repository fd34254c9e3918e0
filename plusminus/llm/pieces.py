"""A SentencePiece vocabulary: its pieces, which of them follow each other, and decoding.

Both models of the library are served. In a unigram model the best way to a position is the one of the highest sum of
scores. In a merge model (BPE) scores are ranks of merges and their sum means nothing: there the last piece of the
encoding of a prefix is the one piece that ends there and follows, as the library would merge, on the last piece of the
prefix before it. That two pieces follow each other is told by merging their characters by rank; each pair is tried once.
"""

from __future__ import annotations

import functools
import heapq
import math
from collections import Counter

import numpy as np
import regex
import sentencepiece

UNIGRAM, BPE = 1, 2
SPACE = "▁"
NONE = -1
#: A blank with the characters up to the next blank, or blanks alone.
UNIT = regex.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
#: Units of more characters are cut wherever no piece reaches across.
LONG = 48


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _model_type(proto: bytes) -> int:
    """Field 3 (model_type, unigram by default) of field 2 (trainer_spec) of the model's protocol buffer."""

    def fields(data: bytes):
        at = 0

        def number() -> int:
            nonlocal at
            value = shift = 0
            while True:
                byte = data[at]
                at += 1
                value |= (byte & 127) << shift
                shift += 7
                if byte < 128:
                    return value

        while at < len(data):
            key = number()
            if key & 7 == 0:
                yield key >> 3, number()
            else:
                size = {1: 8, 5: 4}.get(key & 7) or number()
                yield key >> 3, data[at : at + size]
                at += size

    spec = next((v for k, v in fields(proto) if k == 2), b"")
    return next((v for k, v in fields(spec) if k == 3), UNIGRAM)


class Vocabulary:
    """Pieces that stand for text, with ids and scores, and what to do with characters that no piece covers."""

    def __init__(self, path: str):
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.kind = _model_type(self.library.serialized_model_proto())
        n = self.library.vocab_size()
        plain = [i for i in range(n) if not (self.library.is_byte(i) or self.library.is_control(i) or self.library.is_unknown(i) or self.library.is_unused(i))]
        self.ids = {self.library.id_to_piece(i): i for i in plain}
        self.pieces = {i: p for p, i in self.ids.items()}
        self.scores = {i: self.library.get_score(i) for i in plain}
        self.bytes = {int(self.library.id_to_piece(i)[3:5], 16): i for i in range(n) if self.library.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.unknown = self.library.unk_id()
        self.longest = max(map(len, self.ids))
        #: Below any piece's score, as the library sets it for unknown characters of unigram models.
        self.unknown_score = min(self.scores.values(), default=0.0) - 10.0
        #: No piece holds a blank after another character, so no merge crosses the place before such a blank.
        self.splits = not any(a != SPACE and b == SPACE for p in self.ids for a, b in zip(p, p[1:], strict=False))
        self.shared = Counter(self.scores.values())
        self._split: dict[str, tuple[str, str] | None] = {}
        self.follows = functools.lru_cache(1 << 18)(self._follows)

    def normalize(self, text: str) -> str:
        return self.library.normalize(text)

    @functools.cached_property
    def neighbours(self) -> np.ndarray:
        """All pairs of characters that stand side by side in a piece, as sorted numbers."""
        return np.unique(np.array([ord(a) << 32 | ord(b) for p in self.ids for a, b in zip(p, p[1:], strict=False)], np.int64))

    def units(self, text: str | None) -> list[str]:
        """A text's normalized form as parts whose encodings, side by side, are the encoding of the whole.

        A part ends before a blank that follows another character, if no piece of the vocabulary reaches over such a place;
        a long one is cut also between any two characters that stand side by side in no piece.
        """
        normalized = self.normalize(text) if text else ""
        units = UNIT.findall(normalized) if self.splits else [normalized] if normalized else []
        if len(normalized) > LONG and max(map(len, units)) > LONG:
            units = [part for u in units for part in (self.cut(u) if len(u) > LONG else (u,))]
        return units

    def cut(self, unit: str) -> list[str]:
        codes = np.frombuffer(unit.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        pairs = codes[:-1] << 32 | codes[1:]
        at = np.minimum(np.searchsorted(self.neighbours, pairs), max(0, len(self.neighbours) - 1))
        apart = np.flatnonzero(self.neighbours[at] != pairs) + 1 if len(self.neighbours) else np.arange(1, len(unit))
        bounds = [0, *apart.tolist(), len(unit)]
        return [unit[i:j] for i, j in zip(bounds, bounds[1:], strict=False)]

    def merged(self, text: str) -> list[str]:
        """The library's merges of a text's characters: the best score first, of equal ones the leftmost."""
        parts: list[str | None] = list(text)
        left, right = list(range(-1, len(parts) - 1)), list(range(1, len(parts) + 1))
        heap: list[tuple[float, int, int, str]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j < len(parts) and (whole := parts[i] + parts[j]) in self.ids:
                heapq.heappush(heap, (-self.scores[self.ids[whole]], i, j, whole))

        for i in range(len(parts) - 1):
            offer(i, i + 1)
        while heap:
            _, i, j, whole = heapq.heappop(heap)
            if parts[i] is None or right[i] != j or j >= len(parts) or parts[j] is None or parts[i] + parts[j] != whole:
                continue
            parts[i], parts[j] = whole, None
            right[i] = right[j]
            if right[j] < len(parts):
                left[right[j]] = i
            offer(left[i], i)
            offer(i, right[i])
        return [p for p in parts if p is not None]

    def _time(self, piece: str) -> float:
        """When a piece is merged: characters are there at the start."""
        return -math.inf if len(piece) == 1 else -self.scores[self.ids[piece]]

    def _parts(self, piece: str) -> tuple[str, str] | None:
        """The two pieces whose merge makes a piece; None for a character, and where merging characters doesn't make it."""
        if piece not in self._split:
            self._split[piece] = self._last_merge(piece)
        return self._split[piece]

    def _last_merge(self, piece: str) -> tuple[str, str] | None:
        if len(piece) < 2 or self.merged(piece) != [piece]:
            return None
        time = self._time(piece)
        for cut in range(1, len(piece)):
            a, b = piece[:cut], piece[cut:]
            if all(len(x) == 1 or (x in self.ids and self._time(x) < time and self.merged(x) == [x]) for x in (a, b)) and self._apart(a, b, time):
                return a, b
        return None

    def _apart(self, a: str, b: str, limit: float) -> bool:
        """Whether a and b, side by side and each made by its merges, are still apart when merges from before limit are done.

        Time runs backwards: the later merge of the two that meet is undone, and what then meets may not merge earlier.
        """
        inclusive = False
        while True:
            if (whole := a + b) in self.ids and ((t := self._time(whole)) < limit or inclusive and t == limit):
                return False
            ta, tb = self._time(a), self._time(b)
            if ta > tb:
                a, limit, inclusive = self._parts(a)[1], ta, False
            elif tb > -math.inf:
                b, limit, inclusive = self._parts(b)[0], tb, True  # of equal merges the left one comes first
            else:
                return True

    def _plain(self, piece: str) -> bool:
        """A character, or a piece of a score of its own that its merges make."""
        return len(piece) == 1 or (self.shared[self.scores[self.ids[piece]]] == 1 and self._parts(piece) is not None)

    def _follows(self, first: str, second: str) -> bool:
        """Whether the encoding of the two, side by side, is the two."""
        if self._plain(first) and self._plain(second):
            return self._apart(first, second, math.inf)
        return self.merged(first + second) == [first, second]

    def ids_of(self, piece: str) -> list[int]:
        """The id of a piece; of a character without one its bytes, or the unknown id."""
        if piece in self.ids:
            return [self.ids[piece]]
        raw = [self.bytes.get(b) for b in piece.encode("utf-8", "surrogatepass")]
        return [self.unknown] if None in raw else raw

    @functools.cached_property
    def names(self) -> list[str]:
        """What each id but a byte's stands for."""
        return [self.pieces.get(i, " ⁇ " if i == self.unknown else "") for i in range(self.library.vocab_size())]

    def decode(self, ids: list[int]) -> str:
        """Pieces side by side, runs of bytes as UTF-8 (what is none as U+FFFD), blanks for marks, without the first blank."""
        if self.byte_of.keys().isdisjoint(ids):
            return self._spaced("".join(map(self.names.__getitem__, ids)))
        is_byte = np.zeros(len(self.names) + 1, bool)
        is_byte[list(self.byte_of)] = True
        bounds = [0, *(np.flatnonzero(np.diff(is_byte[ids])) + 1).tolist(), len(ids)]
        runs = (ids[i:j] for i, j in zip(bounds, bounds[1:], strict=False))
        return self._spaced("".join(self._text(run) if run[0] in self.byte_of else "".join(map(self.names.__getitem__, run)) for run in runs))

    def _text(self, ids: list[int]) -> str:
        """The text of a run of byte ids."""
        raw, out, at = bytes(map(self.byte_of.__getitem__, ids)), [], 0
        try:
            return raw.decode()
        except UnicodeDecodeError:
            pass
        while at < len(raw):  # one mark for each byte that starts no character
            for size in (4, 3, 2, 1):
                try:
                    out.append(raw[at : at + size].decode())
                    if len(out[-1]) != 1:
                        out.pop()
                        continue
                    at += size
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                at += 1
        return "".join(out)

    def _spaced(self, text: str) -> str:
        text = text.replace(SPACE, " ")
        return text[1:] if text.startswith(" ") and self.dummy_prefix else text

    @functools.cached_property
    def dummy_prefix(self) -> bool:
        return self.normalize("a").startswith(SPACE)


@functools.cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)
