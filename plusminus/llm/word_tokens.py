"""Ids of a word-level BPE of the tokenizers library, with the ids of each distinct word computed once.

White space never takes part in a token of such a vocabulary, so the ids of a text are those of its
white-space separated chunks, one after the other. Chunks of ASCII and Latin letters are cut into
pre-tokens here and their merges are done by the library in blocks; every other chunk goes to the
library as it is.
"""

from __future__ import annotations

import os
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from plusminus.llm.common import PIECE, pieces

END_ID = 1
#: Bytes of chunks, and of pre-tokens, with their ids that a Python worker keeps, in two generations each: four times this in all.
KEPT = 72 << 20
#: What an entry takes besides its own bytes, about.
ENTRY = 180
#: Pre-tokens of one call of the library.
BLOCK = 2_000
#: The vocabulary's own pre-token pattern (fixed value), and the line ends that stand between chunks here.
PRE_TOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+|\n")
#: Chunks that hold a character beyond these go to the library whole, and so do those with the mark of a special token.
PLAIN = regex.compile(r"[!-~¡-ɏ\n]*")
SPECIAL = "<|"
#: Bytes of text of one step, or fewer where little is to be kept; texts of more are cut.
SLICE = 8 << 20
#: Stands between chunks in a run of ids; no vocabulary has this id.
BETWEEN = b"\xff\xff\xff\xff"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Recent:
    """Values by key in two generations: the older one goes when the younger one is full, so that memory is bounded by bytes."""

    def __init__(self, most: int):
        self.most, self.size, self.young, self.old = most, 0, {}, {}

    def put(self, keys: Iterable, values: Iterable[bytes]) -> None:
        for k, v in zip(keys, values, strict=True):
            self.young[k] = v
            self.size += ENTRY + len(k) + len(v)

    def renewed(self, keys: Iterable) -> list:
        """Those of keys, each given once, that aren't known; the others are young afterwards, and stay so until the next call."""
        if self.size > self.most:
            self.old, self.young, self.size = self.young, {}, 0
        new = [k for k in keys if k not in self.young]
        again = [k for k in new if k in self.old]
        self.put(again, map(self.old.__getitem__, again))
        return [k for k in new if k not in self.young]


class WordEncoder:
    """encode(text) gives little-endian unsigned 32-bit ids as bytes, equal to the library's for the whole text."""

    def __init__(self, path: str, kept: int = KEPT):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

        self.whole = Tokenizer.from_file(path)
        self.merges = Tokenizer(self.whole.model)
        self.merges.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.whole.get_vocab(with_added_tokens=True)
        self.size = max(vocabulary.values()) + 1
        self.last = np.zeros(self.size, bool)
        self.last[[i for s, i in vocabulary.items() if s.endswith("</w>")]] = True
        self.chunks, self.tokens, self.slice = Recent(kept), Recent(kept), min(SLICE, max(1, kept // 4))

    def encode(self, text: str | None) -> bytes:
        return self.encode_column(pa.array([text], pa.string()))[0]

    def encode_column(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text of an Arrow column; a null is empty. Long texts are worked on piece by piece."""
        texts = texts.fill_null("")
        sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
        out: list[bytes] = []
        start = 0
        while start < len(texts):
            if sizes[start] > self.slice:
                cut = pieces(texts[start].as_py().encode(), min(PIECE, self.slice))
                out.append(b"".join(self._encode(pa.array([p], pa.binary()).cast(pa.string()))[0] for p in cut))
                start += 1
                continue
            end = start + max(1, int(np.searchsorted(np.cumsum(sizes[start:]), self.slice, "right")))
            out += self._encode(texts.slice(start, end - start))
            start = end
        return out

    def _encode(self, texts: pa.Array) -> list[bytes]:
        words = pc.ascii_split_whitespace(texts)
        ends = words.offsets.to_numpy() - words.offsets[0].as_py()
        distinct = words.flatten().dictionary_encode()
        found = self._of(distinct.dictionary.cast(pa.binary()).to_pylist())
        index = distinct.indices.to_numpy()
        ids = np.frombuffer(b"".join(found), "<u4")
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        starts, taken = np.cumsum(sizes) - sizes, sizes[index]
        after = np.cumsum(taken)
        at = np.repeat((starts[index] - (after - taken)).astype(np.int32), taken)  # a slice has far fewer ids than 2 ** 31
        at += np.arange(len(at), dtype=np.int32)
        ids = ids[at]
        bounds = np.concatenate([[0], after])[ends].tolist()
        return [ids[i:j].tobytes() for i, j in zip(bounds, bounds[1:], strict=False)]

    def _of(self, words: list[bytes]) -> list[bytes]:
        """The ids of each of some distinct chunks."""
        if new := self.chunks.renewed(words):
            self._learn(new)
        return list(map(self.chunks.young.__getitem__, words))

    def _learn(self, new: list[bytes]) -> None:
        if b"" in new:
            self.chunks.put([b""], [b""])
            new = [w for w in new if w]
        if not new:
            return
        text = b"\n".join(new).decode("utf-8", "surrogatepass")
        if SPECIAL in text or not PLAIN.fullmatch(text):
            plain = [w for w in new if PLAIN.fullmatch(c := w.decode("utf-8", "surrogatepass")) and SPECIAL not in c]
            others = list(set(new).difference(plain))
            self.chunks.put(others, (np.array(self.whole.encode(w.decode("utf-8", "surrogatepass"), add_special_tokens=False).ids, "<u4").tobytes() for w in others))
            new, text = plain, b"\n".join(plain).decode()
            if not new:
                return
        flat = PRE_TOKEN.findall(text.lower())  # none of these characters changes under NFC
        missing = self.tokens.renewed(set(flat).difference("\n"))
        for start in range(0, len(missing), BLOCK):
            self._merge(missing[start : start + BLOCK])
        self.tokens.young["\n"] = BETWEEN
        self.chunks.put(new, b"".join(map(self.tokens.young.__getitem__, flat)).split(BETWEEN))

    def _merge(self, block: list[str]) -> None:
        ids = np.array(self.merges.encode(" ".join(block), add_special_tokens=False).ids, "<u4")
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(block) or ends[-1] != len(ids):  # not a vocabulary with word ends
            self.tokens.put(block, (np.array(self.whole.encode(token, add_special_tokens=False).ids, "<u4").tobytes() for token in block))
            return
        data, bounds = ids.tobytes(), [0, *(ends * 4).tolist()]
        self.tokens.put(block, (data[i:j] for i, j in zip(bounds, bounds[1:], strict=False)))


_ENCODERS: dict[tuple[str, int], WordEncoder] = {}


def encoder(path: str, kept: int = KEPT) -> WordEncoder:
    """One encoder a Python worker and vocabulary; what it has learned serves the worker's later tasks too."""
    if (path, kept) not in _ENCODERS:
        _ENCODERS[path, kept] = WordEncoder(path, kept)
    return _ENCODERS[path, kept]


def forget() -> None:
    """Drops this worker's encoders: the worker may serve other stages next."""
    _ENCODERS.clear()
