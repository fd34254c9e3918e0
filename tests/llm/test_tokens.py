"""Ops 1, 4, 5 and 7 against the tokenizer libraries, text by text."""

import random
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
import tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from plusminus.llm import lockstep, packing, pieces, suffix_pieces, token_counts, token_file, word_tokens

TEXTS = [None, "", " ", "\n\n", "Hello  world", "it's I'LL don't 3.14 a1b22", "<|endoftext|> x<|startoftext|>y", "ÀÉß ñandú ǅ İ Σίσυφος ΑΣ", "日本語 🦊 é x́", "a" * 5000, "tab\tx\x1cy z　w\x85v", "\0", "▁a▁ ▁", "    " * 9, "� <0x41>", "the cat sat " * 300]
SCHEMA = "doc_id long, text string, doc_id2 string"


@pytest.fixture(scope="module")
def word():
    return tokenizers.Tokenizer.from_file(word_tokens.default_path())


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.default_path())


def ids_of(data):
    return np.frombuffer(data, "<u4").tolist()


def table_of(spark, texts):
    ids = [None, 5, 5, *range(10, 10 + len(texts))]
    return spark.createDataFrame([(i, t, "x") for i, t in zip(ids, texts)], SCHEMA).repartition(3)


def test_words_equal_the_library(word):
    code = word_tokens.WordEncoder(word_tokens.default_path(), kept=8)
    for _ in range(2):  # the second time from what is remembered
        for text, data in zip(TEXTS, code.encode_column(pa.array(TEXTS, pa.string()))):
            assert ids_of(data) == word.encode(text or "", add_special_tokens=False).ids
    latin = "".join(map(chr, range(0xA1, 0x250)))
    for text in (latin, " ".join(latin), "1a".join(latin)):
        assert ids_of(code.encode(text)) == word.encode(text, add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=4))
def test_words_of_any_text(texts):
    word = tokenizers.Tokenizer.from_file(word_tokens.default_path())
    texts = [t.encode("utf-8", "replace").decode() for t in texts]
    for text, data in zip(texts, word_tokens.encoder(word_tokens.default_path()).encode_column(pa.array(texts, pa.string()))):
        assert ids_of(data) == word.encode(text, add_special_tokens=False).ids


def test_long_text_is_worked_on_in_parts(word, monkeypatch):
    monkeypatch.setattr(word_tokens, "SLICE", 1000)
    text = "some words, and 12 more\n" * 400
    assert ids_of(word_tokens.WordEncoder(word_tokens.default_path()).encode(text)) == word.encode(text, add_special_tokens=False).ids


def test_pieces_equal_the_library(library):
    code, counter = suffix_pieces.SuffixEncoder(pieces.vocabulary(pieces.default_path())), token_counts.TrieCounter(pieces.vocabulary(pieces.default_path()))
    found, counts = code.encode_batch(TEXTS), counter.count_batch(TEXTS)
    for text, data, (_, n) in zip(TEXTS, found, counts):
        want = library.encode(text) if text else []
        assert ids_of(data) == want and n == len(want)
        assert code.words.decode(want) == library.decode(want)


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("aeinst ▁th\n.1é日"), st.characters(codec="utf-8")), max_size=60))
def test_pieces_of_any_text(text):
    words = pieces.vocabulary(pieces.default_path())
    want = words.library.encode(text)
    assert ids_of(suffix_pieces.encoder(pieces.default_path()).encode_batch([text])[0]) == want
    assert token_counts.counter(pieces.default_path()).count_batch([text])[0][1] == len(want)
    assert words.decode(want) == words.library.decode(want)


class Unigram(pieces.Vocabulary):
    """A small unigram vocabulary, as pieces.Vocabulary has it."""

    kind, unknown_score, splits, unknown = pieces.UNIGRAM, -30.0, True, 0

    def __init__(self):
        names = "▁ a b c ab bc abc ▁a ▁ab ca".split()
        self.ids = {p: i + 1 for i, p in enumerate(names)}
        self.scores = {i: s for i, s in zip(self.ids.values(), (-2, -3, -3.5, -3, -4, -4.2, -7, -4, -5.5, -5))}
        self.longest = 3
        self.normalize = lambda t: "▁" + t.replace(" ", "▁")
        self.ids_of = lambda p: [self.ids.get(p, 0)]


def best_score(words, unit):
    best = [0.0] + [-1e9] * len(unit)
    for j in range(1, len(unit) + 1):
        for i in range(j):
            piece = unit[i:j]
            if piece in words.ids:
                best[j] = max(best[j], best[i] + words.scores[words.ids[piece]])
            elif j - i == 1:
                best[j] = max(best[j], best[i] + words.unknown_score)
    return best[-1]


def test_unigram_models_take_the_best_sum():
    words = Unigram()
    code, counter = suffix_pieces.SuffixEncoder(words), token_counts.TrieCounter(words)
    names = {i: p for p, i in words.ids.items()}
    for text in ("abc", "ab cab", "aabbcc abcabc", "cabx bca", "xyz a"):
        ids = ids_of(code.encode_batch([text])[0])
        want = sum(best_score(words, u) for u in words.units(text))
        assert sum(words.scores[i] if i in names else words.unknown_score for i in ids) == pytest.approx(want)
        assert counter.count_batch([text])[0][1] == len(ids)


LONG = {
    "base64": lambda rng: "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(1 << 20)),
    "one letter": lambda rng: "a" * (1 << 20),
    "ideographs": lambda rng: "".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(1 << 18)),
    "words": lambda rng: "".join(rng.choice(["the", "there", "nation", "ing", "ation", "er", "é"]) for _ in range(1 << 18)),
    "unknown": lambda rng: "\U0001f98a" * 3000 + "ab" * 100,
}


@pytest.mark.parametrize("make", LONG.values(), ids=LONG)
def test_a_long_text_without_a_blank_takes_seconds(library, make):
    text, words = make(random.Random(5)), pieces.vocabulary(pieces.default_path())
    want, began = library.encode(text), time.monotonic()
    assert ids_of(suffix_pieces.SuffixEncoder(words).encode_batch([text])[0]) == want
    assert token_counts.TrieCounter(words).count_batch([text])[0][1] == len(want)
    assert time.monotonic() - began < 30


def test_long_units_of_a_unigram_model(monkeypatch):
    words, rng = Unigram(), random.Random(4)
    monkeypatch.setattr(lockstep, "TILE", 50)
    for n in (300, 1000):
        text = "".join(rng.choice("abcabcabcx") for _ in range(n))
        ids = ids_of(suffix_pieces.SuffixEncoder(words).encode_batch([text])[0])
        names = {i: p for p, i in words.ids.items()}
        assert sum(words.scores[i] if i in names else words.unknown_score for i in ids) == pytest.approx(best_score(words, words.normalize(text)))
        assert token_counts.TrieCounter(words).count_batch([text])[0][1] == len(ids)


def test_what_is_kept_is_bounded_by_bytes():
    code = word_tokens.WordEncoder(word_tokens.default_path(), kept=100_000)
    for k in range(40):
        code.encode(" ".join(f"w{k}x{i}" for i in range(500)) + " " + "z" * 10_000)
        for kept in (code.chunks, code.tokens):
            assert sum(len(w) + len(v) + word_tokens.ENTRY for w, v in kept.young.items()) < 100_000 + 500 * 400 + 60_000
    seen = lockstep.Kept(50_000)
    for k in range(60):
        new = seen.missing({f"u{k}{i}" for i in range(100)} | {"u"})
        seen.put(new, [b"x" * 50] * len(new))
        assert len(seen.young) < 400


def test_the_trie_computes_a_shared_prefix_once():
    counter = token_counts.TrieCounter(Unigram())
    counter.count_batch(["abca abcb abcc abc"])
    assert counter.nodes == 4 + 3  # ▁ a b c, then a, b and c


def test_suffix_array_finds_every_occurrence():
    text = "banana band"
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    array = suffix_pieces.SuffixArray(codes, 4)
    for p in ("an", "ana", "b", "nd", "x", "band", "d"):
        low, high = array.ranges([np.frombuffer(p.encode("utf-32-le"), np.uint32)])
        assert sorted(array.order[low[0] : high[0]].tolist()) == [i for i in range(len(text)) if text.startswith(p, i)]


def test_encode_and_decode_tables(spark, library):
    docs = table_of(spark, TEXTS)
    encoded = suffix_pieces.encode(docs)
    assert encoded.columns == ["doc_id", "ids"]
    back = sorted((r.text for r in suffix_pieces.decode(encoded).collect()))
    assert back == sorted(library.decode(library.encode(t)) if t else "" for t in TEXTS)
    rows = suffix_pieces.round_trips(docs).collect()
    assert len(rows) == len(TEXTS) and sum(r.n_tokens for r in rows) == sum(r.n_tokens for r in token_counts.count_tokens(docs).collect())
    empty = docs.limit(0)
    assert suffix_pieces.round_trips(empty).count() == token_counts.count_tokens(empty).count() == suffix_pieces.decode(suffix_pieces.encode(empty)).count() == 0


def test_token_files(spark, word, tmp_path):
    docs = table_of(spark, TEXTS)
    manifest = token_file.write_files(docs, f"file://{tmp_path}/a", file_rows=4)
    rows = token_file.read_files(manifest).collect()
    ids = {}
    for r in docs.collect():
        ids.setdefault(r.doc_id, []).append(np.array([*word.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4"))
    assert len(rows) == len(TEXTS) and manifest.count() > 1
    at = 0
    for r in sorted(rows, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
        assert (r.n_tokens, r.ids_crc32) in [(len(x), zlib.crc32(x.tobytes())) for x in ids[r.doc_id]]
    order = [r.doc_id for r in sorted(rows, key=lambda r: r.start)]
    assert order == sorted(order, key=lambda d: (d is not None, d))
    some = token_file.read_documents(manifest, [12, 15])
    assert {d: x.tolist() for d, x in some.items()} == {d: ids[d][0].tolist() for d in (12, 15)}
    empty = token_file.write_files(docs.limit(0), f"file://{tmp_path}/b")
    assert token_file.read_files(empty).count() == 0


def test_a_reader_takes_requested_frames_and_sees_damage(tmp_path, monkeypatch):
    monkeypatch.setattr(token_file, "FRAME_IDS", 100)
    path = tmp_path / "x.zst"
    with open(path, "wb") as out:
        file = token_file.FileWriter(out, 2)
        for d in range(50):
            file.add(d, np.arange(d * 10, dtype="<u4"))
        file.close()
    with pa.OSFile(str(path)) as stream:
        reader = token_file.FileReader(stream)
        before = reader.bytes_read
        assert reader.find([30])[30].tolist() == list(range(300))
        assert reader.bytes_read - before < path.stat().st_size / 10
        assert all(x.tolist() == list(range(d * 10)) for d, x in reader.find(range(50)).items())
    raw = bytearray(path.read_bytes())
    raw[20] ^= 255
    path.write_bytes(raw)
    with pa.OSFile(str(path)) as stream, pytest.raises(Exception):
        token_file.FileReader(stream).find(range(50))


def first_fit(lengths, capacity):
    free, placed = [], {}
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        b = next((b for b, f in enumerate(free) if f >= lengths[i]), len(free))
        if b == len(free):
            free.append(capacity)
        placed[i] = (b, capacity - free[b])
        free[b] -= lengths[i]
    return [placed[i] for i in range(len(lengths))]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=60))
def test_tournament_tree_is_first_fit(lengths):
    assert packing.first_fit_decreasing(lengths, 50) == first_fit(lengths, 50)


def test_packing(spark, word):
    docs = table_of(spark, TEXTS)
    rows = packing.pack(docs, capacity=64, group_rows=5).collect()
    held = {}
    for r in rows:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    want = sorted((r.doc_id is not None, r.doc_id, len(word.encode(r.text or "", add_special_tokens=False).ids) + 1) for r in docs.collect())
    assert sum(r.length for r in rows) == sum(n for _, _, n in want)
    for r in rows:
        if r.doc_id is not None and r.doc_id > 5:
            ids = np.array([*word.encode(TEXTS[r.doc_id - 7] or "", add_special_tokens=False).ids, 1], "<u4")
            assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    assert packing.pack(docs.limit(0)).count() == 0
