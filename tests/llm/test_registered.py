"""Registered queries without SQL, over the whole table documents, against plain implementations; the pipeline on odd tables."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
import tokenizers

from plusminus.llm import pieces, queries, secrets, word_tokens
from tests.llm.test_text_ops import spans_by_hand

Q = queries.queries()


@pytest.fixture(scope="module")
def texts(spark, data):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def word_ids(texts):
    word = tokenizers.Tokenizer.from_file(word_tokens.default_path())
    return {d: np.array([*word.encode(t, add_special_tokens=False).ids, 1], "<u4") for d, t in texts.items()}


def test_op1_and_op5_equal_the_library(spark, data, texts):
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.default_path())
    want = {d: library.encode(t) for d, t in texts.items()}
    rows = Q["op1_sentencepiece"](spark, data).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = want[r.doc_id]
        back = library.decode(ids) if ids else ""
        assert (r.n_tokens, r.ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        assert (r.decoded_crc32, r.round_trip) == (zlib.crc32(back.encode()), back == texts[r.doc_id])
    counted = {r.doc_id: (r.n_tokens, r.n_chars) for r in Q["op5_token_counts"](spark, data).collect()}
    assert counted == {d: (len(ids), len(texts[d])) for d, ids in want.items()}


def test_op4_files_hold_the_ids(spark, data, word_ids):
    at, want = 0, []
    for d in sorted(word_ids):
        want.append((d, at, len(word_ids[d]), zlib.crc32(word_ids[d].tobytes())))
        at += len(word_ids[d])
    rows = Q["op4_token_file"](spark, data).select("doc_id", "start", "n_tokens", "ids_crc32").collect()
    assert sorted(tuple(r) for r in rows) == want


def test_op7_packs_each_id_once(spark, data, word_ids):
    rows = Q["op7_packing"](spark, data).collect()
    of_doc, of_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        ids = word_ids[r.doc_id]
        assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
        of_doc[r.doc_id].append((r.start, r.length))
        of_sequence[r.sequence_id].append((r.offset, r.length))
    for parts, most in [(p, len(word_ids[d])) for d, p in of_doc.items()] + [(p, None) for p in of_sequence.values()]:
        at = 0
        for start, length in sorted(parts):
            assert start == at and length > 0
            at += length
        assert at == most if most is not None else at <= 2048
    assert set(of_doc) == set(word_ids)
    assert sum(map(len, word_ids.values())) >= 0.95 * 2048 * len(of_sequence)


# --- secrets ----------------------------------------------------------------------------------------------------


def battery_by_hand(body):
    """(p, whether both gates pass, symbols) of a run."""
    _, _, alphabet, rate = next(e for e in secrets.ENCODINGS if re.fullmatch(e[1], body))
    hexadecimal = re.fullmatch("[0-9a-f]+|[0-9A-F]+", body) and not body.isdigit()
    symbols = (body.lower() if hexadecimal else body).rstrip("=")
    x, k = [alphabet.find(c) + 1 for c in symbols], len(alphabet)
    n = len(x)
    if n < 8:
        return None
    shift = n * (rate * k - 1)
    z = (sum(c * c for c in Counter(symbols).values()) * k / n - n - (k - 1) - shift) / math.sqrt(2 * (k - 1) + 4 * shift)
    high = [v > (k + 1) / 2 for v in x]
    a, b = sum(high), n - sum(high)
    runs = 1 + sum(u != v for u, v in zip(high, high[1:]))
    variance = 2 * a * b * (2 * a * b - n) / (n * n * (n - 1))
    runs_z = (runs - 2 * a * b / n - 1) / math.sqrt(max(variance, 1e-9))
    mean = sum(x) / n
    power = sum(v * v for v in x) / n - mean * mean
    serial = sum((u - mean) * (v - mean) for u, v in zip(x, x[1:])) / (n * power) if power > 1e-9 else 1
    serial_z = serial * math.sqrt(n) + 1 / math.sqrt(n)
    return math.erfc(-z / math.sqrt(2)) / 2, abs(runs_z) <= 2.58 and abs(serial_z) <= 2.58, n


def found_by_hand(texts):
    """The random spans of each text: tests, and the step-up rule in each class of lengths at a rate of 0.01."""
    tested = []
    for d, text in texts.items():
        base = [tuple(map(int, s.split(":")[1:])) for s in spans_by_hand(text).split(",") if s]
        spans = [m.span() for m in re.finditer(r"[A-Za-z0-9+_=-]{20,}", text)]
        spans += [m.span() for m in re.finditer(r"[A-Za-z0-9+/]{20,}={0,2}", text) if "/" in m[0]]
        for a, b in spans:
            if not any(u < b and a < v for u, v in base) and (one := battery_by_hand(text[a:b])):
                p, passed, n = one
                step = math.floor(math.log10(max(p, 1e-300)) * 50) + 1
                tested.append((max(c for c in (20, 24, 32, 48, 64, 128, 256) if c <= max(n, 20)), step if passed else None, d, a, b))
    out = defaultdict(list)
    for c in {t[0] for t in tested}:
        steps = [t[1] for t in tested if t[0] == c]
        good = sorted(s for s in steps if s is not None)
        limit = max((s for s in good if 10 ** (s / 50) * len(steps) <= sum(g <= s for g in good) * 0.01), default=None)
        for _, step, d, a, b in (t for t in tested if t[0] == c and t[1] is not None and limit is not None and t[1] <= limit):
            out[d].append((a, b))
    joined = {}
    for d, spans in out.items():
        joined[d] = []
        for a, b in sorted(spans):
            if joined[d] and a < joined[d][-1][1]:
                joined[d][-1] = (joined[d][-1][0], max(b, joined[d][-1][1]))
            else:
                joined[d].append((a, b))
    return joined


def test_op6_spans_of_the_table(spark, data, texts):
    want = found_by_hand(texts)
    rows = Q["op6_secrets"](spark, data).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = spans_by_hand(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        kinds = [s.split(":")[0] for s in base.split(",") if s]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(kinds.count(k) for k in secrets.KINDS)
        found = [tuple(map(int, s.split(":")[1:])) for s in r.spans.split(",") if s.startswith("random")]
        assert found == want.get(r.doc_id, [])


def test_op6_tests_and_rule_by_hand(spark, tmp_path):
    rng = random.Random(23)
    digits = "0123456789"
    some = ["ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", digits + "abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", digits, digits + "abcdefghijklmnopqrstuvwxyz"]
    texts = {i: "see " + "".join(rng.choice(some[i % 5]) for _ in range(rng.choice([20, 22, 30, 40, 64, 150]))) + " and " + "ab_cde_" * rng.randrange(6) for i in range(300)}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    rows = secrets.find_secrets(spark.read.parquet(str(tmp_path / "d"))).collect()
    want = found_by_hand(texts)
    assert len(want) > 60
    assert {r.doc_id: f for r in rows if (f := [tuple(map(int, s.split(":")[1:])) for s in r.spans.split(",") if s.startswith("random")])} == want


def test_op6_work_grows_with_the_length_of_a_run(spark, tmp_path):
    spark.createDataFrame([(1, "x" * 300_000)], "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    begun = time.time()
    assert [r.spans for r in secrets.find_secrets(spark.read.parquet(str(tmp_path / "d"))).collect()] == [""]
    assert time.time() - begun < 60  # ten minutes and more if every symbol costs a pass over the run


# --- substring dedup --------------------------------------------------------------------------------------------


def repeats_by_hand(texts, words):
    """Documents with a window of so many words that an earlier document, or an earlier place of their own, has."""
    seen, found = set(), set()
    for d in sorted(texts):
        parts = texts[d].split()
        for i in range(len(parts) - words + 1):
            window = hash(tuple(parts[i : i + words]))
            if window in seen:
                found.add(d)
            seen.add(window)
    return found


def test_op9_finds_the_repeats_of_the_table(spark, data, texts):
    rows = {r.doc_id: r for r in Q["op9_substring_dedup"](spark, data).collect()}
    assert set(rows) == set(texts)
    found = {d for d, r in rows.items() if r.n_spans}
    long, short = repeats_by_hand(texts, 50), repeats_by_hand(texts, 15)
    assert len(long) > 10 and len(found & long) >= 0.97 * len(long)
    assert len(found - short) <= 0.01 * len(texts)
    for d, r in rows.items():
        spans = [tuple(map(int, s.split(":"))) for s in r.spans.split(",") if s]
        assert len(spans) == r.n_spans and spans == sorted(spans)
        assert r.repeated_words == sum(len(texts[d][a:b].split()) for a, b in spans)
        assert all(b <= c for (_, b), (c, _) in zip(spans, spans[1:])) and all(b <= len(texts[d]) for _, b in spans)


# --- the pipeline -----------------------------------------------------------------------------------------------

ODD = "doc_id long, text string, lang string, source string, n_chars long, row string, base string, spans string, bucket string"


def test_pipeline_on_odd_rows_and_an_empty_table(spark, data, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    known = spark.read.parquet(f"{data}/documents.parquet").filter("text is not null and lang is not null").orderBy("doc_id").collect()
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars, "r", None, "s", "b") for r in known]
    prose = max((r.text for r in known), key=len)
    odd = [(None, prose + " at the end", None), (10**6, None, "en"), (10**6 + 1, "", "en"), (10**6 + 2, " \n ", None), (10**6 + 3, "x" * 300_000, None), (10**6 + 4, (prose + "\n") * 20, None), (rows[0][0], rows[0][1], rows[0][2])]
    rows += [(i, t, g, None, None, "r", "b", "s", None) for i, t, g in odd]
    for name, some in (("odd", rows), ("empty", [])):
        spark.createDataFrame(some, ODD).repartition(3).write.parquet(str(tmp_path / name / "documents.parquet"))
        docs = spark.read.parquet(str(tmp_path / name / "documents.parquet"))
        seen = docs
        for stage, step in pipeline.STAGES[:-1]:
            seen = pipeline.saved(step(spark, seen, str(tmp_path / name)), f"odd-{stage}")
            assert seen.columns == docs.columns
        packed = pipeline.run(spark, str(tmp_path / name)).collect()
        left = [r.doc_id for r in seen.collect()]
        assert {r.doc_id for r in packed} == set(left)
        if not some:
            assert not packed
            continue
        assert 10**6 not in left and 10**6 + 1 not in left and 10**6 + 2 not in left  # no letter, no language
        assert left.count(rows[0][0]) <= 1 and len(left) > 0.7 * len(known)
