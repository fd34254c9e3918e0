"""Ops 8 and 10, the pipeline, and the queries' SQL."""

import os
import random

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from plusminus.llm import components, packing, queries, simhash, topk
from plusminus.llm.common import pieces, shared_dir, word_lists

# --- top-k ------------------------------------------------------------------------------------------------------


def by_hand(rows, k):
    """rows: (vec_id, vector, asks)."""
    whole = [(i, [int(np.floor(1024 * float(x))) for x in v], a) for i, v, a in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, (qi, qv, asks) in enumerate(whole):
        if asks:
            found = sorted((-sum(a * b for a, b in zip(qv, v)), i) for c, (i, v, _) in enumerate(whole) if c != q and len(v) == len(qv))
            out += [(qi, r + 1, i, -s) for r, (s, i) in enumerate(found[:k])]
    return sorted(out)


def test_top_k_with_odd_rows(spark):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)], i % 10 == 0) for i in range(120)]
    rows += [(i, [0.5] * 6, False) for i in range(200, 230)]  # ties
    rows += [(300, [0.0] * 6, True), (301, None, True), (302, [1.0, None, 0.0, 0.0, 0.0, 0.0], True), (303, [float("nan")] * 6, True), (304, [float("inf")] * 6, False), (305, [], True), (None, [1.0] * 6, True), (306, [1.0, 2.0], True), (307, [3.0, 1.0], False), (10, [0.25] * 6, True), (308, [1e20] * 2, False)]
    df = spark.createDataFrame([(i, v, a, "x", 1) for i, v, a in rows], "vec_id long, embedding array<double>, asks boolean, block string, row int").repartition(5)
    found = [tuple(r) for r in topk.top_k(df, F.col("asks"), k=7, block=16, chunk=4).collect()]
    want = [(q, r, i, max(-(1 << 63), min((1 << 63) - 1, s))) for q, r, i, s in by_hand(rows, 7)]
    assert sorted(found) == want
    assert topk.top_k(df.limit(0), F.col("asks")).count() == 0


def test_threshold_algorithm_stops_early_and_is_exact():
    rng = np.random.default_rng(2)
    vectors = np.floor(1024 * rng.standard_normal((4000, 3)) ** 3)
    ids, lists, scored = np.arange(4000), topk.Lists(vectors), []
    for q in range(20):
        query = vectors[q]
        at, score, seen = lists.search(query, ids, ids == q, 5)
        want = sorted((-s, i) for i, s in enumerate((vectors @ query).astype(int).tolist()) if i != q)[:5]
        assert [(-s, i) for i, s in zip(at.tolist(), score.tolist())] == want
        scored.append(seen)
    assert np.median(scored) < 2000


# --- SimHash ----------------------------------------------------------------------------------------------------


def print_by_hand(text):
    words = (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum((2 * sum(x >> k & 1 for x in h) > len(h)) << k for k in range(64))


def test_fingerprints_by_hand_and_in_pieces(monkeypatch):
    texts = [None, "", " \n", "One", "one two", "A b C d E", "É é x\x1cy z w", "the same the same the same the same"]
    assert [simhash.fingerprint(t)[0] for t in texts] == [print_by_hand(t) for t in texts]
    long = " ".join(f"w{i % 97}" for i in range(5000))
    monkeypatch.setattr(simhash, "word_lists", lambda data: (p.split() for p in pieces(data, 64) if p.split()))
    assert simhash.fingerprint(long)[0] == print_by_hand(long)
    assert [w for ws in word_lists(long.encode()) for w in ws] == long.encode().split()


def components_by_hand(prints, radius):
    parent = {i: i for i in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in prints:
        for j in prints:
            if i < j and (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in prints}


def test_simhash_of_the_table(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").collect()
    prints = {r.doc_id: print_by_hand(r.text) for r in docs}
    want = components_by_hand(prints, 3)
    rows = simhash.op10_simhash(spark, data).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == {i: (f"{prints[i]:016x}", want[i]) for i in prints}


def test_links_across_many_small_tiles(spark):
    rng = random.Random(3)
    prints = {}
    for i in range(300):
        base = rng.getrandbits(64) if i % 3 or not prints else prints[rng.choice(list(prints))]
        for _ in range(rng.randrange(4)):
            base ^= 1 << rng.randrange(64)
        prints[i] = base
    signed = {i: p - (1 << 64) if p >> 63 else p for i, p in prints.items()}
    nodes = spark.createDataFrame([([p],) for p in set(signed.values())], "fp array<long>")
    found = components.components(simhash.links(nodes, 3, tile=16)).collect()
    root = {r.u[0]: r.root[0] for r in found}
    groups = {}
    for i, p in signed.items():
        groups.setdefault(root.get(p, p), []).append(i)
    want = {}
    for i, c in components_by_hand(prints, 3).items():
        want.setdefault(c, []).append(i)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_a_group_of_close_prints_gives_few_links():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 1, np.uint64)
    close = np.unique(base ^ (np.uint64(1) << rng.integers(0, 60, 3000).astype(np.uint64)))[:, None]
    assert len(simhash.tile_links(close, close, 3, True)) == len(close) - 1


def test_components_of_chains(spark):
    rng, edges = random.Random(5), [(i, i + 1) for i in range(200)] + [(500 + i, 501 + i) for i in range(3)] + [(9, 9), (None, 3)]
    rng.shuffle(edges)
    found = {r.u: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {i: 0 for i in range(1, 201)} | {501: 500, 502: 500, 503: 500}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def odd_docs(spark, path):
    text = " ".join(f"w{i * i % 1009}" for i in range(300))
    near = text.replace("w4 ", "x4 ", 1)
    rows = [(None, text), (3, text), (3, text), (2, near), (5, None), (6, ""), (7, "other words here"), (None, "lonely words here"), (8, " ".join(f"v{i}" for i in range(200)))]
    spark.createDataFrame([(i, t, "r", "f", "l") for i, t in rows], "doc_id long, text string, row string, fp string, least string").write.mode("overwrite").parquet(str(path))
    return spark.read.parquet(str(path)), rows


def test_simhash_odd_inputs(spark, tmp_path):
    docs, rows = odd_docs(spark, tmp_path / "d")
    found = sorted(((r.doc_id is not None, r.doc_id, r.component_id) for r in simhash.near_duplicates(docs, radius=6).collect()), key=lambda x: tuple(y or -1 for y in x))
    assert [x[1:] for x in found if x[0]] == [(2, 2), (3, 2), (3, 2), (5, 5), (6, 5), (7, 7), (8, 8)]
    assert sorted(x[2] or 0 for x in found if not x[0]) == [0, 2]
    one = simhash.one_of_each(docs, radius=6)
    assert one.columns == docs.columns
    assert sorted(r.doc_id or -1 for r in one.collect()) == [-1, 2, 5, 7, 8]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0 and simhash.one_of_each(docs.limit(0)).count() == 0


# --- queries and the pipeline ------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, data, name):
    con = duckdb.connect()
    for f in os.listdir(data):
        con.execute(f"CREATE VIEW {f.partition('.')[0]} AS SELECT * FROM '{data}/{f}'")
    df = queries.queries()[name](spark, data)
    columns = sorted(df.columns)
    assert sorted(tuple(r) for r in df.select(*columns).collect()) == sorted(con.sql(f"SELECT {', '.join(columns)} FROM ({queries.oracle_sql()[name]})").fetchall())


def test_there_is_a_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 11))


def test_pipeline(spark, data):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    seen, parts = docs, {}
    for name, stage in pipeline.STAGES[:-1]:
        seen = pipeline.saved(stage(spark, seen, data), f"test-{name}")
        assert seen.columns == docs.columns
        parts[name] = {r.doc_id: r for r in seen.collect()}
    assert set(parts["language"]) == set(rows)
    # Of each set of equal texts one document is left, the one of the smallest id; later stages keep all documents.
    first = {}
    for i in sorted(rows):
        first.setdefault(rows[i].text, i)
    assert set(parts["near_dedup"]) <= set(first.values()) and len(parts["near_dedup"]) > 0.8 * len(first)
    assert set(parts["substring_dedup"]) == set(parts["secrets"]) == set(parts["near_dedup"])
    assert not any("24be64439e3e49cf46b2d7c90f3602a3d0b907ff" in r.text for r in parts["secrets"].values())
    packed = packing.pack(seen).collect()
    ran = pipeline.run(spark, data).collect()
    assert sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in packed) == sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in ran)
    assert {r.doc_id for r in ran} == set(parts["near_dedup"])


# --- near duplicates by similarity -------------------------------------------------------------------------------


def kept_by_hand(rows, shingle):
    """The ids that are left of (id, text): the smallest of each component of pairs at a Jaccard similarity of 0.8 or more."""
    sets = {}
    for i, text in rows:
        words = text.split()
        sets[i] = {" ".join(words[k : k + shingle]) for k in range(max(1, len(words) - shingle + 1))}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i for i in sets if find(i) == i}


def text_table(spark, path, rows):
    spark.createDataFrame(rows, "doc_id long, text string").write.mode("overwrite").parquet(str(path))
    return spark.read.parquet(str(path))


@pytest.mark.parametrize("set_tile", [1000, 1 << 20])
def test_near_duplicates_by_brute_force_similarity(spark, tmp_path, set_tile):
    pipeline = pytest.importorskip("corpus_pipeline")
    rng, rows = random.Random(12), []
    for base in range(40):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([12, 60, 300]))]
        for _ in range(5):  # the last words are others: similarities of about 0.7 to 0.98
            n = int(len(words) * rng.uniform(0.84, 0.99))
            rows.append((len(rows), " ".join(words[:n] + [f"x{rng.randrange(10**6)}" for _ in words[n:]])))
    docs = text_table(spark, tmp_path / "d", rows)
    want = kept_by_hand(rows, pipeline.SHINGLE)
    assert 60 < len(want) < 180
    kept = simhash.one_of_each(docs, pipeline.SHINGLE, pipeline.RADIUS, pipeline.WORDS64, similar=pipeline.SIMILAR, set_tile=set_tile)
    assert {r.doc_id for r in kept.collect()} == want


def test_a_repeated_block_votes_once(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    rng, rows = random.Random(13), []
    for _ in range(6):
        words = [f"w{rng.randrange(10**6)}" for _ in range(300)]
        rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join(words + words[:12] * 100))]
    menu = [f"m{k}" for k in range(64)]
    rows += [(len(rows) + k, " ".join(menu * 5 + [f"w{rng.randrange(10**6)}" for _ in range(244)])) for k in range(6)]
    docs = text_table(spark, tmp_path / "d", rows)
    want = kept_by_hand(rows, pipeline.SHINGLE)
    assert want == {0, 2, 4, 6, 8, 10, *range(12, 18)}
    assert {r.doc_id for r in pipeline.near_dedup(spark, docs, "").collect()} == want
    apart = lambda a, b: sum((x ^ y).bit_count() for x, y in zip(a[:4], b[:4], strict=True))
    prints = [simhash.signature(t, pipeline.SHINGLE, pipeline.WORDS64) for _, t in rows]
    assert apart(prints[0], prints[1]) <= 40 and apart(prints[12], prints[13]) > 60


def test_similar_sets_share_a_key():
    rng = random.Random(14)
    for _ in range(3000):
        n = rng.choice([1, 2, 3, 5, 9, 40, 200])
        base = [rng.getrandbits(64) for _ in range(n)]
        other = [x for x in base if rng.random() > 0.1] + [rng.getrandbits(64) for _ in range(rng.randrange(1 + n // 6))]
        x, y = (np.unique(np.array(v, np.uint64)) for v in (base, other))
        both = len(np.intersect1d(x, y))
        if both and 5 * both >= 4 * (len(x) + len(y) - both):
            assert len(np.intersect1d(simhash.block_keys(x, (4, 5)), simhash.block_keys(y, (4, 5))))
    assert len(simhash.block_keys(np.zeros(0, np.uint64), (4, 5))) == 0


@pytest.mark.parametrize("tile", [40, 8192])
def test_blocks_lose_no_similar_pair(spark, tmp_path, tile):
    pipeline = pytest.importorskip("corpus_pipeline")
    rng, rows = random.Random(15), []
    common = [f"c{k}" for k in range(60)]  # a passage that is a third of many texts: large blocks of texts that aren't alike
    for _ in range(150):
        rows.append((len(rows), " ".join(common + [f"w{rng.randrange(10**6)}" for _ in range(120)])))
    base = [f"b{k}" for k in range(200)]  # a large group of near copies, some just near enough and some just not
    for k in range(200):
        copy = list(base)
        for _ in range(rng.choice([1, 2, 4, 8])):
            copy[rng.randrange(200)] = f"y{rng.randrange(10**6)}"
        rows.append((len(rows), " ".join(copy)))
    rows += [(len(rows) + k, f"only {k % 3}") for k in range(9)] + [(len(rows) + 9, None), (len(rows) + 10, " ")]
    docs = text_table(spark, tmp_path / "d", rows)
    want = kept_by_hand([(i, t or "") for i, t in rows], pipeline.SHINGLE)
    assert 160 < len(want) < 340  # the unlike ones and some of the near ones
    kept = simhash.one_of_each(docs, pipeline.SHINGLE, pipeline.RADIUS, pipeline.WORDS64, similar=pipeline.SIMILAR, tile=tile)
    assert {r.doc_id for r in kept.collect()} == want
    assert not [n for n in os.listdir(shared_dir(spark).removeprefix("file://")) if n.startswith("keyed")]


def test_unlike_texts_are_not_compared(spark, tmp_path, monkeypatch):
    """Fingerprints compared grow with the near copies and not with the square of the texts."""
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(16)
    rows = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(30))) for i in range(400)]
    rows += [(400 + i, rows[i][1] + " more") for i in range(20)]
    docs = text_table(spark, tmp_path / "d", rows)
    prints = simhash.saved(simhash.signatures(docs, pipeline.SHINGLE, pipeline.WORDS64, simhash.SEED, pipeline.SIMILAR), "prints")
    asked, compared = [], simhash._compared
    monkeypatch.setattr(simhash, "_compared", lambda *a: asked.append(a) or compared(*a))
    found = simhash.links_in_blocks(prints.select("fp"), prints.select("fp", "keys"), pipeline.RADIUS, pipeline.WORDS64, 8192, pipeline.SIMILAR)
    assert found.count() == 20 and not asked
