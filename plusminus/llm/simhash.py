"""SimHash near-duplicates (10): tiled exact comparison with exclusive-or and bit counts.

1. A narrow pass computes each document's fingerprint; it is written to the shared folder (a few bytes a row).
2. Distinct fingerprints are the nodes: exact copies, however many, are one node.
3. Nodes are sorted into tiles by population count. A pair of tiles whose population counts differ by more than
   the radius is never formed; within a pair, blocks are skipped by the counts of the whole and of its halves.
4. Each pair of tiles gives a spanning forest of the links it finds, so that a group of n close fingerprints gives
   n - 1 rows and not n * n / 2, and no link between different fingerprints is lost to its component.
5. Components by star contraction; a component's id is its smallest doc_id.

The comparison is exact, and so it grows with the square of the number of distinct fingerprints.

The pipeline's stage (one_of_each) has sets of shingles as nodes, uses links of fingerprints as candidates and joins only
those whose sets are similar enough, compared in full. It compares fingerprints within blocks alone: a set's keys are the
least of its hashes, as many as its elements that a similar set may lack and one more, so that any two sets that are similar
enough have a key in common, and a block is the sets that have a key. No pair is lost to the blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plusminus.llm.common import columns_of, few_rows, fresh, released, removed, saved, shared_path, slices, table, text_of, word_lists
from plusminus.llm.components import components
from plusminus.llm.lookup import Found, looked_up, numbered, ranges, read_range, written

SHINGLE, SEED, RADIUS = 3, 42, 3
#: Fingerprints of one tile: two tiles and a block of their comparison take a few tens of MB.
TILE = 8192
BLOCK_A, BLOCK_B = 512, 2048
#: Least Jaccard similarity of near duplicates' sets, as a fraction, and hashes of one tile of sets, about (8 MB).
SIMILAR, SET_TILE = (4, 5), 1 << 20
#: Hashes that vote, or are looked for, at once.
VOTES = 1 << 18
#: Keys of one task that makes blocks, and rows of one that compares them, about (32 and 14 MB); blocks of up to SMALL rows are compared together.
TASK_KEYS, TASK_ROWS, SMALL = 1 << 21, 1 << 18, 32
#: Rows that are compared with all others before the rest is, so that a block of near copies takes no time in its square.
LEADERS = 3
GOLDEN = 0x9E3779B97F4A7C15


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th 64-bit hash of the shingles, from the first one (splitmix64)."""
    if not k:
        return h
    h = h + np.uint64(GOLDEN * k & (1 << 64) - 1)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> Iterator[np.ndarray]:
    """The hashes of a text's shingles, array by array, in order; a text of fewer words has its whole sequence as the one shingle."""
    none, tail = True, []
    data = (text or "").encode("utf-8", "surrogatepass").lower()  # bytes.lower() changes A-Z alone
    for words in word_lists(data):
        words = tail + words
        grams = [b" ".join(g) for g in zip(*(words[k:] for k in range(shingle)), strict=False)]
        tail = words[-(shingle - 1) :] if shingle > 1 else []
        if grams:
            none = False
            yield np.array([xxhash.xxh64_intdigest(g, seed) for g in grams], np.uint64)
    if none and tail:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(tail), seed)], np.uint64)


def voted(hashes: Iterable[np.ndarray], words64: int = 1) -> list[int]:
    """The fingerprint as 64-bit words. A bit is set if it is set in over half the hashes."""
    totals, n = np.zeros((words64, 64), np.int64), 0
    for whole in hashes:
        n += len(whole)
        for h in (whole[i : i + VOTES] for i in range(0, len(whole), VOTES)):
            for k in range(words64):
                bits = np.unpackbits(_mixed(h, k).astype(">u8").view(np.uint8)).reshape(-1, 64)
                totals[k] += bits.sum(0, dtype=np.int64)
    return [int.from_bytes(np.packbits(2 * t > n).tobytes(), "big") for t in totals] if n else [0] * words64


def fingerprint(text: str | None, shingle: int = SHINGLE, words64: int = 1, seed: int = SEED) -> list[int]:
    """The fingerprint of a text; every repeat of a shingle votes again."""
    return voted(shingles(text, shingle, seed), words64)


def distinct(hashes: list[np.ndarray]) -> np.ndarray:
    return np.unique(np.concatenate(hashes)) if hashes else np.zeros(0, np.uint64)


def signature(text: str | None, shingle: int = SHINGLE, words64: int = 1, seed: int = SEED) -> list[int]:
    """The fingerprint's words, a digest of the set of shingles and the size of the set: equal for equal sets alone.

    Each distinct shingle votes once, as the similarity of sets counts it.
    """
    return _signed(distinct(list(shingles(text, shingle, seed))), words64)


def _signed(found: np.ndarray, words64: int) -> list[int]:
    return [*voted([found], words64), xxhash.xxh3_64_intdigest(found.tobytes()), len(found)]


def block_keys(found: np.ndarray, similar: tuple[int, int]) -> np.ndarray:
    """The least of the sorted hashes of a set; sets of a Jaccard similarity of `similar` or more have one of them in common.

    Both share at least `similar` of the larger one's elements. If the least key of one that the other lacks came before all
    shared ones, more elements than that leaves would be missing.
    """
    return found[: len(found) - -(-len(found) * similar[0] // similar[1]) + 1] if len(found) else found


def fingerprints(texts: DataFrame, shingle: int = SHINGLE, words64: int = 1, seed: int = SEED) -> DataFrame:
    """The columns of texts, longs but for text, and in place of text fp, the fingerprint's 64-bit words, as signed longs."""
    others = [c for c in texts.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = np.array([fingerprint(x, shingle, words64, seed) for x in batch.column("text").to_pylist()], np.uint64).astype(np.int64)
            prints = pa.array(list(found.reshape(batch.num_rows, -1)), pa.list_(pa.int64()))
            yield pa.record_batch([*(batch.column(c) for c in others), prints], [*others, "fp"])

    return texts.mapInArrow(released(run), ", ".join(f"{c} long" for c in others) + ", fp array<long>")


def signatures(texts: DataFrame, shingle: int, words64: int, seed: int, similar: tuple[int, int]) -> DataFrame:
    """fingerprints() of signatures, and the keys of their sets, as signed longs."""
    others = [c for c in texts.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [distinct(list(shingles(x, shingle, seed))) for x in batch.column("text").to_pylist()]
            found = np.array([_signed(x, words64) for x in sets], np.uint64).astype(np.int64)
            prints = pa.array(list(found.reshape(batch.num_rows, -1)), pa.list_(pa.int64()))
            keys = pa.array([block_keys(x, similar).view(np.int64) for x in sets], pa.list_(pa.int64()))
            yield pa.record_batch([*(batch.column(c) for c in others), prints, keys], [*others, "fp", "keys"])

    return texts.mapInArrow(released(run), ", ".join(f"{c} long" for c in others) + ", fp array<long>, keys array<long>")


class Forest:
    """Union-find over places 0 to n - 1, merging whole arrays of links at once."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self, x: np.ndarray) -> np.ndarray:
        r = self.parent[x]
        while not np.array_equal(up := self.parent[r], r):
            r = up
        return r

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.roots(a), self.roots(b)
            apart = a != b
            a, b = a[apart], b[apart]
            if len(a):
                np.minimum.at(self.parent, np.maximum(a, b), np.minimum(a, b))


    def links(self) -> list[tuple[int, int]]:
        every = np.arange(len(self.parent))
        roots = self.roots(every)
        child = np.flatnonzero(roots != every)
        return list(zip(child.tolist(), roots[child].tolist(), strict=True))


def _ordered(fp: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those places of fp in order of population count, and the counts of the whole, upper and lower half of each word set."""
    fp = fp[places]
    upper, lower = fp >> np.uint64(32), fp & np.uint64(0xFFFFFFFF)
    counts = np.stack([np.bitwise_count(x).sum(1, dtype=np.int32) for x in (fp, upper, lower)])
    order = np.lexsort((counts[1], counts[0]))
    return places[order], counts[:, order]


def _apart(x: np.ndarray, y: np.ndarray, radius: int) -> bool:
    """Whether the counts alone tell that no row of x and y is within the radius."""
    whole, upper, lower = np.maximum(0, np.maximum(x.min(1) - y.max(1), y.min(1) - x.max(1)))
    return whole > radius or upper + lower > radius


def _fit(x: np.ndarray, y: np.ndarray, similar: tuple[int, int]) -> np.ndarray:
    """Whether sets of these sizes can have that similarity."""
    return np.minimum(x, y) * similar[1] >= np.maximum(x, y) * similar[0]


def _joined_by_leaders(forest: Forest, fp: np.ndarray, sizes: np.ndarray, radius: int, similar: tuple[int, int]) -> np.ndarray:
    """Joins LEADERS rows with all that they link to; gives whether a place is in the largest component then."""
    order, main = np.argsort(sizes, kind="stable"), np.zeros(len(fp), bool)
    for _ in range(LEADERS):
        rest = order[~main[order]]
        if not len(rest):
            break
        one = rest[len(rest) // 2]
        near = np.flatnonzero((np.bitwise_count(fp ^ fp[one]).sum(1, dtype=np.int32) <= radius) & _fit(sizes, sizes[one], similar))
        forest.join(np.full(len(near), one), near)
        roots = forest.roots(np.arange(len(fp)))
        main = roots == np.bincount(roots).argmax()
    return main


class Sets:
    """Sets of shingles, one after the other in values; place i has values[bounds[i]:bounds[i + 1]], sorted."""

    def __init__(self, values: np.ndarray, bounds: np.ndarray):
        self.values, self.bounds = values, bounds

    def similar(self, u: int, others: np.ndarray, similar: tuple[int, int]) -> np.ndarray:
        """For each of others, none of them empty, whether its Jaccard similarity to u is that fraction or more."""
        one, sizes = self.values[self.bounds[u] : self.bounds[u + 1]], self.bounds[others + 1] - self.bounds[others]
        out = np.zeros(len(others), bool)
        for part in np.split(np.arange(len(others)), np.flatnonzero(np.diff(np.cumsum(sizes) // VOTES)) + 1):
            every = np.concatenate([self.values[self.bounds[v] : self.bounds[v + 1]] for v in others[part]])
            at = np.minimum(np.searchsorted(one, every), len(one) - 1)
            both = np.add.reduceat((one[at] == every).astype(np.int64), np.cumsum(sizes[part]) - sizes[part])
            out[part] = both * similar[1] >= (len(one) + sizes[part] - both) * similar[0]
        return out


def _join_similar(forest: Forest, u: np.ndarray, v: np.ndarray, similar: tuple[int, int], sets: Sets) -> None:
    """Joins the pairs whose similarity is that or more; pairs that are joined already aren't compared. u comes in runs."""
    for row in np.split(np.arange(len(u)), np.flatnonzero(np.diff(u)) + 1):
        row = row[forest.roots(u[row]) != forest.roots(v[row])]
        if len(row):
            row = row[sets.similar(int(u[row[0]]), v[row], similar)]
            forest.join(u[row], v[row])


def tile_links(a: np.ndarray, b: np.ndarray, radius: int, same: bool, similar: tuple[int, int] | None = None, sets: Sets | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links between rows of a and b (64-bit words in columns) at radius or fewer differing bits.

    Places of b follow those of a; with same, b is a. With similar, rows are signatures, and a pair also needs sizes of
    sets that allow this Jaccard similarity; with sets, of all places, it needs the similarity itself.
    """
    sizes, both = None, a if same else np.concatenate([a, b])
    if similar:
        sizes, both = both[:, -1].astype(np.int64), both[:, :-2]
    forest, words = Forest(len(both)), both.shape[1]
    dense = words if radius > 24 * -(-words // 2) else -(-words // 2)  # most pairs are within a large radius in half of the words
    left, right = np.arange(len(a)), np.arange(len(b)) + (0 if same else len(a))
    parts = [(left, right, same)]
    if similar and not sets:
        main = _joined_by_leaders(forest, both, sizes, radius, similar)
        parts = [(left[~main[left]], right, False), *([] if same else [(left[main[left]], right[~main[right]], False)])] if 2 * main.sum() > len(main) else parts
    for ia, ib, one in parts:
        oa, ca = (ia[np.argsort(sizes[ia], kind="stable")], None) if similar else _ordered(both, ia)
        ob, cb = (oa, ca) if one else (ib[np.argsort(sizes[ib], kind="stable")], None) if similar else _ordered(both, ib)
        sa, sb = np.asfortranarray(both[oa]), np.asfortranarray(both[ob])
        for i in range(0, len(sa), BLOCK_A):
            first, end = 0, len(sb)
            if similar:  # both are in order of size
                first = int(np.searchsorted(sizes[ob], -(-int(sizes[oa[i]]) * similar[0] // similar[1])))
                end = int(np.searchsorted(sizes[ob], int(sizes[oa[min(i + BLOCK_A, len(oa)) - 1]]) * similar[1] // similar[0], "right"))
            for j in range(max(first, i) if one else first, end, BLOCK_B):
                stop = min(j + BLOCK_B, end)
                if not similar and _apart(ca[:, i : i + BLOCK_A], cb[:, j:stop], radius):
                    continue
                # Half of the words are compared for all pairs; those that are within the radius there, few of them, in full.
                d = np.bitwise_count(sa[i : i + BLOCK_A, None, 0] ^ sb[None, j:stop, 0])
                d = d if dense < 4 else d.astype(np.uint16)  # four words or more can differ by over 255 bits
                for k in range(1, dense):
                    d = d + np.bitwise_count(sa[i : i + BLOCK_A, None, k] ^ sb[None, j:stop, k])
                x, y = np.nonzero(d <= radius)
                if dense < words and len(x):
                    total = d[x, y].astype(np.int32)
                    for k in range(dense, words):
                        total += np.bitwise_count(sa[i + x, k] ^ sb[j + y, k])
                    x, y = x[total <= radius], y[total <= radius]
                u, v = oa[i + x], ob[j + y]
                if similar and len(u):
                    fits = (u != v) & _fit(sizes[u], sizes[v], similar)
                    u, v = u[fits], v[fits]
                if len(u) and sets:
                    _join_similar(forest, u, v, similar, sets)
                elif len(u):
                    forest.join(u, v)
    return forest.links()


def _compare(files: list[tuple[str, int, int]], radius: int, width: int, similar: tuple[int, int] | None, with_sets: bool):
    def tile(number: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        found = read_range(files, "tile", number, number)
        values, sizes = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        if found is None:
            return np.zeros((0, width), np.uint64), values, sizes
        if with_sets:
            column = found.column("hashes").combine_chunks()
            values, sizes = _unsigned(column), column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        return _unsigned(found.column("fp").combine_chunks()).reshape(-1, width), values, sizes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, a = None, None
        for batch in batches:
            for left, right in zip(batch.column("tile").to_pylist(), batch.column("other").to_pylist(), strict=True):
                if left != held:  # pairs of one tile follow one another
                    held, a = left, tile(left)
                b = a if left == right else tile(right)
                if not len(a[0]) or not len(b[0]):
                    continue
                both, values, sizes = a if left == right else (np.concatenate(x) for x in zip(a, b, strict=True))
                sets = Sets(values, np.concatenate([[0], np.cumsum(sizes)])) if with_sets else None
                found = np.array(tile_links(a[0], b[0], radius, left == right, similar, sets), np.int64).reshape(-1, 2)
                u, v = (pa.array(list(both.view(np.int64)[found[:, k]]), pa.list_(pa.int64())) for k in (0, 1))
                yield pa.record_batch([u, v], ["u", "v"])

    return run


def _unsigned(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def tiles_of(counts: list[tuple[int, int]], tile: int) -> list[tuple[int, int, int, int]]:
    """(least count, largest count, first tile, tiles): runs of population counts that fill about a tile or are split to several."""
    runs: list[list[int]] = []
    for count, rows in sorted(counts):
        if runs and runs[-1][2] + rows <= tile:
            runs[-1][1], runs[-1][2] = count, runs[-1][2] + rows
        else:
            runs.append([count, count, rows])
    out, first = [], 0
    for low, high, rows in runs:
        out.append((low, high, first, -(-rows // tile)))
        first += out[-1][3]
    return out


def _compared(placed: DataFrame, spans: list[tuple[int, int, int]], radius: int, width: int, similar: tuple[int, int] | None, with_sets: bool = False) -> DataFrame:
    """(u, v) of tile pairs: for each span (first, n, last) each of n tiles from first on, with itself and those up to last."""
    spark = placed.sparkSession
    # Tiles are written once and read by the tasks that compare them: what is shuffled is the numbers of pairs of tiles.
    files = ranges(placed, "tile")
    total = sum(n * (last - first + 1) for first, n, last in spans)
    tasks = min(max(total, 1), 8 * spark.sparkContext.defaultParallelism + total // 8)
    pairs = few_rows(spark, spans, "first int, n int, last int")
    pairs = pairs.select(F.explode(F.sequence("first", F.col("first") + F.col("n") - 1)).alias("tile"), "last")
    # Each tile is a row by now: many tasks make its pairs.
    pairs = pairs.repartition("tile").select("tile", F.explode(F.sequence("tile", "last")).alias("other"))
    dealt = pairs.repartition(tasks, "tile", "other").sortWithinPartitions("tile", "other")
    return dealt.mapInArrow(released(_compare(files, radius, width, similar, with_sets)), "u array<long>, v array<long>")


def links(nodes: DataFrame, radius: int = RADIUS, words64: int = 1, tile: int = TILE) -> DataFrame:
    """(u, v): links that join the same components as all links of the distinct fingerprints in nodes.fp do."""
    spark = nodes.sparkSession
    counted = nodes.select("fp", F.aggregate(F.slice("fp", 1, words64), F.lit(0), lambda s, x: s + F.bit_count(x)).alias("ones"))
    # One row for each population count there is: 64 * words64 + 1 at most.
    runs = tiles_of([(r[0], r[1]) for r in counted.groupBy("ones").count().collect()], tile)
    last = {first: max(f + m - 1 for low, _, f, m in runs if low <= high + radius) for _, high, first, _ in runs}
    plan = [(p, first, n) for low, high, first, n in runs for p in range(low, high + 1)]
    placed = counted.join(F.broadcast(few_rows(spark, plan, "ones int, first int, n int")), "ones")
    placed = placed.select((F.col("first") + F.pmod(F.xxhash64("fp"), F.col("n")).cast("int")).alias("tile"), "fp")
    return _compared(placed, [(first, n, last[first]) for _, _, first, n in runs], radius, words64, None)


def _whole(batches: Iterator[pa.RecordBatch]) -> pa.Table | None:
    found = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(found).combine_chunks() if found else None


def _blocks(tile: int) -> Callable:
    """For mapInArrow: (key, digest), all rows of a key together, as (block, digest, many): sets that share a key with another.

    Keys with the same sets are one block; it is `many` if it has over a tile of sets. A sum of the digests' hashes names a
    block; should two have one name, they are compared as one, and no link is lost.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = _whole(batches)
        if whole is None:
            return
        key, digest = (whole.column(c).to_numpy().view(np.uint64) for c in ("key", "digest"))
        del whole
        order = np.lexsort((digest, key))
        key, digest = key[order], digest[order]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        kept = new | np.concatenate([[True], digest[1:] != digest[:-1]])
        digest, starts = digest[kept], np.flatnonzero(new[kept])
        sizes = np.diff(np.append(starts, len(digest)))
        shared = sizes > 1
        if not shared.any():
            return
        digest, sizes = digest[np.repeat(shared, sizes)], sizes[shared]
        block = np.repeat(np.add.reduceat(_mixed(digest, 1), np.cumsum(sizes) - sizes), sizes)
        many = np.repeat(sizes > tile, sizes)
        order = np.lexsort((digest, block))
        block, digest, many = block[order], digest[order], many[order]
        kept = np.concatenate([[True], (block[1:] != block[:-1]) | (digest[1:] != digest[:-1]) | (many[1:] != many[:-1])])
        out = pa.table([block[kept].view(np.int64), digest[kept].view(np.int64), many[kept]], ["block", "digest", "many"])
        yield from out.to_batches(max_chunksize=10_000)

    return run


def _compare_blocks(radius: int, width: int, similar: tuple[int, int]) -> Callable:
    """For mapInArrow: (block, fp), all rows of a block together, as (u, v), the links within blocks as a spanning forest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = _whole(batches)
        if whole is None:
            return
        block, rows = whole.column("block").to_numpy(), _unsigned(whole.column("fp").combine_chunks()).reshape(-1, width)
        _, first, place = np.unique(np.ascontiguousarray(rows).view(f"V{8 * width}").ravel(), return_index=True, return_inverse=True)
        fp, order = rows[first], np.lexsort((place, block))
        block, place = block[order], place[order]
        kept = np.concatenate([[True], (block[1:] != block[:-1]) | (place[1:] != place[:-1])])  # of blocks that several tasks found
        block, place = block[kept], place[kept]
        starts = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
        counts = np.diff(np.append(starts, len(block)))
        forest, sizes = Forest(len(fp)), fp[:, -1].astype(np.int64)
        for n in range(2, SMALL + 1):
            of, (x, y) = starts[counts == n], np.triu_indices(n, 1)
            for some in (of[k : k + VOTES // len(x) + 1] for k in range(0, len(of), VOTES // len(x) + 1)):
                u, v = (place[(some[:, None] + z).ravel()] for z in (x, y))
                fits = _fit(sizes[u], sizes[v], similar)
                u, v = u[fits], v[fits]
                near = np.bitwise_count(fp[u, :-2] ^ fp[v, :-2]).sum(1, dtype=np.int32) <= radius
                forest.join(u[near], v[near])
        for start, n in zip(starts[counts > SMALL].tolist(), counts[counts > SMALL].tolist(), strict=True):
            of = place[start : start + n]
            found = np.array(tile_links(fp[of], fp[of], radius, True, similar), np.int64).reshape(-1, 2)
            forest.join(of[found[:, 0]], of[found[:, 1]])
        found = np.array(forest.links(), np.int64).reshape(-1, 2)
        for part in (found[k : k + 10_000] for k in range(0, len(found), 10_000)):
            u, v = (pa.array(list(fp.view(np.int64)[part[:, k]]), pa.list_(pa.int64())) for k in (0, 1))
            yield pa.record_batch([u, v], ["u", "v"])

    return run


def links_in_blocks(nodes: DataFrame, keyed: DataFrame, radius: int, words64: int, tile: int, similar: tuple[int, int]) -> DataFrame:
    """(u, v): links that join the same components as all pairs of nodes.fp within the radius, of fitting sizes, that share a key do.

    keyed: fp and keys, for each fp of nodes at least once. Fingerprints are signatures.
    """
    spark, width = nodes.sparkSession, words64 + 2
    digest = F.element_at("fp", words64 + 1).alias("digest")
    # At most, about: a set's keys are what a similar one may lack, and one.
    keys = keyed.agg(F.coalesce(F.sum(F.element_at("fp", -1)), F.lit(0)) * (similar[1] - similar[0]) / similar[1] + 2 * F.count("*")).first()[0]
    pairs = keyed.select(digest, F.explode("keys").alias("key")).repartition(1 + int(keys) // TASK_KEYS, "key")
    blocks = saved(pairs.mapInArrow(released(_blocks(tile)), "block long, digest long, many boolean"), "blocks")
    large = [tuple(r) for r in blocks.filter("many").groupBy("block").agg(F.count_distinct("digest")).collect()]  # over a tile each
    members = blocks.join(nodes.select("fp", digest), "digest")
    tasks = max(2 * spark.sparkContext.defaultParallelism, 1 + blocks.count() // TASK_ROWS)
    few = members.filter("not many").select("block", "fp").repartition(tasks, "block")
    found = few.mapInArrow(released(_compare_blocks(radius, width, similar)), "u array<long>, v array<long>")
    if not large:
        return found
    tiles = [-(-n // tile) for _, n in large]
    firsts = (np.cumsum(tiles) - tiles).tolist()
    plan = few_rows(spark, [(block, first, n) for (block, _), first, n in zip(large, firsts, tiles, strict=True)], "block long, first int, n int")
    placed = members.filter("many").join(F.broadcast(plan), "block")
    placed = placed.select((F.col("first") + F.pmod(F.xxhash64("fp"), F.col("n")).cast("int")).alias("tile"), "fp").distinct()
    return found.unionByName(_compared(placed, [(first, n, first + n - 1) for first, n in zip(firsts, tiles, strict=True)], radius, width, similar))


def similar_links(nodes: DataFrame, keyed: DataFrame, texts: DataFrame, shingle: int, radius: int, words64: int, seed: int, tile: int, similar: tuple[int, int], set_tile: int = SET_TILE) -> DataFrame:
    """(u, v): links that join the same components as all pairs of signatures within the radius whose sets are similar.

    nodes: fp and row, of one text with that set; keyed: fp and keys; texts: row and text. Pairs within the radius that share
    a key are first joined to groups, unchecked; only texts of a group have their sets written, and only tiles of one group are compared.
    """
    spark = nodes.sparkSession
    near = components(links_in_blocks(nodes.select("fp"), keyed, radius, words64, tile, similar))
    near = near.select(F.col("u").alias("fp"), "root").unionByName(near.select(F.col("root").alias("fp"), "root").distinct())
    near = saved(nodes.join(near, "fp"), "near")
    # Tiles are bounded by the sizes of their sets, which signatures end with.
    sizes = near.groupBy("root").agg(F.sum(F.element_at("fp", -1)).alias("hashes"), F.count("*").alias("sets"))
    # Groups of over a tile: as many rows as there are tiles at most.
    large = [(r["root"], min(r["sets"], -(-r["hashes"] // set_tile))) for r in sizes.filter(F.col("hashes") > set_tile).collect()]
    rest = sizes.filter(F.col("hashes") <= set_tile).agg(F.coalesce(F.sum("hashes"), F.lit(0))).first()[0]
    bins = max(1, -(-rest // set_tile))
    firsts = bins + np.cumsum([0, *(n for _, n in large)])
    plan = few_rows(spark, [(root, int(first), n) for (root, n), first in zip(large, firsts[:-1], strict=True)], "root array<long>, first int, n int")
    own = F.col("first") + F.pmod(F.xxhash64("fp"), F.col("n")).cast("int")
    placed = near.join(F.broadcast(plan), "root", "left").select("row", F.struct(F.coalesce(own, F.pmod(F.xxhash64("root"), F.lit(bins)).cast("int")).alias("tile"), "fp").alias("place"))
    # A text's place is looked up where its set is made: one Python worker a task, and no text is moved.
    files, kind = written(placed, "row", "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there = Found(files, kind)
        for batch in slices(batches):
            places = there.take(batch.column("row"))
            batch, places = batch.filter(places.is_valid()), places.drop_null()
            found = [distinct(list(shingles(x, shingle, seed))).view(np.int64) for x in batch.column("text").to_pylist()]
            yield pa.record_batch([places.field("tile"), places.field("fp"), pa.array(found, pa.list_(pa.int64()))], ["tile", "fp", "hashes"])

    sets = texts.mapInArrow(released(run), "tile int, fp array<long>, hashes array<long>")
    spans = [(b, 1, b) for b in range(bins)] + [(int(first), n, int(first) + n - 1) for (_, n), first in zip(large, firsts[:-1], strict=True)]
    return _compared(saved(sets, "sets"), spans, radius, words64 + 2, similar, True)


def _least_of_component(prints: DataFrame, least: Column, linked: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(fp, least): the least value of a column over the whole component of each distinct fingerprint; linked gives the links of fp and least."""
    nodes = saved(prints.groupBy("fp").agg(F.min(least).alias("least")), "nodes")
    found = components(linked(nodes)).withColumnRenamed("u", "fp")
    rooted = nodes.join(found, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    of_root = rooted.groupBy("root").agg(F.min("least").alias("of_root"))
    return rooted.join(of_root, "root").select("fp", F.col("of_root").alias("least"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, words64: int = 1, seed: int = SEED, tile: int = TILE) -> DataFrame:
    """For each row of docs: doc_id, fp (64-bit words) and component_id, the smallest doc_id that links lead to.

    A null, empty or blank text has the fingerprint zero and is linked like any other; a text of fewer words than a
    shingle has its whole sequence as the one shingle. Rows with a null doc_id are linked too; a component of such
    rows alone has a null component_id. Repeated rows each give a row. An empty table gives no rows.
    """
    prints = saved(fingerprints(text_of(docs), shingle, words64, seed), "fingerprints")
    least = _least_of_component(prints, F.col("doc_id"), lambda nodes: links(nodes.select("fp"), radius, words64, tile))
    return prints.join(least, "fp").select("doc_id", "fp", F.col("least").alias("component_id"))


def one_of_each(
    docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, words64: int = 1, seed: int = SEED, tile: int = TILE, similar: tuple[int, int] = SIMILAR, set_tile: int = SET_TILE
) -> DataFrame:
    """docs with one row of each component: the one of the smallest (doc_id, row number); a null doc_id comes last.

    Texts are linked if their fingerprints differ by radius or fewer bits and their sets of shingles have a Jaccard
    similarity of `similar` or more. All texts without a word have the one empty set. Of equal rows one stays. Columns stay
    as they are, and texts aren't shuffled, but sets of shingles of texts that have another within the radius are.
    An empty table gives no rows.
    """
    row, stays = fresh("row"), fresh("stays")
    rows = numbered(docs, row)
    texts = rows.select(F.col(row).alias("row"), F.col("text").cast("string").alias("text"))
    known = rows.select(F.col(row).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # Keys take a part of the texts' size: they go when the links are found, so that later stages have that disk.
    path = shared_path(docs.sparkSession, "keyed")
    keyed = saved(signatures(known, shingle, words64, seed, similar), "keyed", path)
    prints = saved(keyed.drop("keys"), "fingerprints")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    least = _least_of_component(prints, order, lambda nodes: similar_links(nodes.select("fp", "least.row"), keyed.select("fp", "keys"), texts, shingle, radius, words64, seed, tile, similar, set_tile))
    removed(docs.sparkSession, path)  # components are written by now
    kept = least.select(F.col("least")["row"].alias(row)).distinct()
    marked = looked_up(rows, row, kept.withColumn(stays, F.lit(True)), stays)
    return marked.filter(F.col(stays).isNotNull()).select(*columns_of(docs))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex(F.col("fp")[0])), 16, "0").alias("fingerprint"), "component_id")
