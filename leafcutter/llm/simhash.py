"""SimHash near-duplicates by the generalised pigeonhole principle.

A fingerprint's bits are grouped into partitions, correlated bits together; partition i gets a
threshold t_i (-1: not used) such that the sum of t_i + 1 is the allowed distance plus 1. Two
fingerprints within the distance then differ in at most t_i bits of some partition i. The
number of partitions and their thresholds come from a dynamic programme over costs
estimated on a bounded sample: rows to shuffle, and pairs that will meet. The choice only
shifts cost; every choice finds all pairs.

Probing is a self-join on keys: for a threshold t, a row stands under each key that leaves out
t of the partition's bits. Inside a key, all distances are taken with array operations, and only a
star for each connected set leaves the task, never its pairs. Equal fingerprints are
collapsed first. A key that holds over ``HOT`` fingerprints is dealt out again by blocks of the
other bits, on which a pair within the distance has to agree somewhere too.

Defined cases: null and wordless texts have fingerprint zero and are linked like any other;
a text of fewer words than a shingle is one shingle; a null ``doc_id`` takes part, and a
component's id is its smallest non-null ``doc_id``; repeated rows appear each; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from itertools import accumulate, combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import give_back_memory, slices
from .common import bit_majority, connected_components, cut, fresh_names, group_starts, local_roots, nearest_forest, runs_of, table, tile_groups, verify_groups

SEED = 42
#: Fingerprints in the sample on which costs are estimated.
SAMPLE = 4096
#: Cost of one shuffled row, in compared pairs.
ROW_COST = 500
#: Fingerprints under one key from which it is dealt out again; groups up to SMALL go side by side.
HOT, SMALL = 20_000, 64
#: Rows that are dealt at once at least, and at most; beyond the latter, those of a share are looked over for hot keys.
PACK, MOST = 200_000, 2_000_000
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def shingle_hashes(text: str | None, k: int) -> list[int]:
    """XXH64 of each run of ``k`` words, A-Z in lower case; one run if there are fewer words."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return []
    buf, h = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= k:
        return [h(buf, SEED)]
    ends = list(accumulate([len(w) + 1 for w in words]))
    return [h(buf[s : e - 1], SEED) for s, e in zip([0, *ends], ends[k - 1 :], strict=False)]


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3, with_size: bool = False) -> DataFrame:
    """``(key, fp)``, fp: the 64 bits as a signed long. ``with_size`` adds ``n``, the number of
    different shingles, and ``node``, a hash of the raw text as in ``text_node``."""
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"), *([text_node(F.col(text)).alias("_node")] if with_size else []))

    def work(batches):
        for b in slices(batches, "_text", 1_000_000):
            texts = b.column("_text").to_pylist()
            hashes = [shingle_hashes(t, words) for t in texts]
            flat = np.array([x for h in hashes for x in h], dtype=np.uint64)
            fp = bit_majority(flat, np.array([len(h) for h in hashes], dtype=np.int64))
            cols = {key: b.column("_key"), "fp": pa.array(fp.view(np.int64))}
            if with_size:
                cols |= {"n": pa.array([len(set(h)) for h in hashes], pa.int64()), "node": b.column("_node")}
            yield pa.RecordBatch.from_arrays([*cols.values()], names=[*cols])
        give_back_memory()

    return rows.mapInArrow(work, f"`{key}` {kind}, fp long" + ", n long, node long" * with_size)


def text_node(text):
    return F.xxhash64(F.coalesce(text, F.lit("")))


# ----------------------------------------------------------------- partitions


def bits_of(fps: np.ndarray) -> np.ndarray:
    return ((fps[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)


def group_bits(bits: np.ndarray, m: int) -> list[list[int]]:
    """64 bit places in ``m`` groups of nearly equal size, the most correlated together."""
    x = bits.astype(np.float64) - bits.mean(axis=0)
    norm = np.sqrt((x * x).sum(axis=0))
    norm[norm == 0] = 1
    c = np.abs((x / norm).T @ (x / norm))
    np.fill_diagonal(c, 0)
    free, groups = list(range(64)), []
    for i in range(m):
        size = 64 // m + (i < 64 % m)
        first = max(free, key=lambda p: (c[p, free].sum(), -p))
        group = [first]
        free.remove(first)
        while len(group) < size:
            p = max(free, key=lambda q: (c[q, group].mean(), -q))
            group.append(p)
            free.remove(p)
        groups.append(sorted(group))
    return groups


def plan_partitions(sample: np.ndarray, total: int, tau: int) -> list[tuple[list[int], int]]:
    """Bit groups and thresholds for pairs of ``total`` fingerprints within ``tau`` bits."""
    sample = np.unique(sample)
    if len(sample) < 2:
        even = [[*range(64 * i // (tau + 1), 64 * (i + 1) // (tau + 1))] for i in range(tau + 1)]
        return [(g, 0) for g in even]
    bits = bits_of(sample)
    rng = np.random.default_rng(7)
    a, b = rng.integers(0, len(sample), (2, 100_000))
    a, b = a[a != b], b[a != b]
    differ = bits[a] ^ bits[b]
    best = None
    for m in range(2, tau + 2):
        groups = group_bits(bits, m)
        costs: list[list[float]] = []
        for g in groups:
            w = len(g)
            seen = np.bincount(differ[:, g].sum(axis=1), minlength=w + 1) + 50 * np.array([comb(w, d) / 2.0**w for d in range(w + 1)])
            seen = seen / seen.sum()
            costs.append([0.0])
            for t in range(3):
                if t > w:
                    break
                pairs = total * (total - 1) / 2 * sum(seen[d] * comb(w - d, t - d) for d in range(t + 1))
                costs[-1].append(ROW_COST * total * comb(w, t) + pairs)
        # least cost for partitions so far, by the sum of t + 1
        reach: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for c in costs:
            new: dict[int, tuple[float, list[int]]] = {}
            for k, (cost, ts) in reach.items():
                for step, more in enumerate(c):
                    s = min(k + step, tau + 1)
                    if s not in new or cost + more < new[s][0]:
                        new[s] = (cost + more, [*ts, step - 1])
            reach = new
        if tau + 1 in reach and (best is None or reach[tau + 1][0] < best[0]):
            best = (reach[tau + 1][0], [(g, t) for g, t in zip(groups, reach[tau + 1][1], strict=True) if t >= 0])
    return best[1]


def gather(fps: np.ndarray, places: list[int]) -> np.ndarray:
    out = np.zeros(len(fps), dtype=np.uint64)
    for j, p in enumerate(places):
        out |= ((fps >> np.uint64(p)) & np.uint64(1)) << np.uint64(j)
    return out


def mixed(*parts: np.ndarray | int) -> np.ndarray:
    """One 64-bit key of several numbers. Keys that happen to be equal only cost comparisons."""
    h = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        for p in parts:
            h = (h ^ np.asarray(p, dtype=np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
            h ^= h >> np.uint64(29)
    return h


def block_keys(rows: DataFrame, plan: list[tuple[list[int], int]], banded: bool) -> DataFrame:
    """``(bucket, part, node, fp)``: each row under each of its keys."""

    def work(batches):
        for b in batches:
            fp = b.column("fp").to_numpy().view(np.uint64)
            bands = (b.column("band").to_numpy().astype(np.uint64),) if banded else ()
            for shift in (0, 1) if banded else (0,):
                for i, (places, t) in enumerate(plan):
                    key = gather(fp, places)
                    for k, left_out in enumerate(combinations(range(len(places)), t)):
                        kept = key & ~np.uint64(sum(1 << j for j in left_out))
                        bucket = mixed(*(x + np.uint64(shift) for x in bands), i, k, kept)
                        yield pa.RecordBatch.from_arrays([pa.array(bucket.view(np.int64)), pa.array(np.full(len(fp), i, dtype=np.int32)), b.column("node"), b.column("fp")], names=["bucket", "part", "node", "fp"])

    return rows.mapInArrow(work, "bucket long, part int, node long, fp long")


def dealt_again(keyed: DataFrame, plan: list[tuple[list[int], int]], tau: int, level: int) -> DataFrame:
    """Rows of hot buckets under finer ones: blocks of the bits that their key does not fix."""
    rest = [[p for p in range(64) if p not in set(places)] for places, _ in plan]
    rest = [r[level * 5 :] + r[: level * 5] for r in rest]
    fine = [[r[len(r) * j // (tau + 1) : len(r) * (j + 1) // (tau + 1)] for j in range(tau + 1)] for r in rest]

    def work(batches):
        for b in batches:
            fp = b.column("fp").to_numpy().view(np.uint64)
            old, part = b.column("bucket").to_numpy().view(np.uint64), b.column("part").to_numpy()
            for i in np.unique(part):
                at = np.flatnonzero(part == i)
                for j, places in enumerate(fine[i]):
                    bucket = mixed(old[at], 1000 + level, j, gather(fp[at], places))
                    yield pa.RecordBatch.from_arrays([pa.array(bucket.view(np.int64)), pa.array(part[at]), b.column("node").take(pa.array(at)), pa.array(fp[at].view(np.int64))], names=["bucket", "part", "node", "fp"])

    return keyed.mapInArrow(work, "bucket long, part int, node long, fp long")


def bucket_links(starts: np.ndarray, node: np.ndarray, fp: np.ndarray, tau: int, nearest: bool) -> pa.RecordBatch | None:
    """The links of ``links_in_buckets`` for whole buckets, one after the other."""
    n = len(fp)
    sizes = np.diff([*starts.tolist(), n])
    if sizes.max(initial=0) < 2:
        return None
    a, b = [], []
    end = np.repeat(starts + np.where(sizes <= SMALL, sizes, 0), sizes)
    i = np.arange(n)
    for d in range(1, SMALL):
        i = i[i + d < end[i]]
        if not len(i):
            break
        near = i[np.bitwise_count(fp[i] ^ fp[i + d]) <= tau]
        a.append(near)
        b.append(near + d)
    for s, size in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist(), strict=True):
        mine, step = fp[s : s + size], max(1, 2_000_000 // size)
        forest = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        for r in range(0, size, step):
            x, y = np.nonzero(np.bitwise_count(mine[r : r + step, None] ^ mine[None, r:]) <= tau)
            ok = x < y
            x, y = x[ok], y[ok]
            if len(x) and nearest:  # the forest so far with the new links
                x, y = np.concatenate([forest[0], x + r]), np.concatenate([forest[1], y + r])
                at = nearest_forest(size, x, y, np.bitwise_count(mine[x] ^ mine[y]))
                forest = x[at], y[at]
            elif len(x):
                root = local_roots(size - r, x, y)
                at = np.flatnonzero(root != np.arange(size - r))
                a.append(at + (s + r))
                b.append(root[at] + (s + r))
        a.append(forest[0] + s)
        b.append(forest[1] + s)
    a, b = np.concatenate(a or [i[:0]]), np.concatenate(b or [i[:0]])
    if nearest:
        at = nearest_forest(n, a, b, np.bitwise_count(fp[a] ^ fp[b]))
        a, b = node[a[at]], node[b[at]]
    else:
        root = local_roots(n, a, b)
        at = np.flatnonzero(root != np.arange(n))
        a, b = node[at], node[root[at]]
    ok = a != b
    return pa.RecordBatch.from_arrays([pa.array(a[ok]), pa.array(b[ok])], ["a", "b"])


def links_in_buckets(keyed: DataFrame, tau: int, limit: int | None = None, nearest: bool = False) -> DataFrame:
    """Stars ``(a, b)`` over nodes of a bucket that are connected by links within ``tau`` bits.
    A bucket of over ``limit`` rows is only named: ``(bucket, null)``. ``nearest``: in place of stars, the links of a
    forest of least distance, so each is a pair within ``tau`` bits."""

    def walk(batches):
        over: list[tuple[int]] = []
        for t in runs_of(batches, ["bucket"], limit, over):
            out = bucket_links(group_starts(t, ["bucket"]), t.column("node").to_numpy(), t.column("fp").to_numpy().view(np.uint64), tau, nearest)
            if out is not None and out.num_rows:
                yield out
        if over:
            yield named_only([k for (k,) in over])
        give_back_memory()

    return keyed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(walk, "a long, b long")


def named_only(buckets: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(buckets, pa.int64()), pa.nulls(len(buckets), pa.int64())], ["a", "b"])


def packed(buckets, share: int):
    """``(share, rows)``: batches of rows (bucket, node, fp and, where wanted, digits; long) dealt into so many shares by their
    bucket, the rows of a share as bytes, so that few large rows are shuffled in place of many small ones."""
    held, most = [], min(max(PACK, 64 * share), MOST)

    def pack():
        rows = np.concatenate(held)
        to = (mixed(rows[:, 0].view(np.uint64)) % np.uint64(share)).astype(np.int32)
        order = np.argsort(to, kind="stable")
        rows, to = rows[order], to[order]
        first = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
        edges = (np.append(first, len(rows)) * rows.itemsize * rows.shape[1]).astype(np.int32)
        blobs = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(edges), pa.py_buffer(rows)])
        return pa.RecordBatch.from_arrays([pa.array(to[first]), blobs], ["share", "rows"])

    for rows in buckets:
        held.append(rows)
        if sum(map(len, held)) >= most:
            yield pack()
            held.clear()
    if held:
        yield pack()


def equal_digits(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """In how many of their ``n`` digits of three bits numbers agree."""
    x = a ^ b
    return n - np.bitwise_count((x | x >> 1 | x >> 2) & sum(1 << 3 * k for k in range(n)))


def links_in_packed(dealt: DataFrame, tau: int, limit: int, least: tuple[int, int] | None = None) -> DataFrame:
    """``links_in_buckets``, with ``nearest``, of rows that ``packed`` dealt; the order in which they arrive changes nothing.
    ``least`` (digits, least number): of the forest, links between rows with so many equal digits go on."""

    def of_share(rows: np.ndarray, over: set) -> pa.RecordBatch | None:
        rows = rows[np.argsort(rows[:, 0], kind="stable")]
        starts = np.flatnonzero(np.concatenate([[True], rows[1:, 0] != rows[:-1, 0]]))
        sizes = np.diff(np.append(starts, len(rows)))
        hot = sizes > limit
        if over:
            hot |= np.isin(rows[starts, 0], [*over])
        over.update(rows[starts[hot], 0].tolist())
        live = (sizes > 1) & ~hot
        rows, sizes = rows[np.repeat(live, sizes)], sizes[live]
        if not len(rows):
            return None
        rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
        out = bucket_links(np.cumsum(sizes) - sizes, np.arange(len(rows)), rows[:, 2].copy().view(np.uint64), tau, True)
        a, b = (c.to_numpy() for c in out.columns)
        if least:
            ok = equal_digits(rows[a, 3], rows[b, 3], least[0]) >= least[1]
            a, b = a[ok], b[ok]
        return pa.RecordBatch.from_arrays([pa.array(rows[a, 1]), pa.array(rows[b, 1])], ["a", "b"])

    def without_hot(rows: np.ndarray, over: set) -> np.ndarray:
        """Rows of buckets of up to ``limit`` rows; the others are added to ``over``, and all their later rows dropped."""
        bucket, which, times = np.unique(rows[:, 0], return_inverse=True, return_counts=True)
        hot = (times > limit) | np.isin(bucket, [*over])
        over.update(bucket[hot].tolist())
        return rows[~hot[which.reshape(-1)]] if hot.any() else rows

    def walk(batches):
        share, held, over, most = None, [], set(), MOST

        def done():
            out = of_share(np.concatenate(held), over) if held else None
            if out is not None and out.num_rows:
                yield out
            if over:
                yield named_only(sorted(over))

        for b in batches:
            for to, blob in zip(b.column("share").to_pylist(), b.column("rows"), strict=True):
                if to != share:
                    yield from done()
                    share, held, over, most = to, [], set(), MOST
                held.append(np.frombuffer(blob.as_buffer(), dtype=np.int64).reshape(-1, 4 if least else 3))
                if sum(map(len, held)) > most:
                    held = [without_hot(np.concatenate(held), over)]
                    most = max(MOST, 2 * len(held[0]))
        yield from done()
        give_back_memory()

    return dealt.repartition("share").sortWithinPartitions("share").mapInArrow(walk, "a long, b long")


def link_fingerprints(rows: DataFrame, tau: int, banded: bool = False) -> DataFrame:
    """Stars ``(a, b)`` that connect all nodes of ``rows`` (node, fp[, band]) within ``tau`` bits.

    With ``band``, a pair counts only if its bands are equal or neighbours.
    """
    total = rows.count()
    sample = [r.fp for r in rows.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).select("fp").collect()]
    plan = plan_partitions(np.array(sample, dtype=np.int64).view(np.uint64), total if not banded else max(2, total // 8), tau)
    return link_keyed(block_keys(rows, plan, banded), plan, tau)


def link_keyed(keyed: DataFrame, plan: list[tuple[list[int], int]], tau: int, nearest: bool = False, dealt: DataFrame | None = None, least: tuple[int, int] | None = None) -> DataFrame:
    """Stars over the pairs within ``tau`` bits of ``(bucket, part, node, fp)`` (``nearest``: as in
    ``links_in_buckets``); hot buckets are dealt again. ``dealt``: the same rows by ``packed``, with ``nearest``, and
    ``least`` as in ``links_in_packed``."""
    out = None
    for level in range(3):
        if dealt is not None and level == 0:
            found = cut(links_in_packed(dealt, tau, HOT, least))
        else:
            found = cut(links_in_buckets(keyed, tau, HOT if level < 2 else None, nearest))
        links = found.where(F.col("b").isNotNull())
        out = links if out is None else out.union(links)
        hot = found.where(F.col("b").isNull()).select(F.col("a").alias("bucket"))
        if hot.isEmpty():
            break
        keyed = dealt_again(keyed.join(hot, "bucket", "left_semi"), plan, tau, level)
    return out


# -------------------------------------------------------------------- results


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3, tau: int = 3) -> DataFrame:
    """``(key, fingerprint, component_id)`` for each row: components of fingerprints that
    differ in at most ``tau`` bits."""
    rows = cut(fingerprints(docs, key, text, words))
    classes = cut(rows.groupBy("fp").agg(F.min(key).alias("_first")))
    links = link_fingerprints(classes.select(F.col("fp").alias("node"), "fp"), tau)
    roots = cut(connected_components(links).select(F.col("node").alias("fp"), "root"))
    linked = classes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    firsts = linked.groupBy("root").agg(F.min("_first").alias("component_id"))
    named = linked.join(firsts, "root").select("fp", "component_id")
    return rows.join(named, "fp", "left").select(key, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Bits in which fingerprints may differ to make a candidate pair, where texts are compared after it.
CANDIDATE_BITS = 10


#: Candidates by their shingle sets: keys of so many minima each. At a Jaccard similarity of s, a pair is
#: missed with probability (1 - s ** SET_ROWS) ** SET_KEYS, 0.08 % at 0.8, whatever kind of edit it is.
SET_KEYS, SET_ROWS = 10, 3


def set_keys(docs: DataFrame, text: str, words: int) -> DataFrame:
    """``(node, keys)``: ``SET_KEYS`` keys of each text, each of ``SET_ROWS`` minima over its set of shingles."""
    salt = np.random.default_rng(13).integers(1, 1 << 63, (SET_KEYS, SET_ROWS, 2), dtype=np.uint64) | np.uint64(1)

    def work(batches):
        for b in slices(batches, "_text", 1_000_000):
            hashes = [shingle_hashes(t, words) or [0] for t in b.column("_text").to_pylist()]
            flat = np.array([x for h in hashes for x in h], dtype=np.uint64)
            starts = np.cumsum([0, *map(len, hashes[:-1])]) if hashes else np.zeros(0, np.int64)
            keys = np.zeros((len(hashes), SET_KEYS), dtype=np.uint64)
            if len(hashes):
                for k in range(SET_KEYS):
                    with np.errstate(over="ignore"):
                        keys[:, k] = mixed(k, *[np.minimum.reduceat((flat ^ flip) * factor, starts) for flip, factor in salt[k]])
            ends = pa.array(np.arange(len(hashes) + 1, dtype=np.int32) * SET_KEYS)
            yield pa.RecordBatch.from_arrays([b.column("_node"), pa.ListArray.from_arrays(ends, pa.array(keys.reshape(-1).view(np.int64)))], names=["node", "keys"])
        give_back_memory()

    return docs.select(text_node(F.col(text)).alias("_node"), F.col(text).alias("_text")).mapInArrow(work, "node long, keys array<long>")


def set_links(keys: DataFrame) -> DataFrame:
    """Stars ``(a, b)`` over the texts that share a key."""
    keyed = keys.select("node", F.explode("keys").alias("bucket")).distinct()
    first = keyed.groupBy("bucket").agg(F.min("node").alias("b"), F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    return keyed.join(first, "bucket").where(F.col("node") != F.col("b")).select(F.col("node").alias("a"), "b").distinct()


def jaccard_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, similarity: float = 0.8, tau: int = CANDIDATE_BITS) -> DataFrame:
    """``(node, root)`` over different texts, linked where their sets of ``words``-word shingles
    have Jaccard similarity ``similarity`` or more. Candidates share a key of their sets, or
    have fingerprints of 3-word shingles that differ in at most ``tau`` bits. ``node``: ``text_node`` of the text."""
    rows = fingerprints(docs, key, text, 3, with_size=True)
    nodes = cut(rows.groupBy("node").agg(F.min("fp").alias("fp"), F.min("n").alias("n")))
    # sets of similarity s have sizes within a factor of s, so their bands are equal or
    # neighbours; a few units of slack, as 3-word sets are banded for 5-word sets
    step = float(np.log(1 / similarity) * 1.25)
    banded = nodes.withColumn("band", F.floor(F.log(F.col("n").cast("double") + 4.0) / F.lit(step)).cast("long")).select("node", "fp", "band")
    sets = cut(set_keys(docs, text, words))
    roots = cut(connected_components(link_fingerprints(banded, tau, banded=True).union(set_links(sets))))
    texts = semi_join_text(docs.select(text_node(F.col(text)).alias("node"), F.coalesce(F.col(text), F.lit("")).alias("_text")), roots.select("node"), "node").groupBy("node").agg(F.first("_text").alias("_text"))
    members = roots.join(texts, "node").join(nodes.select("node", "fp"), "node").select(F.col("root").alias("grp"), "node", "fp", "_text")

    def prepare(t: pa.Table):
        return [np.unique(np.array(shingle_hashes(x, words), dtype=np.uint64)) for x in t.column("_text").to_pylist()]

    def linked(x: np.ndarray, y: np.ndarray) -> bool:
        small, large = sorted((len(x), len(y)))
        if small < similarity * large:
            return False
        both = len(np.intersect1d(x, y, assume_unique=True))
        return both >= similarity * (small + large - both)

    return cut(connected_components(verify_groups(tile_groups(members, "grp", "node"), "grp", "node", "fp", 64, prepare, linked)))


#: Keys up to which a side is broadcast (16 bytes each: 32 MB at most).
BROADCAST_KEYS = 500_000


def semi_join_text(big: DataFrame, small: DataFrame, key: str) -> DataFrame:
    """Rows of ``big`` whose key is in ``small``. Few keys, by count, are broadcast, so texts
    are not shuffled; more are joined by shuffle."""
    small = cut(small.select(key).distinct())
    return big.join(F.broadcast(small) if small.count() <= BROADCAST_KEYS else small, key, "left_semi")


def keep_one_per_group(docs: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: the one with the smallest key
    (null last), and the first text in hash order among equal keys."""
    node, root, nth, wk, wt = fresh_names(docs.columns, "_node", "_root", "_nth", "_wk", "_wt")
    groups = jaccard_groups(docs, key, text, **how).select(F.col("node").alias(node), F.col("root").alias(root))
    small = docs.select(F.col(f"`{key}`"), text_node(F.col(f"`{text}`")).alias(node)).distinct()
    small = small.join(groups, node, "left").withColumn(root, F.coalesce(root, node))
    best = small.groupBy(root).agg(F.min(F.struct(F.col(key).isNull().alias("no"), F.col(key).alias("k"), F.col(node).alias("t"))).alias("w"))
    best = best.select(F.col("w.k").alias(wk), F.col("w.t").alias(wt))
    named = docs.withColumn(node, text_node(F.col(f"`{text}`")))
    kept = named.join(best, (F.col(node) == F.col(wt)) & F.col(f"`{key}`").eqNullSafe(F.col(wk)), "left_semi")
    kept = kept.withColumn(nth, F.row_number().over(Window.partitionBy(node, key).orderBy(F.lit(1))))
    return kept.where(F.col(nth) == 1).drop(node, nth)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
