"""Helpers shared by the training-data operators.

* ``cut``: lineage cut through Spark's reliable checkpoint, in the shared folder
  that the session names in ``spark.checkpoint.dir``.
* ``stream_groups``: vectorised grouped processing. Rows are dealt and sorted by
  key, and a Python worker walks over runs of equal keys without one call per group.
* ``connected_components``: alternating large-star / small-star over DataFrames.
* ``simhash64``: bit majorities of 64-bit hashes, for many sequences at once.
* ``filter_of``: a bitmap of hashes of one size, that keeps what cannot be wanted from being shuffled.
* ``tile_groups`` / ``verify_groups``: exact checks inside candidate groups, cut
  into bounded tiles.
"""

from __future__ import annotations

import gc
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Members of one tile when a large candidate group is cut for verification, and of groups that are compared side by
#: side; pairs checked in one turn.
TILE, SIDE, TURN = 500, 64, 16384
#: Rows of tiles whose pairs are decided together, and bytes at which fewer are.
GATHER, GATHER_BYTES = 12_000, 16_000_000


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The session's shared checkpoint folder. Where none is set, a temporary one for a local
    master, and an error for a cluster, whose executors would not see each other's files."""
    sc = spark.sparkContext
    found = sc._jsc.sc().getCheckpointDir()
    if found.isDefined():
        return found.get()
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if not named and not (sc.master.startswith("local") and not sc.master.startswith("local-cluster")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="leafcutter-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from the files."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let shuffle files go that nothing refers to any more. Executors drop them only once the driver has collected its
    garbage, which with a small driver can come after the job; called after the steps that shuffle most."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_names(columns: list[str], *wanted: str) -> list[str]:
    """Column names close to ``wanted`` that do not clash with ``columns``, whatever their case."""
    taken, out = {c.lower() for c in columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


# ------------------------------------------------------------------ hashing


def bit_majority(hashes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """For consecutive runs of ``hashes`` (uint64), the 64 majority bits of each run.

    A bit is one if it is set in over half of the run's values; an empty run gives zero.
    Counts are kept in bytes, eight to a word, for stretches of at most 255 values.
    """
    out = np.zeros(len(lengths), dtype=np.uint64)
    lengths = np.asarray(lengths, dtype=np.int64)
    full = lengths > 0
    if not full.any():
        return out
    runs = lengths[full]
    pieces = -(-runs // 255)
    first = np.cumsum(runs) - runs
    owner = np.repeat(np.arange(len(runs)), pieces)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    starts = first[owner] + nth * 255
    piece_of = np.cumsum(pieces) - pieces
    ones = np.uint64(0x0101010101010101)
    bits, low = np.zeros(len(runs), dtype=np.uint64), np.empty_like(hashes)
    for k in range(8):
        np.right_shift(hashes, np.uint64(k), out=low)
        low &= ones
        lane = np.add.reduceat(low, starts)
        counts = lane.view(np.uint8).reshape(-1, 8).astype(np.int32)
        counts = np.add.reduceat(counts, piece_of, axis=0)
        major = (2 * counts > runs[:, None]).astype(np.uint64)
        for byte in range(8):
            bits |= major[:, byte] << np.uint64(8 * byte + k)
    out[full] = bits
    return out


# ------------------------------------------------------- grouped processing


def runs_of(batches: Iterator[pa.RecordBatch], keys: list[str], limit: int | None = None, over: list | None = None) -> Iterator[pa.Table]:
    """Tables that hold whole groups only, from batches sorted by ``keys``.

    With ``limit``, a group that outgrows it is not gathered: its key goes to ``over``.
    """
    held: list[pa.RecordBatch] = []  # rows of one group, the last so far
    last: tuple | None = None
    skipped: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = [batch.column(k) for k in keys]
        first = tuple(c[0].as_py() for c in ends)
        tail = tuple(c[batch.num_rows - 1].as_py() for c in ends)
        new = np.zeros(batch.num_rows, dtype=bool)
        if first != tail:
            for c in ends:
                v = c.to_numpy(zero_copy_only=False)
                new[1:] |= v[1:] != v[:-1]
        start = 0
        if first == skipped:
            if first == tail:
                continue
            start = int(np.flatnonzero(new)[0])
            batch, new = batch.slice(start), new[start:]
            first = tuple(batch.column(k)[0].as_py() for k in keys)
        if held and first != last:
            yield pa.Table.from_batches(held)
            held = []
        at = int(np.flatnonzero(new[1:])[-1]) + 1 if first != tail else 0
        if at:
            held.append(batch.slice(0, at))
            yield pa.Table.from_batches(held)
            held = []
        held.append(batch.slice(at))
        last = tail
        if limit and sum(x.num_rows for x in held) > limit:
            over.append(tail)
            held, skipped = [], tail
    if held:
        yield pa.Table.from_batches(held)


def gathered(tables: Iterator[pa.Table], rows: int) -> Iterator[pa.Table]:
    """``tables`` put together until they have ``rows`` rows or ``GATHER_BYTES`` bytes."""
    held: list[pa.Table] = []
    for t in tables:
        held.append(t)
        if sum(x.num_rows for x in held) >= rows or sum(x.nbytes for x in held) >= GATHER_BYTES:
            yield pa.concat_tables(held)
            held = []
    if held:
        yield pa.concat_tables(held)


def stream_groups(df: DataFrame, keys: list[str], fn: Callable[[pa.Table], pa.RecordBatch | None], schema: str, rows: int = 0) -> DataFrame:
    """``fn`` gets tables of whole groups, many groups at a time (``rows`` rows or more, if there are), sorted by ``keys``."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in gathered(runs_of(batches, keys), rows):
            out = fn(t)
            if out is not None and out.num_rows:
                yield out

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(walk, schema)


def group_starts(t: pa.Table, keys: list[str]) -> np.ndarray:
    new = np.zeros(t.num_rows, dtype=bool)
    new[0] = True
    for k in keys:
        v = t.column(k).to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(new)


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of ``n`` nodes over the links ``a``-``b``."""
    root = np.arange(n)
    if not len(a):
        return root
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        while True:
            again = new[new]
            if (again == new).all():
                break
            new = again
        if (new == root).all():
            return root
        root = new


def nearest_forest(n: int, a: np.ndarray, b: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Places of the links ``a``-``b`` between ``n`` nodes that make up a spanning forest of least total
    distance ``d``: every set of nodes that are closer to each other than to the rest is joined inside itself."""
    comp, live, out = np.arange(n), np.arange(len(a)), []
    rank = np.empty(len(a), dtype=np.int64)
    rank[np.argsort(d, kind="stable")] = np.arange(len(a))
    while True:
        live = live[comp[a[live]] != comp[b[live]]]
        if not len(live):
            return np.concatenate(out) if out else live
        best = np.full(n, len(a), dtype=np.int64)
        np.minimum.at(best, comp[a[live]], rank[live])
        np.minimum.at(best, comp[b[live]], rank[live])
        picked = np.zeros(len(a), dtype=bool)
        picked[best[best < len(a)]] = True
        at = live[picked[rank[live]]]
        out.append(at)
        comp = local_roots(n, comp[a[at]], comp[b[at]])[comp]


class Forest:
    """Union-find with path halving, for the exact checks inside a tile."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.find(x), self.find(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)


# ------------------------------------------------------ connected components


#: Rows from which hot keys are looked for: below it, a key with all of them is a small task. A key of over
#: this share of the rows is hot, so there are at most twice the inverse of hot ones.
HOT_ROWS, HOT_SHARE = 200_000, 1 / 1000


def join_few(many: DataFrame, one: DataFrame, keys: list[str], weight: str, total: int) -> DataFrame:
    """Inner join with ``one``, a row for each key with its number of rows in ``weight`` (dropped). Rows of
    the few hot keys stay where they are, as their single rows are broadcast; the rest is shuffled."""
    if total <= HOT_ROWS:
        return many.join(one.drop(weight), keys)
    hot = F.col(weight) > int(total * HOT_SHARE)
    few = F.broadcast(one.where(hot).drop(weight))
    return many.join(few, keys).unionByName(many.join(few, keys, "left_anti").join(one.where(~hot).drop(weight), keys))


def _few_components(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    links = [(b.column("u").to_numpy(), b.column("v").to_numpy()) for b in batches]
    if not links:
        return
    u, v = (np.concatenate(x) for x in zip(*links, strict=True))
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    root = nodes[local_roots(len(nodes), at[: len(u)], at[len(u) :])]
    for k in range(0, len(nodes), 10_000):
        yield pa.RecordBatch.from_arrays([pa.array(nodes[k : k + 10_000]), pa.array(root[k : k + 10_000])], names=["node", "root"])


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, root)`` for every node that has a link; root is the smallest node reachable.

    Alternates large-star and small-star steps until the links no longer change. Each
    round is joins and partial aggregates; nothing but a count and a checksum reaches
    the driver. Up to ``HOT_ROWS`` links are a small task: one worker connects them, without a shuffle. A node that has over ``HOT_SHARE`` of many links, such as the centre of a large
    star, meets its links by a broadcast of those few nodes, so they stay where they are.
    Loops and repeated links are allowed; null ends are dropped.
    """
    star = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    star = cut(star)
    seen = None
    while True:
        # count and checksum of the links tell whether a round changed anything
        mark = star.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark[0] <= HOT_ROWS:
            return star.coalesce(1).mapInArrow(_few_components, "node long, root long")
        if mark == seen:
            return star.select(F.col("u").alias("node"), F.col("v").alias("root")).union(star.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        seen = mark
        both = star.union(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("m", "u").alias("m"), "n")
        # large star: neighbours above a node move to the smallest neighbour
        large = join_few(both.where("v > u"), low, ["u"], "n", mark[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        # small star: neighbours below a node, and the node, move to the smallest one
        near = large.join(low, "u")
        star = cut(near.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct())


# ------------------------------------------------------------- bounded filters

#: Bits of a filter (16 MB), and of one of its pieces.
FILTER_BITS, PIECE_BITS = 27, 16


def filter_of(hashes: DataFrame, column: str):
    """A broadcast bitmap of ``FILTER_BITS`` leading bits of 64-bit hashes: one size, however many there are.

    What it lets through by chance is for a join to sort out; a full one would let all through."""
    slot = F.shiftrightunsigned(F.col(column), 64 - FILTER_BITS)
    rows = hashes.select(F.shiftright(slot, PIECE_BITS).cast("int").alias("piece"), F.pmod(slot, F.lit(1 << PIECE_BITS)).cast("int").alias("bit")).distinct()

    def work(t: pa.Table) -> pa.RecordBatch:
        starts, bit = group_starts(t, ["piece"]), t.column("bit").to_numpy()
        out = []
        for s, e in zip(starts.tolist(), [*starts.tolist()[1:], t.num_rows], strict=True):
            bits = np.zeros(1 << PIECE_BITS, dtype=bool)
            bits[bit[s:e]] = True
            out.append(np.packbits(bits).tobytes())
        return pa.RecordBatch.from_arrays([pa.array(t.column("piece").to_numpy()[starts], pa.int32()), pa.array(out, pa.binary())], ["piece", "bits"])

    whole = np.zeros((1 << (FILTER_BITS - PIECE_BITS), 1 << (PIECE_BITS - 3)), dtype=np.uint8)
    for r in stream_groups(rows, ["piece"], work, "piece int, bits binary").collect():
        whole[r.piece] = np.frombuffer(r.bits, dtype=np.uint8)
    return hashes.sparkSession.sparkContext.broadcast(whole.reshape(-1))


def passes(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    slot = (hashes.view(np.uint64) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
    return (bitmap[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1 == 1


# ------------------------------------------------- verification inside groups


def own_tiles(members: DataFrame, group: str, node: str) -> DataFrame:
    """``members`` (counted first) of groups of two or more, with ``tiles``, so many as their group has, and
    ``tile_a`` and ``tile_b``, both the one that a member is in by a hash: a tile has about ``TILE`` members at most."""
    sizes = members.groupBy(group).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1)
    m = join_few(members, sizes.withColumn("_w", F.col("_n")), [group], "_w", members.count())
    m = m.withColumn("tiles", F.ceil(F.col("_n") / F.lit(TILE)).cast("int"))
    m = m.withColumn("tile_a", F.pmod(F.xxhash64(F.col(node), F.lit(7)), F.col("tiles").cast("long")).cast("int"))
    return m.withColumn("tile_b", F.col("tile_a")).drop("_n")


def tile_groups(members: DataFrame, group: str, node: str) -> DataFrame:
    """``members`` with ``tile_a``, ``tile_b``: a group of up to ``TILE`` members is one tile, a larger one
    is cut into tiles by a hash and each pair of tiles meets once, so no task holds over
    two tiles' members of a group."""
    m = own_tiles(members, group, node).withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    return m.withColumns({"tile_a": F.least("tile_a", "_o"), "tile_b": F.greatest("tile_a", "_o")}).drop("tiles", "_o")


def near_pairs(bits: np.ndarray, starts: np.ndarray, tau: int, worth: Callable | None = None) -> tuple[np.ndarray, np.ndarray]:
    """``(left, right)``: places of the pairs in one run (``starts`` of the runs), the later place first, whose
    fingerprints differ in at most ``tau`` bits and that ``worth(left, right)``, taken for a strip at a time, keeps."""
    sizes = np.diff([*starts.tolist(), len(bits)])
    end = np.repeat(starts + np.where(sizes <= SIDE, sizes, 0), sizes)
    left, right = [], []

    def add(x: np.ndarray, y: np.ndarray) -> None:
        if worth and len(x):
            ok = worth(x, y)
            x, y = x[ok], y[ok]
        left.append(x)
        right.append(y)

    i = np.arange(len(bits))
    for d in range(1, SIDE):
        i = i[i + d < end[i]]
        if not len(i):
            break
        near = i[np.bitwise_count(bits[i] ^ bits[i + d]) <= tau]
        add(near + d, near)
    for s, size in zip(starts[sizes > SIDE].tolist(), sizes[sizes > SIDE].tolist(), strict=True):
        mine, step = bits[s : s + size], max(1, 1_000_000 // size)
        for r in range(0, size, step):
            x, y = np.nonzero(np.bitwise_count(mine[r : r + step, None] ^ mine[None, : r + step]) <= tau)
            ok = x + r > y
            add(x[ok] + (r + s), y[ok] + s)
    return np.concatenate([*left, i[:0]]), np.concatenate([*right, i[:0]])


def first_of(group: np.ndarray, n: int) -> np.ndarray:
    """Whether a place is among the first ``n`` of its group."""
    order = np.argsort(group, kind="stable")
    new = np.ones(len(group), dtype=bool)
    new[1:] = group[order[1:]] != group[order[:-1]]
    at = np.arange(len(group))
    out = np.empty(len(group), dtype=bool)
    out[order] = at - np.maximum.accumulate(np.where(new, at, 0)) < n
    return out


def settled(items: list, left: np.ndarray, right: np.ndarray, far: np.ndarray, many: Callable, root: np.ndarray | None = None) -> np.ndarray:
    """The smallest place reachable from each item over those of the pairs that ``many(items, left, right)`` links
    and over the links to ``root``, known from before.

    In each round every component so far has its closest pairs to others checked, at first one, then twice as many as
    in the round before; pairs that are connected by then go unchecked, all others come up in the end."""
    order = np.argsort(far, kind="stable")
    left, right = left[order], right[order]
    root, tries = np.arange(len(items)) if root is None else root, 1
    while True:
        apart = root[left] != root[right]
        left, right = left[apart], right[apart]
        if not len(left):
            return root
        now = first_of(root[left], tries) | first_of(root[right], tries)
        a, b = left[now], right[now]
        hit = np.concatenate([many(items, a[k : k + TURN], b[k : k + TURN]) for k in range(0, len(a), TURN)])
        root = local_roots(len(items), np.concatenate([root, a[hit]]), np.concatenate([np.arange(len(items)), b[hit]]))
        left, right, tries = left[~now], right[~now], 2 * tries


def verify_groups(tiled: DataFrame, group: str, node: str, fp: str, tau: int, prepare: Callable, linked: Callable, screen: Callable | None = None, many: Callable | None = None, known: str | None = None) -> DataFrame:
    """Verified links ``(a, b)`` between nodes of the same group, as stars.

    ``tiled``: rows of ``tile_groups`` with group, node, fp (all long) and payload columns. Pairs whose
    fingerprints differ in at most ``tau`` bits are decided by ``linked(x, y)`` on the items that
    ``prepare`` makes of a tile's table. Pairs that are already connected inside the tile need no
    check, so a group of thousands of copies costs about one check for each member; all other
    pairs are checked, so no link that matters for the components is lost.
    With ``many(items, left, right)``, ``linked`` for arrays of places, the pairs of all tiles at hand are decided
    together, in the rounds of ``settled``; ``screen``, made of the same table, tells for such arrays which pairs are worth it, and members
    equal in the column ``known`` (long) are connected from the start.
    """
    keys = [group, "tile_a", "tile_b"]

    def one_by_one(t: pa.Table, starts: np.ndarray, bits: np.ndarray) -> np.ndarray:
        root = np.arange(t.num_rows)
        for s, e in zip(starts.tolist(), [*starts.tolist()[1:], t.num_rows], strict=True):
            items, forest = prepare(t.slice(s, e - s)), Forest(e - s)
            for i in range(1, e - s):
                far = np.bitwise_count(bits[s : s + i] ^ bits[s + i])
                near = np.flatnonzero(far <= tau)[::-1]
                # the closest first, and of these the latest: copies of a copy are often closest to it
                for j in near[np.argsort(far[near], kind="stable")].tolist():
                    if forest.find(i) != forest.find(j) and linked(items[i], items[j]):
                        forest.join(i, j)
            root[s:e] = [s + forest.find(i) for i in range(e - s)]
        return root

    def all_at_once(t: pa.Table, starts: np.ndarray, bits: np.ndarray) -> np.ndarray:
        left, right = near_pairs(bits, starts, tau, screen(t) if screen else None)
        first = None
        if known:
            run = np.repeat(np.arange(len(starts)), np.diff([*starts.tolist(), t.num_rows]))
            _, at, which = np.unique(np.stack([run, t.column(known).to_numpy()]), axis=1, return_index=True, return_inverse=True)
            first = at[which.reshape(-1)]
        return settled(prepare(t), left, right, np.bitwise_count(bits[left] ^ bits[right]), many, first)

    def work(t: pa.Table) -> pa.RecordBatch | None:
        t = t.combine_chunks()
        bits = t.column(fp).to_numpy().view(np.uint64)
        root = (all_at_once if many else one_by_one)(t, group_starts(t, keys), bits)
        ids, at = t.column(node).to_numpy(), np.flatnonzero(root != np.arange(t.num_rows))
        return pa.RecordBatch.from_arrays([pa.array(ids[at], pa.int64()), pa.array(ids[root[at]], pa.int64())], ["a", "b"]) if len(at) else None

    return stream_groups(tiled, keys, work, "a long, b long", GATHER if many else 0)
