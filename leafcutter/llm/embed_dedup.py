"""Near-duplicate embeddings by PCA-ordered, tiled comparison.

Vectors of one label are compared by cosine. They are turned by an orthonormal basis, found by
PCA on a bounded sample (any such basis gives the same cosines, a good one ends sooner), and
dealt into tiles by their first coordinate; tiles whose boxes over the leading coordinates lie
too far apart never meet. For two tiles, products over the leading coordinates are
taken first; a pair goes on only while its sum plus the product of both suffix norms can
reach the threshold. Survivors are decided by the cosine of the vectors as given, in double
precision.

Equal vectors are one class from the start, so a vector that fills any share of the rows is
compared once; a class brings its size to the link counts. A task holds two tiles, and
what leaves it is one count per vector and a star per connected set, never the pairs.

Defined cases: a null label, and a vector that is null, empty, zero or holds null or
non-finite components, links with nothing and is a component of its own; vectors of
different length do not link; a null ``vec_id`` takes part in links, is never a
component's id unless all are null; repeated rows are equal vectors; an empty table gives
an empty result; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, cut, group_starts, local_roots, stream_groups, table

THRESHOLD = 0.93
#: Vectors in the sample on which the basis is fitted.
SAMPLE = 4096
#: Vectors of a tile, slices of the first coordinate per label, coordinates of a tile's box.
TILE, SLICES, BOX = 2048, 64, 4
#: Keys over which a label's boxes are joined.
DEAL = 32
#: Slack of the bounds, above rounding errors of the rotated products.
SLACK = 1e-9


def pca_basis(sample: np.ndarray) -> np.ndarray:
    """Orthonormal columns, those that hold most of the unit vectors' energy first."""
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    _, vectors = np.linalg.eigh(unit.T @ unit)
    return vectors[:, ::-1].copy()


def pairs_over(a: np.ndarray, b: np.ndarray, ta: np.ndarray, tb: np.ndarray, threshold: float, same: bool):
    """Index pairs of rows of ``a`` and ``b`` (as given; ``ta``, ``tb``: unit and turned) whose
    cosine reaches ``threshold``; for a tile with itself only pairs of ascending index."""
    dim = a.shape[1]
    steps = [s for s in (8, 16, 32) if s < dim] + [dim]
    suffix = lambda t, k: np.sqrt(np.maximum(0.0, (t[:, k:] ** 2).sum(axis=1)))
    na, nb = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
    need = threshold - SLACK
    first = steps[0]
    sa, sb = {k: suffix(ta, k) for k in steps}, {k: suffix(tb, k) for k in steps}
    for r in range(0, len(a), 512):
        part = slice(r, min(r + 512, len(a)))
        head = ta[part, :first] @ tb[:, :first].T
        i, j = np.nonzero(head + sa[first][part, None] * sb[first][None, :] >= need)
        if same:
            ok = i + r < j
            i, j = i[ok], j[ok]
        total = head[i, j]
        i = i + r
        for k, nxt in zip(steps, steps[1:], strict=False):
            if not len(i):
                break
            more = np.empty(len(i))
            for c in range(0, len(i), 200_000):
                q = slice(c, c + 200_000)
                more[q] = np.einsum("ij,ij->i", ta[i[q], k:nxt], tb[j[q], k:nxt])
            total = total + more
            ok = total + sa[nxt][i] * sb[nxt][j] >= need
            i, j, total = i[ok], j[ok], total[ok]
        if len(i):
            cos = np.empty(len(i))
            for c in range(0, len(i), 200_000):
                q = slice(c, c + 200_000)
                cos[q] = np.einsum("ij,ij->i", a[i[q]], b[j[q]]) / (na[i[q]] * nb[j[q]])
            ok = cos >= threshold
            yield i[ok], j[ok]


def near_embeddings(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """``(key, n_links, component_id, kept)`` for every row of ``rows``."""
    base = rows.select(F.col(key).alias("_key"), F.col(label).alias("_label"), F.col(vector).alias("_v"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    usable = F.col("_label").isNotNull() & F.col("_v").isNotNull() & (F.size("_v") > 0) & ~F.exists("_v", bad) & F.exists("_v", lambda x: x != 0)
    marked = base.select("_key", "_label", "_v", F.coalesce(usable, F.lit(False)).alias("ok"), F.xxhash64("_label", "_v").alias("h1"), F.xxhash64(F.lit(1), "_v", "_label").alias("h2"))
    good = marked.where("ok")
    classes = cut(good.groupBy("h1", "h2").agg(F.min("_key").alias("first"), F.count(F.lit(1)).alias("copies"), F.min_by("_label", F.lit(1)).alias("_label"), F.min_by("_v", F.lit(1)).alias("_v")))
    classes = cut(classes.withColumn("node", F.monotonically_increasing_id()).withColumn("dim", F.size("_v")))
    dims = [r.dim for r in classes.groupBy("dim").count().orderBy("dim").limit(64).collect()]
    sample = [(r.dim, r._v) for r in classes.orderBy(F.xxhash64("h1")).limit(SAMPLE).select("dim", "_v").collect()]
    bases = {d: pca_basis(np.array([v for n, v in sample if n == d], dtype=np.float64)) for d in dims if any(n == d for n, _ in sample)}

    def turned(vectors: np.ndarray) -> np.ndarray:
        unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
        return unit @ bases[vectors.shape[1]] if vectors.shape[1] in bases else unit

    def matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
        flat = column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten()
        return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)

    def lead(batches):
        for b in batches:
            dim = b.column("dim").to_numpy()
            out = np.zeros((b.num_rows, BOX))
            for d in np.unique(dim):
                at = np.flatnonzero(dim == d)
                t = turned(matrix(b.column("_v").take(pa.array(at)), int(d)))
                out[at, : min(BOX, d)] = t[:, :BOX]
            cols = [*b.columns, *(pa.array(out[:, k]) for k in range(BOX))]
            yield pa.RecordBatch.from_arrays(cols, names=[*b.schema.names, *(f"p{k}" for k in range(BOX))])

    kind = rows.schema[label].dataType.simpleString()
    vkind = rows.schema[vector].dataType.simpleString()
    small = classes.select("node", "copies", F.col("_label").alias("lab"), "dim", "_v")
    placed = small.mapInArrow(lead, f"node long, copies long, lab {kind}, dim int, _v {vkind}, " + ", ".join(f"p{k} double" for k in range(BOX)))
    cuts = placed.groupBy("lab", "dim").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("p0", [i / SLICES for i in range(1, SLICES)], 2000).alias("q"))
    tiles = F.ceil(F.col("n") / TILE).cast("int")
    piece = F.size(F.filter("q", lambda x: x < F.col("p0")))
    wide = F.ceil(F.col("n") / (TILE * SLICES)).cast("int")
    spread = F.pmod(F.xxhash64("node"), wide.cast("long")).cast("int")
    tile = F.when(tiles <= SLICES, F.floor(piece * tiles / SLICES).cast("int")).otherwise(piece * wide + spread)
    placed = cut(placed.join(cuts, ["lab", "dim"]).withColumn("tile", tile).drop("n", "q"))
    boxes = placed.groupBy("lab", "dim", "tile").agg(*[f(f"p{k}").alias(f"{f.__name__}{k}") for k in range(BOX) for f in (F.min, F.max)])
    # a label's pairs of tiles are dealt over DEAL keys
    boxes = cut(boxes)
    x, y = boxes.withColumn("deal", F.pmod("tile", F.lit(DEAL))).alias("x"), boxes.withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(DEAL - 1)))).alias("y")
    gap = sum(F.pow(F.greatest(F.lit(0.0), F.col(f"x.min{k}") - F.col(f"y.max{k}"), F.col(f"y.min{k}") - F.col(f"x.max{k}")), F.lit(2.0)) for k in range(BOX))
    meet = x.join(y, (F.col("x.deal") == F.col("y.deal")) & (F.col("x.lab") == F.col("y.lab")) & (F.col("x.dim") == F.col("y.dim")) & (F.col("x.tile") <= F.col("y.tile")) & (gap <= 2 * (1 - threshold) + SLACK))
    meet = cut(meet.select(F.col("x.lab").alias("lab"), F.col("x.dim").alias("dim"), F.col("x.tile").alias("ta"), F.col("y.tile").alias("tb")))
    sides = meet.withColumn("tile", F.explode(F.array_distinct(F.array("ta", "tb"))))
    dealt = placed.select("node", "copies", "lab", "dim", "_v", "tile").join(sides, ["lab", "dim", "tile"])
    keys = ["lab", "dim", "ta", "tb"]

    def work(t: pa.Table):
        starts = [*group_starts(t, keys).tolist(), t.num_rows]
        node_, n_, up_ = [], [], []
        for s, e in zip(starts, starts[1:], strict=False):
            g = t.slice(s, e - s)
            v = matrix(g.column("_v"), g.column("dim")[0].as_py())
            turn, tile_ = turned(v), g.column("tile").to_numpy()
            same = g.column("ta")[0].as_py() == g.column("tb")[0].as_py()
            ia = np.flatnonzero(tile_ == g.column("ta")[0].as_py())
            ib = ia if same else np.flatnonzero(tile_ == g.column("tb")[0].as_py())
            copies, count = g.column("copies").to_numpy().astype(np.float64), np.zeros(len(v))
            root = np.arange(len(v))
            for i, j in pairs_over(v[ia], v[ib], turn[ia], turn[ib], threshold, same):
                i, j = ia[i], ib[j]
                count += np.bincount(i, copies[j], len(v)) + np.bincount(j, copies[i], len(v))
                root = np.minimum(root, local_roots(len(v), np.concatenate([i, np.arange(len(v))]), np.concatenate([j, root])))
            at = np.flatnonzero(count > 0)
            node = g.column("node").to_numpy()
            node_.append(node[at])
            n_.append(count[at].astype(np.int64))
            up_.append(node[root[at]])
        if not node_:
            return None
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (node_, n_, up_)], ["node", "n", "up"])

    found = cut(stream_groups(dealt, keys, work, "node long, n long, up long"))
    roots = connected_components(found.select(F.col("node").alias("a"), F.col("up").alias("b"))).select("node", "root")
    counts = found.groupBy("node").agg(F.sum("n").alias("n"))
    named = classes.select("h1", "h2", "node", "first", "copies").join(counts, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = cut(named)
    firsts = named.groupBy("root").agg(F.min("first").alias("component_id"))
    named = named.join(firsts, "root").select("h1", "h2", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    linked = good.select("_key", "h1", "h2").join(named, ["h1", "h2"], "left").select("_key", "n_links", "component_id")
    alone = marked.where("not ok").select("_key", F.lit(0).cast("long").alias("n_links"), F.col("_key").alias("component_id"))
    return linked.union(alone).select(F.col("_key").alias(key), "n_links", "component_id", F.col("_key").eqNullSafe(F.col("component_id")).alias("kept"))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_embeddings(table(spark, sf_dir, "embeddings"))
