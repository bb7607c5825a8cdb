"""Mixing sources to target weights, with DataFrame functions alone.

Every document gets a hash-random key. A source's documents, in key order, are a random
permutation; a source with budget ``b`` and size ``s`` gives ``b div s`` whole epochs and
then the documents whose running size stays within the rest, the one at the cut in part.

The running sums are distributed: two digits of the key deal each source into 256 x 256
buckets of equal expected size, sums of buckets are accumulated over at most 256 rows at
a time on two levels, and only inside a bucket are documents sorted. So a source that
holds any share of the rows is spread over all tasks, and no task sees over 1/65536 of it.

Defined cases: a null text has size 0 and takes 0; a null source is a source of its own, last
in order; null or repeated ``doc_id`` values are ordered by size after the key, and rows equal
in all of these are interchangeable; an empty table gives an empty result; a table of
empty texts has targets 0. Further columns are kept by ``mix`` and may have any name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, fresh_names, table

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
CAP = 3
SEED = "mix-1"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int], cap: int, share: float) -> DataFrame:
    """``(s, source_size, target, budget)`` from one row per source ``(s, source_size)``.

    Sources are filled to a common level per unit of weight; those whose limit lies below the
    level stop at it. In order of limit per weight, the first source whose limit is not below
    the level of what is left fixes that level. One row per source: this is a table of the
    mix's recipe, not of its documents.
    """
    every = Window.partitionBy()
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(every.orderBy("s")) - 1) % len(weights) + 1).cast("int")).cast("decimal(38,0)")
    t = sizes.withColumn("w", w).withColumn("lim", (F.col("source_size") * cap).cast("decimal(38,0)"))
    by = every.orderBy((F.col("lim").cast("double") / F.col("w").cast("double")).alias("ratio"), "s")
    t = t.withColumn("rn", F.row_number().over(by))
    total = F.floor(F.sum("source_size").over(every) * F.lit(share)).cast("decimal(38,0)")
    t = t.withColumn("left", total - F.coalesce(F.sum("lim").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    t = t.withColumn("ws", F.sum("w").over(by.rowsBetween(0, Window.unboundedFollowing)))
    open_ = F.col("lim") * F.col("ws") >= F.col("left") * F.col("w")
    t = t.withColumn("at", F.min(F.when(open_, F.struct("rn", "left", "ws"))).over(every))
    level = (F.col("at.left") * F.col("w")).cast("double") / F.col("at.ws").cast("double")
    t = t.withColumn("target", F.when(F.col("rn") < F.col("at.rn"), F.col("lim").cast("double")).otherwise(level))
    return t.select("s", "source_size", "target", F.floor("target").cast("long").alias("budget"))


def _keyed(df: DataFrame, key: str, source: str, size: Column, names: list[str], seed: str) -> DataFrame:
    s, h, n = names
    return df.withColumns({
        s: F.when(F.col(source).isNull(), "t").otherwise(F.concat(F.lit("s"), F.col(source).cast("string"))),
        h: F.md5(F.concat(F.lit(seed + "|"), F.coalesce(F.col(key).cast("string"), F.lit("")))),
        n: size,
    })


def mix_plan(rows: DataFrame, base: DataFrame | None = None, key: str = "doc_id", source: str = "source", size: Column | str = "size", weights: Sequence[int] = WEIGHTS, cap: int = CAP, share: float = 1.0, seed: str = SEED) -> DataFrame:
    """``rows`` and what the mix takes of each: size, source_size, target, taken, epochs, cut.

    ``base`` gives the sums (by default ``rows``). ``cut`` is the number of words of the last,
    partial copy, ``epochs`` the number of whole copies.
    """
    s, h, n, b1, b2, before, js, j1, j2 = fresh_names(rows.columns, "_s", "_h", "_n", "_b1", "_b2", "_before", "_js", "_j1", "_j2")
    size = F.col(size) if isinstance(size, str) else size
    keyed = _keyed(rows, key, source, size, [s, h, n], seed).withColumns({b1: F.substring(h, 1, 2), b2: F.substring(h, 3, 2)})
    sums = (base if base is not None else rows)
    sums = _keyed(sums, key, source, size, [s, h, n], seed).groupBy(F.col(s).alias("s"), F.substring(h, 1, 2).alias("b1"), F.substring(h, 3, 2).alias("b2")).agg(F.sum(n).alias("sum2"))
    sums = cut(sums)
    tops = sums.groupBy("s", "b1").agg(F.sum("sum2").alias("sum1"))
    targets = source_targets(tops.groupBy("s").agg(F.sum("sum1").alias("source_size")), weights, cap, share)
    upto = (Window.unboundedPreceding, -1)
    tops = tops.withColumn("before1", F.coalesce(F.sum("sum1").over(Window.partitionBy("s").orderBy("b1").rowsBetween(*upto)), F.lit(0)))
    tops = tops.join(targets, "s").drop("sum1")
    lows = sums.withColumn("before2", F.coalesce(F.sum("sum2").over(Window.partitionBy("s", "b1").orderBy("b2").rowsBetween(*upto)), F.lit(0)))
    offsets = lows.join(tops, ["s", "b1"]).select(F.struct("source_size", "target", "budget", (F.col("before1") + F.col("before2")).alias("before")).alias(before), F.col("s").alias(js), F.col("b1").alias(j1), F.col("b2").alias(j2))
    j = keyed.join(offsets, (F.col(s) == F.col(js)) & (F.col(b1) == F.col(j1)) & (F.col(b2) == F.col(j2)), "left")
    inside = Window.partitionBy(s, b1, b2).orderBy(h, F.col(key), n).rowsBetween(*upto)
    at = F.col(f"{before}.before") + F.coalesce(F.sum(n).over(inside), F.lit(0))
    total, budget = F.col(f"{before}.source_size"), F.col(f"{before}.budget")
    exact = F.when(total > 0, F.expr(f"`{before}`.budget div greatest(`{before}`.source_size, 1L)")).otherwise(F.lit(0).cast("long"))
    rest = budget - exact * total
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col(n), rest - at))
    return j.select(*[F.col(f"`{c}`") for c in rows.columns if not (isinstance(size, Column) and c in ("size", "source_size", "target", "taken", "epochs", "cut"))], F.col(n).alias("size"), total.alias("source_size"), F.col(f"{before}.target").alias("target"), (exact * F.col(n) + part).alias("taken"), exact.alias("epochs"), part.alias("cut"))


def mix(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", **how) -> DataFrame:
    """The mixed corpus, with the columns of ``docs``: whole copies of each document for the
    whole epochs, and the document at the cut shortened to its first words."""
    e, plan = fresh_names(docs.columns, "_copy", "_plan")
    small = docs.select(F.col(key), F.col(source), F.col(f"`{text}`"))
    nested = docs.select(F.col(key), F.col(source), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(plan))
    got = mix_plan(nested, base=small.select(F.col(key), F.col(source), F.struct(F.col(f"`{text}`")).alias(plan)), key=key, source=source, size=n_words(F.col(f"{plan}.`{text}`")), **how)
    got = got.where(F.col("taken") > 0).withColumn(e, F.explode(F.sequence(F.lit(1).cast("long"), F.col("epochs") + (F.col("cut") > 0).cast("long"))))
    whole = F.col(f"{plan}.`{text}`")
    # the first `cut` words, white space between them kept: pieces end where a word ends
    pieces = F.split(whole, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    first = F.array_join(F.slice(pieces, F.lit(1), F.greatest(F.col("cut"), F.lit(1)).cast("int")), "")
    short = F.when((F.col(e) > F.col("epochs")) & (F.col("cut") < F.col("size")), first).otherwise(whole)
    return got.select(*[short.alias(c) if c == text else F.col(f"{plan}.`{c}`") for c in docs.columns])


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", n_words(F.col("text")).alias("size"))
    return mix_plan(cut(rows)).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
                  md5('mix-1|' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM d GROUP BY source),
w AS (SELECT *, CASE (place - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w, 3 * source_size AS lim FROM s),
r AS (SELECT *, row_number() OVER o AS rn, CAST(sum(source_size) OVER () - coalesce(sum(lim) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS remaining,
             CAST(sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS ws
      FROM w WINDOW o AS (ORDER BY CAST(lim AS DOUBLE) / w, source NULLS LAST)),
k AS (SELECT rn AS at_rn, remaining AS at_left, ws AS at_ws FROM r WHERE lim * ws >= remaining * w ORDER BY rn LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN rn < at_rn THEN CAST(lim AS DOUBLE) ELSE CAST(at_left * w AS DOUBLE) / at_ws END AS target FROM r, k),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target, CAST(floor(t.target) AS BIGINT) AS budget,
             CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size AS BIGINT) AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CASE WHEN source_size = 0 THEN CAST(0 AS BIGINT)
            ELSE (budget // source_size) * size + greatest(CAST(0 AS BIGINT), least(size, budget - (budget // source_size) * source_size - before)) END AS taken
FROM p
"""
