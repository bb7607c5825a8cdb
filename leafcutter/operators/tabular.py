"""Positional grouping of rows that already are a table: column expressions only.

Rows are numbered inside a group (a sheet, a file, an order), never over a whole table, so
groups are the unit of parallelism and nothing is gathered in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def render_row(columns: Sequence[tuple[str, Column]], headers: bool = True) -> Column:
    """``name: value | name: value``; nulls are empty values."""
    cells = [F.concat(F.lit(f"{n}: " if headers else ""), F.coalesce(c.cast("string"), F.lit(""))) for n, c in columns]
    return F.concat_ws(" | ", *cells)


def ordered_text(pos: Column, text: Column, glue: str) -> Column:
    """Aggregate: texts of a group in order of position, joined."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(pos.alias("p"), text.alias("t")))), lambda x: x["t"]), glue)


def numbered(df: DataFrame, group: Sequence[str], order: Sequence[str], name: str = "rn") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))


def tumbling(df: DataFrame, group: Sequence[str], order: Sequence[str], text: Column, rows: int, glue: str = "\n") -> DataFrame:
    """Groups of ``rows`` rows: chunk_index (0-based), row_start, row_end (1-based), row_count, content."""
    n = numbered(df.select(*group, *[c for c in order if c not in group], text.alias("_line")), group, order)
    n = n.withColumn("chunk_index", F.expr(f"(rn - 1) div {rows}"))
    out = n.groupBy(*group, "chunk_index").agg(F.min("rn").cast("long").alias("row_start"), F.max("rn").cast("long").alias("row_end"), F.count(F.lit(1)).alias("row_count"), ordered_text(F.col("rn"), F.col("_line"), glue).alias("content"))
    return out


def sliding(df: DataFrame, group: Sequence[str], order: Sequence[str], text: Column, window: int, overlap: int, glue: str = "\n\n", suffixes: bool = False) -> DataFrame:
    """Windows of ``window`` rows every ``window - overlap``: window_index, first, last (0-based), n, content.

    The last window is the first that reaches the end; with ``suffixes`` windows go on
    while they start before the end. Each row goes to the windows that hold it, at most
    ceil(window / step) of them.
    """
    step = window - overlap
    n = numbered(df.select(*group, *[c for c in order if c not in group], text.alias("_line")), group, order)
    n = n.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*group)))
    i = F.col("rn") - 1
    last = F.expr(f"(_n - 1) div {step}") if suffixes else F.greatest(F.expr(f"(_n - {window} + {step - 1}) div {step}"), F.lit(0).cast("long"))
    low = F.greatest(F.lit(0).cast("long"), F.expr(f"(rn - 1 - {window}) div {step} + if(rn - 1 >= {window}, 1, 0)"))
    high = F.least(last, F.expr(f"(rn - 1) div {step}"))
    n = n.where(low <= high).withColumn("window_index", F.explode(F.sequence(low, high)))
    return n.groupBy(*group, "window_index").agg(F.min(i).cast("long").alias("first"), F.max(i).cast("long").alias("last"), F.count(F.lit(1)).alias("n"), ordered_text(F.col("rn"), F.col("_line"), glue).alias("content"))


def forward_fill(df: DataFrame, group: Sequence[str], order: Sequence[str], value: Column, name: str) -> DataFrame:
    """The last value that is not null so far, in order."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w))


def islands(df: DataFrame, group: Sequence[str], order: Sequence[str], full: Column) -> DataFrame:
    """Runs of consecutive rows for which ``full`` holds: island (1-based), first, last (1-based), n."""
    n = numbered(df.select(*group, *[c for c in order if c not in group], full.alias("_full")), group, order)
    keep = n.where("_full").withColumn("_g", F.col("rn") - F.row_number().over(Window.partitionBy(*group).orderBy("rn")))
    runs = keep.groupBy(*group, "_g").agg(F.min("rn").cast("long").alias("first"), F.max("rn").cast("long").alias("last"), F.count(F.lit(1)).alias("n"))
    return runs.withColumn("island", F.row_number().over(Window.partitionBy(*group).orderBy("first")).cast("long")).drop("_g")


def keep_first(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key."""
    return numbered(df, key, order, "_k").where("_k = 1").drop("_k")


def most_common(df: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """The most frequent value of each group, the smallest among equals, and its count."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("times"))
    best = counts.groupBy(*group).agg(F.min(F.struct((-F.col("times")).alias("m"), F.col(value).alias("v"))).alias("b"))
    return best.select(*group, F.col("b.v").alias(value), (-F.col("b.m")).alias("times"))


def as_of(left: DataFrame, right: DataFrame, key: Sequence[str], at: str, start: str, value: str) -> DataFrame:
    """Each left row with the value of the greatest ``start`` not above ``at``, by one sorted pass."""
    a = left.select(*key, F.col(at).alias("_at"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_row"), F.lit(None).cast(dict(right.dtypes)[value]).alias("_v"))
    b = right.select(*key, F.col(start).alias("_at"), F.lit(0).alias("_side"), F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), F.col(value).alias("_v"))
    w = Window.partitionBy(*key).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b).withColumn("_last", F.last("_v", ignorenulls=True).over(w))
    return both.where("_side = 1").select("_row.*", F.col("_last").alias(value))


def category_column(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The column with the fewest distinct values of those that repeat: one row ``(column, cardinality)``."""
    one = df.agg(F.count(F.lit(1)).alias("n"), *[F.countDistinct(c).alias(c) for c in columns])
    rows = one.select("n", F.posexplode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("cardinality")) for c in columns])).alias("pos", "x"))
    return rows.where("x.cardinality < n and x.cardinality > 0").orderBy("x.cardinality", "pos").limit(1).select("x.column", "x.cardinality")
