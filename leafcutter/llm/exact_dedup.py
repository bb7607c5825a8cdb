"""Exact deduplication by an exchange of compressed fingerprints.

1. Each scanned block of rows sorts its different fingerprints and sends one message to each
   owner of a fingerprint range: Golomb-Rice coded gaps.
2. An owner merges the messages of all blocks and answers each with a bitmap: which of its
   fingerprints other blocks have too.
3. Rows whose bit is set, or that repeat inside their block, are suspects. Only suspects' texts are
   shuffled, grouped by their bytes, to verify that equal digests mean equal bytes.

A text that fills any share of the rows is one fingerprint per block, one bit per block,
and one partial row per task in the byte comparison. Rows without suspicion never move
with their text.

Defined cases: a null text counts as empty; a null ``doc_id`` is smaller than any other, so
it stays only where all of the group are null (``keep_id`` is then null); of rows equal in text and
``doc_id`` exactly one is kept; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, group_starts, join_few, stream_groups, table
from .simhash import semi_join_text

#: Bits of a fingerprint. Chance hits only make more suspects.
BITS = 48
#: Rows of a block, and fingerprints of an owner on average.
BLOCK_ROWS, OWNED = 65_536, 2_000_000


def rice_encode(values: np.ndarray, k: int) -> bytes:
    """Gaps of ascending values: a stream of unary quotients, then one of ``k``-bit rests."""
    gaps = np.diff(values, prepend=np.uint64(0))
    q, r = (gaps >> np.uint64(k)).astype(np.int64), gaps & np.uint64((1 << k) - 1)
    ends = np.cumsum(q + 1)
    unary = np.ones(int(ends[-1]) if len(ends) else 0, dtype=np.uint8)
    unary[ends - 1] = 0
    rest = ((r[:, None] >> np.arange(k - 1, -1, -1, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8) if k else np.zeros(0, np.uint8)
    head = np.array([len(values), k, len(unary)], dtype="<u4").tobytes()
    return head + np.packbits(unary).tobytes() + np.packbits(rest.reshape(-1)).tobytes()


def rice_decode(data: bytes) -> np.ndarray:
    n, k, bits = np.frombuffer(data, "<u4", 3).tolist()
    body = np.frombuffer(data, np.uint8, offset=12)
    at = -(-bits // 8)
    unary = np.unpackbits(body[:at], count=bits)
    stops = np.flatnonzero(unary == 0)
    q = np.diff(stops, prepend=-1) - 1
    r = np.zeros(n, dtype=np.uint64)
    if k:
        rest = np.unpackbits(body[at:], count=n * k).reshape(n, k)
        for j in range(k):
            r = (r << np.uint64(1)) | rest[:, j]
    return np.cumsum((q.astype(np.uint64) << np.uint64(k)) | r).astype(np.uint64)


def rice_width(values: np.ndarray, span: int) -> int:
    """Rest bits for ``len(values)`` values spread over ``span``."""
    return max(0, (span // max(1, len(values))).bit_length() - 1)


def send(rows: DataFrame, owners: int, kind: str) -> DataFrame:
    """Rows ``(block, owner, place, repeated, _key, sha, fp)`` and, with ``payload`` set, messages."""
    span = (1 << BITS) // owners + 1

    def block_of(t: pa.Table, block: int):
        shas = t.column("sha").to_pylist()
        fp = np.array([int(s[: BITS // 4], 16) for s in shas], dtype=np.uint64)
        values, inverse, counts = np.unique(fp, return_inverse=True, return_counts=True)
        owner = (values // np.uint64(span)).astype(np.int64)
        start = np.searchsorted(owner, np.arange(owners + 1))
        n = t.num_rows
        row_owner = owner[inverse]
        nulls = lambda m, kind_: pa.nulls(m, kind_)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, block)), pa.array(row_owner.astype(np.int32)), pa.array((inverse - start[row_owner]).astype(np.int32)), pa.array(np.arange(n, dtype=np.int32)), pa.array(counts[inverse] > 1), t.column("_key").combine_chunks(), t.column("sha").combine_chunks(), pa.array(fp.astype(np.int64)), nulls(n, pa.binary())],
            names=NAMES,
        )
        full = [o for o in range(owners) if start[o] < start[o + 1]]
        messages = []
        for o in full:
            mine = values[start[o] : start[o + 1]] - np.uint64(o * span)
            messages.append(rice_encode(mine, rice_width(mine, span)))
        m = len(full)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(m, block)), pa.array(np.array(full, dtype=np.int32)), nulls(m, pa.int32()), nulls(m, pa.int32()), nulls(m, pa.bool_()), nulls(m, t.schema.field("_key").type), nulls(m, t.schema.field("sha").type), nulls(m, pa.int64()), pa.array(messages, pa.binary())],
            names=NAMES,
        )

    def work(batches):
        part, seq, held, size = TaskContext.get().partitionId(), 0, [], 0
        for b in batches:
            held.append(b)
            size += b.num_rows
            if size >= BLOCK_ROWS:
                yield from block_of(pa.Table.from_batches(held), (part << 24) + seq)
                seq, held, size = seq + 1, [], 0
        if size:
            yield from block_of(pa.Table.from_batches(held), (part << 24) + seq)

    return rows.mapInArrow(work, f"block long, owner int, place int, nth int, repeated boolean, _key {kind}, sha string, fp long, payload binary")


NAMES = ["block", "owner", "place", "nth", "repeated", "_key", "sha", "fp", "payload"]


def answer(messages: DataFrame) -> DataFrame:
    """``(block, owner, words)``: a bitmap in 64-bit words of the fingerprints that other blocks have."""

    def work(t: pa.Table):
        starts = [*group_starts(t, ["owner"]).tolist(), t.num_rows]
        blocks, owners, words = [], [], []
        for s, e in zip(starts, starts[1:], strict=False):
            part = t.slice(s, e - s)
            lists = [rice_decode(x) for x in part.column("payload").to_pylist()]
            every = np.concatenate(lists)
            _, inverse, counts = np.unique(every, return_inverse=True, return_counts=True)
            hit = counts[inverse] > 1
            at = 0
            for block, owner, mine in zip(part.column("block").to_pylist(), part.column("owner").to_pylist(), lists, strict=True):
                bits = np.zeros(-(-len(mine) // 64) * 64, dtype=np.uint8)
                bits[: len(mine)] = hit[at : at + len(mine)]
                at += len(mine)
                blocks.append(block)
                owners.append(owner)
                words.append(np.packbits(bits, bitorder="little").view("<i8"))
        return pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array(owners, pa.int32()), pa.array(words, pa.list_(pa.int64()))], ["block", "owner", "words"])

    return stream_groups(messages.select("owner", "block", "payload"), ["owner"], work, "block long, owner int, words array<long>")


def exact_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, keep_id, group_size, kept, text_sha256)`` for every row of ``docs``."""
    spark = docs.sparkSession
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    rows = docs.select(F.col(key).alias("_key"), F.sha2(body, 256).alias("sha"))
    # as many owners as keep the fingerprints of each within bounds
    owners = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // OWNED))
    sent = cut(send(rows, owners, docs.schema[key].dataType.simpleString()))
    messages = sent.where(F.col("payload").isNotNull())
    mine = sent.where(F.col("payload").isNull()).drop("payload")
    told = mine.join(answer(messages), ["block", "owner"], "left")
    bit = F.expr("bit_get(element_at(words, cast(place div 64 as int) + 1), place % 64) = 1")
    told = cut(told.select("_key", "sha", "fp", "block", "nth", (F.col("repeated") | F.coalesce(bit, F.lit(False))).alias("suspect")))
    alone = told.where(~F.col("suspect")).select(F.col("_key").alias(key), F.col("_key").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("sha").alias("text_sha256"))
    suspects = told.where("suspect")
    # bytes of the suspects' texts: one partial row per task for each different text
    scanned = docs.select(F.sha2(body, 256).alias("sha"), body.alias("_bytes")).withColumn("fp", F.conv(F.substring("sha", 1, BITS // 4), 16, 10).cast("long"))
    texts = semi_join_text(scanned, suspects.select("fp"), "fp").groupBy("sha", "_bytes").agg(F.count(F.lit(1)).alias("copies"))
    texts = texts.groupBy("sha").agg(F.count(F.lit(1)).alias("variants"), F.sum("copies").alias("copies"))
    groups = suspects.groupBy("sha").agg(F.count(F.lit(1)).alias("group_size"), F.max(F.struct("_key", "block", "nth")).alias("w"))
    same = (F.col("variants") == 1) & (F.col("copies") == F.col("group_size"))
    groups = groups.join(texts, "sha").select("sha", F.col("group_size").alias("_w"), F.when(same, F.col("group_size")).otherwise(F.raise_error(F.lit("texts with one digest differ in their bytes")).cast("long")).alias("group_size"), "w")
    found = join_few(suspects, cut(groups), ["sha"], "_w", suspects.count()).select(F.col("_key").alias(key), F.col("w._key").alias("keep_id"), "group_size", ((F.col("block") == F.col("w.block")) & (F.col("nth") == F.col("w.nth"))).alias("kept"), F.col("sha").alias("text_sha256"))
    return alone.union(found)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g ON d.t = g.t
"""
