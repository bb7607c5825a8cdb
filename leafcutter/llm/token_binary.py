"""Token ids in a binary format of 64-bit words (Simple-8b).

A word holds a selector in its top four bits and as many ids as fit into the other sixty,
all of the same width. Blocks of ``BLOCK`` ids start at a word of their own and an
array has each block's first word, so any block can be decoded without those before it, and
all of them at once with a few array operations per selector. A value of over sixty bits
is an escape: its word holds the place of the value in a list of raw 64-bit values.

File: magic, five unsigned 64-bit counts (documents, ids, words, blocks, escapes), then
document ids (int64), a byte for each that is null, ids per document (uint64), first word of
each block (uint64), words (uint64), escaped values (uint64). All little-endian.

Writing sorts documents over range partitions and writes files of about ``FILE_IDS`` ids to the
shared folder, under names that hold the task attempt, so a task that runs twice never
writes over another's file; a manifest names those that count and is itself kept in the
shared folder.

Defined cases: a null text counts as empty; every document has at least the end id; null
``doc_id`` values come first and stay null; equal ``doc_id`` values are ordered by text;
an empty table gives no file and an empty result; further columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import give_back_memory, shared_spec, slices, worker_encoder
from .common import cut, ensure_checkpoint_dir, table

MAGIC = b"LCIDS8B1"
BLOCK = 128
FILE_IDS = 1_000_000
#: Ids per word and bits per id, by selector; selector 14 marks an escape.
COUNTS = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1, 1])
BITS = np.array([1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60, 60])
ESCAPE = 14
END_ID = 1


def widths(values: np.ndarray) -> np.ndarray:
    """Bits that each unsigned 64-bit value needs."""
    if not values.size or int(values.max()) < 1 << 16:
        return SMALL_WIDTHS[values]
    out = np.zeros(values.shape, dtype=np.uint8)
    rest = values.copy()
    for step in (32, 16, 8, 4, 2, 1):
        big = rest >= (np.uint64(1) << np.uint64(step))
        out[big] += np.uint8(step)
        rest[big] >>= np.uint64(step)
    return out + (values > 0)


SMALL_WIDTHS = np.array([x.bit_length() for x in range(1 << 16)], dtype=np.uint8)


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, the first word of each block, and escaped values."""
    values = np.ascontiguousarray(values, dtype=np.uint64)
    n = len(values)
    blocks = -(-n // BLOCK)
    if not blocks:
        return (np.zeros(0, np.uint64),) * 3
    ids = np.zeros((blocks, BLOCK + 64), dtype=np.uint64)
    padded = np.zeros(blocks * BLOCK, dtype=np.uint64)
    padded[:n] = values
    ids[:, :BLOCK] = padded.reshape(blocks, BLOCK)
    need = widths(ids)
    # most[k]: the largest width among k values from each place on
    most = {1: need}
    for k in (2, 4, 8, 16, 32):
        m = most[k // 2].copy()
        m[:, : -(k // 2)] = np.maximum(m[:, : -(k // 2)], m[:, k // 2 :])
        most[k] = m
    # a selector that fits stays fitting with fewer, wider ids, so the first one is their number that fail
    select = np.zeros((blocks, BLOCK), dtype=np.uint8)
    for s in range(ESCAPE):
        c = int(COUNTS[s])
        k = 1 << (c.bit_length() - 1)
        top = most[k][:, :BLOCK]
        if k < c:
            top = np.maximum(top, most[k][:, c - k : c - k + BLOCK])
        select += top > BITS[s]
    ends = np.full(blocks, BLOCK)
    ends[-1] = n - (blocks - 1) * BLOCK
    at, live = np.zeros(blocks, dtype=np.int64), np.arange(blocks)
    made: list[np.ndarray] = []
    where: list[np.ndarray] = []
    raw: list[np.ndarray] = []
    escapes = 0
    while len(live):
        s = select[live, at[live]]
        words = s.astype(np.uint64) << np.uint64(60)
        for x in np.flatnonzero(np.bincount(s)):
            rows = np.flatnonzero(s == x)
            b, c = live[rows], int(COUNTS[x])
            if x == ESCAPE:
                raw.append(ids[b, at[b]])
                words[rows] |= np.arange(escapes, escapes + len(b), dtype=np.uint64)
                escapes += len(b)
                continue
            part = ids[b[:, None], at[b][:, None] + np.arange(c)] << (np.arange(c) * BITS[x]).astype(np.uint64)
            words[rows] |= np.bitwise_or.reduce(part, axis=1)
        made.append(words)
        where.append(live)
        at[live] += COUNTS[s]
        live = live[at[live] < ends[live]]
    owner = np.concatenate(where)
    order = np.argsort(owner, kind="stable")
    first = np.searchsorted(owner[order], np.arange(blocks)).astype(np.uint64)
    return np.concatenate(made)[order], first, np.concatenate(raw) if raw else np.zeros(0, np.uint64)


def decode(words: np.ndarray, first: np.ndarray, raw: np.ndarray, n: int, blocks: slice | None = None) -> np.ndarray:
    """All values, or those of consecutive blocks."""
    total = len(first)
    lo, hi, _ = (blocks or slice(None)).indices(total)
    if hi <= lo:
        return np.zeros(0, np.uint64)
    stop = int(first[hi]) if hi < total else len(words)
    base = int(first[lo])
    words = words[base:stop]
    count = min(n, hi * BLOCK) - lo * BLOCK
    select = (words >> np.uint64(60)).astype(np.int64)
    c = COUNTS[select]
    run = np.cumsum(c) - c
    starts = first[lo:hi].astype(np.int64) - base
    sizes = np.diff([*starts.tolist(), len(words)])
    block = np.repeat(np.arange(hi - lo), sizes)
    place = run - run[starts][block] + block * BLOCK
    end = np.minimum((block + 1) * BLOCK, count)
    out = np.zeros(count, dtype=np.uint64)
    for s in np.unique(select):
        rows = np.flatnonzero(select == s)
        w = words[rows] & np.uint64((1 << 60) - 1)
        if s == ESCAPE:
            out[place[rows]] = raw[w.astype(np.int64)]
            continue
        k = np.arange(int(COUNTS[s]))
        got = (w[:, None] >> (k * BITS[s]).astype(np.uint64)) & np.uint64((1 << int(BITS[s])) - 1)
        to = place[rows][:, None] + k
        ok = to < end[rows][:, None]
        out[to[ok]] = got[ok]
    return out


def pack(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    words, first, raw = encode(ids)
    head = np.array([len(doc_ids), len(ids), len(words), len(first), len(raw)], dtype="<u8")
    return b"".join([
        MAGIC, head.tobytes(), np.array([d or 0 for d in doc_ids], dtype="<i8").tobytes(),
        bytes(d is None for d in doc_ids), np.array(lengths, dtype="<u8").tobytes(),
        first.astype("<u8").tobytes(), words.astype("<u8").tobytes(), raw.astype("<u8").tobytes(),
    ])


def unpack(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, ids per document, and all ids."""
    if data[:8] != MAGIC:
        raise ValueError("not a file of token ids")
    docs, n, words, blocks, escapes = np.frombuffer(data, "<u8", 5, 8).astype(np.int64).tolist()
    at = 48

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        got = np.frombuffer(data, kind, count, at)
        at += got.nbytes
        return got

    doc_ids, null = take("<i8", docs), take("u1", docs)
    lengths, first, packed, raw = take("<u8", docs), take("<u8", blocks), take("<u8", words), take("<u8", escapes)
    return [None if x else int(d) for d, x in zip(doc_ids, null, strict=True)], lengths.astype(np.int64), decode(packed, first, raw, n)


def write_file(uri: str, data: bytes) -> None:
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    with store.open_output_stream(path) as f:
        f.write(data)


def read_file(uri: str) -> bytes:
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    with store.open_input_stream(path) as f:
        return f.read()


def as_uri(folder: str) -> str:
    return folder if ":/" in folder else f"file://{folder}"


def write_tokens(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, end_id: int | None = END_ID, folder: str | None = None) -> DataFrame:
    """Write the ids of all texts in ascending key order; return the manifest
    ``(part, seq, uri, n_docs, n_ids, start)``, one row per file, ``start``: ids in files before it."""
    spark = docs.sparkSession
    spec = shared_spec(spark, path)
    folder = folder or f"{as_uri(ensure_checkpoint_dir(spark)).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    end = np.array([] if end_id is None else [end_id], dtype="<u4")

    def work(batches):
        enc, me = worker_encoder(spec), TaskContext.get()
        part, attempt = me.partitionId(), me.taskAttemptId()
        seq, doc_ids, lengths, raw, held = 0, [], [], [], 0

        def flush():
            uri = f"{folder}/part-{part:06d}-{seq:06d}-{attempt:08x}.ids"
            write_file(uri, pack(doc_ids, lengths, np.concatenate(raw)))
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "uri": [uri], "n_docs": pa.array([len(doc_ids)], pa.int64()), "n_ids": pa.array([held], pa.int64())})

        for b in slices(batches, "_text"):
            flat, edges = enc.encode_array(b.column("_text"))
            n = np.diff(edges)
            if len(end):  # the end id after each text's ids
                flat = np.insert(flat, edges[1:], end)
            doc_ids += b.column("_key").to_pylist()
            lengths += (n + len(end)).tolist()
            raw.append(flat)
            held += len(flat)
            if held >= FILE_IDS:
                yield flush()
                seq, doc_ids, lengths, raw, held = seq + 1, [], [], [], 0
                give_back_memory()
        if doc_ids:
            yield flush()
        raw = []
        give_back_memory()

    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).repartitionByRange("_key").sortWithinPartitions("_key", "_text")
    files = cut(rows.mapInArrow(work, "part int, seq int, uri string, n_docs long, n_ids long"))
    before = (Window.unboundedPreceding, -1)
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("all"))
    parts = parts.select("part", F.coalesce(F.sum("all").over(Window.orderBy("part").rowsBetween(*before)), F.lit(0)).alias("_p"))
    files = files.join(parts, "part").withColumn("start", F.col("_p") + F.coalesce(F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq").rowsBetween(*before)), F.lit(0))).drop("_p")
    # an explicit number, as a manifest is small but its files are not
    return files.repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), "uri")


def read_tokens(manifest: DataFrame) -> DataFrame:
    """``(doc_id, start, n_tokens, ids)`` of each document, from the files."""

    def work(batches):
        for b in batches:
            for uri, start in zip(b.column("uri").to_pylist(), b.column("start").to_pylist(), strict=True):
                doc_ids, lengths, ids = unpack(read_file(uri))
                ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
                for i in range(0, len(doc_ids), 2000):
                    j = min(i + 2000, len(doc_ids))
                    offsets = pa.array((ends[i : j + 1] - ends[i]).astype(np.int32))
                    lists = pa.ListArray.from_arrays(offsets, pa.array(ids[ends[i] : ends[j]].astype(np.int64)))
                    yield pa.RecordBatch.from_arrays([pa.array(doc_ids[i:j], pa.int64()), pa.array(start + ends[i:j]), pa.array(lengths[i:j]), lists], names=["doc_id", "start", "n_tokens", "ids"])

    return manifest.select("uri", "start").mapInArrow(work, "doc_id long, start long, n_tokens long, ids array<long>")


def token_digests(manifest: DataFrame) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of each document, from the files."""

    def work(batches):
        for b in batches:
            for uri, start in zip(b.column("uri").to_pylist(), b.column("start").to_pylist(), strict=True):
                doc_ids, lengths, ids = unpack(read_file(uri))
                ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
                data = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(data[4 * s : 4 * e]) for s, e in zip(ends.tolist(), ends.tolist()[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(start + ends[:-1]), pa.array(lengths), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return manifest.select("uri", "start").mapInArrow(work, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op8_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(write_tokens(table(spark, sf_dir, "documents")))
