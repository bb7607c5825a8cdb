"""WARC archives, their capture index, and its external merge.

Writing: each task writes compressed archives (one gzip member per record) to the shared
folder, under names that hold the task attempt, and a locally sorted run of index entries. Of
equal payloads one record is the response, the others are revisits that refer to it.

Merging: the runs are cut at key bounds from a sample (so many entries a range), in ranges of bounded
size; for each range, the runs' pieces are merged by a loser tree on (URL key, timestamp, page), which reads
each piece block by block, so the ranges in order are the captures of the whole table in order, each URL's
history in one stretch. Ranges are cut on the full key, so a URL or host that fills any share of the
rows is spread over ranges.

Reading: the merged index is dealt by archive, and each record that it lists is read at its offset; a
revisit takes its length from the response it refers to, after comparing digests. Neither bodies nor
revisits meet on a payload's key, so a payload of any share of the rows is no task of its own.

Defined cases: a null page is an empty payload; a null URL gets an empty key; of equal
payloads that with the largest ``page_id`` is the response (null is smallest; rows equal in
payload and ``page_id`` are the same capture read twice and get the same type); an empty table gives
an empty result; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from bisect import bisect_right
from datetime import UTC, datetime, timedelta

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, ensure_checkpoint_dir, group_starts, join_few, runs_of, table
from .token_binary import as_uri, read_file, write_file

#: Bytes of an archive; entries of a range of the merge, of the sample for each of its bounds, and of a block.
ARCHIVE_BYTES, RANGE, PER_BOUND, BLOCK = 32_000_000, 200_000, 20, 1024
#: Tasks that read archives at most at a time.
READERS = 20_000
EPOCH = datetime(2020, 1, 1, tzinfo=UTC)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def url_key(url: str | None) -> str:
    """Sort-friendly key: host labels reversed, then path and query; no scheme or fragment."""
    m = re.match(r"(?i)(?:[a-z][a-z0-9+.-]*://)?([^/?#]*)([^#]*)", url or "")
    host, rest = m[1].rpartition("@")[2].lower(), m[2] or "/"
    host, _, port = host.partition(":")
    host = re.sub(r"^www\d*\.", "", host)
    key = ",".join(reversed(host.split(".")))
    return (key + (f":{port}" if port and port not in ("80", "443") else "") + ")" + rest.lower()) if url else ""


def record_id(page: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(f'{page}|{digest}'.encode()).digest())}>"


def record(kind: str, url: str | None, page: int | None, date: str, digest: str, payload: bytes, refers: int | None) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http + payload if kind == "response" else http
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page, digest)}", f"WARC-Date: {date}", f"WARC-Target-URI: {re.sub(r'[\r\n]', '', url or '')}",
        f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if page is not None:
        head.append(f"X-Page-ID: {page}")
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers, digest)}", f"X-Refers-To-Page-ID: {refers}"]
    c = zlib.compressobj(1, zlib.DEFLATED, 31)
    return c.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + c.flush()


def record_at(data: bytes, at: int) -> tuple[dict[str, str], bytes]:
    """Headers and payload of the record that begins at ``at``."""
    view, d, parts = memoryview(data), zlib.decompressobj(31), []
    while not d.eof and at < len(data):  # in pieces, as what is left over is copied
        parts.append(d.decompress(view[at : at + 32_768]))
        at += 32_768
    head, _, rest = b"".join(parts).partition(b"\r\n\r\n")
    headers = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    return headers, rest[: int(headers["Content-Length"])].partition(b"\r\n\r\n")[2]


class LoserTree:
    """Merges sorted sequences with about log2(k) comparisons per item."""

    def __init__(self, sequences: list):
        self.its = [iter(s) for s in sequences]
        self.k = max(1, len(self.its))
        self.heads = [next(i, None) for i in self.its] or [None]
        self.tree = [-1] * self.k
        for i in range(len(self.heads)):
            self._play(i)

    def _less(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return x is not None and (y is None or (x, a) < (y, b))

    def _play(self, winner: int) -> None:
        node = (winner + self.k) // 2
        while node > 0:
            other = self.tree[node]
            if other == -1:  # the first to arrive waits for its opponent
                self.tree[node] = winner
                return
            if self._less(other, winner):
                self.tree[node], winner = winner, other
            node //= 2
        self.tree[0] = winner

    def __iter__(self):
        while (w := self.tree[0]) >= 0 and self.heads[w] is not None:
            yield self.heads[w]
            self.heads[w] = next(self.its[w], None)
            self._play(w)


def write_archives(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", least: int = 0, folder: str | None = None) -> DataFrame:
    """Write all records; return index entries ``(run, pos, k, ts, page, uri, offset)`` in sorted runs."""
    spark = pages.sparkSession
    folder = folder or f"{as_uri(ensure_checkpoint_dir(spark)).rstrip('/')}/warc-{uuid.uuid4().hex}"
    body = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    rows = pages.select(F.col(key).alias("_key"), F.col(url).alias("_url"), body.alias("_body")).withColumn("_sha", F.sha2("_body", 256))
    small = cut(rows.select("_key", "_sha", F.length("_body").alias("_size")))
    groups = small.where(F.col("_size") >= least).groupBy("_sha").agg(F.max("_key").alias("_best"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    again = join_few(small.select("_key", "_sha").distinct(), groups, ["_sha"], "_n", small.count())
    again = again.where(~F.col("_key").eqNullSafe(F.col("_best"))).select(F.col("_key").alias("_k2"), F.col("_sha").alias("_s2"), F.col("_best").alias("_refers"))
    typed = rows.join(again, F.col("_key").eqNullSafe(F.col("_k2")) & (F.col("_sha") == F.col("_s2")), "left").select("_key", "_url", "_body", "_refers")

    def work(batches):
        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        state = {"seq": 0, "data": [], "size": 0, "index": []}

        def flush():
            uri = f"{folder}/part-{part:06d}-{state['seq']:04d}-{attempt:08x}.warc.gz"
            write_file(uri, b"".join(state["data"]))
            entries = sorted(state["index"], key=lambda e: e[:4])
            n = len(entries)
            out = pa.RecordBatch.from_arrays(
                [pa.array([(part << 24) + state["seq"]] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array([e[0] for e in entries]), pa.array([e[1] for e in entries]), pa.array([e[3] if e[2] else None for e in entries], pa.int64()), pa.array([uri] * n), pa.array([e[4] for e in entries], pa.int64())],
                names=["run", "pos", "k", "ts", "page", "uri", "offset"],
            )
            state.update(seq=state["seq"] + 1, data=[], size=0, index=[])
            return out

        for b in batches:
            for page, u, data, refers in zip(*(b.column(c).to_pylist() for c in ("_key", "_url", "_body", "_refers")), strict=True):
                digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
                when = EPOCH + timedelta(seconds=(page or 0) % 1_000_000_000)
                rec = record("response" if refers is None else "revisit", u, page, when.strftime("%Y-%m-%dT%H:%M:%SZ"), digest, data, refers)
                state["index"].append((url_key(u), when.strftime("%Y%m%d%H%M%S"), page is not None, page or 0, state["size"]))
                state["data"].append(rec)
                state["size"] += len(rec)
                if state["size"] >= ARCHIVE_BYTES:
                    yield flush()
        if state["data"]:
            yield flush()

    return cut(typed.mapInArrow(work, "run long, pos int, k string, ts string, page long, uri string, offset long"))


def merge_index(index: DataFrame) -> DataFrame:
    """``(slot, rank, k, ts, page, uri, offset)``: all entries in global order of (slot, rank)."""
    parts = -(-index.count() // RANGE)
    sample = index.orderBy(F.xxhash64("uri", "offset")).limit(PER_BOUND * parts).select("k", "ts", "page").collect() if parts > 1 else []
    keys = sorted((r.k, r.ts, r.page is not None, r.page or 0) for r in sample)
    bounds = [keys[len(keys) * i // parts] for i in range(1, parts)]

    def entry(k, t, p):
        return k, t, p is not None, p or 0

    def place(batches):
        for b in batches:
            rows = zip(*(b.column(c).to_pylist() for c in ("k", "ts", "page")), strict=True)
            slot = [bisect_right(bounds, entry(*r)) for r in rows]
            yield pa.RecordBatch.from_arrays([pa.array(slot, pa.int32()), *b.columns], names=["slot", *b.schema.names])

    def piece(t: pa.Table, start: int, end: int):
        for s in range(start, end, BLOCK):
            block = t.slice(s, min(BLOCK, end - s))
            for i, r in enumerate(zip(*(block.column(c).to_pylist() for c in ("k", "ts", "page")), strict=True)):
                yield entry(*r), s + i

    def merge(batches):
        for t in runs_of(batches, ["slot"]):
            starts = [*group_starts(t, ["slot"]).tolist(), t.num_rows]
            for s, e in zip(starts, starts[1:], strict=False):
                mine = t.slice(s, e - s).combine_chunks()
                runs = [*group_starts(mine, ["run"]).tolist(), mine.num_rows]
                order = np.fromiter((i for _, i in LoserTree([piece(mine, x, y) for x, y in zip(runs, runs[1:], strict=False)])), dtype=np.int64, count=mine.num_rows)
                for x in range(0, len(order), BLOCK):
                    got = mine.take(pa.array(order[x : x + BLOCK])).drop_columns(["run", "pos"])
                    yield from got.add_column(1, "rank", pa.array(np.arange(x, x + got.num_rows))).combine_chunks().to_batches()

    kind = "run long, pos int, k string, ts string, page long, uri string, offset long"
    placed = index.mapInArrow(place, "slot int, " + kind)
    return placed.repartition(max(1, parts), "slot").sortWithinPartitions("slot", "run", "pos").mapInArrow(merge, "slot int, rank long, k string, ts string, page long, uri string, offset long")


READ = {"slot": pa.int32(), "rank": pa.int64(), "page_id": pa.int64(), "kind": pa.string(), "bytes": pa.int64(), "digest": pa.string(), "refers": pa.int64()}


def read_archives(merged: DataFrame) -> DataFrame:
    """``(slot, rank, page_id, kind, bytes, digest, refers)`` of each record that the merged index lists,
    read at its offset. An archive is opened once, by the task that has its entries."""

    def work(batches):
        uri, data = None, b""
        for b in batches:
            out = {c: [] for c in READ}
            for slot, rank, where, at in zip(*(b.column(c).to_pylist() for c in ("slot", "rank", "uri", "offset")), strict=True):
                if where != uri:
                    uri, data = where, read_file(where)
                h, payload = record_at(data, at)
                stated = h["WARC-Payload-Digest"].removeprefix("sha1:")
                real = h["WARC-Type"] == "response"
                if real and base64.b32encode(hashlib.sha1(payload).digest()).decode() != stated:
                    raise ValueError(f"payload of the record at {at} in {uri} does not have its digest")
                page, refers = h.get("X-Page-ID"), h.get("X-Refers-To-Page-ID")
                row = (slot, rank, int(page) if page else None, h["WARC-Type"], len(payload) if real else None, stated, int(refers) if refers else None)
                for c, v in zip(out, row, strict=True):
                    out[c].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, READ[c]) for c, v in out.items()], names=[*out])

    files = merged.select("uri").distinct().count()
    # by number, so that small rows that stand for large files are not put together in one task
    dealt = merged.select("slot", "rank", "uri", "offset").repartitionByRange(max(1, min(files, READERS)), "uri").sortWithinPartitions("uri", "offset")
    return dealt.mapInArrow(work, "slot int, rank long, page_id long, kind string, bytes long, digest string, refers long")


def round_trip(pages: DataFrame, **how) -> DataFrame:
    """Write, merge, read: ``(page_id, payload_bytes, payload_digest, record_type, refers_to)``."""
    seen = cut(read_archives(cut(merge_index(write_archives(pages, **how)))))
    full, again = seen.where("kind = 'response'"), seen.where("kind = 'revisit'")
    asked = again.groupBy("refers", "digest").agg(F.count(F.lit(1)).alias("times"))
    there = full.select(F.col("page_id").alias("refers"), "digest", "bytes").distinct().withColumnRenamed("bytes", "full").join(asked, ["refers", "digest"])
    there = cut(there)
    total = again.count()
    if total != (there.agg(F.sum("times")).first()[0] or 0):
        raise ValueError("a revisit refers to no response with its digest")
    again = join_few(again, there, ["refers", "digest"], "times", total)
    full = full.select("page_id", F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    return full.union(again.select("page_id", "full", "digest", "kind", "refers"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages"))


def _base32_sql(hexed: str) -> str:
    letters = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'"
    parts = [f"substr({letters}, CAST(1 + ((CAST('0x' || substr({hexed}, {10 * g + 1}, 10) AS BIGINT) >> {35 - 5 * k}) & 31) AS BIGINT), 1)" for g in range(4) for k in range(8)]
    return " || ".join(parts)


SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
g AS (SELECT h, max(page_id) AS best FROM p GROUP BY h),
d AS (SELECT p.page_id, g.best, CAST(strlen(p.h) AS BIGINT) AS payload_bytes, sha1(p.h) AS x FROM p JOIN g ON p.h = g.h)
SELECT page_id, payload_bytes, {_base32_sql('x')} AS payload_digest,
       CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> best THEN best END AS refers_to
FROM d
"""
