"""Every query with SQL against DuckDB, on the smallest tables."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

from leafcutter.plans import catalog


def canon(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    clean = lambda x: None if isinstance(x, float) and math.isnan(x) else x
    return sorted(columns), sorted(repr(tuple(clean(r[i]) for i in order)) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_same_as_sql(spark, sf, name):
    df = catalog.QUERIES[name](spark, sf)
    got = canon([tuple(r) for r in df.collect()], df.columns)
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.execute(f"CREATE VIEW {f.partition('.')[0]} AS SELECT * FROM '{sf}/{f}'")
    c.execute(catalog.SQL[name])
    assert got == canon(c.fetchall(), [d[0] for d in c.description])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_document_queries(spark, sf, name):
    rows = catalog.QUERIES[name](spark, sf).collect()
    assert rows and not any(r.error_kind for r in rows)
    assert all(r.content.strip() for r in rows)


def test_streaming_file_source_gives_the_batch_rows(spark, tmp_path):
    from leafcutter import api

    (tmp_path / "in").mkdir()
    spark.createDataFrame([(1, "One. Two."), (2, "THREE\n\nfour")], "doc_id long, text string").write.parquet(str(tmp_path / "in" / "p"))
    batch = spark.read.parquet(str(tmp_path / "in" / "p"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in" / "p"))
    q = api.chunk(stream, family="txt", mode="sentence").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out"))
    q.awaitTermination()
    key = lambda df: sorted(map(tuple, df.select("doc_id", "chunk_pos", "content", "metadata").collect()))
    assert key(spark.read.parquet(str(tmp_path / "out"))) == key(api.chunk(batch, family="txt", mode="sentence"))


def test_arriving_files_give_the_batch_rows(spark, tmp_path):
    from leafcutter import api
    from leafcutter.streaming import chunk_stream, write_stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.md").write_bytes(b"# T\n\nbody")
    (tmp_path / "in" / "b.csv").write_bytes(b"full name,size of it\nx,1\n")
    out, where = str(tmp_path / "out"), str(tmp_path / "in")
    for more in (b"one", b"two. three."):
        (tmp_path / "in" / f"{len(more)}.txt").write_bytes(more)
        write_stream(chunk_stream(spark, where), out, str(tmp_path / "cp")).awaitTermination()
    key = lambda df: sorted(map(tuple, df.select("path", "chunk_pos", "content", "metadata").collect()))
    assert key(spark.read.parquet(out)) == key(api.chunk_files(spark, where))
