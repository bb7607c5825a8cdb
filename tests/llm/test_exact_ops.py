"""Operators whose results are defined exactly: against SQL, libraries or round trips."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafcutter.llm import bpe, exact_dedup, mixing, registry, token_binary, warc

from ..test_catalog import canon


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_as_sql(spark, sf, name):
    import os

    import duckdb

    df = registry.queries()[name](spark, sf)
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.execute(f"CREATE VIEW {f.partition('.')[0]} AS SELECT * FROM '{sf}/{f}'")
    c.execute(registry.oracle_sql()[name])
    want = canon(c.fetchall(), [d[0] for d in c.description])
    assert canon([tuple(r) for r in df.collect()], df.columns) == want


ODD = [
    (1, "a b c", "s1", "x"), (2, "a b c", "s1", "y"), (2, "a b c", "s1", "y"), (None, "a b c", None, "z"), (3, None, "s2", None), (4, "", None, "w"),
    (5, "word " * 3000, "s1", "v"), (None, None, None, None),
]
SCHEMA = "doc_id long, text string, source string, TEXT_ string"


def test_mixing_odd_rows(spark):
    df = spark.createDataFrame(ODD, SCHEMA)
    got = mixing.mix_plan(df, size=mixing.n_words(F.col("text"))).collect()
    assert len(got) == len(ODD)
    by = {}
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        k = by.setdefault(r.source, [r.target, 0])
        k[1] += r.taken
    assert all(int(t) == n for t, n in by.values())
    assert sum(t for t, _ in by.values()) == pytest.approx(sum(r.size for r in got))
    out = mixing.mix(df)
    assert out.columns == df.columns
    words = out.select(F.sum(mixing.n_words(F.col("text")))).first()[0]
    assert words == sum(n for _, n in by.values())
    assert mixing.mix(df.limit(0)).count() == 0




def test_exact_dedup_odd_rows(spark):
    df = spark.createDataFrame(ODD, SCHEMA)
    got = exact_dedup.exact_duplicates(df).collect()
    assert len(got) == len(ODD)
    groups = {}
    for r in got:
        groups.setdefault(r.text_sha256, []).append(r)
    assert sorted(len(g) for g in groups.values()) == [1, 3, 4]
    for g in groups.values():
        assert sum(r.kept for r in g) == 1 and {r.group_size for r in g} == {len(g)}
        assert {r.keep_id for r in g} == {max((r.doc_id for r in g if r.doc_id is not None), default=None)}
    assert exact_dedup.exact_duplicates(df.limit(0)).count() == 0


def test_rice_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 500):
        v = np.unique(rng.integers(0, 1 << 44, n).astype(np.uint64))
        assert (exact_dedup.rice_decode(exact_dedup.rice_encode(v, exact_dedup.rice_width(v, 1 << 44))) == v).all()


@pytest.mark.parametrize("high", [2, 40, 49_408, 2**40, 2**64 - 1])
def test_simple8b_round_trip(high):
    rng = np.random.default_rng(2)
    for n in (0, 1, 127, 128, 129, 5000):
        v = rng.integers(0, high, n, dtype=np.uint64, endpoint=True)
        v[rng.random(n) < 0.3] = 0
        words, first, raw = token_binary.encode(v)
        assert (token_binary.decode(words, first, raw, n) == v).all()
        if n == 5000:
            assert (token_binary.decode(words, first, raw, n, slice(3, 7)) == v[3 * 128 : 7 * 128]).all()


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_path())


def test_encoder_is_the_library():
    lib, enc = library(), bpe.Encoder(open(bpe.default_path()).read())
    random.seed(3)
    texts = ["", " \n\t", "it's I'LL don't 12ab", "x<|endoftext|>y <|startoftext|>", "Ω ΑΣ é é \x1c\x85 世界 🙂", "\r\x0b\x0c", "ß Ÿ ÿ µ ª × ÷", "a" * 5000]
    for alphabet in ("ab", "thein", "0a!", "aé世🙂"):
        texts += ["".join(random.choice(alphabet) for _ in range(n)) for n in (1025, 2600)]
    ids = [np.frombuffer(x, "<u4").tolist() for x in enc.encode_bytes(texts)]
    want = [lib.encode(t, add_special_tokens=False).ids for t in texts]
    assert ids == want
    assert [enc.decode(i).decode() for i in ids] == [lib.decode(i, skip_special_tokens=False) for i in ids]


def test_tree_concatenation_joins_exactly():
    lib, enc = library(), bpe.Encoder(open(bpe.default_path()).read())
    random.seed(4)
    for alphabet in ("ab", "the", "abcdefghijklmnop"):
        for n in (65, 300, 1000):
            s = "".join(random.choice(alphabet) for _ in range(n))
            assert enc.tree(s, leaf=32) == lib.encode(s, add_special_tokens=False).ids


def test_token_files_and_bpe_odd_rows(spark):
    lib, df = library(), spark.createDataFrame(ODD, SCHEMA)
    order = sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    got = sorted(token_binary.token_digests(token_binary.write_tokens(df)).collect(), key=lambda r: r.start)
    start = 0
    for r, (doc, text, *_) in zip(got, order, strict=True):
        ids = lib.encode(text or "", add_special_tokens=False).ids + [1]
        assert tuple(r) == (doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    full = token_binary.read_tokens(token_binary.write_tokens(df)).collect()
    assert sorted(len(r.ids) for r in full) == sorted(r.n_tokens for r in got)
    enc = {(r.doc_id, r.n_tokens, r.ids_sha256) for r in bpe.encode_decode(df).collect()}
    assert enc == {(d, len(i := lib.encode(t or "", add_special_tokens=False).ids), hashlib.sha256(" ".join(map(str, i)).encode()).hexdigest()) for d, t, *_ in ODD}
    assert token_binary.token_digests(token_binary.write_tokens(df.limit(0))).count() == 0
    assert bpe.encode_documents(df).columns == [*df.columns, "ids"]


def test_loser_tree():
    random.seed(5)
    for k in (0, 1, 2, 3, 5, 9):
        runs = [sorted(random.randint(0, 30) for _ in range(random.randint(0, 12))) for _ in range(k)]
        assert list(warc.LoserTree(runs)) == sorted(x for r in runs for x in r)


def test_warc_odd_rows_and_order(spark):
    rows = [(1, "http://www.A.example/x?q#f", "é"), (2, "http://b.example/", "é"), (2, "http://b.example/", "é"), (3, None, None), (None, "x", ""), (4, "http://a.example/x", "z" * 50_000), (5, "http://a.example/\r\nx", "e\r\n\r\nf")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted(map(tuple, warc.round_trip(df).collect()), key=str)
    b32 = lambda s: __import__("base64").b32encode(hashlib.sha1(s.encode()).digest()).decode()
    best = {"é": 2, "": 3, "z" * 50_000: 4, "e\r\n\r\nf": 5}
    want = [(p, len((h or "").encode()), b32(h or ""), "response" if p == best[h or ""] else "revisit", None if p == best[h or ""] else best[h or ""]) for p, _, h in rows]
    assert got == sorted(want, key=str)
    merged = warc.merge_index(warc.write_archives(df)).orderBy("slot", "rank").collect()
    keys = [(r.k, r.ts, r.page is not None, r.page or 0) for r in merged]
    assert keys == sorted(keys) and len(keys) == len(rows)
    assert warc.round_trip(df.limit(0)).count() == 0
