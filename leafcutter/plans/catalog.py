"""Queries over the standard tables, one or more per operator, and their SQL where SQL can say it."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import api
from ..functions import native as N
from ..functions import text as T
from ..operators import tabular as R

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def put(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return put


def read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def money(c: str):
    return F.col(c).cast("decimal(18,2)")


# ------------------------------------------------------------ rows and windows

_LINE = """'l_partkey: ' || CAST(l_partkey AS VARCHAR) || ' | l_quantity: ' || CAST(CAST(l_quantity AS DECIMAL(18,2)) AS VARCHAR) || ' | l_returnflag: ' || l_returnflag || ' | l_linestatus: ' || l_linestatus"""


def _lineitem(spark, sf_dir):
    df = read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_returnflag", "l_linestatus")
    return df, R.render_row([("l_partkey", F.col("l_partkey")), ("l_quantity", money("l_quantity")), ("l_returnflag", F.col("l_returnflag")), ("l_linestatus", F.col("l_linestatus"))])


@query(f"""
WITH n AS (SELECT l_orderkey, {_LINE} AS line, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity) AS rn FROM lineitem)
SELECT l_orderkey, (rn - 1) // 3 AS chunk_index, min(rn) AS row_start, max(rn) AS row_end, count(*) AS row_count, string_agg(line, chr(10) ORDER BY rn) AS content
FROM n GROUP BY l_orderkey, (rn - 1) // 3
""")
def rows_tumbling(spark, sf_dir):
    df, line = _lineitem(spark, sf_dir)
    return R.tumbling(df, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_quantity"], line, 3)


@query("""
WITH n AS (SELECT c_nationkey, 'c_name: ' || c_name || ' | c_mktsegment: ' || c_mktsegment AS line, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS rn FROM customer)
SELECT c_nationkey, (rn - 1) // 10 AS chunk_index, min(rn) AS row_start, max(rn) AS row_end, count(*) AS row_count, string_agg(line, chr(10) ORDER BY rn) AS content
FROM n GROUP BY c_nationkey, (rn - 1) // 10
""")
def rows_tumbling_sheets(spark, sf_dir):
    df = read(spark, sf_dir, "customer")
    line = R.render_row([("c_name", F.col("c_name")), ("c_mktsegment", F.col("c_mktsegment"))])
    return R.tumbling(df, ["c_nationkey"], ["c_custkey"], line, 10)


def _window_sql(table: str, group: str, order: str, text: str, w: int, o: int, glue: str, suffixes: bool) -> str:
    step = w - o
    last = f"(n - 1) // {step}" if suffixes else f"greatest(-((-(n - {w})) // {step}), 0)"
    if not suffixes:
        last = f"CASE WHEN n <= {w} THEN 0 ELSE (n - {w} + {step - 1}) // {step} END"
    return f"""
WITH r AS (SELECT {group} AS g, {text} AS t, row_number() OVER (PARTITION BY {group} ORDER BY {order}) - 1 AS i, count(*) OVER (PARTITION BY {group}) AS n FROM {table}),
s AS (SELECT DISTINCT g, n, unnest(generate_series(0, {last})) AS window_index FROM r)
SELECT r.g AS {group}, CAST(s.window_index AS BIGINT) AS window_index, CAST(min(r.i) AS BIGINT) AS first, CAST(max(r.i) AS BIGINT) AS last, count(*) AS n, string_agg(r.t, {glue} ORDER BY r.i) AS content
FROM r JOIN s ON r.g = s.g AND r.i >= s.window_index * {step} AND r.i < s.window_index * {step} + {w}
GROUP BY r.g, s.window_index
"""


@query(_window_sql("conversations", "conv_id", "turn, role, text", "text", 3, 1, "chr(10) || chr(10)", False))
def windows_of_units(spark, sf_dir):
    return R.sliding(read(spark, sf_dir, "conversations"), ["conv_id"], ["turn", "role", "text"], F.col("text"), 3, 1)


@query(_window_sql("lineitem", "l_orderkey", "l_linenumber, l_partkey, l_quantity", _LINE, 4, 2, "chr(10)", True))
def windows_of_rows(spark, sf_dir):
    df, line = _lineitem(spark, sf_dir)
    return R.sliding(df, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_quantity"], line, 4, 2, "\n", suffixes=True)


@query("""
SELECT conv_id, turn, role, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS heading FROM conversations
""")
def heading_forward_fill(spark, sf_dir):
    df = read(spark, sf_dir, "conversations")
    return R.forward_fill(df, ["conv_id"], ["turn", "role", "text"], F.when(F.col("role") == "user", F.col("text")), "heading").select("conv_id", "turn", "role", "heading")


@query("""
WITH n AS (SELECT l_orderkey, l_quantity >= 20 AS f, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity) AS rn FROM lineitem),
k AS (SELECT l_orderkey, rn, rn - row_number() OVER (PARTITION BY l_orderkey ORDER BY rn) AS g FROM n WHERE f),
a AS (SELECT l_orderkey, min(rn) AS first, max(rn) AS last, count(*) AS n FROM k GROUP BY l_orderkey, g)
SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY first) AS island FROM a
""")
def regions_islands(spark, sf_dir):
    df = read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return R.islands(df, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_quantity"], F.col("l_quantity") >= 20)


@query("SELECT DISTINCT ON (l_suppkey) l_suppkey, l_orderkey, l_linenumber FROM lineitem ORDER BY l_suppkey, l_orderkey, l_linenumber")
def keep_first_rows(spark, sf_dir):
    return R.keep_first(read(spark, sf_dir, "lineitem", "l_suppkey", "l_orderkey", "l_linenumber"), ["l_suppkey"], ["l_orderkey", "l_linenumber"])


@query("""
WITH c AS (SELECT source, lang, count(*) AS times FROM documents GROUP BY source, lang)
SELECT source, lang, times FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY times DESC, lang) AS k FROM c) WHERE k = 1
""")
def most_common_reason(spark, sf_dir):
    return R.most_common(read(spark, sf_dir, "documents", "source", "lang"), ["source"], "lang")


@query("""
SELECT a.user_id, a.event_id, max(b.event_id) AS record_start
FROM events a LEFT JOIN events b ON a.user_id = b.user_id AND b.event_type = 'purchase' AND b.event_id <= a.event_id
GROUP BY a.user_id, a.event_id
""")
def record_as_of(spark, sf_dir):
    e = read(spark, sf_dir, "events", "user_id", "event_id", "event_type")
    starts = e.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("start"), F.col("event_id").alias("record_start"))
    return R.as_of(e.select("user_id", "event_id"), starts, ["user_id"], "event_id", "start", "record_start")


@query("""
SELECT 'l_returnflag' AS "column", count(DISTINCT l_returnflag) AS cardinality FROM lineitem
UNION ALL SELECT 'l_linestatus', count(DISTINCT l_linestatus) FROM lineitem ORDER BY 2, 1 LIMIT 1
""")
def category_column(spark, sf_dir):
    return R.category_column(read(spark, sf_dir, "lineitem", "l_returnflag", "l_linestatus"), ["l_returnflag", "l_linestatus"])


@query("""
WITH n AS (SELECT p_brand, p_name, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS rn FROM part)
SELECT p_brand, count(*) AS row_count, string_agg(p_name, chr(10) ORDER BY rn) AS content FROM n GROUP BY p_brand
""")
def category_groups(spark, sf_dir):
    n = R.numbered(read(spark, sf_dir, "part", "p_brand", "p_name", "p_partkey"), ["p_brand"], ["p_partkey"])
    return n.groupBy("p_brand").agg(F.count(F.lit(1)).alias("row_count"), R.ordered_text(F.col("rn"), F.col("p_name"), "\n").alias("content"))


@query("""
SELECT c_custkey, c_name, n_name, r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey
""")
def lookup_joins(spark, sf_dir):
    c, n, r = read(spark, sf_dir, "customer"), read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    return c.join(n, c.c_nationkey == n.n_nationkey, "left").join(r, n.n_regionkey == r.r_regionkey, "left").select("c_custkey", "c_name", "n_name", "r_name")


# ----------------------------------------------------------------- text, native

_STOP = "[" + ", ".join(f"'{w}'" for w in sorted(T.STOPWORDS)) + "]"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SENT = r"list_filter(list_transform(string_split(regexp_replace(text, '([.!?])([ \t\n\r])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda s: regexp_replace(s, '^[ \t\n\r]+|[ \t\n\r]+$', '', 'g')), lambda s: s <> '')"


def _starts_sql(openings: tuple[str, ...], c: str) -> str:
    return "(" + " OR ".join(f"starts_with({c}, '{o}')" for o in openings) + ")"


@query(f"SELECT doc_id, CAST(len({_SENT}) AS BIGINT) AS sentences, array_to_string({_SENT}, chr(1)) AS joined FROM documents")
def sentence_split(spark, sf_dir):
    s = N.sentences(F.col("text"))
    return read(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.size(s).cast("long").alias("sentences"), F.array_join(s, "\u0001").alias("joined"))


@query(f"""
WITH s AS (SELECT doc_id, unnest({_SENT}) AS s, generate_subscripts({_SENT}, 1) AS i FROM documents)
SELECT doc_id, (i - 1) // 3 AS chunk_index, count(*) AS actual_sentence_count, string_agg(s, ' ' ORDER BY i) AS content FROM s GROUP BY doc_id, (i - 1) // 3
""")
def sentence_groups(spark, sf_dir):
    s = read(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", N.sentences(F.col("text")).alias("s"))
    n = F.size("s")
    s = s.where(n > 0).select("doc_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.expr("(size(s) - 1) div 3").cast("int")), lambda i: F.slice("s", i * 3 + 1, 3))).alias("pos", "part"))
    return s.select("doc_id", F.col("pos").cast("long").alias("chunk_index"), F.size("part").cast("long").alias("actual_sentence_count"), F.array_join("part", " ").alias("content"))


@query(f"""
SELECT doc_id, array_to_string(list_sort(list_filter(list_distinct(list_filter(regexp_split_to_array({_LOWER}, '[^a-z0-9]+'), lambda w: length(w) >= 4)), lambda w: NOT list_contains({_STOP}, w))), ' ') AS keywords FROM documents
""")
def keywords_distinct(spark, sf_dir):
    return read(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.array_join(F.array_sort(N.keywords(F.col("text"))), " ").alias("keywords"))


@query(f"""
WITH k AS (SELECT doc_id, list_filter(list_distinct(list_filter(regexp_split_to_array({_LOWER}, '[^a-z0-9]+'), lambda w: length(w) >= 4)), lambda w: NOT list_contains({_STOP}, w)) AS k FROM documents)
SELECT a.doc_id, CAST(len(list_intersect(a.k, b.k)) AS BIGINT) AS shared, len(list_intersect(a.k, b.k)) > 0 AS overlaps FROM k a JOIN k b ON b.doc_id = a.doc_id + 1
""")
def keyword_overlap(spark, sf_dir):
    k = read(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", N.keywords(F.col("text")).alias("k"))
    nxt = k.select((F.col("doc_id") - 1).alias("doc_id"), F.col("k").alias("k2"))
    return k.join(nxt, "doc_id").select("doc_id", F.size(F.array_intersect("k", "k2")).cast("long").alias("shared"), F.arrays_overlap("k", "k2").alias("overlaps"))


@query(f"""
WITH d AS (SELECT conv_id, turn, role, translate(substr(text, 1, 24), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM conversations)
SELECT conv_id, turn, role, CASE WHEN {_starts_sql(T.TRANSITION_BREAKS, 't')} THEN 'break' WHEN {_starts_sql(T.REFERENCE_STARTS, 't')} THEN 'reference_continuity' WHEN {_starts_sql(T.ELABORATION_STARTS, 't')} THEN 'elaboration'
WHEN {_starts_sql(T.EXAMPLE_STARTS, 't')} THEN 'example' WHEN {_starts_sql(T.CAUSE_EFFECT_STARTS, 't')} THEN 'cause_effect' WHEN {_starts_sql(T.CONTRAST_CONTINUATION, 't')} THEN 'contrast_continuation' ELSE 'none' END AS signal FROM d
""")
def merge_signals(spark, sf_dir):
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", N.signal(F.col("text")).alias("signal"))


@query("""
SELECT doc_id, CAST(strlen(text) AS BIGINT) AS bytes, CAST(length(text) AS BIGINT) AS chars,
CASE WHEN strlen(text) > 900 THEN 'long_single_paragraph' WHEN strlen(text) < 90 THEN 'short_disconnected_paragraph' ELSE 'plain_paragraph' END AS kind FROM documents
""")
def prose_class(spark, sf_dir):
    return read(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.octet_length("text").cast("long").alias("bytes"), F.length("text").cast("long").alias("chars"), N.prose_kind(F.col("text")).alias("kind"))


@query(r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
SELECT doc_id, count(*) AS lines, CAST(count(*) FILTER (regexp_matches(line, '^(?:[-*+] |\[[xX ]\]|[0-9]{1,3}[.)].|[A-Za-z][.)].)')) AS BIGINT) AS items,
CAST(count(*) FILTER (contains(line, '|')) AS BIGINT) AS pipes, CAST(count(*) FILTER (regexp_matches(line, '^(?:={4,}|-{4,})$')) AS BIGINT) AS underlines,
CAST(count(*) FILTER (regexp_matches(line, '^#{1,6} ')) AS BIGINT) AS headings, CAST(count(*) FILTER (regexp_matches(line, '^(?:-{3,}|\*{3,}|_{3,})$')) AS BIGINT) AS rules
FROM l GROUP BY doc_id
""")
def line_predicates(spark, sf_dir):
    line = F.explode(F.split("text", "\n")).alias("line")
    x = F.col("line")
    n = lambda c: F.count_if(c)
    return read(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", line).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("lines"), n(N.is_list_item(x)).alias("items"), n(x.contains("|")).alias("pipes"), n(N.is_underline(x)).alias("underlines"),
        n(x.rlike("^#{1,6} ")).alias("headings"), n(x.rlike(r"^(?:-{3,}|\*{3,}|_{3,})$")).alias("rules"),
    )


@query(r"SELECT page_id, regexp_replace(html, '(?s)<!--.*?(?:-->|\z)', '', 'g') AS html FROM pages")
def html_comments_removed(spark, sf_dir):
    return read(spark, sf_dir, "pages", "page_id", "html").select("page_id", N.without_comments(F.col("html")).alias("html"))


@query(r"""
SELECT page_id, regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS title, regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1) AS h1,
CAST(len(regexp_extract_all(html, '<li[ >]')) AS BIGINT) AS items, CAST(len(regexp_extract_all(html, '<p[ >]')) AS BIGINT) AS paragraphs FROM pages
""")
def html_facts(spark, sf_dir):
    n = lambda p: F.regexp_count("html", F.lit(p)).cast("long")
    return read(spark, sf_dir, "pages", "page_id", "html").select("page_id", F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1).alias("title"), F.regexp_extract("html", "(?s)<h1>(.*?)</h1>", 1).alias("h1"), n("<li[ >]").alias("items"), n("<p[ >]").alias("paragraphs"))


@query(r"SELECT doc_id, regexp_replace(regexp_replace(text, '[ \t\n\r]+', ' ', 'g'), '^[ \t\n\r]+|[ \t\n\r]+$', '', 'g') AS text FROM documents")
def whitespace_collapsed(spark, sf_dir):
    return read(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", N.collapse(F.col("text")).alias("text"))


@query("SELECT doc_id, regexp_replace(replace(text, chr(10), chr(13) || chr(10)), chr(13) || chr(10) || '?', chr(10), 'g') AS text FROM documents")
def newlines_normalised(spark, sf_dir):
    crlf = F.replace(F.col("text"), F.lit("\n"), F.lit("\r\n"))
    return read(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", N.newlines(crlf).alias("text"))


@query("SELECT doc_id, text FROM documents")
def front_matter_removed(spark, sf_dir):
    d = read(spark, sf_dir, "documents", "doc_id", "lang", "text")
    return d.select("doc_id", N.without_front_matter(F.concat(F.lit("---\nlang: "), F.col("lang"), F.lit("\n---\n\n"), F.col("text"))).alias("text"))


@query("SELECT doc_id, text FROM documents")
def ansi_removed(spark, sf_dir):
    return read(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", N.without_ansi(F.concat(F.lit("\u001b[1;31m"), F.col("text"), F.lit("\u001b[0m"))).alias("text"))


@query(r"""SELECT page_id, lower(regexp_extract(url, '\.([^./]+)$', 1)) AS extension FROM pages""")
def extension_router(spark, sf_dir):
    return read(spark, sf_dir, "pages", "page_id", "url").select("page_id", N.extension(F.col("url")).alias("extension"))


@query(r"""
WITH d AS (SELECT doc_id, regexp_replace(text, '"(?:[^"]|"")*"', '', 'g') AS t FROM documents),
c AS (SELECT doc_id, length(t) - length(replace(t, ',', '')) AS a, length(t) - length(replace(t, chr(9), '')) AS b, length(t) - length(replace(t, ';', '')) AS s, length(t) - length(replace(t, '|', '')) AS p FROM d)
SELECT doc_id, CASE WHEN a >= greatest(b, s, p) THEN ',' WHEN b >= greatest(s, p) THEN chr(9) WHEN s >= p THEN ';' ELSE '|' END AS delimiter FROM c
""")
def delimiter_sniff(spark, sf_dir):
    return read(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", N.delimiter(F.col("text")).alias("delimiter"))


@query("""
WITH s AS (SELECT s_suppkey, chr(CAST(65 + s_suppkey % 26 AS INTEGER)) AS a, chr(CAST(65 + s_suppkey * 7 % 26 AS INTEGER)) AS b FROM supplier)
SELECT s_suppkey, a || b AS letters, CAST((ascii(a) - 64) * 26 + ascii(b) - 65 AS BIGINT) AS number FROM s
""")
def column_letters(spark, sf_dir):
    s = read(spark, sf_dir, "supplier", "s_suppkey").withColumn("letters", F.concat(F.char((F.col("s_suppkey") % 26 + 65)), F.char((F.col("s_suppkey") * 7 % 26 + 65))))
    return s.select("s_suppkey", "letters", N.column_number(F.col("letters")).alias("number"))


@query("SELECT conv_id, count(*) AS total_chunks, min(turn) AS first, max(turn) AS last, CAST(count(*) FILTER (role = 'user') AS BIGINT) AS headings, array_to_string(list_sort(list(DISTINCT role)), ',') AS block_types FROM conversations GROUP BY conv_id")
def unit_aggregates(spark, sf_dir):
    return read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("total_chunks"), F.min("turn").alias("first"), F.max("turn").alias("last"), F.count_if(F.col("role") == "user").alias("headings"), F.array_join(F.array_sort(F.collect_set("role")), ",").alias("block_types"))


@query("SELECT e.event_id, json_extract_string(props, '$.page') AS page, length(props) AS chars FROM events e")
def json_pointers(spark, sf_dir):
    return read(spark, sf_dir, "events", "event_id", "props").select("event_id", F.get_json_object("props", "$.page").alias("page"), F.length("props").cast("long").alias("chars"))


# -------------------------------------------------------------- whole documents


def _mode(name: str, mode: str, **options) -> None:
    def run(spark, sf_dir):
        return api.chunk(read(spark, sf_dir, "documents", "doc_id", "text"), family="txt", mode=mode, **options)

    run.__name__ = f"txt_{name}"
    QUERIES[run.__name__] = run


for _m in ("structural", "section", "semantic", "sentence", "page_aware", "sliding_window"):
    _mode(_m, _m)


def _html(name: str) -> None:
    def run(spark, sf_dir):
        return api.chunk(read(spark, sf_dir, "pages", "page_id", "html"), key="page_id", content="html", family="html", mode=name)

    run.__name__ = f"html_{name}"
    QUERIES[run.__name__] = run


for _m in ("structural", "section", "semantic", "sentence", "page_aware", "sliding_window"):
    _html(_m)


def _md(name: str) -> None:
    def run(spark, sf_dir):
        c = read(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text").groupBy("conv_id")
        docs = c.agg(R.ordered_text(F.col("turn"), F.concat(F.lit("## "), F.col("role"), F.lit("\n\n"), F.col("text")), "\n\n").alias("text"))
        return api.chunk(docs, key="conv_id", family="md", mode=name)

    run.__name__ = f"md_{name}"
    QUERIES[run.__name__] = run


for _m in ("structural", "section", "semantic", "sentence", "page_aware", "sliding_window"):
    _md(_m)


@query()
def json_records(spark, sf_dir):
    """Events of a user as JSON lines, chunked as records."""
    e = read(spark, sf_dir, "events", "user_id", "event_id", "event_type", "props")
    line = F.to_json(F.struct("event_id", "event_type", "props"))
    docs = e.groupBy("user_id").agg(R.ordered_text(F.col("event_id"), line, "\n").alias("text")).withColumn("name", F.lit("x.jsonl"))
    return api.chunk(docs, key="user_id", name="name")


@query()
def csv_rows(spark, sf_dir):
    """Customers of a nation as delimited text, read back and chunked in row groups."""
    c = read(spark, sf_dir, "customer")
    line = F.concat_ws(",", F.col("c_custkey").cast("string"), "c_name", "c_mktsegment")
    docs = c.groupBy("c_nationkey").agg(F.concat(F.lit("key,customer name,segment\n"), R.ordered_text(F.col("c_custkey"), line, "\n")).alias("text")).withColumn("name", F.lit("x.csv"))
    return api.chunk(docs, key="c_nationkey", name="name")


# The next ones take the path of the API, from bytes to chunks, and compare the chunks themselves.


def _contents(chunks: DataFrame, key: str) -> DataFrame:
    return chunks.select(key, F.col("chunk_pos").cast("long").alias("chunk_pos"), "content", "content_type", "error_kind")


@query("""
WITH r AS (SELECT c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS n,
                  concat('key: ', c_custkey, ' | customer name: ', c_name, ' | segment: ', c_mktsegment) AS line FROM customer)
SELECT c_nationkey, n // 10 AS chunk_pos, string_agg(line, chr(10) ORDER BY n) AS content, 'row_group' AS content_type, CAST(NULL AS VARCHAR) AS error_kind
FROM r GROUP BY ALL
""")
def csv_row_chunks(spark, sf_dir):
    return _contents(csv_rows(spark, sf_dir), "c_nationkey")


@query("""
SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS chunk_pos,
       concat('event_id: ', event_id, chr(10), 'event_type: ', event_type, chr(10), 'props: ', props) AS content, 'bullet_list' AS content_type, CAST(NULL AS VARCHAR) AS error_kind
FROM events
""")
def jsonl_record_chunks(spark, sf_dir):
    return _contents(json_records(spark, sf_dir), "user_id")


@query("""
WITH u AS (SELECT c_nationkey, unnest([2 * row_number() OVER w - 2, 2 * row_number() OVER w - 1]) AS n, unnest([c_mktsegment, 'Number ' || c_custkey || ' buys here.']) AS t, 2 * count(*) OVER (PARTITION BY c_nationkey) AS units
           FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_custkey)),
w AS (SELECT DISTINCT c_nationkey, unnest(range(CASE WHEN units <= 3 THEN 1 ELSE CAST(ceil((units - 3) / 2.0) AS BIGINT) + 1 END)) AS chunk_pos FROM u)
SELECT w.c_nationkey, w.chunk_pos, string_agg(u.t, chr(10) || chr(10) ORDER BY u.n) AS content, 'sliding_window' AS content_type, CAST(NULL AS VARCHAR) AS error_kind
FROM w JOIN u ON u.c_nationkey = w.c_nationkey AND u.n BETWEEN 2 * w.chunk_pos AND 2 * w.chunk_pos + 2 GROUP BY ALL
""")
def md_window_chunks(spark, sf_dir):
    """A Markdown document for each nation, with a heading and a paragraph for each customer, in windows."""
    c = read(spark, sf_dir, "customer", "c_nationkey", "c_custkey", "c_mktsegment")
    part = F.concat(F.lit("## "), "c_mktsegment", F.lit("\n\nNumber "), F.col("c_custkey").cast("string"), F.lit(" buys here."))
    docs = c.groupBy("c_nationkey").agg(R.ordered_text(F.col("c_custkey"), part, "\n\n").alias("text"))
    return _contents(api.chunk(docs, key="c_nationkey", family="md", mode="sliding_window"), "c_nationkey")


def _outline_mode(family: str, mode: str, size: str, glue: str, kind: str, head: str = "heading") -> None:
    """Documents of 50 customers, a heading for each market segment and a paragraph for each customer under it."""
    marks = {"html": ("<h2>", "</h2>", "<p>", "</p>", "\n")}.get(family, ("## ", "", "", "", "\n\n"))

    def run(spark, sf_dir):
        c = read(spark, sf_dir, "customer", "c_custkey", "c_mktsegment").withColumn("k", F.floor(F.col("c_custkey") / 50))
        part = F.concat(F.lit(marks[2] + "Number "), F.col("c_custkey").cast("string"), F.lit(" buys here." + marks[3]))
        under = c.groupBy("k", "c_mktsegment").agg(R.ordered_text(F.col("c_custkey"), part, marks[4]).alias("body"))
        docs = under.groupBy("k").agg(R.ordered_text(F.col("c_mktsegment"), F.concat(F.lit(marks[0]), "c_mktsegment", F.lit(marks[1] + marks[4]), "body"), marks[4]).alias("text"))
        if family == "ipynb":  # one Markdown cell
            docs = docs.select("k", F.to_json(F.struct(F.array(F.struct(F.lit("markdown").alias("cell_type"), F.col("text").alias("source"))).alias("cells"))).alias("text"))
        return _contents(api.chunk(docs, key="k", family=family, mode=mode), "k")

    run.__name__ = f"{family}_{mode}_chunks"
    QUERIES[run.__name__] = run
    SQL[run.__name__] = f"""
WITH c AS (SELECT c_custkey // 50 AS k, c_mktsegment AS s, 'Number ' || c_custkey || ' buys here.' AS t, row_number() OVER (PARTITION BY c_custkey // 50, c_mktsegment ORDER BY c_custkey) - 1 AS n FROM customer),
b AS (SELECT k, s, n // {size} AS part, string_agg(t, {glue} ORDER BY n) AS content FROM c GROUP BY ALL),
a AS (SELECT k, s, part, content, {kind} AS content_type FROM b UNION ALL SELECT DISTINCT k, s, -1, s, '{head}' FROM c)
SELECT k, row_number() OVER (PARTITION BY k ORDER BY s, part) - 1 AS chunk_pos, content, content_type, CAST(NULL AS VARCHAR) AS error_kind FROM a
"""


_PROSE = "CASE WHEN strlen(content) > 900 THEN 'long_single_paragraph' WHEN strlen(content) < 90 THEN 'short_disconnected_paragraph' ELSE 'plain_paragraph' END"
for _f in ("txt", "md", "html", "ipynb"):
    _outline_mode(_f, "structural", "1000", "chr(10)", _PROSE)
    _outline_mode(_f, "section", "1000", "chr(10) || chr(10)", "'section'")
    _outline_mode(_f, "page_aware", "15", "chr(10) || chr(10)", "'page_aware'")
    _outline_mode(_f, "sentence", "3", "' '", "'sentence'")


@query("""
WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(regexp_replace(x, '[ \\t\\r]+', ' ', 'g'))), lambda x: x <> '') AS lines FROM documents)
SELECT doc_id, array_to_string(list_prepend('# Document ' || doc_id, lines), chr(10) || chr(10)) AS markdown FROM l
""")
def odt_markdown(spark, sf_dir):
    """Documents written as OpenDocument files, a heading and a paragraph for each line, and read back."""
    docs = read(spark, sf_dir, "documents", "doc_id", "text")

    def write(batches):
        for b in batches:
            files = [_odt(f"Document {k}", (t or "").split("\n")) for k, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(["x.odt"] * len(files)), pa.array(files, pa.binary())], names=["doc_id", "name", "content"])

    return api.to_markdown(docs.mapInArrow(write, "doc_id long, name string, content binary"), content="content", name="name").select("doc_id", "markdown")


def _odt(title: str, lines: list[str]) -> bytes:
    body = "".join(f"<text:p>{escape(x)}</text:p>" for x in lines)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("mimetype", "application/vnd.oasis.opendocument.text")
        z.writestr("content.xml", f'<office:document-content xmlns:office="o" xmlns:text="t"><text:h text:outline-level="1">{escape(title)}</text:h>{body}</office:document-content>')
    return out.getvalue()


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["txt_structural"](spark, sf_dir)
