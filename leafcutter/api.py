"""Chunks, Markdown and errors of documents in a DataFrame.

A document is a row and one unit of work: its text or bytes are decoded, parsed and grouped in
one step of a Python worker, with no shuffle. A document that cannot be read gives one
row with ``error_kind`` and ``error_message`` and never fails the job.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import replace

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import txt
from .operators.outline import BUILDERS, Chunk
from .options import FAMILIES, FAMILY_OF, ChunkError, ChunkOptions, Unsupported, extension
from .sources import csv, epub, html, ipynb, mail, markdown, odf, xlsx
from .sources import json as json_source
from .sources.decode import decode_text

#: Families that have a loader here.
AVAILABLE = ("txt", "md", "html", "csv", "json", "ipynb", "epub", "eml", "xlsx", "odf")
#: Modes and extensions of a family that have no builder or reader yet.
MISSING_MODES = {"xlsx": ("semantic", "page_aware")}
MISSING_EXTENSIONS = frozenset({"xls", "xlsb", "ods"})


def family_of(name: str) -> str:
    family = FAMILY_OF.get(extension(name))
    if family is None:
        raise Unsupported(f"unsupported file extension: {extension(name)!r}")
    if family not in AVAILABLE or extension(name) in MISSING_EXTENSIONS:
        raise Unsupported(f"no loader for {extension(name)}")
    return family


def _text(data: bytes | str) -> str:
    return data if isinstance(data, str) else decode_text(data)


def _bytes(data: bytes | str) -> bytes:
    return data.encode("utf-8", "surrogateescape") if isinstance(data, str) else data


def document_images(name: str, data: bytes | str) -> list[tuple[str, bytes]]:
    """Images of notebooks, e-books, mail and OpenDocument files, the first of each name."""
    family = family_of(name)
    found: list[tuple[str, bytes]] = []
    if family == "ipynb":
        found = ipynb.load(data).images
    elif family == "epub":
        found = epub.load(_bytes(data)).images
    elif family == "eml":
        found = (mail.load_mailbox if extension(name) == "mbox" else mail.load)(_bytes(data)).images
    elif family == "odf":
        found = odf.load(_bytes(data), extension(name)).images
    return first_of_each(found)


def document_markdown(name: str, data: bytes | str, o: ChunkOptions | None = None) -> str:
    o = o or ChunkOptions()
    family = family_of(name)
    if family == "csv":
        return csv.markdown(data, replace(o, delimiter=o.delimiter or ("\t" if extension(name) == "tsv" else None)))
    if family == "json":
        records = json_source.document_records if extension(name) == "json" else json_source.line_records
        return json_source.markdown(records(data))
    if family == "html":
        return html.markdown(data)
    if family == "ipynb":
        return ipynb.load(data).markdown
    if family == "xlsx":
        return xlsx.markdown(_bytes(data))
    if family == "epub":
        return epub.markdown(_bytes(data))
    if family == "eml":
        return mail.load_mailbox(_bytes(data)).markdown if extension(name) == "mbox" else mail.markdown(mail.load(_bytes(data)))
    if family == "odf":
        return odf.load(_bytes(data), extension(name)).markdown
    return markdown.front_matter_off(_text(data)) if family == "md" else _text(data)


def document_chunks(name: str, data: bytes | str, o: ChunkOptions) -> list[Chunk]:
    """The chunks of one document."""
    family = family_of(name)
    o.checked(family)
    if o.mode in MISSING_MODES.get(family, ()):
        raise Unsupported(f"no {o.mode} mode for {family} yet")
    if family == "xlsx":
        return xlsx.chunks(_bytes(data), o)
    if family == "csv":
        return csv.chunks(data, replace(o, delimiter=o.delimiter or ("\t" if extension(name) == "tsv" else None)))
    if family == "json":
        lines = extension(name) != "json"
        records = (json_source.line_records if lines else json_source.document_records)(data)
        starts, total = [], 0
        for r in records:
            starts.append(total)
            total += len(markdown.blocks(r))
        made = BUILDERS[o.mode](markdown.units(json_source.markdown(records), front_matter=False), markdown.RULES, o)
        for c in made:
            c.metadata["document_metadata"] = {"source_type": extension(name), "record_count": len(records)}
        return made
    if family == "epub":
        return epub.chunks(_bytes(data), o)
    if family == "eml":
        box = mail.load_mailbox(_bytes(data)) if extension(name) == "mbox" else None
        one = None if box else mail.load(_bytes(data))
        made = BUILDERS[o.mode](markdown.units(box.markdown if box else mail.markdown(one), front_matter=False), markdown.RULES, o)
        meta = box.meta if box else {"source_type": "eml", **one.meta, "has_attachments": bool(one.attachments), "attachment_count": len(one.attachments)}
        for c in made:
            c.metadata["document_metadata"] = meta
        return mail.stamp(made, box.infos) if box else made
    if family == "ipynb":
        nb = ipynb.load(data)
        made = BUILDERS[o.mode](markdown.units(nb.markdown, front_matter=False), markdown.RULES, o)
        for c in made:
            c.metadata["document_metadata"] = nb.meta
        return made
    if family == "odf":
        doc = odf.load(_bytes(data), extension(name))
        made = BUILDERS[o.mode](markdown.units(doc.markdown, front_matter=False), markdown.RULES, o)
        for c in made:
            c.metadata["document_metadata"] = doc.meta
        return odf.stamp_slides(made) if extension(name) == "odp" else made
    if family == "html":
        return BUILDERS[o.mode](html.units(data), html.RULES, o)
    text = _text(data)
    rules = txt.RULES if family == "txt" else markdown.RULES
    units = txt.units(text) if family == "txt" else markdown.units(text)
    return BUILDERS[o.mode](units, rules, o)


def chunk(docs: DataFrame, key: str = "doc_id", content: str = "text", name: str | None = None, family: str | None = None, options: ChunkOptions | None = None, **kwargs) -> DataFrame:
    """``(key, chunk_pos, content, content_type, metadata, error_kind, error_message)``.

    ``content``: a STRING or BINARY column. The format comes from the extension in column ``name``
    or from ``family``. ``metadata`` is JSON text. Options are checked here, on the driver,
    where the family is known.
    """
    o = replace(options or ChunkOptions(), **kwargs)
    if family is not None:
        if family not in AVAILABLE:
            raise Unsupported(f"no loader for {family}")
        o.checked(family)
    kind = docs.schema[key].dataType.simpleString()
    label = F.col(name) if name else F.lit("x." + FAMILIES[family or "txt"][0])
    rows = docs.select(F.col(key).alias("_key"), label.alias("_name"), F.col(content).alias("_data"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, pos, text, types, meta, kinds, messages = [], [], [], [], [], [], []
            for r, (n, d) in enumerate(zip(b.column("_name").to_pylist(), b.column("_data").to_pylist(), strict=True)):
                try:
                    made, error = ([] if d is None else document_chunks(n or "", d, o)), None
                except ChunkError as e:
                    made, error = [], (e.kind, str(e))
                except Exception as e:  # a fault in one document must not end the job
                    made, error = [], ("Parse", f"{type(e).__name__}: {e}")
                for i, c in enumerate(made):
                    for column, v in zip((at, pos, text, types, meta, kinds, messages), (r, i, c.content, c.content_type, json.dumps(c.metadata, ensure_ascii=False), None, None), strict=True):
                        column.append(v)
                if error:
                    for column, v in zip((at, pos, text, types, meta, kinds, messages), (r, None, None, None, None, *error), strict=True):
                        column.append(v)
            columns = [b.column("_key").take(pa.array(at, pa.int64())), pa.array(pos, pa.int32()), *(pa.array(c, pa.string()) for c in (text, types, meta, kinds, messages))]
            yield pa.RecordBatch.from_arrays(columns, names=[key, "chunk_pos", "content", "content_type", "metadata", "error_kind", "error_message"])

    return rows.mapInArrow(work, f"`{key}` {kind}, chunk_pos int, content string, content_type string, metadata string, error_kind string, error_message string")


def chunk_files(spark: SparkSession, path: str, **kwargs) -> DataFrame:
    """Chunks of all files under a path that have a known extension."""
    known = "*.{" + ",".join(e for f in AVAILABLE for e in FAMILIES[f]) + "}"
    files = spark.read.format("binaryFile").option("pathGlobFilter", known).option("recursiveFileLookup", "true").load(path)
    return chunk(files, key="path", content="content", name="path", **kwargs)


def first_of_each(found: list[tuple[str, bytes]]) -> list[tuple[str, bytes]]:
    kept: dict[str, bytes] = {}
    for image, raw in found:
        kept.setdefault(image, raw)
    return [*kept.items()]


def images(docs: DataFrame, key: str = "doc_id", content: str = "content", name: str = "name") -> DataFrame:
    """``(key, image_pos, image_name, bytes)`` of the images in notebooks, e-books and mail."""
    kind = docs.schema[key].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, pos, names, data = [], [], [], []
            for r, (n, d) in enumerate(zip(b.column("_name").to_pylist(), b.column("_data").to_pylist(), strict=True)):
                try:
                    found = [] if d is None else document_images(n or "", d)
                except ChunkError:
                    found = []
                for i, (image, raw) in enumerate(found):
                    at.append(r)
                    pos.append(i)
                    names.append(image)
                    data.append(raw)
            yield pa.RecordBatch.from_arrays([b.column("_key").take(pa.array(at, pa.int64())), pa.array(pos, pa.int32()), pa.array(names, pa.string()), pa.array(data, pa.binary())], names=[key, "image_pos", "image_name", "bytes"])

    return docs.select(F.col(key).alias("_key"), F.col(name).alias("_name"), F.col(content).alias("_data")).mapInArrow(work, f"`{key}` {kind}, image_pos int, image_name string, bytes binary")


def to_markdown(docs: DataFrame, content: str = "text", name: str | None = None, family: str | None = None, out: str = "markdown") -> DataFrame:
    """``docs`` with each document's Markdown, ``error_kind`` and ``error_message``; Markdown is null
    for a null document and where it cannot be read, and only then is there an error."""
    label = F.col(name) if name else F.lit("x." + FAMILIES[family or "txt"][0])

    @F.pandas_udf("markdown string, error_kind string, error_message string")
    def convert(data, names):
        import pandas as pd

        def one(n, d):
            try:
                return (None if d is None else document_markdown(n or "", d)), None, None
            except ChunkError as e:
                return None, e.kind, str(e)
            except Exception as e:
                return None, "Parse", f"{type(e).__name__}: {e}"

        return pd.DataFrame([one(n, d) for n, d in zip(names, data, strict=True)], columns=["markdown", "error_kind", "error_message"])

    convert.func.__annotations__ = {}
    rows = docs.withColumn(out, convert(F.col(content), label))
    return rows.withColumns({"error_kind": F.col(f"`{out}`.error_kind"), "error_message": F.col(f"`{out}`.error_message"), out: F.col(f"`{out}`.markdown")})
