from __future__ import annotations

import json

import pytest

from leafcutter import api
from leafcutter.operators import txt
from leafcutter.options import ChunkOptions, InvalidArg, ParseError, Unsupported
from leafcutter.sources import csv, epub, html, ipynb, markdown, odf
from leafcutter.sources import json as js
from leafcutter.sources.decode import decode_text

MODES = ("structural", "section", "semantic", "sentence", "page_aware", "sliding_window")
DOC = "INTRODUCTION\n\nFirst paragraph here. It has two sentences.\n\nThis goes on about it.\n\n- one\n- two\n\nTitle two\n-----\n\nHowever, another topic starts."


def test_block_kinds():
    assert [txt.kind(b) for b in txt.blocks(DOC)] == ["heading", "short_disconnected_paragraph", "short_disconnected_paragraph", "bullet_list", "heading", "short_disconnected_paragraph"]
    assert txt.kind("| a | b |\n| c | d |") == "table"
    assert txt.kind("$ x\ngit pull") == "code_block"
    assert txt.kind("IV.") != "heading" and txt.kind("MOBY-DICK;") != "heading" and txt.kind("WARNING") == "heading"


@pytest.mark.parametrize("mode", MODES)
@pytest.mark.parametrize("text", ["", "   ", "\n\n", "﻿".strip("﻿"), "\t \n"])
@pytest.mark.parametrize("name", ["a.txt", "a.md", "a.jsonl"])
def test_empty_documents_give_nothing(name, mode, text):
    assert api.document_chunks(name, text, ChunkOptions(mode=mode)) == []


def test_section_has_preamble_and_path():
    got = api.document_chunks("a.txt", "before\n\n" + DOC, ChunkOptions(mode="section"))
    assert got[0].metadata["section_heading"] == "Preamble"
    assert [c.metadata["chunk_index"] for c in got] == [*range(len(got))]
    assert got[-1].metadata["heading_path"] == ["Title two"]
    assert api.document_chunks("a.md", "before\n\n# H\n\nafter", ChunkOptions(mode="section"))[0].metadata["section_heading"] is None


def test_semantic_reasons():
    got = api.document_chunks("a.txt", DOC, ChunkOptions(mode="semantic"))
    prose = [c for c in got if c.content_type == "semantic"]
    assert prose[0].metadata["merge_reasons"] == ["reference_continuity"] and prose[0].metadata["paragraph_count"] == 2
    assert prose[-1].content.startswith("However")


def test_sliding_window_stops_at_the_end():
    text = "\n\n".join(f"paragraph {i}" for i in range(5))
    got = api.document_chunks("a.txt", text, ChunkOptions(mode="sliding_window", window_size=3, overlap=1))
    assert [c.metadata["paragraph_range"] for c in got] == [[0, 2], [2, 4]]


def test_structural_merges_short_prose_and_keeps_caps():
    text = "\n\n".join("word " * 40 + "." for _ in range(30))
    got = api.document_chunks("a.txt", text, ChunkOptions())
    assert all(len(c.content.encode()) <= 1200 + 350 for c in got)


@pytest.mark.parametrize(("options", "family"), [({"mode": "sliding_window", "window_size": 0}, "txt"), ({"mode": "sliding_window", "overlap": 3}, "md"), ({"mode": "sentence", "sentences_per_chunk": 0}, "txt"), ({"mode": "page_aware", "paragraphs_per_page": 0}, "csv"), ({"mode": "semantic"}, "csv"), ({"mode": "row"}, "txt"), ({"mode": "none"}, "txt")])
def test_bad_arguments_are_refused(options, family):
    with pytest.raises(InvalidArg):
        ChunkOptions(**options).checked(family)


def test_arguments_of_other_modes_are_not_checked():
    ChunkOptions(mode="structural", window_size=0, sentences_per_chunk=0).checked("txt")


def test_unknown_extensions():
    with pytest.raises(Unsupported):
        api.family_of("a.exe")
    with pytest.raises(Unsupported):
        api.family_of("none")


def test_csv_keeps_rows_that_start_with_a_hash():
    data = b"id,item,note\n1,apple,ok\n#2,pear,x\n3,fig,\n4,kiwi,y\n"
    got = csv.chunks(data, ChunkOptions(rows_per_chunk=10))
    assert len(got) == 1 and got[0].metadata["row_count"] == 4
    assert got[0].content.split("\n")[1] == "id: #2 | item: pear | note: x"


def test_csv_without_header_gets_numbers_and_grows():
    got = csv.chunks("1,2\n3,4\n5,6,7\n", ChunkOptions())
    assert got[0].metadata["header_row"] == ["Column 1", "Column 2", "Column 3"] and not got[0].metadata["has_header"]


def test_csv_windows_go_on_to_the_last_row():
    data = "full name,size of it\n" + "".join(f"row{i},{i}\n" for i in range(5))
    got = csv.chunks(data, ChunkOptions(mode="sliding_window", window_size=3, overlap=1))
    assert [(c.metadata["row_start"], c.metadata["row_end"]) for c in got] == [(1, 3), (3, 5), (5, 5)]


@pytest.mark.parametrize(("line", "want"), [("a,b;c", ","), ("a;b;c,d", ";"), ('"a,b,c"|d', "|"), ("a\tb", "\t"), ("abc", ",")])
def test_delimiter(line, want):
    assert csv.delimiter(line) == want


def test_json_members_keep_their_order_and_siblings_reach_the_output():
    assert js.record({"zulu": 1, "alpha": [1, 2], "mike": {"x": None}}) == "- **zulu:** 1\n- **alpha:** 1, 2\n- **mike:**\n  - **x:** null"
    got = js.document_records(b'{"type":"F","bbox":[1,2],"features":[{"a":1}]}')
    assert got[0].startswith("type: F\nbbox: ") and got[1] == "- **a:** 1"


def test_json_lines_drop_record_separators_and_keep_bad_lines():
    assert js.line_records("\x1e{\"id\":1}\n\n{bad\n") == ["- **id:** 1", "{bad"]


@pytest.mark.parametrize(("text", "want"), [
    (r"C:\new\dir", r"C:\new\dir"), (r"\*x\*", "*x*"), ("An unterminated <a href= tag", "An unterminated <a href= tag"), ("<em>x</em>", "x"), ("mail <user@host> or <http://a.b/c>", "mail user@host or http://a.b/c"),
    ("[text](http://x) and ![alt](y)", "text and [Image: alt]"), ("![](y)", "[Image]"), ("**b** *i* ~~s~~ `c` snake_case_name", "b i s c snake_case_name"), ("note[^1] here", "note here"), ('<img alt="A b">', "[Image: A b]"),
])
def test_inline_marks(text, want):
    assert markdown.plain(text) == want


def test_front_matter_goes_only_if_closed():
    assert markdown.front_matter_off("---\ntitle: x\n---\n\n# H\n") == "# H\n"
    assert markdown.front_matter_off("---\ntitle: x\n\n# H\n") == "---\ntitle: x\n\n# H\n"
    assert markdown.front_matter_off("a\n---\nb\n---\n") == "a\n---\nb\n---\n"


def test_markdown_blocks():
    text = "# A\n\npara\n\n- x\n  - y\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n```py\ncode | x\n```\n\nUnder\n=====\nlast"
    assert [k for k, _ in markdown.raw_blocks(text)] == ["heading", "paragraph", "list", "table", "code", "heading", "paragraph"]


@pytest.mark.parametrize("encoding", ["utf-8", "utf-8-sig", "utf-16", "utf-16-le", "cp1252"])
def test_decoding(encoding):
    text = "Grüße, an café\r\nnext" + " plain" * 10
    assert decode_text(text.encode(encoding)) == text.replace("\r\n", "\n")


def test_chunk_frame_isolates_errors(spark):
    rows = [(1, "a.txt", "Hello there."), (2, "b.exe", "x"), (3, "c.json", "{bad"), (4, "d.txt", None), (5, "e.csv", "a,b c d\n1,2\n")]
    df = spark.createDataFrame(rows, "id long, name string, text string")
    got = {r.id: r for r in api.chunk(df, key="id", name="name").collect()}
    assert got[1].content == "Hello there." and json.loads(got[1].metadata)["document_metadata"]["source_type"] == "txt"
    assert got[2].error_kind == "Unsupported" and got[3].error_kind == "Parse" and 4 not in got and got[5].content_type == "row_group"


def test_files_and_markdown(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b"name,size of it\nx|y,1\n")
    (tmp_path / "b.md").write_bytes(b"# T\n\nbody")
    (tmp_path / "c.bin").write_bytes(b"\0")
    got = api.chunk_files(spark, str(tmp_path)).collect()
    assert {r.path.rpartition("/")[2] for r in got} == {"a.csv", "b.md"}
    df = spark.createDataFrame([("a.csv", "name,size of it\nx|y,1\n")], "name string, text string")
    assert api.to_markdown(df, name="name").first().markdown.split("\n")[2] == "| x\\|y | 1 |"


@pytest.mark.parametrize("mode", MODES)
@pytest.mark.parametrize("text", ["", "<html><head><title> </title></head><body><div><span> </span></div></body></html>", "<!-- x", "<script>a<b</script>"])
def test_markup_without_text_gives_nothing(text, mode):
    assert api.document_chunks("a.html", text, ChunkOptions(mode=mode)) == []


def test_html_blocks():
    page = "<h1>A &amp; B</h1><p>one<p>two <b>bold</b><ul><li>x<li>y</ul><pre>c  d\n</pre>loose <i>text</i><div>next</div><script>var t='<q>'</script><style>p{}</style>tail"
    assert [(k, t) for k, t, _, _ in html.blocks(page)] == [("heading", "A & B"), ("paragraph", "one"), ("paragraph", "two bold"), ("list", "x\ny"), ("code", "c  d"), ("paragraph", "loose text\nnext"), ("paragraph", "tail")]


def test_html_nested_table_stays_in_its_cell():
    page = "<table><tr><th>h</th><td>a<table><tr><td>x</td><td>y</td></tr><tr><td>z</td></tr></table></td></tr><tr><td>c</td></tr></table>"
    assert html.blocks(page) == [("table", "h | a x | y / z\nc", None, False)]


def test_html_semantic_starts_with_headings_and_drops_crumbs():
    got = api.document_chunks("a.htm", "<h2>Head</h2><p>First paragraph that is long enough.</p><p>tiny</p><h2>Alone</h2>", ChunkOptions(mode="semantic"))
    assert [c.content_type for c in got] == ["semantic", "heading"]
    assert got[0].metadata["merge_reasons"] == ["heading_merge", "short_paragraph"] and got[1].metadata["has_body_content"] is False


@pytest.mark.parametrize(("data", "want"), [("<meta charset=windows-1251><p>Привет".encode("cp1251"), "Привет"), ("<p>Grüße".encode(), "Grüße"), ("<p>abc</p>".encode("utf-16"), "abc")])
def test_html_charsets(data, want):
    assert html.blocks(html.decode(data))[0][1] == want


def test_html_markdown():
    assert html.markdown("<h2>T</h2><ol><li>a<li>b</ol><table><tr><th>x</th><th>y</th></tr><tr><td>1</td><td>2</td></tr></table>") == "## T\n\n1. a\n2. b\n\n| x | y |\n| --- | --- |\n| 1 | 2 |"


def test_markdown_sentences():
    assert markdown.sentences("Dr. Who came. He left at No 3. Then J. R. R. T. U.S.A. Today? Yes! ok. go") == ["Dr. Who came.", "He left at No 3. Then J.", "R.", "R.", "T.", "U.S.A. Today?", "Yes! ok. go"]


NOTEBOOK = {
    "nbformat": 4, "nbformat_minor": 5, "metadata": {"kernelspec": {"name": "python3", "language": "python"}},
    "cells": [
        {"cell_type": "markdown", "source": ["# Title\n", "text ![x](attachment:a.png)"], "attachments": {"a.png": {"image/png": ["aGVs", "bG8="]}}},
        {"cell_type": "code", "source": "print(1)\n", "outputs": [
            {"output_type": "stream", "text": ["1\n"]}, {"output_type": "display_data", "data": {"image/png": "aGVsbG8=\n", "text/plain": "<Figure>"}},
            {"output_type": "execute_result", "data": {"text/html": "<b>bold</b>  x", "text/plain": "p"}}, {"output_type": "error", "traceback": ["\x1b[31mE\x1b[0m"]}, {"output_type": "odd"},
        ]},
        {"cell_type": "raw", "source": "raw"}, {"cell_type": "code", "source": " "},
    ],
}


def test_notebooks(spark):
    nb = ipynb.load(json.dumps(NOTEBOOK))
    assert nb.markdown == "# Title\ntext ![x](attachment_a.png.png)\n\n```python\nprint(1)\n```\n\n```\n1\n```\n\n![](output_image_1.png)\n\n```\n<Figure>\n```\n\nbold x\n\n```\nE\n```\n\nraw"
    assert nb.images == [("attachment_a.png.png", b"hello"), ("output_image_1.png", b"hello")]
    assert nb.meta["cell_count"] == 4 and nb.meta["code_cell_count"] == 2 and nb.meta["nbformat"] == "4.5"
    df = spark.createDataFrame([(1, "a.ipynb", json.dumps(NOTEBOOK)), (2, "b.ipynb", "{"), (3, "c.txt", "x")], "id long, name string, content string")
    assert [tuple(r) for r in api.images(df, key="id").orderBy("image_pos").collect()] == [(1, 0, "attachment_a.png.png", b"hello"), (1, 1, "output_image_1.png", b"hello")]
    got = api.document_chunks("a.ipynb", json.dumps(NOTEBOOK), ChunkOptions())
    assert {c.metadata["document_metadata"]["kernel"] for c in got} == {"python3"}
    assert ipynb.load('{"worksheets":[{"cells":[{"cell_type":"heading","level":2,"source":"H"},{"cell_type":"code","input":"x"}]}]}').markdown == "## H\n\n```\nx\n```"


def book(**more) -> bytes:
    files = {
        "META-INF/container.xml": '<container xmlns="urn:x"><rootfiles><rootfile full-path="O%20B/c.opf"/></rootfiles></container>',
        "O B/c.opf": """<package xmlns="u" xmlns:dc="d" version="3.0"><metadata><dc:title>T &amp; U</dc:title><dc:creator>A</dc:creator><dc:creator>B</dc:creator><dc:creator>A</dc:creator><dc:language>en</dc:language></metadata>
<manifest><item id="n" href="nav.xhtml" properties="nav"/><item id="one" href="t/1.xhtml"/><item id="gone" href="t/2.xhtml"/><item id="z" href="i/z.png" media-type="image/png"/><item id="a" href="i/a.png" media-type="image/png"/></manifest>
<spine><itemref idref="n"/><itemref idref="one"/><itemref idref="gone"/><itemref idref="none"/></spine></package>""",
        "O B/nav.xhtml": '<html xmlns="h"><body><nav><ol><li><a href="t/1.xhtml">One</a></li></ol></nav></body></html>',
        "O B/t/1.xhtml": "<html><head><title>x</title></head><body><h1>One</h1><p>Body text.</p></body></html>",
        "O B/i/z.png": "zz", "O B/i/a.png": "aa",
    } | more
    import io
    import zipfile

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name, text)
    return out.getvalue()


def test_epub():
    got = api.document_chunks("a.epub", book(), ChunkOptions(mode="section"))
    assert [(c.metadata["spine_index"], c.metadata["is_navigation"], c.content, c.metadata["chunk_index"]) for c in got] == [(0, True, "One", 0), (1, False, "One", 0), (1, False, "Body text.", 1)]
    meta = got[0].metadata["document_metadata"]
    assert meta["title"] == "T & U" and meta["creators"] == ["A", "B"] and meta["skipped_spine_items"] == ["O B/t/2.xhtml", "none (no manifest item)"] and meta["toc"] == [{"title": "One", "href": "t/1.xhtml"}]
    assert epub.load(book()).images == [("O B/i/z.png", b"zz"), ("O B/i/a.png", b"aa")]
    assert api.document_markdown("a.epub", book()) == "# T & U\n\n---\n\nOne\n\n---\n\n# One\n\nBody text."


@pytest.mark.parametrize("data", [b"", b"x" * 100, book()[:200], book(**{"META-INF/container.xml": "<a/>"}), book(**{"O B/c.opf": "<p"})])
def test_broken_epubs_are_parse_errors(data):
    from leafcutter.options import ParseError

    with pytest.raises(ParseError):
        api.document_chunks("a.epub", data, ChunkOptions())


@pytest.mark.parametrize("name", ["a.txt", "a.md", "a.html", "a.csv", "a.tsv", "a.json", "a.jsonl", "a.ipynb", "a.epub", "a.eml", "a.mbox", "a.xlsx"])
@pytest.mark.parametrize("data", [b"", b"\x00\xff\xfe\x80" * 50, b"PK\x03\x04" + bytes(40), b"{" * 3000, b"<div>" * 3000, b"a," * 2000])
def test_garbage_never_crashes(name, data):
    from leafcutter.options import ChunkError

    for mode in ("structural", "sliding_window"):
        try:
            api.document_chunks(name, data, ChunkOptions(mode="row" if name[2:] in ("csv", "tsv", "xlsx") and mode == "structural" else mode))
        except ChunkError:
            pass


EML = b"""From: =?utf-8?q?J=C3=B6rg?= <j@x.org>\r
To: a@x.org, B <b@x.org>\r
Subject: Hi there\r
Date: Mon, 02 Jan 2023 03:04:05 +0100\r
Message-ID: <1@x>\r
References: <0@x> <00@x>\r
MIME-Version: 1.0\r
Content-Type: multipart/mixed; boundary=B\r
\r
--B\r
Content-Type: text/plain; charset=utf-8\r
\r
The body.\r
--B\r
Content-Type: image/png; name=p.png\r
Content-Disposition: attachment; filename=p.png\r
Content-Transfer-Encoding: base64\r
\r
aGVsbG8=\r
--B\r
Content-Type: text/csv; name=t.csv\r
Content-Disposition: attachment; filename=t.csv\r
\r
a,b\r
--B--\r
"""


def test_mail():
    from leafcutter.sources import mail

    got = mail.load(EML)
    assert mail.markdown(got) == "# Hi there\n\n**From:** Jörg <j@x.org>  \n**To:** a@x.org, B <b@x.org>  \n**Date:** 2023-01-02T03:04:05+01:00\n\nThe body.\n\n## Attachments\n\n- p.png (image/png)\n- t.csv (text/csv)\n\na,b"
    assert got.images == [("p.png", b"hello")] and got.meta["references"] == ["0@x", "00@x"] and got.meta["message_id"] == "1@x"
    html_only = b"Subject: s\nContent-Type: text/html\n\n<h1>T</h1><p>x &amp; y</p>"
    assert mail.markdown(mail.load(html_only)) == "# s\n\n# T\n\nx & y"


def test_mailbox():
    from leafcutter.sources import mail

    box = b"From a Mon Jan  2 03:04:05 2023\nSubject: one\n\nFrom here it is prose\n>From quoted\nFrom b 12:00 no header next\n\nFrom c Mon Jan  2 03:04:05 2023\n\x00\x01 garbage\nFrom d 1:2\nSubject: two\n\nsecond\n"
    got = mail.load_mailbox(box)
    assert got.meta["message_count"] == 2 and "From quoted" in got.markdown and ">From" not in got.markdown
    chunks = api.document_chunks("a.mbox", box, ChunkOptions(mode="section"))
    assert {(c.metadata.get("message_index"), c.metadata.get("message_subject")) for c in chunks} >= {(1, "one"), (2, "two")}


def workbook() -> bytes:
    import io
    import zipfile

    m, r = 'xmlns="m" xmlns:r="http://r"', "http://r"
    files = {
        "xl/workbook.xml": f'<workbook {m}><sheets><sheet name="One" sheetId="1" r:id="a"/><sheet name="Bad" sheetId="2" r:id="b"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships xmlns="p"><Relationship Id="a" Target="worksheets/s1.xml"/><Relationship Id="b" Target="worksheets/s2.xml"/></Relationships>',
        "xl/sharedStrings.xml": "<sst><si><t>name</t></si><si><r><t>si</t></r><r><t>ze</t></r><rPh><t>x</t></rPh></si></sst>",
        "xl/styles.xml": '<styleSheet><numFmts><numFmt numFmtId="170" formatCode="yyyy&quot;-&quot;mm"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/></cellXfs></styleSheet>',
        "xl/worksheets/s1.xml": """<worksheet><sheetData>
<row r="2"><c r="B2" t="s"><v>0</v></c><c r="C2" t="s"><v>1</v></c><c r="D2" t="inlineStr"><is><t>when</t></is></c></row>
<row r="3"><c r="B3" t="str"><v>x</v></c><c r="C3"><v>0.30000000000000004</v></c><c r="D3" s="1"><v>44927.5</v></c></row>
<row r="5"><c r="B5" t="b"><v>1</v></c><c r="C5"><v>3</v></c><c r="D5" t="e"><v>#N/A</v></c></row></sheetData></worksheet>""",
        "xl/worksheets/s2.xml": "<worksheet><sheetData>",
    }
    del r
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name, text)
    return out.getvalue()


def test_spreadsheets():
    rows = api.document_chunks("a.xlsx", workbook(), ChunkOptions(rows_per_chunk=1))
    assert [c.content for c in rows] == ["name: x | size: 0.3 | when: 2023-01-01 12:00:00", "name: true | size: 3 | when: #N/A"]
    assert [c.metadata["row_index"] for c in rows] == [2, 4] and rows[0].metadata["skipped_sheets"] == ["Bad"]
    windows = api.document_chunks("a.xlsm", workbook(), ChunkOptions(mode="sliding_window", window_size=2, overlap=1))
    assert [(c.metadata["start_row"], c.metadata["end_row"], c.metadata["actual_row_count"]) for c in windows] == [(2, 4, 2), (4, 4, 1)]
    assert [c.content_type for c in api.document_chunks("a.xlsx", workbook(), ChunkOptions(mode="table"))] == ["table_region", "table_region"]
    assert api.document_chunks("a.xlsx", workbook(), ChunkOptions(mode="sheet", include_headers=False))[0].content == "x | 0.3 | 2023-01-01 12:00:00\ntrue | 3 | #N/A"
    for name, mode in (("a.ods", "row"), ("a.xlsx", "semantic")):
        with pytest.raises(Unsupported):
            api.document_chunks(name, workbook(), ChunkOptions(mode=mode))


def odf_file(kind: str, body: str, meta: str = "", **more) -> bytes:
    import io
    import zipfile

    names = 'xmlns:office="o" xmlns:text="t" xmlns:table="b" xmlns:draw="d" xmlns:xlink="x" xmlns:style="s" xmlns:presentation="p"'
    files = {"mimetype": f"application/vnd.oasis.{odf.KINDS[kind]}", "content.xml": f"<office:document-content {names}>{body}</office:document-content>", "meta.xml": meta} | more
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name, text)
    return out.getvalue()


TABLE = '<table:table><table:table-row><table:table-cell table:number-columns-repeated="2"><text:p>a|b</text:p></table:table-cell><table:table-cell/></table:table-row><table:table-row><table:table-cell/><table:table-cell><text:p>c</text:p><table:table><table:table-row><table:table-cell><text:p>x</text:p></table:table-cell><table:table-cell><text:p>y</text:p></table:table-cell></table:table-row></table:table></table:table-cell></table:table-row></table:table>'


def test_odt():
    styles = '<text:list-style style:name="L1"><text:list-level-style-number/></text:list-style><text:list-style style:name="L2"><text:list-level-style-bullet/></text:list-style>'
    lists = '<text:list text:style-name="L1"><text:list-item><text:p>one</text:p><text:list><text:list-item><text:p>two</text:p></text:list-item></text:list></text:list-item></text:list><text:list text:style-name="L2"><text:list-item><text:p>dot</text:p></text:list-item></text:list>'
    body = styles + '<text:h text:outline-level="2">Head &amp; tail</text:h><text:p>A <text:a xlink:href="http://u">link</text:a><text:s/>end<text:note><text:note-body><text:p>why</text:p></text:note-body></text:note>.</text:p>' + lists + TABLE + '<text:p><draw:frame draw:name="Pic"><draw:image xlink:href="Pictures/p.PNG"/></draw:frame>after</text:p><text:h>Last</text:h>'
    data = odf_file("odt", body, "<m><dc:title>T &amp; U</dc:title></m>", **{"Pictures/p.PNG": "zz"})
    image = odf.load(data, "odt").images
    assert [raw for _, raw in image] == [b"zz"] and image[0][0].endswith(".png")
    want = ["## Head & tail", "A [link](http://u) end.", "1. one", "  1. two", "- dot", "| a\\|b | a\\|b |  |\n| --- | --- | --- |\n|  | c x \\| y |  |", f"![Pic]({image[0][0]})", "after", "# Last", "## Notes", "1. why"]
    assert api.document_markdown("a.odt", data).split("\n\n") == want
    got = api.document_chunks("a.odt", data, ChunkOptions(mode="section"))
    assert {tuple(c.metadata["document_metadata"].items()) for c in got} == {(("source_type", "odt"), ("title", "T & U"), ("creator", None))}
    assert api.document_chunks("a.odt", odf_file("odt", ""), ChunkOptions()) == []


def test_odp_slides_know_their_titles():
    body = "".join(f"<draw:page><text:p>Title {i}</text:p><text:p>Body text of slide {i}.</text:p><presentation:notes><text:p>say {i}</text:p></presentation:notes></draw:page>" for i in (1, 2))
    data = odf_file("odp", body)
    assert api.document_markdown("a.odp", data) == "\n\n".join(f"## Slide {i}\n\nTitle {i}\n\nBody text of slide {i}.\n\n**Notes:** say {i}" for i in (1, 2))
    for mode in ("structural", "section"):
        got = api.document_chunks("a.odp", data, ChunkOptions(mode=mode))
        assert {(c.metadata["slide_number"], (c.metadata["slide_title"] or "")[:7]) for c in got} == {(1, "Title 1"), (2, "Title 2")}, mode
        assert got[0].metadata["document_metadata"]["slide_count"] == 2


def test_odf_errors():
    whole = odf_file("odt", "<text:p>x</text:p>")
    for name, data in (("a.odt", b"junk"), ("a.odp", whole), ("a.odt", odf_file("odt", "<text:p>x")), ("a.odt", odf_file("odt", "<text:p/>", **{"META-INF/manifest.xml": "<manifest:encryption-data/>"}))):
        with pytest.raises(ParseError):
            api.document_chunks(name, data, ChunkOptions())
