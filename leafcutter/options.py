"""Options of a chunking call, checked on the driver before any job is planned."""

from __future__ import annotations

from dataclasses import dataclass

MODES = ("default", "structural", "section", "semantic", "sentence", "page_aware", "sliding_window", "row", "table", "sheet")

TEXT_MODES = frozenset(MODES[:7])
ROW_MODES = frozenset({"default", "row", "sliding_window", "page_aware"})
SHEET_MODES = ROW_MODES | {"semantic", "table", "sheet"}

#: Extensions of each family.
FAMILIES = {
    "csv": ("csv", "tsv"),
    "xlsx": ("xlsx", "xls", "xlsm", "xlsb", "ods", "xltx", "xltm"),
    "md": ("md",), "txt": ("txt",), "html": ("html", "htm"),
    "docx": ("docx", "docm", "dotx", "dotm"),
    "pptx": ("pptx", "potx", "potm", "ppsx", "ppsm"),
    "json": ("json", "jsonl", "ndjson"), "eml": ("eml", "mbox"), "odf": ("odt", "odp"),
    "ipynb": ("ipynb",), "rtf": ("rtf",), "epub": ("epub",), "msg": ("msg",), "doc": ("doc",), "ppt": ("ppt",), "pdf": ("pdf",),
}
FAMILY_OF = {ext: family for family, exts in FAMILIES.items() for ext in exts}


class ChunkError(Exception):
    kind = "Parse"


class Unsupported(ChunkError):
    kind = "Unsupported"


class InvalidArg(ChunkError):
    kind = "InvalidArg"


class ParseError(ChunkError):
    kind = "Parse"


def extension(name: str) -> str:
    return name.rpartition(".")[2].lower() if "." in name else ""


@dataclass(frozen=True)
class ChunkOptions:
    mode: str = "default"
    window_size: int = 3
    overlap: int = 1
    sentences_per_chunk: int = 3
    paragraphs_per_page: int = 15
    rows_per_chunk: int = 10
    include_headers: bool = True
    delimiter: str | None = None
    encoding: str = "auto"
    skip_empty_rows: bool = True

    def checked(self, family: str) -> ChunkOptions:
        """Itself, or an error: only what the mode uses is checked."""
        if self.mode not in MODES:
            raise InvalidArg(f"unknown mode {self.mode!r}")
        allowed = ROW_MODES if family == "csv" else SHEET_MODES if family == "xlsx" else TEXT_MODES
        if self.mode not in allowed:
            raise InvalidArg(f"mode {self.mode!r} is not supported for {family}")
        if self.mode == "sliding_window":
            if self.window_size < 1:
                raise InvalidArg("window_size must be greater than 0")
            if not 0 <= self.overlap < self.window_size:
                raise InvalidArg("overlap must be less than window_size")
        if self.mode == "sentence" and self.sentences_per_chunk < 1:
            raise InvalidArg("sentences_per_chunk must be greater than 0")
        if self.mode == "page_aware" and self.paragraphs_per_page < 1:
            raise InvalidArg("paragraphs_per_page must be greater than 0")
        if self.mode in ("row", "default") and family in ("csv", "xlsx") and self.rows_per_chunk < 1:
            raise InvalidArg("rows_per_chunk must be greater than 0")
        return self
