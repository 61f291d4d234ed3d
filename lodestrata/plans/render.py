"""Pack artifacts: overview, prefixes, records and whole documents.

Blocks and records are made as columns where the files are; only prefixes, which hold a few lines and the
structure tree, are made on the driver.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.functions import text

FORMATS = {"markdown": ".md", "plain": ".txt", "json": ".json", "xml": ".xml", "jsonl": ".jsonl"}
ENCODINGS = ("verbatim", "fence-safe", "base64")
_INTRO = "The same tree always gives the same text."


def canonical(value: object) -> str:
    """JSON with sorted keys and no spaces."""
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def overview(files: DataFrame) -> DataFrame:
    return files.agg(
        F.count_distinct("path").alias("files"),
        F.count_if(F.col("path").endswith(".py")).alias("python_files"),
        F.count_if("is_binary").alias("binary_files"),
        F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("total_bytes"),
    )


@dataclass
class Header:
    """What an artifact says of itself before its files."""

    root_name: str
    encoding_name: str
    content_encoding: str = "fence-safe"
    compressed: bool = False
    line_numbers: bool = False
    minimal: bool = False
    structure: list[str] | None = None
    overview: dict | None = None
    include_files: bool = True
    mode: str = "bundle"
    extra: dict = field(default_factory=dict)

    def selected(self) -> dict | None:
        return None if self.overview is None else self.overview.get("selected")

    def prefix(self, fmt: str, structure: bool = True, about: bool = True) -> str:
        tree = self.structure if structure else None
        chosen = self.selected() if about else None
        facts = {"Root": self.root_name, "Encoding": self.encoding_name, "Compressed": str(self.compressed), "Content encoding": self.content_encoding}
        if fmt == "markdown":
            if self.content_encoding == "verbatim":
                raise ValueError("Markdown needs fence-safe or base64 content")
            out = ["# Code Pack", ""]
            if not self.minimal:
                hints = ("**Structure** shows how the tree is laid out.", "**Files** holds what each path contains; binary files are only named.", "To make this smaller, choose by globs or imports, or compress Python.")
                out += [_INTRO, "", "## How to use", *(f"- {h}" for h in hints), "", "## Summary"]
            out += [f"- {k}: `{v}`" for k, v in facts.items()]
            if chosen:
                out.append("- Selected: {files} files ({python_files} python, {binary_files} binary), {total_bytes} bytes".format(**chosen))
            out.append("")
            if tree is not None:
                out += ["## Structure", "", "```", *tree, "```", ""]
            return "\n".join([*out, *(["## Files"] if self.include_files else [])]) + "\n"
        out = ["CODE_PACK"] + ([] if self.minimal else [_INTRO, ""])
        out += [f"{k.upper().replace(' ', '_')}: {v}" for k, v in facts.items()]
        if chosen:
            out.append("SELECTED: files={files} python={python_files} binary={binary_files} bytes={total_bytes}".format(**chosen))
        out.append("")
        if not self.minimal:
            out += ["NOTES:", "- Chosen paths come first, as a tree; then what they contain.", "- Binary files are only named.", ""]
        if tree is not None:
            out += ["STRUCTURE:", *tree, ""]
        return "\n".join([*out, *(["FILES:"] if self.include_files else [])]) + "\n"

    def jsonl(self, structure: bool = True, about: bool = True) -> str:
        tree = self.structure if structure else None
        kept = ("max_output", "split_output", "representation_rules", "summary_config", "selection_trace")
        meta = {k: self.extra.get(k) for k in kept} | {
            "type": "meta", "schema_version": 2, "fit_to_max_output": self.extra.get("fit_to_max_output", False), "root_name": self.root_name, "mode": self.mode,
            "prefix_style": "minimal" if self.minimal else "standard", "encoding_name": self.encoding_name, "content_encoding": self.content_encoding,
            "overview": self.overview if about else None, "compressed": self.compressed, "line_numbers": self.line_numbers, "include_files": self.include_files,
            "structure_included": tree is not None,
        }
        return canonical(meta) + "\n" + (canonical({"type": "structure", "paths": tree}) + "\n" if tree is not None else "")


def blocks(files: DataFrame, fmt: str, encoding: str) -> DataFrame:
    """(path, text): the block of each file."""
    path, binary, content = F.col("path"), F.col("is_binary"), F.col("content")
    made = text.markdown_block(path, F.col("language"), binary, content, encoding) if fmt == "markdown" else text.plain_block(path, binary, content, encoding)
    return files.select("path", made.alias("text"))


def jsonl_record(files: DataFrame, encoding: str) -> DataFrame:
    """(path, line): the record of each file, keys in order, nulls shown. `summary` is JSON text or null."""
    shown = F.col("representation") == "content"
    body = F.when(shown, text.encoded(F.col("content"), encoding))
    record = F.struct(
        body.alias("content"), F.when(shown, encoding).alias("content_encoding"), "is_binary", "language", "path", "representation", "size_bytes",
        F.lit("\x01").alias("summary"), F.lit("file").alias("type"),
    )
    line = F.to_json(record, {"ignoreNullFields": "false"})
    # A summary is JSON already: it replaces its place-holder.
    line = F.replace(line, F.lit('"summary":"\\u0001"'), F.concat(F.lit('"summary":'), F.coalesce("summary", F.lit("null"))))
    return files.select("path", line.alias("line"))


def json_document(header: Header, rows: Iterable) -> Iterator[str]:
    """Pieces of the JSON document; rows are (path, language, is_binary, content) in order."""
    shown = {"root_name": header.root_name, "overview": header.overview, "encoding_name": header.encoding_name, "compressed": header.compressed, "content_encoding": header.content_encoding}
    before = canonical(shown)
    at = before.index(',"overview"')  # "files" sorts between "encoding_name" and "overview"
    yield before[:at] + ',"files":['
    for k, r in enumerate(rows):
        mine = {"path": r.path, "language": r.language, "is_binary": r.is_binary, "content_encoding": header.content_encoding if header.include_files else None, "content": r.content if header.include_files and not r.is_binary else None}
        yield ("," if k else "") + canonical(mine)
    yield "]" + before[at:-1] + ',"structure_paths":' + canonical(header.structure or []) + "}\n"


def xml_document(header: Header, rows: Iterable) -> Iterator[str]:
    yield f"<code_pack root_name={quoteattr(header.root_name)} encoding={quoteattr(header.encoding_name)} compressed=\"{str(header.compressed).lower()}\" content_encoding={quoteattr(header.content_encoding)}>"
    if header.overview is not None:
        yield f"<overview>{escape(canonical(header.overview))}</overview>"
    if header.structure is not None:
        yield "<structure>" + "".join(f"<path>{escape(p)}</path>" for p in header.structure) + "</structure>"
    yield "<files>"
    for r in rows:
        lang = f" language={quoteattr(r.language)}" if r.language else ""
        head = f"<file path={quoteattr(r.path)}{lang} binary=\"{str(r.is_binary).lower()}\""
        yield f"{head}><content>{escape(r.content or '')}</content></file>" if header.include_files and not r.is_binary else f"{head} />"
    yield "</files></code_pack>\n"
