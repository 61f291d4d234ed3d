"""Skeletons: catalogues of a tree's packages, modules and symbols, at three levels of detail.

`hierarchy` has packages only; `modules` adds names, docs, classes and methods; `signatures` adds
parameters, imports, constants and attributes. Symbols stay in a DataFrame; the writer goes through
it package by package, so no more than one package's document is ever on the driver.
"""

from __future__ import annotations

import hashlib
import json
import os
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby
from pathlib import Path
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions import ignore, pysource, tokens
from lodestrata.operators import compare, graph, packages
from lodestrata.plans import render
from lodestrata.plans.pack import fail, replace_directory
from lodestrata.sources import tree

VERSION = "1"
DEFAULT_EXCLUDE = tuple(sorted({"__pycache__", "*.pyc"} | {f".{name}" for name in ("skeleton", "git", "venv", "ruff_cache", "pytest_cache", "mypy_cache")}))


class Formatter(Protocol):
    """A format of a skeleton's documents: the ending of its files, and their text."""

    suffix: str

    def hierarchy(self, document: dict) -> str: ...

    def modules(self, document: dict, rows: list, full: bool) -> str:
        """document: a package's modules at the skeleton's level; rows: the same as rows of symbols; full: with signatures."""


#: What a skeleton can be written as, by name.
FORMATS: dict[str, Formatter] = {}


def register(name: str, formatter: Formatter) -> None:
    """From now on the format can be asked for by that name."""
    if any(f.suffix == formatter.suffix and n != name for n, f in FORMATS.items()):
        raise ValueError(f"another format has the ending {formatter.suffix}")
    FORMATS[name] = formatter


class SkeletonError(ValueError):
    """Sources that don't make a skeleton, or one that isn't as it should be."""


@dataclass
class Skeleton:
    level: str
    sources: list[str]
    packages: DataFrame
    modules: DataFrame
    metadata: dict

    def module(self, name: str) -> DataFrame:
        """The row of a module by its name; no row if there is none."""
        return packages.get(self.modules, "module", name)

    def package(self, name: str) -> DataFrame:
        return packages.get(self.packages, "name", name)


def generate(spark: SparkSession, sources: list[str], level: str = "modules", exclude: list[str] | None = None, symlinks: str = "forbid", encoding: str = tokens.APPROXIMATE) -> Skeleton:
    if level not in pysource.LEVELS:
        raise SkeletonError(f"level must be one of {', '.join(pysource.LEVELS)}")
    rules = ignore.compile_rules(exclude or DEFAULT_EXCLUDE)
    roots = [os.path.abspath(s) for s in sources]
    entries = None
    for k, root in enumerate(roots):
        each = tree.decided(tree.scan(spark, root, symlinks, rules=rules, ending=".py"), rules).where("decision = 'included' and not is_dir and endswith(path, '.py')")
        each = each.select("path", F.lit(k).alias("source"), F.validate_utf8(F.col("content").cast("string")).alias("content"))
        entries = each if entries is None else entries.unionByName(each)
    entries = graph.cut(entries)
    found = packages.modules(entries)
    if clash := packages.collisions(found.where("not is_package")).orderBy("module").collect():
        raise SkeletonError("several sources have " + ", ".join(r.module for r in clash))
    plain = found.where("not is_package").join(entries.select("path", "source", "content"), ["path", "source"])
    parsed = pysource.extract(plain.select("module", "package", "path", "source", "content"))
    if level == "hierarchy":
        parsed = parsed.where("false")
    symbols = graph.cut(parsed)
    fail(symbols, "can't parse")
    made = graph.cut(packages.package_tree(found))
    sums = packages.totals(symbols).first().asDict() | {"total_modules": found.where("not is_package").count(), "total_packages": made.count()}
    one = Skeleton(level, roots, made, symbols, {"generator_version": VERSION, "resolution": level} | sums)
    one.metadata["token_estimate"] = _estimate(one, encoding) + tokens.count(render.canonical(hierarchy_document(one, roots)), encoding)
    return one


def _estimate(skeleton: Skeleton, encoding: str) -> int:
    """Tokens of all documents of packages but the hierarchy: each module's text is counted where it lies."""
    if skeleton.level == "hierarchy":
        return 0
    rows, level = skeleton.modules.drop("edges", "positions", "error"), skeleton.level

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [render.canonical({r.module.rsplit(".", 1)[-1]: _module(r, level)}) for r in map(_as_row, batch.to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])

    counted = rows.mapInArrow(run, "text string").agg(F.sum(tokens.count_column(F.col("text"), encoding))).first()[0] or 0
    named = rows.select("package").distinct().select(F.concat(F.lit('{"modules":{},"package":"'), "package", F.lit('"}')).alias("text"))
    return counted + (named.agg(F.sum(tokens.count_column(F.col("text"), encoding))).first()[0] or 0)


def _as_row(value: object) -> object:
    """Nested dictionaries as rows, so that a worker makes the same documents as the driver."""
    if isinstance(value, dict):
        return Row(**{k: _as_row(v) for k, v in value.items()})
    return [_as_row(v) for v in value] if isinstance(value, list) else value


def hierarchy_document(skeleton: Skeleton, sources: list[str]) -> dict:
    order = ("generator_version", "sources", "resolution", "total_packages", "total_modules", "total_classes", "total_functions", "token_estimate")
    known = skeleton.metadata | {"sources": sources}
    rows = skeleton.packages.orderBy("name").toLocalIterator()
    return {"metadata": {k: known.get(k) for k in order}, "packages": {r.name: {"subpackages": list(r.subpackages), "modules": list(r.modules)} for r in rows}}


def _kept(pairs: list[tuple[str, object]]) -> dict:
    return {k: v for k, v in pairs if v}


def _plain(row) -> dict:
    return {k: v for k, v in row.asDict(recursive=True).items() if v is not None}


def _function(f, full: bool) -> dict:
    basic = [("doc", f.doc), ("decorators", f.decorators), ("async", f.is_async)]
    detail = [("signature", f.signature), ("returns", f.returns), ("parameters", [_plain(p) for p in f.parameters])] if full else []
    return {"name": f.name, "line": f.line} | _kept(basic + detail)


def _sorted(symbols: list) -> list:
    return sorted(symbols, key=lambda s: (s.line, s.name))


def _class(c, full: bool) -> dict:
    pairs = [("doc", c.doc), ("bases", c.bases), ("decorators", c.decorators), ("dataclass", c.is_dataclass), ("pydantic", c.is_pydantic)]
    pairs += [("methods", [_function(m, full) for m in _sorted(c.methods)]), ("attributes", [_plain(a) for a in c.attributes] if full else [])]
    return {"name": c.name, "line": c.line} | _kept(pairs)


def _module(row, level: str) -> dict:
    full = level == "signatures"
    first = [("doc", row.doc), ("imports", row.imports if full else []), ("constants", [_plain(c) for c in row.constants] if full else [])]
    rest = [("classes", [_class(c, full) for c in _sorted(row.classes)]), ("functions", [_function(f, full) for f in _sorted(row.functions)])]
    return {"path": row.path, "source": row.source} | _kept(first + rest)


def _by_package(skeleton: Skeleton) -> Iterator[tuple[str, list]]:
    rows = skeleton.modules.drop("edges", "positions", "error").orderBy("package", "module").toLocalIterator()
    for name, group in groupby(rows, key=lambda r: r.package):
        yield name, list(group)


def module_documents(skeleton: Skeleton) -> Iterator[tuple[str, dict]]:
    for name, rows in _by_package(skeleton):
        yield name, {"package": name, "modules": {r.module.rsplit(".", 1)[-1]: _module(r, skeleton.level) for r in rows}}


def _markdown_hierarchy(document: dict) -> str:
    m = document["metadata"]
    totals = " | ".join(f"{k.title()}: {m['total_' + k]}" for k in ("packages", "modules", "classes", "functions"))
    out = ["# Skeleton", "", f"Sources: {', '.join(m['sources'])} | {totals}", "", f"**Token Estimate:** ~{m['token_estimate']:,}", "", "## Package Hierarchy", ""]
    for name, package in document["packages"].items():
        out += [f"### {name}", ""]
        for title in ("Subpackages", "Modules"):
            if held := package[title.lower()]:
                out += [f"**{title}:** {', '.join(held)}", ""]
    return "\n".join(out)


def _markdown_module(row, full: bool) -> list[str]:
    out = [f"## {row.module.rsplit('.', 1)[-1]}", "", f"**Path:** `{row.path}`", "", *([f"> {row.doc}", ""] if row.doc else [])]
    call = lambda f: f"`{f.name}{f.signature if full and f.signature else '()'}`"
    if row.classes:
        out += ["### Classes", ""]
        for c in row.classes:
            out += [f"#### `@{', @'.join(c.decorators)}`"] if c.decorators else []
            out.append(f"#### `class {c.name}{'(' + ', '.join(c.bases) + ')' if c.bases else ''}` (line {c.line})")
            out += [f"> {c.doc}"] if c.doc else []
            if c.methods:
                out += ["", "**Methods:**"]
            for m in c.methods:
                marks = ("async " if m.is_async else "") + (f"@{m.decorators[0]} " if m.decorators else "")
                out.append(f"- {marks}{call(m)} (line {m.line})")
            out.append("")
    if row.functions:
        out += ["### Functions", ""]
        for f in row.functions:
            out += [f"`@{', @'.join(f.decorators)}`"] if f.decorators else []
            out += [f"#### {'async ' if f.is_async else ''}{call(f)} (line {f.line})", *([f"> {f.doc}"] if f.doc else []), ""]
    return out


class _Json:
    suffix = ".json"

    def hierarchy(self, document: dict) -> str:
        return json.dumps(document | {"$schema": "schemas/hierarchy.schema.json"}, indent=2, ensure_ascii=False) + "\n"

    def modules(self, document: dict, rows: list, full: bool) -> str:
        return json.dumps(document | {"$schema": "../schemas/module.schema.json"}, indent=2, ensure_ascii=False) + "\n"


class _Yaml:
    suffix = ".yaml"

    def hierarchy(self, document: dict) -> str:
        import yaml

        return yaml.safe_dump(document, allow_unicode=True, sort_keys=False, default_flow_style=False, width=1 << 20)

    def modules(self, document: dict, rows: list, full: bool) -> str:
        return self.hierarchy(document)


class _Markdown:
    suffix = ".md"

    def hierarchy(self, document: dict) -> str:
        return _markdown_hierarchy(document)

    def modules(self, document: dict, rows: list, full: bool) -> str:
        return "\n".join([f"# Package: {document['package']}", "", *(x for r in rows for x in _markdown_module(r, full))])


register("yaml", _Yaml())
register("json", _Json())
register("markdown", _Markdown())


def schemas() -> dict[str, dict]:
    """Closed JSON schemas of both kinds of documents."""
    base = {"$schema": "http://json-schema.org/draft-07/schema#", "type": "object", "additionalProperties": False}
    strings, optional = {"type": "array", "items": {"type": "string"}}, {"type": ["string", "null"]}
    counts = {f"total_{k}": {"type": "integer", "minimum": 0} for k in ("packages", "modules", "classes", "functions")}
    meta = {"generator_version": {"type": "string"}, "sources": strings, "resolution": {"enum": list(pysource.LEVELS)}, **counts, "token_estimate": {"type": "integer", "minimum": 0}}
    closed = lambda properties, required: {"type": "object", "additionalProperties": False, "required": required, "properties": properties}
    package = closed({"subpackages": strings, "modules": strings}, ["subpackages", "modules"])
    attribute = closed({"name": {"type": "string"}, "line": {"type": "integer"}, "doc": optional, "annotation": optional, "default": optional}, ["name", "line"])
    parameter = closed({"name": {"type": "string"}, "annotation": optional, "default": optional, "kind": {"type": "string"}}, ["name", "kind"])
    named = {"name": {"type": "string"}, "line": {"type": "integer"}, "doc": {"type": "string"}, "decorators": strings}
    function = closed({**named, "async": {"const": True}, "signature": {"type": "string"}, "returns": {"type": "string"}, "parameters": {"type": "array", "items": parameter}}, ["name", "line"])
    flags = {"dataclass": {"const": True}, "pydantic": {"const": True}}
    klass = closed({**named, "bases": strings, **flags, "methods": {"type": "array", "items": function}, "attributes": {"type": "array", "items": attribute}}, ["name", "line"])
    lists = {"imports": strings, "constants": {"type": "array", "items": attribute}, "classes": {"type": "array", "items": klass}, "functions": {"type": "array", "items": function}}
    module = closed({"path": {"type": "string"}, "source": {"type": "integer"}, "doc": {"type": "string"}, **lists}, ["path", "source"])
    where = {"$schema": {"type": "string"}}
    return {
        "hierarchy.schema.json": base | {"required": ["metadata", "packages"], "properties": where | {"metadata": closed(meta, list(meta)), "packages": {"type": "object", "additionalProperties": package}}},
        "module.schema.json": base | {"required": ["package", "modules"], "properties": where | {"package": {"type": "string"}, "modules": {"type": "object", "additionalProperties": module}}},
    }


def write(skeleton: Skeleton, directory: str, formats: list[str], base: str | None = None) -> None:
    """Writes all documents beside the target and puts them in its place at once, with a manifest of their hashes."""
    if not formats or set(formats) - set(FORMATS):
        raise SkeletonError(f"formats must be of {', '.join(FORMATS)}")
    directory = os.path.abspath(directory)
    os.makedirs(os.path.dirname(directory), exist_ok=True)
    made = tempfile.mkdtemp(dir=os.path.dirname(directory), prefix=".skeleton-")
    write_into(skeleton, made, formats, base or os.getcwd())
    replace_directory(directory, made)


def write_into(skeleton: Skeleton, directory: str, formats: list[str], base: str) -> None:
    target = Path(directory)

    def put(name: str, content: str) -> None:
        (target / name).parent.mkdir(parents=True, exist_ok=True)
        (target / name).write_text(content, encoding="utf-8")

    sources = [Path(os.path.relpath(s, base)).as_posix() for s in skeleton.sources]
    top = hierarchy_document(skeleton, sources)
    for name, schema in schemas().items():
        put(f"schemas/{name}", json.dumps(schema, indent=2) + "\n")
    for fmt in formats:
        put(f"hierarchy{FORMATS[fmt].suffix}", FORMATS[fmt].hierarchy(top))
    for name, rows in _by_package(skeleton):
        document = {"package": name, "modules": {r.module.rsplit(".", 1)[-1]: _module(r, skeleton.level) for r in rows}}
        for fmt in formats:
            put(f"modules/{name}{FORMATS[fmt].suffix}", FORMATS[fmt].modules(document, rows, skeleton.level == "signatures"))
    hashes = {p.relative_to(target).as_posix(): hashlib.sha256(p.read_bytes()).hexdigest() for p in sorted(target.rglob("*")) if p.is_file()}
    put(compare.MANIFEST, render.canonical({"formats": formats, "resolution": skeleton.level, "files": hashes}) + "\n")


def read_metadata(directory: str) -> tuple[list[str], str]:
    """(formats, level) of a skeleton that was written."""
    formats = [name for name, f in FORMATS.items() if Path(directory, f"hierarchy{f.suffix}").is_file()]
    if not formats:
        raise SkeletonError(f"there is no skeleton in {directory}")
    if "json" in formats:
        found = json.loads(Path(directory, "hierarchy.json").read_text(encoding="utf-8"))
    elif "yaml" in formats:
        import yaml

        found = yaml.safe_load(Path(directory, "hierarchy.yaml").read_text(encoding="utf-8"))
    else:
        raise SkeletonError("a skeleton in Markdown alone doesn't tell its level")
    level = found.get("metadata", {}).get("resolution") if isinstance(found, dict) and isinstance(found.get("metadata"), dict) else None
    if level not in pysource.LEVELS:
        raise SkeletonError(f"the skeleton in {directory} has no valid level")
    return formats, level


def validate(spark: SparkSession, directory: str, sources: list[str], exclude: list[str] | None = None, symlinks: str = "forbid", fix: bool = False, base: str | None = None) -> bool:
    """Compares a skeleton with what its sources give now, by content. True if it was rewritten."""
    formats, level = read_metadata(directory)
    fresh = generate(spark, sources, level, exclude, symlinks)
    made = tempfile.mkdtemp(dir=os.path.dirname(os.path.abspath(directory)), prefix=".validate-")
    try:
        write_into(fresh, made, formats, base or os.getcwd())
        sides = []
        for folder in (made, directory):
            content = tree.scan(spark, folder).where("not is_dir").select("path", F.sha2("content", 256).alias("sha256"))
            sides.append(graph.cut(content))
        found = compare.differences(*sides)
        if lines := compare.report(found):
            if not fix:
                raise SkeletonError("the skeleton isn't up to date:\n" + "\n".join(f"- {x}" for x in lines))
            replace_directory(os.path.abspath(directory), made)
            return True
        return False
    finally:
        if os.path.isdir(made):
            import shutil

            shutil.rmtree(made)
