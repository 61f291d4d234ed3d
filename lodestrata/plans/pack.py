"""Packs: the files of a tree that were chosen, as one deterministic artifact or several parts."""

from __future__ import annotations

import json
import os
import shutil
import tempfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from dataclasses import fields as fields_of
from itertools import groupby
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.functions import ignore, names, outline, pysource, text, tokens
from lodestrata.operators import compare, graph, sizes, trees
from lodestrata.plans import render
from lodestrata.sources import langserver, tree

ROUNDS = 10


class PackError(ValueError):
    """The request, or what it met, is wrong; nothing was written."""


@dataclass
class Options:
    output: str | None = None
    format: str = "markdown"
    mode: str = "bundle"
    include: list[str] = field(default_factory=list)
    ignore: list[str] = field(default_factory=list)
    ignore_files: list[str] = field(default_factory=list)
    standard_ignores: bool = True
    symlinks: str = "forbid"
    max_file_bytes: int = 1_000_000
    token_encoding: str = tokens.APPROXIMATE
    compress: bool = False
    content_encoding: str = "fence-safe"
    minimal_prefix: bool = False
    line_numbers: bool = False
    structure: bool = True
    files: bool = True
    max_output: str | None = None
    split_output: str | None = None
    fit: bool = False
    content: list[str] = field(default_factory=list)
    summary: list[str] = field(default_factory=list)
    meta: list[str] = field(default_factory=list)
    bounds: outline.Bounds = field(default_factory=outline.Bounds)
    entries: list[str] = field(default_factory=list)
    deps: bool = False
    target: str | None = None
    target_module: str | None = None
    reverse_deps: bool = False
    uses: bool = False
    uses_include_private: bool = False
    slice_backend: str = "imports"
    langserver: str = "pyright-langserver --stdio"
    python_roots: list[str] = field(default_factory=list)
    selection_report: str | None = None

    def check(self) -> None:
        """Combinations that make no sense are errors before anything is read."""
        hybrid = self.mode == "hybrid"
        rules = [
            (self.format in render.FORMATS, f"format must be one of {', '.join(render.FORMATS)}"),
            (self.mode in ("bundle", "hybrid"), "mode must be bundle or hybrid"),
            (self.content_encoding in render.ENCODINGS, f"content encoding must be one of {', '.join(render.ENCODINGS)}"),
            (self.symlinks in tree.SYMLINKS, f"symlinks must be one of {', '.join(tree.SYMLINKS)}"),
            (not (hybrid and self.compress), "hybrid packs aren't compressed"),
            (not hybrid or self.format in ("markdown", "plain", "jsonl"), "hybrid packs are markdown, plain or jsonl"),
            (hybrid or not (self.content or self.summary or self.meta), "representation rules are for hybrid packs"),
            (not self.fit or (hybrid and self.format == "jsonl" and self.max_output), "fitting needs a hybrid jsonl pack and a maximum"),
            (self.format != "markdown" or self.content_encoding != "verbatim", "markdown needs fence-safe or base64 content"),
            (not self.split_output or self.format not in ("json", "xml"), "json and xml packs can't be split"),
            (not (self.entries and (self.target or self.target_module or self.reverse_deps)), "give entries or a target, not both"),
            (not self.entries or self.deps, "entries need deps"),
            (not (self.target and self.target_module), "give a target file or a target module, not both"),
            (not (self.target or self.target_module) or self.reverse_deps or self.deps or self.uses, "a target needs reverse-deps, deps or uses"),
            (not (self.reverse_deps or self.uses) or self.target or self.target_module, "reverse-deps and uses need a target"),
            (self.slice_backend in ("imports", "pyright"), "slices come from imports or pyright"),
            (not self.uses or self.slice_backend == "pyright", "uses need the pyright backend"),
            (self.output is None or (infer_format(self.output) or self.format) == self.format, "the output's extension is of another format"),
        ]
        if wrong := [message for fine, message in rules if not fine]:
            raise PackError("; ".join(wrong))


@dataclass(frozen=True)
class Artifact:
    path: str
    bytes: int
    tokens: int


@dataclass(frozen=True)
class Result:
    artifacts: list[Artifact]
    files: int
    content_tokens: int
    tokens_by_path: dict[str, int]


def infer_format(path: str) -> str | None:
    return {end: fmt for fmt, end in render.FORMATS.items()}.get(Path(path).suffix.lower())


def default_output(fmt: str) -> str:
    return "codepack" + render.FORMATS[fmt]


def roots(root: str, given: list[str]) -> list[str]:
    """Import roots, relative to the root: those given, or src if there is one, or else the root."""
    if given:
        return [os.path.relpath(os.path.join(root, g), root).replace(os.sep, "/") for g in given]
    return ["src"] if os.path.isdir(os.path.join(root, "src")) else ["."]


def module_index(entries: DataFrame, import_roots: list[str]) -> DataFrame:
    """(module, is_package, path, content) of all Python files under the import roots, whatever is ignored.

    A file counts under the first root that holds it; of several files for a module the last root's wins.
    """
    python = entries.where("not is_dir and endswith(path, '.py')")
    each = None
    for k, base in enumerate(import_roots):
        inside = python if base == "." else python.where(F.startswith("path", F.lit(base + "/")))
        made = inside.withColumn("rest", F.col("path") if base == "." else F.substring("path", len(base) + 2, 1 << 20)).withColumn("rank", F.lit(k))
        each = made if each is None else each.unionByName(made)
    first = each.groupBy("path").agg(F.min_by(F.struct("rest", "rank", "content"), "rank").alias("f"))
    named = first.select("path", names.module_name(F.col("f.rest")).alias("module"), F.col("f.rest").rlike(r"(^|/)__init__\.py$").alias("is_package"), F.validate_utf8(F.col("f.content").cast("string")).alias("content"), "f.rank")
    return named.groupBy("module").agg(F.max_by(F.struct("path", "is_package", "content"), F.struct("rank", "path")).alias("m")).select("module", "m.path", "m.is_package", "m.content")


def _relative(root: str, paths: Iterable[str]) -> list[str]:
    return [os.path.relpath(os.path.join(root, p), root).replace(os.sep, "/") for p in paths]


def sliced(spark: SparkSession, root: str, entries: DataFrame, o: Options) -> DataFrame | None:
    """(path) of the files that a slice asks for; None for no slice."""
    if not (o.entries or o.target or o.target_module):
        return None
    import_roots = roots(root, o.python_roots)
    index = graph.cut(module_index(entries, import_roots))
    parsed = graph.cut(pysource.extract(index).select("module", "path", "is_package", "edges", "positions", "error"))
    fail(parsed, "can't parse")
    modules = index.select("module", "is_package", "path")
    imports = graph.cut(graph.edges(parsed, modules))
    start = index.where(F.col("path").isin(_relative(root, o.entries or [o.target or ""])))
    if o.target_module:
        start = index.where(F.col("module") == o.target_module)
    if (found := start.count()) < max(1, len(o.entries)):
        raise PackError(f"{max(1, len(o.entries)) - found} of the entries or targets aren't modules of the import roots")
    wanted = start.select("module")
    if o.reverse_deps:
        target = o.target_module or start.first().module
        wanted = wanted.union(graph.reverse_closure(target, imports, modules).select("module"))
    if o.uses:
        one = start.first()
        where = parsed.where(F.col("module") == one.module).select(F.explode("positions").alias("p")).collect()
        places = [(r.p.line, r.p.character) for r in where if o.uses_include_private or not (r.p.name or "").startswith("_")]
        files = [r.path for r in modules.select("path").orderBy("path").toLocalIterator()]  # names only, for the server to open
        used = langserver.references(root, one.path, sorted(set(places)), names.split_command(o.langserver), files, import_roots)
        wanted = wanted.union(modules.where(F.col("path").isin(*used)).select("module")) if used else wanted
    if o.deps:
        reached = graph.forward_closure(wanted.distinct(), imports, modules)
        lost = graph.unresolved(imports).join(reached.select("module"), "module", "left_semi").orderBy("module", "target").first()
        if lost is not None:
            raise PackError(f"unresolved local import {lost.target!r}, by " + " -> ".join(graph.chain(reached, lost.module)))
        wanted = reached.select("module")
    return modules.join(wanted.distinct(), "module", "left_semi").select("path")


def fail(rows: DataFrame, what: str) -> None:
    """Raises all errors at once, in order."""
    errors = rows.where("error is not null").select("path", "error").orderBy("path").collect()
    if errors:
        raise PackError("\n".join(f"{what} {r.path}: {r.error}" for r in errors))


def summaries(files: DataFrame, bounds: outline.Bounds) -> DataFrame:
    """(path, summary, error): JSON text of what a file's structure is."""

    def one(path: str, source: str) -> tuple[str | None, str | None]:
        kind = outline.KINDS.get(os.path.splitext(path)[1].lower())
        try:
            if kind is None:
                raise ValueError("no summary for this kind of file")
            if kind == "python":
                found = pysource.parse(source)
                if found["error"]:
                    return None, found["error"]
                kept = {k: v for k, v in found.items() if k not in ("edges", "positions", "error")}
                made = {"type": "python", "module": {"path": path} | kept}
            elif kind == "markdown":
                made = {"type": kind, "headings": _headings(source, bounds.max_headings)}
            else:
                made = {"type": kind, "paths": outline.paths(outline.load(kind, source), bounds)}
            return render.canonical(_without_nulls(made)), None
        except Exception as e:  # each parser has its own
            return None, f"{type(e).__name__}: {e}".splitlines()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [one(p, c or "") for p, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([m[k] for m in made], pa.string()) for k in (0, 1)]], names=["path", "summary", "error"])

    return files.select("path", "content").mapInArrow(run, "path string, summary string, error string")


def _headings(source: str, most: int) -> list[dict]:
    import re

    found = (re.match(r"(#{1,6})\s+(.+?)\s*$", line) for line in source.splitlines())
    return [{"level": len(m[1]), "text": m[2]} for m in found if m][:most]


def _without_nulls(value: object) -> object:
    if isinstance(value, dict):
        return {k: _without_nulls(v) for k, v in value.items() if v is not None}
    return [_without_nulls(v) for v in value] if isinstance(value, list) else value


def _compacted(files: DataFrame) -> DataFrame:
    """(path, text): indented lines of what isn't shown as content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                shown = {k: r[k] for k in ("representation", "path", "language", "size_bytes")}
                shown |= {"is_binary": r["is_binary"]} if r["representation"] == "meta" else {"summary": json.loads(r["summary"])}
                out.append("\n".join(outline.compact(shown)) + "\n")
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(out, pa.string())], names=["path", "text"])

    return files.select("path", "language", "size_bytes", "is_binary", "representation", "summary").mapInArrow(run, "path string, text string")


class _Sink:
    """Artifacts are written beside their places and moved there together at the end."""

    def __init__(self) -> None:
        self.staged: list[tuple[str, str]] = []

    def write(self, path: str, pieces: Iterable[str], encoding: str) -> Artifact:
        os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
        handle, temporary = tempfile.mkstemp(dir=os.path.dirname(os.path.abspath(path)), prefix=".pack-")
        self.staged.append((temporary, path))
        size, parts = 0, []
        with os.fdopen(handle, "w", encoding="utf-8", newline="") as file:
            for piece in pieces:
                file.write(piece)
                size += len(piece.encode())
                parts.append(piece)
            file.flush()
            os.fsync(file.fileno())
        return Artifact(path, size, tokens.count("".join(parts), encoding))

    def commit(self) -> None:
        for temporary, path in self.staged:
            os.replace(temporary, path)
        self.staged = []

    def discard(self) -> None:
        for temporary, _ in self.staged:
            if os.path.exists(temporary):
                os.remove(temporary)
        self.staged = []


def chosen_files(spark: SparkSession, root: str, o: Options) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(decided entries, files to show, paths of the slice)."""
    rules = ignore.compile_rules(tree.ignore_lines(root, o.ignore, o.ignore_files, o.standard_ignores))
    entries = tree.scan(spark, root, o.symlinks, rules=rules, include=o.include, most_bytes=o.max_file_bytes)
    decided = tree.decided(entries, rules, o.include)
    # Imports are followed through ignored files, too, so a slice has a scan of its own.
    wanted = sliced(spark, root, tree.scan(spark, root, o.symlinks, ending=".py"), o) if o.entries or o.target or o.target_module else None
    found = tree.files(decided, o.max_file_bytes)
    if wanted is not None:
        wanted = graph.cut(wanted)
        lost = compare.missing(wanted, found, rules, o.include).orderBy("path").collect()
        if lost:
            raise PackError("required files aren't included by the filters:\n" + "\n".join(f"- {r.path}: {r.reason}" for r in lost))
        found = found.join(wanted, "path", "left_semi")
    return decided, found, wanted


def pack(spark: SparkSession, root: str, o: Options) -> Result:
    """Writes the artifacts and tells what they hold."""
    o.check()
    root = os.path.abspath(root)
    output = o.output or default_output(o.format)
    split = names.parse_limit(o.split_output) if o.split_output else None
    most = names.parse_limit(o.max_output) if o.max_output else None
    decided, found, wanted = chosen_files(spark, root, o)
    found = graph.cut(found)
    if o.selection_report:
        selection_report(decided, found, wanted, root, o)
    hybrid = o.mode == "hybrid"
    raw_tokens = tokens.count_column(F.coalesce("content", F.lit("")), o.token_encoding) if o.files else F.lit(0).cast("long")
    files = found.withColumn("summary", F.lit(None).cast("string")).withColumn("representation", F.when(F.col("is_binary") | F.lit(not o.files), "meta").otherwise("content"))
    if hybrid:
        rules = ignore.representation_rules(o.meta, o.summary, o.content)
        files = found.withColumn("representation", ignore.representation_column(rules, F.col("path"), F.col("is_binary"), o.files))
        wrong = files.where("is_binary and representation <> 'meta'").select("path", F.lit("it is binary").alias("error"))
        fail(wrong, "no summary or content of")
        made = graph.cut(summaries(files.where("representation = 'summary'"), o.bounds))
        fail(made, "can't summarise")
        files = files.join(made.select("path", "summary"), "path", "left")
    if o.compress:
        python = pysource.extract(files.where("endswith(path, '.py') and not is_binary").select("path", "content")).withColumn("stub", F.when(F.col("error").isNull(), pysource.stub()))
        python = graph.cut(python.select("path", "stub", "error"))
        fail(python, "can't parse")
        files = files.join(python.select("path", "stub"), "path", "left").withColumn("content", F.coalesce("stub", "content")).drop("stub")
    if o.line_numbers:
        files = files.withColumn("content", text.numbered(F.col("content")))
    if not hybrid:
        raw_tokens = tokens.count_column(F.coalesce("content", F.lit("")), o.token_encoding) if o.files else F.lit(0).cast("long")
    files = graph.cut(files.withColumn("n_tokens", raw_tokens))
    about = render.overview(files).first().asDict()
    folders = decided.where("is_dir and decision = 'included'").select("path", "is_dir")
    above = files.select(F.explode(ignore.ancestors(F.col("path"))).alias("path")).distinct()
    shown = folders.join(above, "path", "left_semi").unionByName(files.select("path", F.lit(False).alias("is_dir")))
    header = render.Header(
        root_name=os.path.basename(root), encoding_name=o.token_encoding, content_encoding=o.content_encoding, compressed=o.compress, line_numbers=o.line_numbers, minimal=o.minimal_prefix,
        structure=trees.lines(trees.structure(shown)) if o.structure else None, overview={"selected": about}, include_files=o.files, mode=o.mode,
        extra={"max_output": str(most) if most else None, "split_output": str(split) if split else None, "fit_to_max_output": o.fit,
               "representation_rules": {"content": o.content, "summary": o.summary, "meta": o.meta} if hybrid else None, "summary_config": vars(o.bounds) if hybrid else None},
    )
    counted = {r.path: r.n_tokens for r in files.select("path", "n_tokens").orderBy("path").toLocalIterator()}
    sink = _Sink()
    try:
        artifacts = _artifacts(files, header, o, output, split, most, sink)
        if most is not None:
            used = sum(a.bytes if most.kind == "bytes" else a.tokens for a in artifacts)
            if used > most.value:
                raise PackError(f"the output has {used} {most.kind}; {most.value} are allowed")
        sink.commit()
    finally:
        sink.discard()
    return Result(artifacts, about["files"], sum(counted.values()), counted)


def _size(column: str, kind: str, encoding: str) -> Column:
    return text.byte_length(F.col(column)) if kind == "bytes" else tokens.count_column(F.col(column), encoding)


def _artifacts(files: DataFrame, header: render.Header, o: Options, output: str, split: names.Limit | None, most: names.Limit | None, sink: _Sink) -> list[Artifact]:
    if o.format in ("json", "xml"):
        document = render.json_document if o.format == "json" else render.xml_document
        rows = files.withColumn("content", text.encoded(F.col("content"), o.content_encoding)).orderBy("path").select("path", "language", "is_binary", "content")
        return [sink.write(output, document(header, rows.toLocalIterator()), o.token_encoding)]
    if o.format == "jsonl":
        return _jsonl(files, header, o, output, split, most, sink)
    pieces = render.blocks(files, o.format, o.content_encoding)
    if o.mode == "hybrid":
        body = _compacted(files.where("representation <> 'content'")).withColumnRenamed("text", "content")
        other = render.blocks(body.withColumns({"is_binary": F.lit(False), "language": F.lit("yaml")}), o.format, o.content_encoding)
        pieces = render.blocks(files.where("representation = 'content'"), o.format, o.content_encoding).unionByName(other)
    if not o.files and o.mode != "hybrid":
        return [sink.write(output, [header.prefix(o.format), "\n"], o.token_encoding)]
    return _parts(pieces, "text", lambda part: header.prefix(o.format, part == 1, part == 1), "\n", o, output, split, sink)


def _parts(rows: DataFrame, column: str, prefix, suffix: str, o: Options, output: str, split: names.Limit | None, sink: _Sink) -> list[Artifact]:
    if split is None:
        body = (r[0] for r in rows.orderBy("path").select(column).toLocalIterator())
        return [sink.write(output, (x for part in ([prefix(1)], body, [suffix]) for x in part), o.token_encoding)]
    measure = (lambda t: len(t.encode())) if split.kind == "bytes" else (lambda t: tokens.count(t, o.token_encoding))
    sized = graph.cut(rows.withColumn("size", _size(column, split.kind, o.token_encoding)))
    # Only paths and sizes pass through the fold; its parts are read back one after another.
    plan = graph.cut(sizes.next_fit(sized.select("path", "size"), split.value, measure(prefix(1)), measure(prefix(2)), measure(suffix)))
    ordered = sized.join(plan.select("path", "part"), "path").orderBy("part", "path").select("part", column)
    made: list[Artifact] = []

    def write(part: int, blocks: list[str]) -> list[str]:
        """Writes a part; the blocks that don't fit, as counted over the whole text, go on to the next."""
        later: list[str] = []
        while (size := measure("".join([prefix(part), *blocks, suffix]))) > split.value and len(blocks) > 1:
            later.insert(0, blocks.pop())
        if size > split.value:
            raise PackError(f"one file alone needs {size} {split.kind} in a part; {split.value} are allowed")
        made.append(sink.write(names.part_path(output, part), [prefix(part), *blocks, suffix], o.token_encoding))
        return later

    over: list[str] = []
    for _, rows_of in groupby(ordered.toLocalIterator(), lambda r: r[0]):  # a part is no longer than the limit
        over = write(len(made) + 1, over + [r[1] for r in rows_of])
    while over:
        over = write(len(made) + 1, over)
    return made


def _jsonl(files: DataFrame, header: render.Header, o: Options, output: str, split: names.Limit | None, most: names.Limit | None, sink: _Sink) -> list[Artifact]:
    trace: list[dict] = []
    for _ in range(ROUNDS):
        header.extra["selection_trace"] = sorted(trace, key=lambda t: t["path"]) or None
        lines = render.jsonl_record(files, o.content_encoding).withColumn("line", F.concat("line", F.lit("\n")))
        made = _parts(lines, "line", lambda part: header.jsonl(part == 1, part == 1), "", o, output, split, sink)
        if not o.fit:
            return made
        used = sum(a.bytes if most.kind == "bytes" else a.tokens for a in made)
        if used <= most.value:
            return made
        sink.discard()
        summed = files.where("representation = 'summary'")
        lower = summed.withColumn("representation", F.lit("meta")).withColumn("summary", F.lit(None).cast("string"))
        cost = lambda df, name: render.jsonl_record(df, o.content_encoding).select("path", _size("line", most.kind, o.token_encoding).alias(name))
        saved = cost(summed, "a").join(cost(lower, "b"), "path").select("path", (F.col("a") - F.col("b")).alias("savings"))
        down = graph.cut(sizes.downgrades(saved, used - most.value))
        rows = down.orderBy("path").collect()
        if sum(r.savings for r in rows) < used - most.value:
            break
        trace += [{"path": r.path, "from": "summary", "to": "meta", "savings": r.savings, "unit": most.kind} for r in rows]
        marked = files.join(down.select("path", F.lit(True).alias("down")), "path", "left")
        files = graph.cut(marked.withColumns({"representation": F.when(F.col("down"), "meta").otherwise(F.col("representation")), "summary": F.when(F.col("down").isNull(), F.col("summary"))}).drop("down"))
    raise PackError("the output can't be made to fit its maximum")


def selection_report(decided: DataFrame, found: DataFrame, wanted: DataFrame | None, root: str, o: Options) -> None:
    """Why each entry is in the pack or isn't, as JSON."""
    marked = decided.drop("content").join(found.select("path", F.lit(True).alias("kept")), "path", "left")
    left = F.when(F.col("is_dir") | F.col("kept") | (F.col("decision") == "excluded"), F.col("reason")).otherwise("slice")
    decision = F.when(left == "slice", "excluded").otherwise(F.col("decision"))
    rows = marked.select("path", "is_dir", decision.alias("decision"), left.alias("reason"), "matched_pattern", "matched_source").orderBy(F.desc("is_dir"), "path")
    traced = [r.asDict() for r in rows.toLocalIterator()]
    shown = lambda t, *names: {k: t[k] for k in names}
    why = ("reason", "matched_pattern", "matched_source")
    kept = [shown(t, "path", "decision", *why) for t in traced if not t["is_dir"]]
    walked = [t for t in kept if t["reason"] in (None, "slice")]
    rules = ignore.compile_rules(tree.ignore_lines(root, o.ignore, o.ignore_files, o.standard_ignores))
    report = {
        "root_name": os.path.basename(root), "mode": o.mode, "include_patterns": o.include, "respect_standard_ignores": o.standard_ignores, "ignore_files": o.ignore_files, "symlinks": o.symlinks, "max_file_bytes": o.max_file_bytes,
        "selection": {"entries": o.entries, "deps": o.deps, "target": o.target, "target_module": o.target_module, "reverse_deps": o.reverse_deps, "uses": o.uses, "slice_backend": o.slice_backend},
        "counts": {"discovered_files": len(walked), "selected_files": sum(t["decision"] == "included" for t in walked)},
        "ignore_rules": [{"pattern": r.pattern, "negated": r.negated, "anchored": r.anchored, "directory_only": r.directories_only, "source": r.source} for r in rules],
        "excluded_directories": [shown(t, "path", *why) for t in traced if t["is_dir"] and t["decision"] == "excluded"],
        "files": kept,
    }
    sink = _Sink()
    sink.write(o.selection_report, [json.dumps(report, ensure_ascii=False, indent=2, sort_keys=True) + "\n"], tokens.APPROXIMATE)
    sink.commit()


def replace_directory(target: str, made: str) -> None:
    """Puts a finished directory in another's place; the old one comes back if that fails."""
    aside = f"{target}.old"
    if os.path.exists(target):
        os.replace(target, aside)
    try:
        os.replace(made, target)
    except OSError:
        if os.path.exists(aside):
            os.replace(aside, target)
        raise
    shutil.rmtree(aside, ignore_errors=True)
