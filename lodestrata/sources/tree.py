"""Source trees as a Spark data source: a row for each directory and file under a root.

`spark.read.format("sourcetree").option("root", ...)`. The built-in binary source leaves out names that
begin with a dot or an underscore, so this one walks itself. Symlinks, ignore rules and include globs are options: a directory
that the rules exclude gives a row but is never opened, a file that they exclude isn't read, and neither is one larger than
`most_bytes`; of a file whose first bytes hold a NUL only those are read. What the rules decide is told by column expressions over the rows.
Directories are opened from the top until there are enough; then each is a partition with all below it, and the files seen so far
make partitions of PART_FILES.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lodestrata.functions import ignore, text

SCHEMA = "path string, name string, is_dir boolean, is_symlink boolean, size_bytes bigint, content binary"
SYMLINKS = ("forbid", "files", "dirs", "all")
#: Directories that are opened before there are partitions, and entries of one partition at the top.
TOP, PART_FILES = 64, 500
Met = tuple[str, os.DirEntry]


class _Part(InputPartition):
    def __init__(self, paths: list[str], above: tuple[str, ...] | None) -> None:
        self.paths, self.above = paths, above  # above: the real paths over a directory that is walked; None for entries by themselves


def patterns(rules: list[ignore.Rule]) -> str:
    """The rules as an option: [expression for files, expression for directories, negated]."""
    return json.dumps([[r.regex(False), r.regex(True), r.negated] for r in rules])


def _judge(given: str) -> Callable[[str, bool], bool]:
    """Whether the last rule that matches a path excludes it."""
    rules = [(re.compile(a), re.compile(b), negated) for a, b, negated in reversed(json.loads(given))]
    return lambda path, is_dir: next((not negated for file, folder, negated in rules if (folder if is_dir else file).search("/" + path)), False)


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.root = options["root"]
        self.symlinks = options.get("symlinks", "forbid")
        self.content = options.get("content", "true").lower() == "true"
        self.rules, self.include = options.get("rules", "[]"), options.get("include", "[]")
        self.most = int(options.get("most_bytes", 0))
        self.ending = options.get("ending", "")
        if self.symlinks not in SYMLINKS:
            raise ValueError(f"symlinks must be one of {', '.join(SYMLINKS)}")
        if not os.path.isdir(self.root):
            raise ValueError(f"not a directory: {self.root}")

    def _prepare(self) -> None:
        self.excluded = _judge(self.rules)
        wanted = _judge(self.include)
        # Globs are rules without negation: what they "exclude" is what they name.
        self.wanted = (lambda path: True) if self.include == "[]" else (lambda path: wanted(path, False))

    def _allowed(self, entry: os.DirEntry) -> bool:
        if not entry.is_symlink():
            return True
        return self.symlinks == "all" or self.symlinks == ("dirs" if entry.is_dir() else "files")

    def _entries(self, path: str) -> list[Met]:
        with os.scandir(os.path.join(self.root, path)) as found:
            kept = sorted((e for e in found if self._allowed(e)), key=lambda e: e.name)
        return [(f"{path}/{e.name}" if path else e.name, e) for e in kept]

    def _opened(self, path: str, entry: os.DirEntry, above: tuple[str, ...]) -> bool:
        """Whether a walk goes into the directory: not if rules exclude it, nor by a link back to where it comes from."""
        return entry.is_dir() and not self.excluded(path, True) and os.path.realpath(os.path.join(self.root, path)) not in above

    def partitions(self) -> list[_Part]:
        self._prepare()
        waiting, seen, opened = [("", ())], [], 0
        while waiting and opened < TOP:
            path, above = waiting.pop(0)
            opened += 1
            here = (*above, os.path.realpath(os.path.join(self.root, path)))
            for below, entry in self._entries(path):
                seen.append(below)
                if self._opened(below, entry, here):
                    waiting.append((below, here))
        flat = [_Part(["."], None), *(_Part(seen[k : k + PART_FILES], None) for k in range(0, len(seen), PART_FILES))]
        return flat + [_Part([path], above) for path, above in waiting]

    def _content(self, path: str, size: int) -> bytes | None:
        if not self.content or not path.endswith(self.ending) or (self.most and size > self.most) or self.excluded(path, False) or not self.wanted(path):
            return None
        with open(os.path.join(self.root, path), "rb") as file:
            head = file.read(text.SNIFFED_BYTES)
            return head if b"\0" in head else head + file.read()

    def _row(self, path: str, is_dir: bool, is_link: bool) -> tuple:
        whole = os.path.join(self.root, path)
        size = os.path.getsize(whole) if os.path.isfile(whole) else 0
        data = self._content(path, size) if not is_dir and os.path.isfile(whole) else None
        return path, os.path.basename(path), is_dir, is_link, size, data

    def _walk(self, path: str, above: tuple[str, ...]) -> Iterator[tuple]:
        here = (*above, os.path.realpath(os.path.join(self.root, path)))
        for below, entry in self._entries(path):
            yield self._row(below, entry.is_dir(), entry.is_symlink())
            if self._opened(below, entry, here):
                yield from self._walk(below, here)

    def read(self, partition: _Part) -> Iterator[tuple]:
        self._prepare()
        for path in partition.paths:
            if partition.above is not None:
                yield from self._walk(path, partition.above)
            elif path == ".":
                yield ".", "", True, os.path.islink(self.root), 0, None
            else:
                whole = os.path.join(self.root, path)
                yield self._row(path, os.path.isdir(whole), os.path.islink(whole))


class SourceTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sourcetree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def scan(spark: SparkSession, root: str, symlinks: str = "forbid", content: bool = True, rules: list[ignore.Rule] = (), include: list[str] = (), most_bytes: int = 0, ending: str = "") -> DataFrame:
    """All entries under a root that a walk by these rules meets; only files that they include, of that ending, have content."""
    spark.dataSource.register(SourceTree)
    options = {"root": os.path.abspath(root), "symlinks": symlinks, "content": str(content).lower(), "rules": patterns(rules), "include": patterns(ignore.compile_rules(include, negation=False)), "most_bytes": most_bytes, "ending": ending}
    return spark.read.format("sourcetree").options(**options).load()


def decided(entries: DataFrame, rules: list[ignore.Rule], include: list[str] | None = None) -> DataFrame:
    """The entries that a walk meets, with its decision: `decision`, `reason`, `matched_pattern`, `matched_source`.

    What lies below an excluded directory is never met. Include globs are for files only.
    """
    path, is_dir = F.col("path"), F.col("is_dir")
    deciding = ignore.deciding_column(rules, path, is_dir)
    met = entries.where(ignore.pruned_column(rules, path).isNull()).withColumn("_rule", deciding)
    left_out = ~is_dir & ~ignore.included_column(include or [], path)
    reason = F.when(F.col("_rule").isNotNull(), "ignore").when(left_out, "include")
    return met.select(
        *entries.columns,
        F.when(reason.isNull(), "included").otherwise("excluded").alias("decision"),
        reason.alias("reason"),
        F.col("_rule.pattern").alias("matched_pattern"),
        F.col("_rule.source").alias("matched_source"),
    )


def files(entries: DataFrame, max_file_bytes: int = 0) -> DataFrame:
    """(path, size_bytes, is_binary, language, content): the files that were included. One that is too large is an error."""
    chosen = entries.where((F.col("decision") == "included") & ~F.col("is_dir"))
    if max_file_bytes:
        message = F.concat(F.lit("file is larger than allowed: "), F.col("path"))
        size = F.when(F.col("size_bytes") <= max_file_bytes, F.col("size_bytes")).otherwise(F.raise_error(message).cast("long"))
    else:
        size = F.col("size_bytes")
    binary: Column = F.coalesce(text.is_binary(F.col("content")), F.lit(True))
    return chosen.select("path", size.alias("size_bytes"), binary.alias("is_binary"), text.language(F.col("path")).alias("language"), F.when(~binary, F.validate_utf8(F.col("content").cast("string"))).alias("content"))


def ignore_lines(root: str, cli: list[str] = (), files: list[str] = (), standard: bool = True) -> list[tuple[str, str]]:
    """(line, source) of all rules in force: defaults, the root's ignore files, named files, then those given."""
    out = [(p, "default") for p in ignore.DEFAULTS]
    named = [p for p in (Path(root, n) for n in ignore.STANDARD_FILES) if standard and p.is_file()] + [Path(f) for f in files]
    for file in named:
        if not file.is_file():
            raise ValueError(f"no such ignore file: {file}")
        source = file.relative_to(root).as_posix() if file.is_relative_to(root) else file.as_posix()
        out += [(line, source) for line in file.read_text(encoding="utf-8").splitlines()]
    return out + [(p, "cli") for p in cli]
