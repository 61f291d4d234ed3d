"""Bounded outlines of structured files, and summaries by suffix."""

from __future__ import annotations

import json
import re
import tomllib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIST_ITEMS = 10
MOST_NESTED = 64
#: Block lines of plain words, numbers and flow collections: what both YAML parsers read alike, at depths where neither gives up.
_LINE = r"(?!\.\.\.)(?! {65}) *+(?:- )?+(?:[A-Za-z0-9_./,{}\[\] ]++|-(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_]):(?=[ \n]|\Z))*+"
PLAIN_YAML = re.compile(rf"(?:{_LINE}\n)*+{_LINE}")
KINDS = {".json": "json", ".yaml": "yaml", ".yml": "yaml", ".toml": "toml", ".md": "markdown", ".markdown": "markdown", ".py": "python"}


@dataclass(frozen=True)
class Bounds:
    max_depth: int = 4
    max_keys: int = 200
    max_items: int = 200
    max_headings: int = 200

    def __post_init__(self) -> None:
        if min(self.max_depth, self.max_keys, self.max_items, self.max_headings) < 1:
            raise ValueError("bounds must be positive")


def paths(value: object, bounds: Bounds = Bounds()) -> list[str]:
    """Paths of keys and items, level by level: keys sorted, the first items of lists, up to the bounds of all together."""
    out: list[str] = []
    keys = 0
    waiting = deque([("", value, 0)])
    while waiting:
        at, here, depth = waiting.popleft()
        if depth >= bounds.max_depth:
            continue
        if isinstance(here, dict):
            steps = [(f"{at}.{k}" if at else str(k), here[k], True) for k in sorted(here, key=str)]
        elif isinstance(here, list):
            steps = [(f"{at}[{i}]", v, False) for i, v in enumerate(here[:LIST_ITEMS])]
        else:
            continue
        for path, below, is_key in steps:
            if len(out) >= bounds.max_items or (is_key and keys >= bounds.max_keys):
                return out
            keys += is_key
            out.append(path)
            waiting.append((path, below, depth + 1))
    return out


def _yaml(text: str) -> object:
    """As `yaml.safe_load` reads it: by the library's parser in C, and by the slow one where that one refuses or may differ."""
    import yaml

    fast = getattr(yaml, "CSafeLoader", None)
    if fast is not None and text.count("[") + text.count("{") <= MOST_NESTED and PLAIN_YAML.fullmatch(text):
        try:
            return yaml.load(text, fast)
        except yaml.YAMLError:  # the message is the slow one's
            pass
    return yaml.safe_load(text)


def load(kind: str, text: str) -> object:
    if kind == "json":
        return json.loads(text)
    if kind == "toml":
        return tomllib.loads(text)
    if kind == "yaml":
        return _yaml(text)
    raise ValueError(f"no outline for {kind!r}")


def outline(rows: DataFrame, kind: str, text: str = "text", bounds: Bounds = Bounds()) -> DataFrame:
    """The other columns of rows, with `paths` (null if the text is malformed) and `error`."""
    others = [f for f in rows.schema.fields if f.name != text]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in others), "paths array<string>", "error string"])

    def one(source: str | None) -> tuple[list[str] | None, str | None]:
        try:
            return paths(load(kind, source or ""), bounds), None
        except Exception as e:  # each parser has its own; the row says what was wrong
            return None, f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [one(x) for x in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(f.name) for f in others], pa.array([m[0] for m in made], pa.list_(pa.string())), pa.array([m[1] for m in made], pa.string())],
                names=[*[f.name for f in others], "paths", "error"],
            )

    return rows.select(*[F.col(f.name) for f in others], F.col(text)).mapInArrow(run, schema)


def compact(value: object, indent: int = 0) -> list[str]:
    """A value in indented lines, keys sorted."""
    pad = " " * indent
    if isinstance(value, dict):
        pairs = [(f"{pad}{k}:", value[k]) for k in sorted(value, key=str)]
    elif isinstance(value, list):
        pairs = [(f"{pad}-", v) for v in value]
    else:
        return [f"{pad}{value}"]
    out = []
    for head, below in pairs:
        out += [head, *compact(below, indent + 2)] if isinstance(below, dict | list) else [f"{head} {below}"]
    return out
