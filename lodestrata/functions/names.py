"""Module names, dotted names, URIs and size literals."""

from __future__ import annotations

import os
import re
import shlex
from dataclasses import dataclass
from urllib.parse import quote, unquote, urlparse

from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS = {"gb": 1 << 30, "mb": 1 << 20, "kb": 1 << 10, "b": 1}


def module_name(path: Column) -> Column:
    """The dotted name of a Python file; a package's `__init__` names the package."""
    bare = F.regexp_replace(path, r"\.py$", "")
    return F.replace(F.regexp_replace(bare, "/__init__$", ""), F.lit("/"), F.lit("."))


def package_of(module: Column) -> Column:
    """All but the last part of a dotted name; '__root__' at the top."""
    return F.when(F.contains(module, F.lit(".")), F.regexp_extract(module, r"^(.*)\.[^.]*$", 1)).otherwise("__root__")


def prefixes(name: Column, separator: str = ".") -> Column:
    """All leading parts of a name, the whole of it included."""
    parts = F.split(name, re.escape(separator))
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), separator))


@dataclass(frozen=True)
class Limit:
    kind: str
    value: int

    def __str__(self) -> str:
        return f"{self.value}{'t' if self.kind == 'tokens' else 'b'}"


_NUMBER = r"(\d+(?:\.\d*)?|\.\d+)\s*(gb|mb|kb|b)|(\d+)\s*(t?)"


def parse_limit(text: str) -> Limit:
    """'20_000t' is tokens; '1.5 mb', '500kb', '123' are bytes, by powers of 1024."""
    literal = text.strip().lower().replace("_", "")
    if not (found := re.fullmatch(_NUMBER, literal, re.ASCII)):
        raise ValueError(f"not a size: {text!r}")
    kind = "tokens" if found[4] else "bytes"
    value = int(float(found[1]) * UNITS[found[2]]) if found[1] else int(found[3])
    if value < 1:
        raise ValueError(f"a size must be positive: {text!r}")
    return Limit(kind, value)


def limit_bytes_column(text: Column) -> Column:
    """struct(kind, value) of size literals in a column; null where one isn't a size. The same literals as in parse_limit."""
    literal = F.replace(F.lower(F.regexp_replace(text, r"^\s+|\s+$", "")), F.lit("_"), F.lit(""))
    part = lambda k: F.regexp_extract(literal, f"^(?:{_NUMBER})$", k)
    times = F.when(part(2) == "gb", UNITS["gb"]).when(part(2) == "mb", UNITS["mb"]).when(part(2) == "kb", UNITS["kb"]).otherwise(1)
    value = F.when(part(1) != "", F.floor(part(1).try_cast("double") * times).cast("long")).otherwise(part(3).try_cast("long"))
    return F.when(value > 0, F.struct(F.when(part(4) == "t", "tokens").otherwise("bytes").alias("kind"), value.alias("value")))


def part_path(path: str, part: int) -> str:
    """out.md, 2 -> out.2.md"""
    stem, end = os.path.splitext(path)
    return f"{stem}.{part}{end}"


def to_uri(path: str) -> str:
    return "file://" + quote(os.path.abspath(path))


def from_uri(uri: str) -> str | None:
    """The path of a file URI; null for any other."""
    found = urlparse(uri)
    return unquote(found.path) if found.scheme == "file" and found.netloc in ("", "localhost") else None


def split_command(text: str) -> list[str]:
    parts = shlex.split(text)
    if not parts:
        raise ValueError("an empty command")
    return parts
