"""Symbols, imports, positions and stubs of Python source, parsed in Arrow batches by `ast`.

One pass parses each file once and gives nested columns, all of them or those that are asked for; everything
after that (totals, lookups, import edges, stubs) is column expressions over them. A file that can't be parsed has its message in
`error` and nothing else, so callers can fail with all errors at once.
"""

from __future__ import annotations

import ast
import re
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from functools import cached_property

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

ATTRIBUTE = "struct<name: string, line: int, doc: string, annotation: string, default: string>"
PARAMETER = "struct<name: string, annotation: string, default: string, kind: string>"
FUNCTION = f"struct<name: string, line: int, doc: string, signature: string, returns: string, decorators: array<string>, is_async: boolean, is_method: boolean, parameters: array<{PARAMETER}>>"
CLASS = f"struct<name: string, line: int, doc: string, bases: array<string>, decorators: array<string>, methods: array<{FUNCTION}>, attributes: array<{ATTRIBUTE}>, is_dataclass: boolean, is_pydantic: boolean>"
IMPORT = "struct<name: string, module: string, level: int, is_from: boolean>"
POSITION = "struct<name: string, line: int, character: int>"
PARSED = f"doc string, imports array<string>, constants array<{ATTRIBUTE}>, functions array<{FUNCTION}>, classes array<{CLASS}>, edges array<{IMPORT}>, positions array<{POSITION}>, error string"
MODELS = frozenset(["BaseModel", "BaseSettings", "pydantic.BaseModel"])
_DEFINED = re.compile(r"(?:async\s+)?(?:def|class)\s+(?=\w)")
_LINE_END = re.compile(rb"\r\n|\n|\r")
#: The fields that lead to further statements.
_BLOCKS = ("body", "handlers", "orelse", "finalbody", "cases")
LEVELS = ("hierarchy", "modules", "signatures")
#: So many files' symbols are in a worker's memory at once.
AT_ONCE = 500


def _first_line(node: ast.AST) -> str | None:
    text = ast.get_docstring(node, clean=False)
    return next((line.strip() for line in (text or "").splitlines() if line.strip()), None)


def _dotted(node: ast.expr) -> str | None:
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute) and (left := _dotted(node.value)) is not None:
        return f"{left}.{node.attr}"
    return None


class _Module:
    def __init__(self, source: str) -> None:
        self.source = source
        self.tree = ast.parse(source)

    @cached_property
    def bytes(self) -> bytes:
        return self.source.encode()

    @cached_property
    def starts(self) -> list[int]:
        """Where each line starts, in bytes, as the grammar counts lines."""
        return [0, *(found.end() for found in _LINE_END.finditer(self.bytes))]

    def text(self, node: ast.AST | None) -> str | None:
        """What `ast.get_source_segment` gives, which divides the whole source anew for each node."""
        return None if node is None else self.bytes[self.starts[node.lineno - 1] + node.col_offset : self.starts[node.end_lineno - 1] + node.end_col_offset].decode()

    def line(self, number: int) -> str:
        end = self.starts[number] if number < len(self.starts) else len(self.bytes)
        return self.bytes[self.starts[number - 1] : end].decode().rstrip("\r\n")

    def doc(self) -> str | None:
        return _first_line(self.tree)

    def imports(self) -> list[str]:
        return [self.text(n) for n in self.tree.body if isinstance(n, ast.Import | ast.ImportFrom)]

    def parameters(self, given: ast.arguments) -> tuple[list[dict], list[str]]:
        found, shown = [], []

        def add(arg: ast.arg, default: ast.expr | None, kind: str, stars: str = "") -> None:
            one = {"name": arg.arg, "annotation": self.text(arg.annotation), "default": self.text(default), "kind": kind}
            found.append(one)
            shown.append(stars + arg.arg + (f": {one['annotation']}" if one["annotation"] else "") + (f" = {one['default']}" if one["default"] else ""))

        plain = [*given.posonlyargs, *given.args]
        defaults = [None] * (len(plain) - len(given.defaults)) + list(given.defaults)
        for k, (arg, default) in enumerate(zip(plain, defaults, strict=True)):
            add(arg, default, "POSITIONAL_ONLY" if k < len(given.posonlyargs) else "POSITIONAL_OR_KEYWORD")
            if k + 1 == len(given.posonlyargs):
                shown.append("/")
        if given.vararg:
            add(given.vararg, None, "VAR_POSITIONAL", "*")
        elif given.kwonlyargs:
            shown.append("*")
        for arg, default in zip(given.kwonlyargs, given.kw_defaults, strict=True):
            add(arg, default, "KEYWORD_ONLY")
        if given.kwarg:
            add(given.kwarg, None, "VAR_KEYWORD", "**")
        return found, shown

    def decorators(self, node) -> list[str]:
        names = [_dotted(d.func if isinstance(d, ast.Call) else d) for d in node.decorator_list]
        return [n for n in names if n]

    def function(self, node, method: bool) -> dict:
        parameters, shown = self.parameters(node.args)
        returns = self.text(node.returns)
        return {
            "name": node.name,
            "line": node.lineno,
            "doc": _first_line(node),
            "signature": f"({', '.join(shown)})" + (f" -> {returns}" if returns else ""),
            "returns": returns,
            "decorators": self.decorators(node),
            "is_async": isinstance(node, ast.AsyncFunctionDef),
            "is_method": method,
            "parameters": parameters,
        }

    def functions(self, body: list[ast.stmt], method: bool = False) -> list[dict]:
        """Undecorated ones first, then decorated ones, each in the order written."""
        nodes = [n for n in body if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef)]
        return [self.function(n, method) for n in sorted(nodes, key=lambda n: bool(n.decorator_list))]

    def attributes(self, body: list[ast.stmt]) -> list[dict]:
        out = []
        for node in body:
            if isinstance(node, ast.Assign) and isinstance(node.targets[0], ast.Name):
                name, annotation, default = node.targets[0].id, None, node.value
            elif isinstance(node, ast.AnnAssign) and isinstance(node.target, ast.Name):
                name, annotation, default = node.target.id, node.annotation, node.value
            else:
                continue
            if not name.startswith("_"):
                out.append({"name": name, "line": node.lineno, "doc": None, "annotation": self.text(annotation), "default": self.text(default)})
        return out

    def classes(self) -> list[dict]:
        nodes = [n for n in self.tree.body if isinstance(n, ast.ClassDef)]
        out = []
        for node in sorted(nodes, key=lambda n: bool(n.decorator_list)):
            bases, decorators = [b for b in map(_dotted, node.bases) if b], self.decorators(node)
            out.append(
                {
                    "name": node.name,
                    "line": node.lineno,
                    "doc": _first_line(node),
                    "bases": bases,
                    "decorators": decorators,
                    "methods": self.functions(node.body, True),
                    "attributes": self.attributes(node.body),
                    "is_dataclass": bool({"dataclass", "dataclasses.dataclass"} & set(decorators)),
                    "is_pydantic": bool(MODELS & set(bases)),
                }
            )
        return out

    def constants(self) -> list[dict]:
        out = []
        for node in self.tree.body:
            target = node.targets[0] if isinstance(node, ast.Assign) else node.target if isinstance(node, ast.AnnAssign) else None
            if isinstance(target, ast.Name) and target.id.isupper():
                out.append({"name": target.id, "line": node.lineno, "doc": None, "annotation": None, "default": self.text(node.value)})
        return out

    def edges(self) -> list[dict]:
        """Of all statements, level by level; expressions hold none."""
        out, waiting = [], deque([self.tree])
        while waiting:
            node = waiting.popleft()
            for block in _BLOCKS:
                if isinstance(below := getattr(node, block, None), list):
                    waiting += below
            if isinstance(node, ast.Import):
                out += [{"name": a.name, "module": None, "level": 0, "is_from": False} for a in node.names]
            elif isinstance(node, ast.ImportFrom):
                out += [{"name": a.name, "module": node.module, "level": node.level, "is_from": True} for a in node.names]
        return out

    def positions(self) -> list[dict]:
        """Where top-level names are defined, counted from 0: on the name itself, as far as it is on the first line."""
        out = []
        for node in self.tree.body:
            if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                found = _DEFINED.match(self.line(node.lineno), node.col_offset)
                out.append({"name": node.name, "line": node.lineno - 1, "character": found.end() if found else node.col_offset})
            elif isinstance(node, ast.Assign | ast.AnnAssign):
                target = node.targets[0] if isinstance(node, ast.Assign) else node.target
                named = isinstance(target, ast.Name)
                place = target if named else node
                out.append({"name": target.id if named else None, "line": place.lineno - 1, "character": place.col_offset})
        return out


#: What makes each column of PARSED but the error.
COLUMNS: dict[str, Callable[[_Module], object]] = {
    "doc": _Module.doc,
    "imports": _Module.imports,
    "constants": _Module.constants,
    "functions": lambda made: made.functions(made.tree.body),
    "classes": _Module.classes,
    "edges": _Module.edges,
    "positions": _Module.positions,
}


def parse(source: str | None, columns: Iterable[str] = tuple(COLUMNS)) -> dict:
    """Those columns of PARSED for one source, and its error."""
    empty = {name: None for name in (*columns, "error")}
    if source is None:
        return empty | {"error": "no source"}
    try:
        made = _Module(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        return empty | {"error": f"{type(e).__name__}: {getattr(e, 'msg', None) or e} (line {getattr(e, 'lineno', None) or 0})"}
    return empty | {name: COLUMNS[name](made) for name in columns}


def extract(files: DataFrame, content: str = "content", columns: Iterable[str] = tuple(COLUMNS)) -> DataFrame:
    """The rows of `files` without the content, with those columns of PARSED and the error beside them."""
    kept = [f for f in files.schema.fields if f.name != content]
    asked = tuple(columns)
    parsed = [f for f in StructType.fromDDL(PARSED).fields if f.name in (*asked, "error")]
    schema = StructType(kept + parsed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(schema)
        names = [f.name for f in parsed]
        for whole in batches:
            for at in range(0, whole.num_rows, AT_ONCE):
                batch = whole.slice(at, AT_ONCE)
                rows = [parse(x, asked) for x in batch.column(content).to_pylist()]
                made = [pa.array([r[n] for r in rows], target.field(n).type) for n in names]
                yield pa.RecordBatch.from_arrays([*[batch.column(f.name).cast(target.field(f.name).type) for f in kept], *made], schema=target)

    return files.select(*[F.col(f.name) for f in kept], F.col(content)).mapInArrow(run, schema)


def by_line(symbols: Column) -> Column:
    """Symbols by line, then name."""
    key = lambda x: F.struct(x["line"].alias("line"), x["name"].alias("name"), x.alias("symbol"))
    return F.transform(F.array_sort(F.transform(symbols, key), lambda a, b: F.when((a["line"] < b["line"]) | ((a["line"] == b["line"]) & (a["name"] < b["name"])), -1).when((a["line"] == b["line"]) & (a["name"] == b["name"]), 0).otherwise(1)), lambda x: x["symbol"])


def _attribute_line(a: Column, indent: str) -> Column:
    annotated = F.when(a["annotation"] != "", F.concat(F.lit(": "), a["annotation"])).otherwise("")
    valued = F.when(a["default"] != "", F.concat(F.lit(" = "), a["default"])).otherwise("")
    return F.concat(F.lit(indent), a["name"], F.coalesce(annotated, F.lit("")), F.coalesce(valued, F.lit("")))


def _function_lines(f: Column, indent: str = "") -> Column:
    head = F.concat(F.lit(indent), F.when(f["is_async"], "async ").otherwise(""), F.lit("def "), f["name"], f["signature"], F.lit(": ..."))
    return F.concat(F.array(F.lit("")), F.transform(f["decorators"], lambda d: F.concat(F.lit(f"{indent}@"), d)), F.array(head))


def _class_lines(c: Column) -> Column:
    bases = F.when(F.size(c["bases"]) > 0, F.concat(F.lit("("), F.array_join(c["bases"], ", "), F.lit(")"))).otherwise("")
    body = F.concat(F.transform(by_line(c["attributes"]), lambda a: _attribute_line(a, "    ")), F.flatten(F.transform(by_line(c["methods"]), lambda m: _function_lines(m, "    "))))
    body = F.when(F.size(body) > 0, body).otherwise(F.array(F.lit("    ...")))
    return F.concat(F.array(F.lit("")), F.transform(c["decorators"], lambda d: F.concat(F.lit("@"), d)), F.array(F.concat(F.lit("class "), c["name"], bases, F.lit(":"))), body)


def stub() -> Column:
    """A stub of a parsed module: its docstring's first line, imports, constants, functions and classes without bodies."""
    none = F.array().cast("array<string>")
    doc = F.when(F.col("doc") != "", F.array(F.concat(F.lit('""" '), F.col("doc"), F.lit(' """')))).otherwise(none)
    constants = F.when(F.size("constants") > 0, F.concat(F.array(F.lit("")), F.transform(by_line(F.col("constants")), lambda a: _attribute_line(a, "")))).otherwise(none)
    functions = F.flatten(F.transform(by_line(F.col("functions")), lambda f: _function_lines(f)))
    classes = F.flatten(F.transform(by_line(F.col("classes")), lambda c: _class_lines(c)))
    return F.concat(F.regexp_replace(F.array_join(F.concat(doc, F.col("imports"), constants, functions, classes), "\n"), r"\s+\z", ""), F.lit("\n"))
