from __future__ import annotations

import ast
import random

import pytest
from pyspark.sql import functions as F

from lodestrata.functions import ignore, names, outline, pysource, text, tokens


@pytest.mark.parametrize(
    ("rules", "path", "is_dir", "want"),
    [
        (["build/"], "build", True, True), (["build/"], "build/x.py", False, True), (["build/"], "src/build/x.py", False, True), (["build/"], "build", False, False),
        (["*.py", "!keep.py"], "a.py", False, True), (["*.py", "!keep.py"], "keep.py", False, False),
        (["/dist/"], "dist", True, True), (["/dist/"], "dist/a.py", False, True), (["/dist/"], "src/dist/a.py", False, False),
        (["\\#keep"], "#keep", False, True), (["\\!literal"], "!literal", False, True), (["# comment", "", "   "], "# comment", False, False),
        (["foo   "], "foo", False, True), (["bar\\ "], "bar", False, False), (["bar\\ "], "bar ", False, True),
        (["build"], "build/x", False, False), (["src/**"], "x/src/y/z", False, True), (["a/**/b"], "a/b", False, True), (["a?[!x]"], "abc", False, True), (["a?[!x]"], "abx", False, False),
    ],
)
def test_rules(spark, rules, path, is_dir, want):
    compiled = ignore.compile_rules(rules)
    assert ignore.excluded(compiled, path, is_dir) is want
    row = spark.createDataFrame([(path,)], "path string").select(ignore.excluded_column(compiled, F.col("path"), is_dir).alias("x")).first()
    assert row.x is want


@pytest.mark.parametrize("line", ["!", "src\\**", "a\\b"])
def test_bad_rules(line):
    with pytest.raises(ignore.RuleError):
        ignore.compile_rules([line])


def reference_match(pattern, path, is_dir):
    """The rules' meaning, segment by segment."""
    from fnmatch import fnmatchcase

    only_dirs, pattern = pattern.endswith("/"), pattern.rstrip("/")
    anchored, pattern = pattern.startswith("/"), pattern.lstrip("/")

    def match(parts, names_):
        if not parts:
            return not names_
        if parts[0] == "**":
            return any(match(parts[1:], names_[k:]) for k in range(len(names_) + 1))
        return bool(names_) and fnmatchcase(names_[0], parts[0]) and match(parts[1:], names_[1:])

    def single(names_):
        if "/" not in pattern and not anchored:
            return fnmatchcase(names_[-1], pattern)
        starts = [0] if anchored else range(len(names_) + 1)
        return any(match(pattern.split("/"), names_[k:]) for k in starts)

    parts = path.split("/")
    if not only_dirs:
        return single(parts)
    return any(single(parts[:k]) for k in range(1, len(parts) + is_dir))


def test_rules_against_their_meaning():
    rng = random.Random(0)
    for _ in range(20000):
        pattern = rng.choice(["", "/"]) + "/".join(rng.choice(["a", "b", "*", "a*", "?", "**", "[ab]", "*.c"]) for _ in range(rng.randrange(1, 4))) + rng.choice(["", "/"])
        path, is_dir = "/".join(rng.choice(["a", "b", "ab", "x.c"]) for _ in range(rng.randrange(1, 5))), rng.random() < 0.5
        if set(pattern.strip("/").split("/")) == {"**"}:  # names the root, too
            continue
        assert ignore.Rule(pattern).matches(path, is_dir) == reference_match(pattern, path, is_dir), (pattern, path, is_dir)


def test_pruning_and_includes(spark):
    rules = ignore.compile_rules(["build", "!build/keep.py", "*.log"])
    paths = spark.createDataFrame([("build/keep.py",), ("a/b.log",), ("a/c.py",), ("d.py",)], "path string")
    kept = paths.where(~ignore.hidden_column(rules, F.col("path"), False)).where(ignore.included_column(["a/**"], F.col("path")))
    assert [r.path for r in kept.collect()] == ["a/c.py"]
    shown = ignore.representation_rules(["*.py"], ["a/**"], ["a/c.*"])
    got = {r.path: r.r for r in paths.select("path", ignore.representation_column(shown, F.col("path"), F.lit(False)).alias("r")).collect()}
    assert got == {"build/keep.py": "meta", "a/b.log": "summary", "a/c.py": "content", "d.py": "meta"}


@pytest.mark.parametrize(("given", "want"), [("1mb", "1048576b"), ("500kb", "512000b"), ("20_000t", "20000t"), ("123", "123b"), ("1.5mb", "1572864b")])
def test_limits(given, want):
    assert str(names.parse_limit(given)) == want


@pytest.mark.parametrize("given", ["", "t", "0", "-1b", "1.5t", "x", "1.5"])
def test_bad_limits(given):
    with pytest.raises(ValueError):
        names.parse_limit(given)


def test_names(spark):
    rows = spark.createDataFrame([("a/b/__init__.py",), ("a/c.py",), ("d.py",)], "path string")
    got = rows.select(names.module_name(F.col("path")).alias("m")).select("m", names.package_of(F.col("m")).alias("p"), names.prefixes(F.col("m")).alias("x")).collect()
    assert [(r.m, r.p) for r in got] == [("a.b", "a"), ("a.c", "a"), ("d", "__root__")]
    assert got[0].x == ["a", "a.b"]
    assert names.from_uri("http://x/y") is None and names.from_uri("plain") is None
    assert names.from_uri("file:///a%20b") == "/a b" and names.from_uri("file://localhost/a") == "/a"
    assert names.from_uri(names.to_uri("/tmp/a b#c")) == "/tmp/a b#c"
    assert names.part_path("out/x.md", 2) == "out/x.2.md"
    assert names.split_command("a 'b c'") == ["a", "b c"]


@pytest.mark.parametrize(
    ("value", "bounds", "want"),
    [
        ({"outer": {"inner": 1}}, {}, ["outer", "outer.inner"]), ([{"a": 1}, {"b": 2}], {}, ["[0]", "[1]", "[0].a", "[1].b"]), ({}, {}, []), (None, {}, []),
        ({"a": {"b": {"c": 1}}}, {"max_depth": 1}, ["a"]), ({"b": 1, "a": 1}, {}, ["a", "b"]), ({str(k): 1 for k in range(10)}, {"max_keys": 3}, ["0", "1", "2"]),
        ({"a": [1, 2, 3, 4, 5]}, {"max_items": 3}, ["a", "a[0]", "a[1]"]), (list(range(30)), {}, [f"[{k}]" for k in range(10)]),
    ],
)
def test_outlines(value, bounds, want):
    assert outline.paths(value, outline.Bounds(**bounds)) == want


def test_outline_errors(spark):
    rows = spark.createDataFrame([(1, "{"), (2, '{"a": 1}'), (3, None)], "id int, text string")
    got = {r.id: (r.paths, r.error is None) for r in outline.outline(rows, "json").collect()}
    assert got == {1: (None, False), 2: (["a"], True), 3: (None, False)}
    assert outline.compact({"b": [1, {"c": 2}], "a": "x"}) == ["a: x", "b:", "  - 1", "  -", "    c: 2"]


def test_text(spark):
    rows = spark.createDataFrame([("a.PY", "x\ny\n"), ("b.sh", "a ```` b"), (".hidden", ""), ("c.md", "# H1 \n text\n ## no\n###### H6\n#no")], "path string, content string")
    got = {
        r.path: r
        for r in rows.select(
            "path", text.language(F.col("path")).alias("lang"), text.fence(F.col("content")).alias("fence"), text.numbered(F.col("content")).alias("numbered"), text.headings(F.col("content")).alias("headings"),
            text.base64(F.repeat("content", F.lit(100))).alias("b64"), text.markdown_block(F.col("path"), text.language(F.col("path")), F.lit(False), F.col("content")).alias("block"),
        ).collect()
    }
    assert [got[p].lang for p in ("a.PY", "b.sh", ".hidden", "c.md")] == ["python", "bash", None, "markdown"]
    assert got["b.sh"].fence == "`````" and got["a.PY"].fence == "```"
    assert got["a.PY"].numbered == "1: x\n2: y\n"
    assert [(h.level, h.text) for h in got["c.md"].headings] == [(1, "H1"), (6, "H6")]
    assert "\n" not in got["c.md"].b64 and "\r" not in got["c.md"].b64
    assert got["a.PY"].block == "\n### a.PY\n\n\n```python\nx\ny\n```\n"


def test_binary(spark):
    rows = spark.createDataFrame([(1, b"\x00\x01"), (2, b"text"), (3, b"\xff\xfe"), (4, b""), (5, b"a" * 9000 + b"\x00")], "id int, content binary")
    assert [r.b for r in rows.orderBy("id").select(text.is_binary(F.col("content")).alias("b")).collect()] == [True, False, True, False, False]


SOURCE = '''"""
First line.
Second.
"""

import os
from .x import y as z

LIMIT: int = 3
_p, q = 1, 2


class Plain:
    size: int = 1
    _hidden = 2

    @property
    def a(self) -> int: ...
    async def b(self): ...
    def c(self, x, /, y: str = "s", *args: int, k, d=1, **kw): ...


@dataclasses.dataclass(frozen=True)
class Data(Base, pkg.Other, Generic[T], metaclass=M): pass


class Empty: ...


def after(): ...
@deco.rated(1)
async def first(a, *, b): ...
'''


def test_parsing():
    got = pysource.parse(SOURCE)
    assert got["doc"] == "First line." and got["imports"] == ["import os", "from .x import y as z"]
    assert [(c["name"], c["default"]) for c in got["constants"]] == [("LIMIT", "3")]
    assert [c["name"] for c in got["classes"]] == ["Plain", "Empty", "Data"]
    plain, _, data = got["classes"]
    assert data["bases"] == ["Base", "pkg.Other"] and data["is_dataclass"] and data["decorators"] == ["dataclasses.dataclass"]
    assert [a["name"] for a in plain["attributes"]] == ["size"]
    assert [m["name"] for m in plain["methods"]] == ["b", "c", "a"]
    assert plain["methods"][1]["signature"] == '(self, x, /, y: str = "s", *args: int, k, d = 1, **kw)'
    assert [f["name"] for f in got["functions"]] == ["after", "first"]
    assert got["functions"][1]["signature"] == "(a, *, b)" and got["functions"][1]["is_async"] and got["functions"][1]["decorators"] == ["deco.rated"]
    assert [(e["name"], e["module"], e["level"]) for e in got["edges"]] == [("os", None, 0), ("y", "x", 1)]
    assert pysource.parse("def (")["error"].startswith("SyntaxError")
    assert pysource.parse(None)["error"] == "no source"
    assert [p for p in pysource.parse("# c\n\nasync def f(): ...\nx = 1")["positions"]] == [{"name": "f", "line": 2, "character": 10}, {"name": "x", "line": 3, "character": 0}]


def test_stub(spark):
    rows = spark.createDataFrame([("m", SOURCE), ("empty", "")], "module string, content string")
    got = {r.module: r.stub for r in pysource.extract(rows).select("module", pysource.stub().alias("stub")).collect()}
    assert got["empty"] == "\n"
    ast.parse(got["m"])
    assert "@deco.rated\nasync def first(a, *, b): ..." in got["m"] and "class Empty:\n    ..." in got["m"]


def test_tokens(spark):
    rows = spark.createDataFrame([("ab 12345, x",), ("",)], "t string")
    assert [r.n for r in rows.select(tokens.count_column(F.col("t")).alias("n")).collect()] == [tokens.count("ab 12345, x"), 0] == [7, 0]
    path = "/opt/tokenizers/byte_bpe_50k.tiktoken"
    assert [r.n for r in rows.select(tokens.count_column(F.col("t"), path).alias("n")).collect()] == [tokens.count("ab 12345, x", path), 0]
