"""Queries on odd inputs, and steps that have to keep pace with larger tables."""

from __future__ import annotations

import ast
import random
import time

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import yaml
from oracle import same_rows
from pyspark.sql import functions as F

from lodestrata.functions import outline, pysource, text
from lodestrata.operators import graph
from lodestrata.plans import catalog, corpus


def test_line_numbers_equal_their_sql_on_every_kind_of_line_end(spark, tmp_path, monkeypatch):
    texts = ["", "\n", "\n\n", "\r\n", "a\r\nb\r\n", "a\rb", "a\x0bb\x0cc\x1cd\x1de\x1ef\x85g h i\n", "a\n\nb", "é\n", "\U0001f469‍\U0001f680\n", "x\0\n", "l\n" * 12, "l\n" * 1000, None]
    made = pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": texts, "lang": ["en"] * len(texts), "source": ["src1"] * len(texts)})
    pq.write_table(made, f"{tmp_path}/documents.parquet")
    monkeypatch.setattr("oracle.FOLDER", str(tmp_path))
    same_rows(spark, catalog.QUERIES["line_numbers"], catalog.ORACLES["line_numbers"])
    shown = spark.createDataFrame([("a\r\nb\x85c",), ("",)], "t string").select(text.numbered(F.col("t")).alias("n")).collect()
    assert [r.n for r in shown] == ["1: a\n2: b\n3: c", ""]


SOURCES = [
    '"""D\u00e9\n\n\u4e2d"""\nimport a\nfrom b import (c,\n    d)\nX = {\n  "\u00e9": 1}\n\x0c\ndef f(x: "\u4e2d" = "\u00e9\u00e9", *, y=(1,\n 2)) -> "\U0001f600": ...\n',
    "import a\r\nX = (1,\r\n  2)\r\nclass C(B):\r\n    y: int = 'a\x0bb'\r\n    async def m(self, *a: int, **k): import z\r\n",
    "X = 1\rY = '\x85\u2028'\rdef g(): pass",
    "try:\n  import a\nexcept E:\n  import b\nelse:\n  import c\nfinally:\n  import d\nmatch x:\n  case 1:\n    import e\nwith q:\n  for i in j:\n    from . import g\n  else:\n    import h\nif u:\n  pass\nelif v:\n  import k\n",
    "",
]


@pytest.mark.parametrize("source", SOURCES)
def test_parts_of_a_source_are_those_of_the_library(source):
    made = pysource._Module(source)
    for node in ast.walk(made.tree):
        if hasattr(node, "end_lineno"):
            assert made.text(node) == ast.get_source_segment(source, node)
    names = [a.name for n in ast.walk(made.tree) if isinstance(n, ast.Import | ast.ImportFrom) for a in n.names]
    assert [e["name"] for e in made.edges()] == names
    for at in pysource.parse(source)["positions"]:
        assert made.line(at["line"] + 1)[at["character"] :].startswith(at["name"])


def test_a_large_source_is_divided_into_lines_once():
    """Each default was cut out of the source divided anew: 34 s for this one, now 0.08 s."""
    source = "".join(f"def f{k}(a=1, b=2): ...\n" for k in range(4000))
    made = pysource._Module(source)
    began = time.process_time()
    assert made.functions(made.tree.body)[-1]["signature"] == "(a = 1, b = 2)"
    assert time.process_time() - began < 2


@pytest.mark.parametrize("columns", [(), ("doc",), ("edges", "positions"), tuple(pysource.COLUMNS)])
def test_only_the_columns_asked_for_are_made(spark, columns):
    rows = spark.createDataFrame([(k, s) for k, s in enumerate([*SOURCES, "def (", None])], "k int, content string")
    whole = {r.k: r for r in pysource.extract(rows).collect()}
    some = pysource.extract(rows, columns=columns)
    assert set(some.columns) == {"k", "error", *columns}
    assert len(got := some.collect()) == len(whole)
    for r in got:
        assert all(r[c] == whole[r.k][c] for c in some.columns)


def test_more_files_than_a_worker_holds_at_once(spark):
    n = 2 * pysource.AT_ONCE + 1
    rows = spark.range(0, n, 1, 1).selectExpr("id", "concat('X = ', id) as content")
    got = pysource.extract(rows, columns=("constants",)).collect()
    assert sorted((r.id, r.constants[0]["default"]) for r in got) == [(k, str(k)) for k in range(n)]


def test_sources_are_dealt_out_to_all_cores(spark, tmp_path):
    """A table in one small file was parsed by one task, whatever its number of rows."""
    made = pa.table({"c_custkey": range(2400), "c_name": ["a"] * 2400, "c_nationkey": pa.array([None] * 2400, pa.int32())})
    pq.write_table(made, f"{tmp_path}/customer.parquet")
    held = corpus.sources(spark, str(tmp_path)).groupBy(F.spark_partition_id()).count().collect()
    assert len(held) >= corpus.LEAST_TASKS and max(r["count"] for r in held) <= 2 * 2400 / len(held)


@pytest.mark.parametrize("seed", range(4))
def test_both_yaml_parsers_read_the_texts_for_the_fast_one_alike(seed):
    bits = ["a", "b1", "1.5", "yes", "null", ".inf", "2001-01-02", "0x1f", "-3", "- ", "-", ": ", ":", ":\n", "\n", "\n  ", "\n    ", "  ", "[", "]", "{", "}", ", ", "...", "a: ", "b: ", "- a", "[1, 2]", "{a: b}", "\n- ", "#", "'", "\t", "&x ", "\x85"]

    def read(made, text):
        try:
            return repr(made(text))
        except Exception as e:
            return f"{type(e).__name__}: {e}"

    rnd = random.Random(seed)
    texts = ["".join(rnd.choices(bits, k=rnd.randint(1, 12))) for _ in range(3000)]
    texts += [f"{'a' * n}: b" for n in range(1020, 1030)] + ["[" * n + "]" * n for n in (60, 70, 400)] + ["- " * 400 + "a", "".join(" " * n + "a:\n" for n in range(80))]
    assert any(outline.PLAIN_YAML.fullmatch(t) for t in texts)
    for t in texts:
        assert read(lambda x: outline.load("yaml", x), t) == read(yaml.safe_load, t), t


@pytest.mark.parametrize("name, table", [("yaml_outline", "part"), ("toml_outline", "part"), ("json_key_outline", "events")])
def test_outlines_are_dealt_out_to_all_cores(spark, name, table):
    """A table in one small file was parsed by one task."""
    assert spark.read.parquet(f"/root/testdata/sf0.001/{table}.parquet").rdd.getNumPartitions() < corpus.LEAST_TASKS
    made = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert made.rdd.getNumPartitions() >= corpus.LEAST_TASKS


def test_plain_yaml_takes_the_fast_parser(monkeypatch):
    monkeypatch.setattr(yaml, "safe_load", None)
    assert outline.load("yaml", "supply: {at: 3}\npart:\n  sizes: [7, 8]\n  b4: x\n") == {"supply": {"at": 3}, "part": {"sizes": [7, 8], "b4": "x"}}


#: What each query needs of a source; it had all made.
ASKED = {
    "find_class": ("classes",),
    "python_signatures": ("functions", "classes"),
    "compress_stub": ("doc", "imports", "constants", "functions", "classes"),
    "skeleton_totals": ("functions", "classes"),
    "find_function": ("functions",),
    "module_by_name": ("doc",),
    "symbol_positions": ("positions",),
}


@pytest.mark.parametrize("name", ASKED)
def test_queries_ask_for_what_they_need(spark, monkeypatch, name):
    asked, made = [], pysource.extract
    monkeypatch.setattr(pysource, "extract", lambda files, content="content", columns=None: asked.append((columns, files)) or made(files, content, columns))
    catalog.QUERIES[name](spark, "/root/testdata/sf0.001")
    [(columns, files)] = asked
    assert columns == ASKED[name]
    assert files.count() == (1 if name == "module_by_name" else spark.read.parquet("/root/testdata/sf0.001/customer.parquet").count())


def test_imports_are_parsed_once(spark):
    """Each kind of import and each list of modules parsed all sources again."""
    plan = catalog.QUERIES["import_edges"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_edges_of_every_kind_of_import(spark):
    edge = "struct<name: string, module: string, level: int, is_from: boolean>"
    imports = [("os", None, 0, False), ("os", None, 0, False), ("p.a", None, 0, False), ("x", "p.a", 0, True), ("a", "p", 0, True), ("*", "p", 0, True), ("b", None, 1, True), ("*", None, 1, True), ("c", "a", 1, True), ("a", None, 2, True)]
    parsed = spark.createDataFrame([("p.q.m", False, imports), ("p", True, [("a", None, 1, True)]), ("top", False, [("p", None, 1, True)]), ("none", False, [])], f"module string, is_package boolean, edges array<{edge}>")
    known = spark.createDataFrame([("p", True), ("p.a", False), ("p.q", True), ("p.q.m", False), ("p.q.b", False), ("top", False)], "module string, is_package boolean")
    found = graph.edges(parsed, known).collect()
    got = {tuple(r) for r in found}
    assert len(got) == len(found)
    assert got == {
        ("p.q.m", "os", False, False), ("p.q.m", "p.a", True, True), ("p.q.m", "p", True, True), ("p.q.m", "p.q.b", True, True), ("p.q.m", "p.q.a", False, True),
        ("p", "p.a", True, True), ("top", "p", True, True),
    }
