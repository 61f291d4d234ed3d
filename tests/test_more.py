"""Walks, parts, encodings, formats, references and orders."""

from __future__ import annotations

import random
import re
import sys
import textwrap

import pytest
from pyspark.sql import functions as F

from lodestrata.functions import ignore, names, text, tokens
from lodestrata.operators import compare, packages, sizes
from lodestrata.plans import pack as packing
from lodestrata.plans import skeleton
from lodestrata.sources import langserver, tree


def put(base, files):
    for name, content in files.items():
        (base / name).parent.mkdir(parents=True, exist_ok=True)
        (base / name).write_bytes(content if isinstance(content, bytes) else content.encode())


# --- walks


def test_excluded_directories_are_never_opened(spark, tmp_path, monkeypatch):
    put(tmp_path, {"build/big.bin": "x" * 100, "build/deep/a.py": "x", "kept/a.py": "y", "kept/b.log": "z", "kept/c.txt": "c", "huge.txt": "h" * 5000, "nul.dat": b"\0" + b"n" * 20_000})
    rules = ignore.compile_rules(["build/", "*.log"])
    reader = tree._Reader({"root": str(tmp_path), "rules": tree.patterns(rules), "most_bytes": "1000"})
    opened, plain = [], tree._Reader._entries
    monkeypatch.setattr(tree._Reader, "_entries", lambda self, path: opened.append(path) or plain(self, path))
    rows = {r[0]: r for part in reader.partitions() for r in reader.read(part)}
    assert opened == ["", "kept"]
    assert set(rows) == {".", "build", "kept", "kept/a.py", "kept/b.log", "kept/c.txt", "huge.txt", "nul.dat"}
    assert rows["kept/a.py"][5] == b"y" and rows["kept/b.log"][5] is None and rows["huge.txt"][4:] == (5000, None)
    scanned = tree.scan(spark, str(tmp_path), rules=rules, include=["*.txt"], most_bytes=100_000)
    assert {r.path: len(r.content) for r in scanned.where("content is not null").collect()} == {"kept/c.txt": 1, "huge.txt": 5000}
    nul = tree.scan(spark, str(tmp_path)).where("path = 'nul.dat'").first()
    assert (nul.size_bytes, len(nul.content)) == (20_001, text.SNIFFED_BYTES)
    assert {r.path for r in tree.scan(spark, str(tmp_path), ending=".py").where("content is not null").collect()} == {"kept/a.py", "build/deep/a.py"}


def test_wide_and_deep_trees_are_partitioned(tmp_path, monkeypatch):
    put(tmp_path, {f"d{k}/e{k}/f.txt": "x" for k in range(30)} | {f"d0/g{k}": "x" for k in range(40)})
    monkeypatch.setattr(tree, "TOP", 5)
    monkeypatch.setattr(tree, "PART_FILES", 20)
    reader = tree._Reader({"root": str(tmp_path)})
    parts = reader.partitions()
    rows = [r[0] for p in parts for r in reader.read(p)]
    assert len(rows) == len(set(rows)) == 1 + 30 * 3 + 40 and len(parts) > 25


def test_walks_decide_as_the_columns_do(spark, tmp_path):
    rng = random.Random(2)
    put(tmp_path, {"/".join(rng.choice("abc") + rng.choice("12") for _ in range(rng.randrange(1, 4))) + f"_{k}.txt": "x" for k in range(60)})
    rules = ignore.compile_rules(["a1/", "!a1/b2/", "b*/c1", "*_1?.txt", "!*_15.txt"])
    shown = lambda scan: {(r.path, r.decision, r.matched_pattern) for r in tree.decided(scan, rules, ["**/*_*"]).collect()}
    assert shown(tree.scan(spark, str(tmp_path), rules=rules)) == shown(tree.scan(spark, str(tmp_path)))


# --- parts


def test_blocks_that_do_not_fit_go_on_to_the_next_part(spark, tmp_path, monkeypatch):
    """A whole text can have more tokens than its blocks have together; then the last block moves on."""
    put(tmp_path / "p", {f"f{k}.txt": "one two three\n" * 5 for k in range(8)})
    plain = tokens.count
    monkeypatch.setattr(packing.tokens, "count", lambda t, e=tokens.APPROXIMATE: plain(t, e) + 30 * max(0, t.count("### f") - 2))
    o = packing.Options(output=str(tmp_path / "o.md"), split_output="240t", minimal_prefix=True, structure=False)
    made = packing.pack(spark, str(tmp_path / "p"), o).artifacts
    assert len(made) > 2 and max(a.tokens for a in made) <= 240
    assert re.findall(r"### (f\d)", "".join(open(a.path).read() for a in made)) == [f"f{k}" for k in range(8)]
    o.split_output = "60t"
    with pytest.raises(Exception, match="alone"):
        packing.pack(spark, str(tmp_path / "p"), o)


def test_required_files_have_reasons(spark, tmp_path):
    required = spark.createDataFrame([(p,) for p in ("a.py", "build/b.py", "c.txt", "gone.py", "a.py")], "path string")
    found = spark.createDataFrame([("a.py",)], "path string")
    got = {r.path: r.reason for r in compare.missing(required, found, ignore.compile_rules(["build/"]), ["**/*.py"]).collect()}
    assert got == {"build/b.py": "excluded by ignore rules", "c.txt": "does not match the include patterns", "gone.py": "not there, or a link that isn't followed"}


# --- encodings


def test_named_encodings(spark, tmp_path, monkeypatch):
    import base64

    monkeypatch.setattr(tokens, "ENCODINGS", {})
    path = tmp_path / "few.tiktoken"
    path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % k for k, t in enumerate([*(bytes([b]) for b in range(256)), b"th", b"the"])))
    tokens.register("few", str(path))
    rows = spark.createDataFrame([(1, "the theme"), (2, ""), (3, None)], "id int, t string")
    got = {r.id: (r.a, r.b) for r in rows.select("id", tokens.count_column(F.col("t"), "few").alias("a"), tokens.count_column(F.col("t"), str(path)).alias("b")).collect()}
    assert got == {1: (5, 5), 2: (0, 0), 3: (None, None)} and tokens.count("the theme", "few") == 5
    for wrong in ("none-such", str(tmp_path / "gone")):
        with pytest.raises(ValueError, match="no such"):
            tokens.count("x", wrong)
    with pytest.raises(ValueError):
        tokens.register("words", str(path))
    put(tmp_path / "p", {"a.txt": "the theme"})
    made = packing.pack(spark, str(tmp_path / "p"), packing.Options(output=str(tmp_path / "o.md"), token_encoding="few"))
    assert made.tokens_by_path == {"a.txt": 5}


# --- formats


def test_formats_can_be_registered(spark, tmp_path, monkeypatch):
    class Names:
        suffix = ".names"

        def hierarchy(self, document):
            return ",".join(document["packages"])

        def modules(self, document, rows, full):
            return ",".join(document["modules"])

    monkeypatch.setattr(skeleton, "FORMATS", dict(skeleton.FORMATS))
    with pytest.raises(ValueError, match="ending"):
        skeleton.register("other", skeleton.FORMATS["json"])
    skeleton.register("names", Names())
    put(tmp_path / "p", {"pkg/__init__.py": "", "pkg/a.py": "x = 1\n", "pkg/b.py": "def f(): pass\n"})
    made = skeleton.generate(spark, [str(tmp_path / "p")])
    skeleton.write(made, str(tmp_path / "out"), ["names", "json"], str(tmp_path))
    assert (tmp_path / "out/hierarchy.names").read_text() == "__root__,pkg" and (tmp_path / "out/modules/pkg.names").read_text() == "a,b"
    assert [r.module for r in made.module("pkg.b").collect()] == ["pkg.b"] and made.module("none").count() == 0
    assert [r.modules for r in made.package("pkg").collect()] == [["pkg.a", "pkg.b"]] and made.package("none").count() == 0
    assert packages.get(made.packages, "name", "__root__").count() == 1


def test_estimates_count_every_module(spark, tmp_path):
    put(tmp_path / "p", {f"pkg/m{k}.py": f'"""Module {k}."""\n\n\ndef f{k}(a: int) -> int:\n    return a\n' for k in range(5)})
    made = {level: skeleton.generate(spark, [str(tmp_path / "p")], level) for level in ("hierarchy", "modules", "signatures")}
    estimate = {k: m.metadata["token_estimate"] for k, m in made.items()}
    assert estimate["hierarchy"] < estimate["modules"] < estimate["signatures"]
    whole = sum(tokens.count(skeleton.render.canonical(d)) for _, d in skeleton.module_documents(made["signatures"]))
    assert abs(estimate["signatures"] - estimate["hierarchy"] - whole) < 0.1 * whole


# --- references


SERVER = """
import json, sys, time
def read():
    n = 0
    while (line := sys.stdin.buffer.readline().strip()):
        if line.lower().startswith(b'content-length'): n = int(line.split(b':')[1])
    return json.loads(sys.stdin.buffer.read(n)) if n else None
def write(m):
    b = json.dumps(m).encode(); sys.stdout.buffer.write(b'Content-Length: %d\\r\\n\\r\\n' % len(b) + b); sys.stdout.buffer.flush()
opened, asked, paths = [], 0, None
while (m := read()):
    if m['method'] == 'textDocument/didOpen': opened.append(m['params']['textDocument']['uri'])
    if m['method'] == 'textDocument/references':
        if len(sys.argv) > 1: time.sleep(60)
        write({'id': 7, 'method': 'workspace/configuration', 'params': {'items': [{'section': 'python.analysis'}, {'section': 'x'}]}})
        paths = read()['result']
        asked += 1
        ready = asked > 2 and paths == [{'extraPaths': ['.', 'src'], 'diagnosticMode': 'workspace'}, None]
        write({'id': m['id'], 'result': [{'uri': u} for u in opened[1:]] if ready else []})
    elif 'id' in m: write({'id': m['id'], 'result': None} if m['method'] != 'textDocument/documentSymbol' else {'id': m['id'], 'error': {'message': 'unknown'}})
    if m['method'] == 'exit': break
"""


def test_references_over_a_workspace(tmp_path):
    (tmp_path / "server.py").write_text(textwrap.dedent(SERVER))
    put(tmp_path, {"a.py": "x = 1\n", "b.py": "import a\n", "c.py": b"\xff"})
    command = [sys.executable, str(tmp_path / "server.py")]
    assert langserver.references(str(tmp_path), "a.py", [(0, 0)], command, ["b.py", "c.py", "gone.py"], ["src", "."]) == ["b.py"]
    with pytest.raises(langserver.ServerError, match="within 1 seconds"):
        langserver.references(str(tmp_path), "a.py", [(0, 0)], [*command, "slow"], patience=1)
    with pytest.raises(langserver.ServerError, match="early"):
        langserver.references(str(tmp_path), "a.py", [(0, 0)], [sys.executable, "-c", "pass"])


# --- sizes and orders


@pytest.mark.parametrize("literal", ["5 kb", "1.5 mb", ".5mb", "5.mb", "20_000t", "20_000 t", "123", "7b", " 1GB ", "", "t", "0", "-1b", "1.5t", "1.5", ".b", "5 x", "1_0.5_0kb", "0.4b", "9" * 30])
def test_size_literals_both_ways(spark, literal):
    try:
        found = names.parse_limit(literal)
        want = (found.kind, found.value)
    except ValueError:
        want = None
    row = spark.createDataFrame([(literal,)], "t string").select(names.limit_bytes_column(F.col("t")).alias("f")).first().f
    got = None if row is None else (row.kind, row.value)
    assert got == want or literal == "9" * 30


def test_downgrades_are_the_fewest_largest(spark):
    rng = random.Random(3)
    for n in (1, 40, 300):
        rows = [(f"p{k:03d}", rng.choice([rng.randrange(1, 50), rng.randrange(1, 100_000)])) for k in range(n)]
        table = spark.createDataFrame([*rows, ("none", 0), ("less", -5)], "path string, savings long")
        for over in (1, sum(s for _, s in rows) // 3, sum(s for _, s in rows), 10**9):
            want, total = [], 0
            for path, s in sorted(rows, key=lambda r: (-r[1], r[0])):
                if total >= over:
                    break
                total += s
                want.append((path, s, total))
            assert [tuple(r) for r in sizes.downgrades(table, over).orderBy("saved").collect()] == want


def test_distinct_in_order(spark):
    row = spark.createDataFrame([(["b", "a", "b", None, "c", None, "a"],)], "v array<string>").select(text.in_order(F.col("v")).alias("v")).first()
    assert row.v == ["b", "a", None, "c"]
