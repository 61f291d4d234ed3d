from __future__ import annotations

import json
import os
import sys
import textwrap
import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from lodestrata import cli
from lodestrata.operators import compare, graph, packages, sizes, trees
from lodestrata.plans import pack as packing
from lodestrata.plans import skeleton
from lodestrata.sources import config, langserver, tree


@pytest.fixture
def root(tmp_path):
    files = {
        ".gitignore": "ignored.txt\n", "ignored.txt": "x", "kept.txt": "kept\n", ".runtime/index.log": "x", "bin.dat": b"\x00\x01", "doc.md": "# Title\n\n```\ncode\n```\n",
        "data.json": '{"a": {"b": 1}}', "pkg/__init__.py": '"""Package."""\n', "pkg/a.py": "from .b import thing\nimport os\n\n\ndef use(x: int = 1) -> int:\n    return x\n", "pkg/b.py": "thing = 1\n",
        "pkg/unrelated.py": "X = 1\n", "app.py": "import pkg.a\n",
    }
    base = tmp_path / "project"
    for name, content in files.items():
        (base / name).parent.mkdir(parents=True, exist_ok=True)
        (base / name).write_bytes(content if isinstance(content, bytes) else content.encode())
    return base


def do(spark, root, tmp_path, **options):
    name = options.pop("name", "out" + packing.render.FORMATS[options.get("format", "markdown")])
    o = packing.Options(output=str(tmp_path / name), **options)
    return packing.pack(spark, str(root), o), (tmp_path / name)


def test_scan(spark, root):
    os.symlink(root / "kept.txt", root / "link.txt")
    os.symlink(root / "pkg", root / "linked")
    for policy, want in {"forbid": set(), "files": {"link.txt"}, "dirs": {"linked"}, "all": {"link.txt", "linked"}}.items():
        found = {r.path for r in tree.scan(spark, str(root), policy).select("path").collect()}
        assert found & {"link.txt", "linked"} == want
        assert {".", ".gitignore", "pkg/__init__.py", ".runtime/index.log"} <= found
    with pytest.raises(Exception, match="not a directory"):
        tree.scan(spark, str(root / "none")).count()


def test_bundle(spark, root, tmp_path):
    result, out = do(spark, root, tmp_path)
    shown = out.read_text()
    assert "### kept.txt" in shown and "### ignored.txt" not in shown and ".runtime" not in shown
    assert "_Binary file (content omitted)._" in shown and "````markdown" in shown
    assert shown.startswith("# Code Pack\n") and "  a.py\n" in shown
    assert result.files == 10 and result.artifacts[0].bytes == len(shown.encode()) and result.artifacts[0].tokens > 0
    again, other = do(spark, root, tmp_path, name="again.md")
    assert other.read_text() == shown


def test_json_and_xml(spark, root, tmp_path):
    _, out = do(spark, root, tmp_path, format="json", content_encoding="base64")
    import base64

    found = json.loads(out.read_text())
    assert list(found) == sorted(found) and [f["path"] for f in found["files"]] == sorted(f["path"] for f in found["files"])
    kept = next(f for f in found["files"] if f["path"] == "kept.txt")
    assert base64.b64decode(kept["content"]) == b"kept\n"
    _, out = do(spark, root, tmp_path, format="xml")
    parsed = ET.fromstring(out.read_text())
    assert parsed.find("files/file[@path='kept.txt']/content").text == "kept\n"
    assert parsed.find("files/file[@path='bin.dat']").get("binary") == "true"


def test_plain_numbers_and_compress(spark, root, tmp_path):
    _, out = do(spark, root, tmp_path, format="plain", line_numbers=True, structure=False, minimal_prefix=True)
    assert "1: kept" in out.read_text() and "STRUCTURE" not in out.read_text()
    _, out = do(spark, root, tmp_path, compress=True, include=["**/*.py"])
    assert "def use(x: int = 1) -> int: ..." in out.read_text() and "return x" not in out.read_text()


def test_includes_limit_the_tree(spark, root, tmp_path):
    result, out = do(spark, root, tmp_path, include=["pkg/**"])
    assert result.files == 4 and "kept.txt" not in out.read_text() and ".runtime" not in out.read_text()


def test_split(spark, root, tmp_path):
    whole, _ = do(spark, root, tmp_path, minimal_prefix=True)
    for limit in (f"{whole.artifacts[0].bytes * 2 // 3}b", f"{whole.artifacts[0].tokens * 2 // 3}t"):
        result, _ = do(spark, root, tmp_path, split_output=limit, minimal_prefix=True, name="parts.md")
        assert len(result.artifacts) > 1
        text = "".join((tmp_path / f"parts.{k + 1}.md").read_text() for k in range(len(result.artifacts)))
        assert text.count("\n### ") == 10
        sizes_ = [a.bytes if limit[-1] == "b" else a.tokens for a in result.artifacts]
        assert max(sizes_) <= int(limit[:-1])
    with pytest.raises(Exception, match="exceeds the limit"):
        do(spark, root, tmp_path, split_output="10b", name="none.md")
    assert not (tmp_path / "none.1.md").exists()


def test_hybrid_and_fit(spark, root, tmp_path):
    options = {"mode": "hybrid", "format": "jsonl", "content": ["kept.txt"], "summary": ["*.json", "*.md"], "structure": False}
    result, out = do(spark, root, tmp_path, **options)
    rows = [json.loads(line) for line in out.read_text().splitlines()]
    by = {r["path"]: r for r in rows if r["type"] == "file"}
    assert rows[0]["type"] == "meta" and rows[0]["schema_version"] == 2
    assert by["kept.txt"]["content"] == "kept\n" and by["data.json"]["summary"] == {"type": "json", "paths": ["a", "a.b"]}
    assert by["pkg/a.py"]["representation"] == "summary" and by["bin.dat"]["representation"] == "meta"
    assert all(list(r) == sorted(r) for r in rows)
    fitted, out = do(spark, root, tmp_path, fit=True, max_output=f"{result.artifacts[0].bytes + 120}b", name="fit.jsonl", **options)
    rows = [json.loads(line) for line in out.read_text().splitlines()]
    _, out = do(spark, root, tmp_path, fit=True, max_output=f"{result.artifacts[0].bytes - 100}b", name="fit.jsonl", **options)
    rows = [json.loads(line) for line in out.read_text().splitlines()]
    assert rows[0]["selection_trace"] and len(out.read_bytes()) <= result.artifacts[0].bytes - 100
    with pytest.raises(packing.PackError, match="fit"):
        do(spark, root, tmp_path, fit=True, max_output="50b", name="never.jsonl", **options)
    _, out = do(spark, root, tmp_path, mode="hybrid", summary=["*.md"])
    assert "representation: summary" in out.read_text()
    with pytest.raises(packing.PackError, match="summar"):
        do(spark, root, tmp_path, mode="hybrid", summary=["*.txt"], name="wrong.md")
    assert not (tmp_path / "wrong.md").exists()


def test_slices(spark, root, tmp_path):
    def paths(**o):
        _, out = do(spark, root, tmp_path, format="json", **o)
        return {f["path"] for f in json.loads(out.read_text())["files"]}

    assert paths(entries=["pkg/a.py"], deps=True) == {"pkg/__init__.py", "pkg/a.py", "pkg/b.py"}
    assert paths(target="pkg/b.py", reverse_deps=True) == {"pkg/b.py", "pkg/a.py", "app.py"}
    assert paths(target_module="pkg.b", reverse_deps=True, deps=True) == {"pkg/b.py", "pkg/a.py", "app.py", "pkg/__init__.py"}
    with pytest.raises(packing.PackError, match="aren't included"):
        do(spark, root, tmp_path, entries=["pkg/a.py"], deps=True, ignore=["b.py"])
    (root / "pkg/a.py").write_text("from .missing import x\n")
    with pytest.raises(packing.PackError, match="unresolved local import"):
        do(spark, root, tmp_path, entries=["pkg/a.py"], deps=True)


def test_report_and_limits(spark, root, tmp_path):
    do(spark, root, tmp_path, include=["pkg/**"], entries=["pkg/a.py"], deps=True, selection_report=str(tmp_path / "report.json"))
    report = json.loads((tmp_path / "report.json").read_text())
    reasons = {f["path"]: f["reason"] for f in report["files"]}
    assert reasons["pkg/unrelated.py"] == "slice" and reasons["kept.txt"] == "include" and reasons["ignored.txt"] == "ignore" and reasons["pkg/a.py"] is None
    assert report["excluded_directories"][0]["path"] == ".runtime"
    assert report["counts"] == {"discovered_files": 4, "selected_files": 3}
    assert {"pattern", "negated", "anchored", "directory_only", "source"} == set(report["ignore_rules"][0])
    with pytest.raises(packing.PackError, match="allowed"):
        do(spark, root, tmp_path, max_output="10b", name="big.md")
    assert not (tmp_path / "big.md").exists()
    with pytest.raises(Exception, match="larger than allowed"):
        do(spark, root, tmp_path, max_file_bytes=4)


@pytest.mark.parametrize("wrong", [{"mode": "hybrid", "compress": True}, {"mode": "hybrid", "format": "xml"}, {"fit": True}, {"content_encoding": "verbatim"}, {"entries": ["a.py"]}, {"target": "a.py"}, {"format": "json", "split_output": "1kb"}, {"output": "x.json"}, {"uses": True, "target": "a.py"}, {"meta": ["x"]}])
def test_wrong_options(wrong):
    with pytest.raises(packing.PackError):
        packing.Options(**wrong).check()


def test_skeleton(spark, root, tmp_path):
    out = tmp_path / "skeleton"
    made = skeleton.generate(spark, [str(root)], "signatures")
    assert made.metadata["total_modules"] == 4 and made.metadata["total_functions"] == 1
    skeleton.write(made, str(out), ["yaml", "json", "markdown"], str(tmp_path))
    top = json.loads((out / "hierarchy.json").read_text())
    assert top["packages"]["pkg"] == {"subpackages": [], "modules": ["pkg.a", "pkg.b", "pkg.unrelated"]} and list(top)[-1] == "$schema"
    assert set(top["packages"]["__root__"]["modules"]) == {"app"} and top["packages"]["__root__"]["subpackages"] == ["pkg"]
    module = json.loads((out / "modules/pkg.json").read_text())["modules"]["a"]
    assert module["functions"][0]["signature"] == "(x: int = 1) -> int" and module["imports"] == ["from .b import thing", "import os"]
    assert "## Package Hierarchy" in (out / "hierarchy.md").read_text() and "### Functions" in (out / "modules/pkg.md").read_text()
    assert skeleton.validate(spark, str(out), [str(root)], base=str(tmp_path)) is False
    (out / "modules/pkg.json").write_text("{}")
    with pytest.raises(skeleton.SkeletonError, match="changed: modules/pkg.json"):
        skeleton.validate(spark, str(out), [str(root)], base=str(tmp_path))
    assert skeleton.validate(spark, str(out), [str(root)], fix=True, base=str(tmp_path)) is True
    assert skeleton.validate(spark, str(out), [str(root)], base=str(tmp_path)) is False


def test_skeleton_errors(spark, root, tmp_path):
    (tmp_path / "other").mkdir()
    (tmp_path / "other/app.py").write_text("")
    with pytest.raises(skeleton.SkeletonError, match="app"):
        skeleton.generate(spark, [str(root), str(tmp_path / "other")])
    (root / "pkg/a.py").write_text("def (")
    with pytest.raises(ValueError, match="pkg/a.py"):
        skeleton.generate(spark, [str(root)])
    assert skeleton.generate(spark, [str(root)], "hierarchy").metadata["total_modules"] == 4
    with pytest.raises(skeleton.SkeletonError, match="no skeleton"):
        skeleton.read_metadata(str(tmp_path))


def test_config(tmp_path):
    path = tmp_path / ".lodestrata.yaml"
    path.write_text(config.dump(config.Config(sources=[config.Source("src", level="signatures")])))
    (tmp_path / "a/b").mkdir(parents=True)
    assert config.find(tmp_path / "a/b") == path
    assert config.load(path).sources[0].level == "signatures"
    assert config.parse("pack: {format: plain, no_structure: true, prefix: minimal, summary_config: {max_depth: 2}}").pack.bounds.max_depth == 2
    for wrong in ("colour: red", "sources: [{path: ' '}]", "sources: [{path: a, output: ../b}]", "pack: {format: xml, mode: hybrid}", "level: all", "pack: {what: 1}"):
        with pytest.raises(ValueError):
            config.parse(wrong)


def test_cli(spark, root, tmp_path, monkeypatch, capsys):
    monkeypatch.chdir(tmp_path)
    assert cli.main(["init", "--preset", "standard"]) == 0 and cli.main(["init"]) == 1
    assert cli.main(["generate", str(root), "--output", "sk", "--format", "json", "--level", "modules"]) == 0
    assert cli.main(["validate", str(root), "--output", "sk"]) == 0
    assert cli.main(["estimate", str(root)]) == 0
    os.remove(".lodestrata.yaml")
    assert cli.main(["pack", str(root), "--output", "p.json", "--token-tree"]) == 0
    assert "kept.txt (2)" in capsys.readouterr().out
    (root / "app.py").write_text("import pkg.none\n")
    assert cli.main(["pack", str(root), "--output", "q.md", "--entries", "app.py", "--deps"]) == 1


def test_graph(spark):
    links = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "d")]
    edges = spark.createDataFrame(links, "src string, dst string")
    start = spark.createDataFrame([("a",)], "module string")
    got = {r.module: r.depth for r in graph.closure(start, edges).collect()}
    assert got == {"a": 0, "b": 1, "c": 2, "d": 3}
    assert graph.chain(graph.closure(start, edges), "d") == ["a", "b", "c", "d"]


def test_relative_imports(spark):
    edge = "array<struct<name: string, module: string, level: int, is_from: boolean>>"
    parsed = spark.createDataFrame([("p.q.m", False, [("x", None, 1, True), ("y", "z", 2, True), ("*", "n", 1, True)]), ("p.q", True, [("m", None, 1, True)])], f"module string, is_package boolean, edges {edge}")
    modules = spark.createDataFrame([("p.q.m", False), ("p.q", True), ("p.z.y", False)], "module string, is_package boolean")
    got = {(r.module, r.target, r.resolved) for r in graph.edges(parsed, modules).collect()}
    assert got == {("p.q.m", "p.q.x", False), ("p.q.m", "p.z", False), ("p.q.m", "p.z.y", True), ("p.q.m", "p.q.n", False), ("p.q", "p.q.m", True)}
    high = spark.createDataFrame([("m", False, [("x", None, 2, True)])], parsed.schema)
    with pytest.raises(Exception, match="above the top"):
        graph.edges(high, modules).collect()


def test_packages(spark):
    rows = spark.createDataFrame([(p, 0) for p in ("pkg/__init__.py", "pkg/mod.py", "ns/sub/mod.py", "top.py")], "path string, source int")
    found = packages.modules(rows)
    got = {r.name: (r.subpackages, r.modules) for r in packages.package_tree(found).collect()}
    assert got == {"__root__": (["ns", "pkg"], ["top"]), "pkg": ([], ["pkg.mod"]), "ns": (["ns.sub"], []), "ns.sub": ([], ["ns.sub.mod"])}


def test_trees(spark):
    paths = spark.createDataFrame([("b/x.py", False), ("a.py", False), ("b", True), ("c", True), (".", True)], "path string, is_dir boolean")
    assert trees.lines(trees.structure(paths)) == ["a.py", "b/", "  x.py", "c/"]
    counts = spark.createDataFrame([("b/x.py", 1234), ("a.py", 5)], "path string, n_tokens long")
    assert trees.lines(trees.with_tokens(counts)) == ["b/", "  x.py (1,234)", "a.py (5)"]


def test_sizes(spark):
    blocks = spark.createDataFrame([("a", 4), ("b", 4), ("c", 4), ("d", 9)], "path string, size long")
    assert [(r.path, r.part) for r in sizes.next_fit(blocks, 10, first=4, later=1).orderBy("path").collect()] == [("a", 1), ("b", 2), ("c", 2), ("d", 3)]
    saved = spark.createDataFrame([("a", 5), ("b", 9), ("c", 5), ("d", -1)], "path string, savings long")
    assert [r.path for r in sizes.downgrades(saved, 10).orderBy("saved").collect()] == ["b", "a"]


def test_differences(spark):
    a = spark.createDataFrame([("x", "1"), ("y", "1"), ("z", "1")], "path string, sha256 string")
    b = spark.createDataFrame([("y", "1"), ("z", "2"), ("w", "1")], "path string, sha256 string")
    assert compare.report(compare.differences(a, b)) == ["extra: w", "missing: x", "changed: z"]
    many = spark.range(60).select(F.format_string("f%02d", "id").alias("path"), F.lit("1").alias("sha256"))
    assert compare.report(compare.differences(many, many.limit(0)))[-1] == "... and 10 more"


def test_language_server(tmp_path):
    server = tmp_path / "server.py"
    server.write_text(textwrap.dedent("""
        import json, sys
        def read():
            n = 0
            while (line := sys.stdin.buffer.readline().strip()):
                if line.lower().startswith(b'content-length'): n = int(line.split(b':')[1])
            return json.loads(sys.stdin.buffer.read(n)) if n else None
        def write(m):
            b = json.dumps(m).encode(); sys.stdout.buffer.write(b'Content-Length: %d\\r\\n\\r\\n' % len(b) + b); sys.stdout.buffer.flush()
        while (m := read()):
            if m['method'] == 'textDocument/references':
                write({'id': 99, 'method': 'workspace/configuration', 'params': {'items': [1]}})
                assert read()['result'] == [None]
                base = m['params']['textDocument']['uri'].rsplit('/', 1)[0]
                write({'id': m['id'], 'result': [{'uri': base + '/user.py'}, {'uri': 'file:///elsewhere.py'}]})
            elif 'id' in m: write({'id': m['id'], 'result': None})
            if m['method'] == 'exit': break
    """))
    (tmp_path / "a.py").write_text("x = 1\n")
    assert langserver.references(str(tmp_path), "a.py", [(0, 0)], [sys.executable, str(server)]) == ["user.py"]
    with pytest.raises(langserver.ServerError, match="start"):
        langserver.references(str(tmp_path), "a.py", [(0, 0)], ["/no/such/server"])
