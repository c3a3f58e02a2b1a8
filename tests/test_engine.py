"""Operators without a table to stand on, and whole runs over a tree with git and a scripted model."""

import json
import os
import random
import subprocess
import sys

import pytest

from lodeworks.functions import paths as P
from lodeworks.functions import text
from lodeworks.operators import blueprint, config, extract, gitignore, impact, resolve, selection, sets, sinks
from lodeworks.plans import fixture, model, render, run
from lodeworks.sources import git, state, tree
from pyspark.sql import functions as F


def plant(root, files=None):
    for p, c in (files or fixture.FILES).items():
        at = root / p
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(c, encoding="utf-8")
    return root


def commit(root, message="x"):
    for args in (["init", "-q"], ["add", "-A"], ["-c", "user.name=t", "-c", "user.email=t@example.com", "commit", "-qm", message]):
        subprocess.run(["git", "-C", str(root), *args], check=True, capture_output=True)


def test_path_functions(spark):
    rows = [("a/b.tar.gz", "a", ".gz", "b.tar"), (".env", ".", "", ".env"), ("README", ".", "", "README"), ("x/y/Z.PY", "x/y", ".py", "Z")]
    df = spark.createDataFrame([(r[0],) for r in rows], "path string")
    got = df.select("path", P.parent("path").alias("d"), P.suffix("path").alias("s"), P.stem("path").alias("t")).collect()
    assert [tuple(r) for r in got] == rows
    got = df.select(P.suffixes("path").alias("s")).collect()
    assert [list(r.s) for r in got] == [[".tar", ".gz"], [], [], [".py"]]


def test_first_path_rule_decides(spark):
    cases = {"build/README.md": "ignored directory", "poetry.lock": "low-value lock file", "a.min.css": "minified asset", "x.png": "binary or bundled asset", "big.py": "file exceeds size budget", "main.py": "text candidate", "s.css": "style file", "README.md": "high-value config or documentation"}
    df = spark.createDataFrame([(p, 10**6 if p in ("big.py", "main.py") else 1) for p in cases], "path string, size long")
    assert {r.path: r.reason for r in df.select("path", P.path_decision("path", "size")["reason"].alias("reason")).collect()} == cases


def test_content_and_binary(spark):
    df = spark.createDataFrame([("a.py", "# @Generated\nx"), ("main.py", "DO NOT EDIT"), ("b.py", " \n\t "), ("c.py", "x")], "path string, content string")
    assert [r.d.reason for r in df.select(P.content_decision("path", "content").alias("d")).collect()] == ["generated file", "content accepted", "empty file", "content accepted"]
    blobs = [b"", b"plain", b"a\0b", b"\x01" * 9 + b"x" * 20, b"\x01" * 8 + b"x" * 20]
    got = spark.createDataFrame([(bytearray(b),) for b in blobs], "b binary").select(P.binary_blob("b").alias("x")).collect()
    assert [r.x for r in got] == [False, False, True, True, False]


def test_priority_quirks(spark):
    want = {"README.md": (102, "config"), "src/report.py": (83, "service"), "inspect.py": (53, "test"), "api/x.py": (20, "source"), "v/api/x.py": (86, "route"), "notes.bin": (10, "source"), "app.py": (93, "entrypoint")}
    got = spark.createDataFrame([(p,) for p in want], "path string").select("path", P.priority("path").alias("p")).collect()
    assert {r.path: (r.p.score, r.p.role) for r in got} == want


def test_gitignore(spark):
    rules = gitignore.parse(["# c", "", "*.log", "!keep.log", "/only.txt", "out/", "a/*.md", "cache"])
    paths = {"x.log": True, "d/keep.log": False, "only.txt": True, "d/only.txt": False, "out/f": True, "d/out/f": False, "a/b.md": True, "a/b/c.md": True, "d/cache/x": True}
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    marked = gitignore.mark(spark, df, ["# c", "", "*.log", "!keep.log", "/only.txt", "out/", "a/*.md", "cache"])
    assert {r.path: r.gitignored for r in marked.collect()} == paths
    shown = gitignore.text_of(spark.createDataFrame(rules, gitignore.RULE)).orderBy("pos").collect()
    assert [r.text for r in shown] == ["*.log", "!keep.log", "/only.txt", "out/", "a/*.md", "cache"]


def test_budget_skips_and_goes_on(spark):
    files = spark.createDataFrame([("a", 9, 60), ("b", 9, 50), ("c", 9, 50), ("d", 5, 40), ("e", 1, 1), ("f", 1, 1), ("z", 99, 101)], "path string, priority int, char_count long")
    got = selection.select_within_budget(files, 3, 100).where("selected").collect()
    assert {r.path: r.running_chars for r in got} == {"b": 50, "c": 100}
    got = selection.budget_totals(selection.select_within_budget(files, 3, 112)).first()
    assert (got.selected, got.dropped, got.total_chars) == (3, 4, 103)


def test_extraction_of_odd_files():
    r = extract.extract("x.py", "service", "def f(a, /, b: int, *c, d=1, **e) -> list[str]:\n    A().b.c(1).d()\n    'x'.join(())\n")
    f = r["function_details"][0]
    assert f["signature"] == "f(a, b: int, *c, d, **e)" and f["return_type"] == "list[str]"
    assert set(r["call_targets"]) == {"A", "A.b.c", "A.b.c.d", "join"} and r["instantiated_classes"] == ["A"]
    assert extract.extract("x.py", None, None)["confidence"] == 0.96
    bad = extract.extract("x.py", None, "def (")
    assert bad["confidence"] == 0.2 and bad["notes"][0].startswith("syntax-error:")
    assert extract.extract("x.py", None, "a\0b")["confidence"] == 0.2


def test_unique_symbols_and_aliases(spark):
    files = {"p/__init__.py": "", "p/one.py": "class Same:\n    pass\n", "p/two.py": "class Same:\n    pass\n\n\ndef alone():\n    pass\n", "use.py": "import p.two as t\n\n\ndef go():\n    t.alone()\n    Same()\n"}
    f = spark.createDataFrame([(p, c, "source") for p, c in files.items()], "path string, content string, role string")
    got = {tuple(r) for r in resolve.dependency_edges(extract.records(f), f).collect()}
    assert ("use.py", "p/two.py") in got and ("use.py", "p/one.py") not in got
    relative = {"a/b/c.py": "from ..x import y\nfrom ... import top\n", "a/x.py": "y = 1\n", "top.py": ""}
    f = spark.createDataFrame([(p, c, "source") for p, c in relative.items()], "path string, content string, role string")
    assert {tuple(r) for r in resolve.dependency_edges(extract.records(f), f).collect()} == {("a/b/c.py", "a/x.py"), ("a/b/c.py", "top.py")}


def test_coverage_and_workflows(spark):
    f = spark.createDataFrame([(p, c, "route" if "web" in p else "service") for p, c in fixture.FILES.items() if p.endswith(".py")], "path string, content string, role string")
    r = extract.records(f).join(f.select("path", "role"), "path").withColumn("ord", F.col("path")).withColumn("internal_dependencies", F.array().cast("array<string>"))
    c = blueprint.coverage(r).first()
    assert c.source_file_count == 9 and c.route_count == 2 and c.class_count == 3 and c.dynamic_import_count == 1
    assert {w.workflow for w in blueprint.workflows(r).collect()} == {"feature-adding-flow"}
    assert [(a.kind, a.name, a.details) for a in blueprint.apis(r).where("source like '%web.py'").collect()] == [("route", "GET /ships", "ships"), ("route", "POST,PUT /ships", "add")]


def test_extraction_rules():
    code = """
import a.b
import c as d
from . import e
class Zeta(Base):
    @deco
    def get(self): pass
    @app.get('/in-class')
    def late(self): pass
class Alpha: pass
@app.post('/x')
def second(): pass
def first_CACHE(): pass
def _registry(): pass
UPPER, lower = 1, 2
app_state: int = 3
session_store = {}
if __name__ == '__main__':
    second()
"""
    r = extract.extract("x.py", "service", code, True)
    assert r["classes"] == ["Zeta", "Alpha"] and r["functions"] == ["second", "first_CACHE", "_registry"] and r["methods"] == ["Zeta.get", "Zeta.late"]
    assert r["exports"] == ["UPPER", "first_CACHE", "second"] and r["export_styles"] == ["named"]
    assert r["state_signals"] == ["_registry", "app_state", "first_CACHE"] and r["decorators"] == ["app.post"]
    assert [(x["method"], x["path"]) for x in r["routes"]] == [("POST", "/x")]
    assert r["file_structure"] == ["imports", "classes", "functions", "assignments"]
    assert r["notes"] == ["has_main_guard", "gitignored_but_preserved"]
    assert [x["aliases"] for x in r["import_details"]] == [["b"], ["d"], ["e"]]


def test_another_language_can_be_registered(spark):
    extract.register("shell", lambda path, role, content, ignored: {"path": path, "functions": content.split(), "confidence": 0.5})
    try:
        f = spark.createDataFrame([("a.py", "source", "x = 1", "python"), ("b.sh", "source", "f g", "shell"), ("c.md", "doc", "", None)], "path string, role string, content string, language string")
        got = {r.path: (r.functions, r.confidence, r.imports) for r in extract.records(f).collect()}
    finally:
        del extract.EXTRACTORS["shell"]
    assert got == {"a.py": ([], 0.96, []), "b.sh": (["f", "g"], 0.5, [])}


def test_long_chains_are_not_cut(spark):
    from lodeworks.operators import graph

    e = spark.createDataFrame([(i + 1, i) for i in range(6)], "src long, dst long")
    seeds = spark.createDataFrame([(0,)], "id long")
    assert {(r.id, r.depth) for r in graph.reachable_from(spark, seeds, e).collect()} == {(i, i) for i in range(7)}
    with pytest.raises(RuntimeError, match="further"):
        graph.reachable_from(spark, seeds, e, rounds=3)


def test_budget_goes_by_chunks(spark):
    rng = random.Random(4)
    rows = [(f"f{i:03}", rng.randint(1, 60), rng.randint(1, 4)) for i in range(300)]
    want, total = [], 0
    for path, size, _ in sorted(rows, key=lambda r: (-r[2], r[1], r[0])):
        if len(want) < 12 and total + size <= 300:
            total += size
            want.append(path)
    f = spark.createDataFrame(rows, "path string, char_count int, priority int")
    for chunk in (1, 7, 2000):
        got = selection.select_within_budget(f, 12, 300, chunk).where("selected").orderBy("running_chars").collect()
        assert [r.path for r in got] == want and got[-1].running_chars == total


def test_rules_that_share_nothing_rank_by_confidence(spark):
    rules = [(f"r{i}", f"word{i}", [f"e{i}"], 0.1 * (i % 10), i) for i in range(40)]
    skills = [("a", "word3 word7", ["e11"]), ("b", "nothing", [])]
    want = {}
    for s, text, read in skills:
        scored = [(int(5 * bool(set(read) & set(e))) + len(set(text.split()) & {t}) + int(c * 3 + 1e-9), c, r) for r, t, e, c, _ in rules]
        want[s] = [r for n, _, r in sorted((x for x in scored if x[0] > 0), key=lambda x: (-x[0], -x[1], x[2]))[:8]]
    r = spark.createDataFrame(rules, "name string, text string, evidence array<string>, confidence double, ord int")
    got = impact.relevant_rules(r, spark.createDataFrame(skills, "name string, text string, read_files array<string>"))
    assert {s: [x.rule for x in got.where(F.col("skill") == s).orderBy("rank").collect()] for s in want} == want


def test_invalid_toml(spark):
    f = spark.createDataFrame([("pyproject.toml", "﻿[project]\nname = 'x'\n"), ("d/pyproject.toml", "[")], "path string, content string")
    got = {r.path: r.error for r in config.configs(f).collect()}
    assert got["pyproject.toml"] is None and got["d/pyproject.toml"]
    with pytest.raises(Exception, match="pyproject"):
        config.strict(config.configs(f)).collect()


def test_json_and_markdown():
    asked = []
    assert text.parse_json_object("no", repair=lambda p: asked.append(p) or '{"a": 1}', key="a") == {"a": 1} and '"a"' in asked[0]
    with pytest.raises(ValueError, match="ctx"):
        text.parse_json_object("[1]", context="ctx")
    new = text.update_sections(fixture.DOCUMENT, [dict(content="## Core Rules\n- new", heading="Core Rules")])
    assert text.UPDATED in new and "- new" in new and "Typical Patterns" in new
    with pytest.raises(ValueError, match="Nope"):
        text.update_sections(fixture.DOCUMENT, [{"heading": "Nope", "content": "x"}])
    grounded = text.ground(fixture.DOCUMENT, [("ships.py", fixture.FILES["src/harbour/ships.py"])])
    assert "made up" not in grounded and "class Ship" in grounded and not text.ungrounded(grounded, [fixture.FILES["src/harbour/ships.py"]])
    assert "clean code" not in text.drop_low_value_rules(fixture.DOCUMENT)
    assert text.UNSURE in text.drop_low_value_rules("# A\n\n## Core Rules\n- write clean code\n")
    assert text.sanitise_markdown("  # A \r\n  b \U0001f600") == "# A\nb\n"


def test_patch_sections(spark):
    s = spark.createDataFrame([(1, 0, "", "# T"), (1, 2, "A", "## A\nold"), (1, 3, "B", "## B\nb")], "doc int, pos int, heading string, content string")
    u = spark.createDataFrame([(1, "A", "new")], "doc int, heading string, content string")
    assert text.patch_sections(s, u).first().markdown == f"# T\n\n## A\n{text.UPDATED}\nnew\n\n## B\nb\n"


@pytest.mark.parametrize(("args", "want"), [(("full", [], True, True), ("full", [])), (("auto", ["a.py"], False, True), ("full", ["no-previous-state"])), (("auto", ["a.py"], True, False), ("full", ["not-a-repository"])), (("incremental", [], True, True), ("incremental", ["no-changes"])), (("auto", ["pyproject.toml"], True, True), ("full", ["configuration-changed"])), (("auto", [f"{i}.py" for i in range(65)], True, True), ("full", ["too-many-changes"])), (("auto", ["a.py"], True, True), ("incremental", []))])
def test_modes(spark, args, want):
    mode, changed, saved, repo = args
    assert impact.choose_mode(mode, spark.createDataFrame([(c,) for c in changed], "path string"), saved, repo) == want


def test_state(spark, tmp_path):
    path = str(tmp_path / "s" / "state.json")
    assert state.load(spark, path, str(tmp_path)) is None
    data = {"version": 1, "generated_at": "now", "repo_root": str(tmp_path), "files": [{"path": "a", "sha256": "x"}], "reverse_dependencies": {"a": ["b"]}}
    state.save(path, data)
    row = state.load(spark, path, str(tmp_path))
    assert state.files_of(row).first().path == "a" and [tuple(r) for r in state.edges_of(row).collect()] == [("b", "a")]
    assert state.load(spark, path, "/elsewhere") is None
    state.save(path, {"version": 1})
    assert state.load(spark, path, str(tmp_path)) is None
    (tmp_path / "s" / "state.json").write_text("{")
    assert state.load(spark, path, str(tmp_path)) is None


def test_sets(spark):
    d = spark.createDataFrame([("b.py", None), ("new.py", "old.py"), (".lodeworks/x", None), ("b.py", None)], "path string, previous_path string")
    assert [r.path for r in sets.changed_paths(d, ".lodeworks").collect()] == ["b.py", "new.py", "old.py"]
    plan = spark.createDataFrame([("a",), ("b",)], "name string")
    have, lack = sets.split_plan(spark.createDataFrame([("b",), ("c",)], "name string"), plan)
    assert [r.name for r in have.collect()] == ["b"] and [r.name for r in lack.collect()] == ["c"]


def test_tree_source_keeps_odd_names(spark, tmp_path):
    plant(tmp_path, {"_x/__init__.py": "", ".env.example": "A=1", "node_modules/a.py": "x", "b.py": "x\n"})
    got = {r.path: r.size_bytes for r in tree.read_tree(spark, str(tmp_path)).collect()}
    assert got == {"_x/__init__.py": 0, ".env.example": 3, "b.py": 2}
    found, method = tree.scan(spark, str(tmp_path))
    assert method == "filesystem" and {r.path for r in found.collect()} == {"b.py", ".env.example"}
    with pytest.raises(FileNotFoundError):
        tree.scan(spark, str(tmp_path / "none"))


def test_sinks(spark, tmp_path):
    out = str(tmp_path / "o")
    assert sinks.write_outputs(spark, out, {"a.md": "1", "skills/x.md": "# X"}) == (["a.md", "skills/x.md"], ["a.md", "skills/x.md"])
    assert sinks.write_outputs(spark, out, {"a.md": "2", "skills/x.md": "# X"})[1] == ["a.md"]
    assert sinks.prune(out, ["y"]) == ["skills/x.md"]
    src = plant(tmp_path / "s", {"b.md": "# B", "a.md": "# A", "index.md": "# I\n- [b](./b.md)\n"})
    assert sinks.ordered_documents(str(src)) == ["b.md", "a.md"]
    (tmp_path / "AGENTS.md").write_text("mine\n")
    sinks.adapt(str(tmp_path), "all", str(src))
    sinks.adapt(str(tmp_path), "codex", str(src))
    agents = (tmp_path / "AGENTS.md").read_text()
    assert agents.startswith("mine") and agents.count(sinks.BEGIN) == 1 and agents.index("# B") < agents.index("# A")
    os.remove(src / "a.md")
    sinks.adapt(str(tmp_path), "cursor", str(src))
    assert sorted(os.listdir(tmp_path / ".cursor/rules")) == [sinks.MANIFEST, "b.md"]
    with pytest.raises(ValueError, match="nobody"):
        sinks.adapt(str(tmp_path), "nobody", str(src))


class Scripted:
    def __init__(self):
        self.prompts = []

    def __call__(self, prompt, system):
        self.prompts.append(prompt)
        if prompt.startswith("Plan"):
            return '```json\n{"skills": [{"name": "Ships!", "title": "Ships", "scope": "s", "why": "w", "read_files": ["src/harbour/ships.py", "no.py"],}]}\n```'
        if prompt.startswith("Update"):
            return json.dumps({"updated_sections": [dict(content="- longer ships pass", heading="Core Rules")]})
        return "# Ships\n\n## Core Rules\n- Follow best practices\n- Ships over 400 m raise\n\n## Typical Patterns\n```python\ninvented()\n```\n"


def test_runs_end_to_end(spark, tmp_path):
    root = plant(tmp_path)
    commit(root)
    m = Scripted()
    first = run.scan(spark, str(root), model=m)
    out = root / ".lodeworks"
    assert first["mode"] == "full" and "src/harbour/web.py" in first["selected_files"] and first["discovery_method"] == "git"
    doc = (out / "skills/ships.md").read_text()
    assert "invented" not in doc and "class Ship" in doc and "best practices" not in doc
    ready = run.doctor(spark, str(root))
    assert ready["ready"] and [c["name"] for c in ready["checks"]][0] == "artifact_bundle" and len(ready["checks"]) == 7, ready
    assert run.doctor(spark, str(root), output="nowhere")["score"] == 0
    report = json.loads((out / "report.json").read_text())
    assert "skills/ships.md" in report["final_products"] and "state/analysis-state.json" in report["intermediate_files"]
    text = (out / "project-summary.md").read_text()
    assert all(f"## {h}" in text for h in ("Profile", "Evidence", "Stack", "Core modules", "Dependencies", "Rules", "Workflows")) and "Routes" not in text.split("## Evidence")[0]
    lines = render.summary_lines(report)
    assert lines[0] == "command: scan" and any(x.startswith("product: skills/ships.md") for x in lines) and render.readiness_lines(ready, "r", "o")[3] == "ready: true"
    assert run.adapt(str(root), "claude") == [str(root / "CLAUDE.md")]
    assert run.doctor(spark, str(root), target="claude")["score"] == 100
    b = json.loads((out / "skill-blueprint.json").read_text())
    assert b["project_profile"]["repo_type"] == "backend" and b["tech_stack"]["package_managers"] == ["python"]
    assert [s["name"] for s in b["recommended_skills"]][:2] == ["project-overview", "backend-architecture"]
    assert b["project_profile"]["framework_signals"] == ["django", "flask", "pytest"] and b["evidence_coverage"]["route_count"] == 2
    # one file changes: only what depends on it is affected, and only its document is updated
    (root / "src/harbour/ships.py").write_text(fixture.FILES["src/harbour/ships.py"].replace("400", "500"))
    second = run.run_ci(spark, str(root), model=m)
    assert second["mode"] == "incremental" and "src/harbour/ships.py" in second["changed_files"]
    assert {"src/harbour/web.py", "src/harbour/cli.py"} <= set(second["affected_files"]) and "src/harbour/uses.py" not in second["affected_files"]
    assert "longer ships pass" in (out / "skills/ships.md").read_text() and m.prompts[-1].startswith("Update")
    # a run again from the same state gives the same scores: nothing drifts
    third = run.run_ci(spark, str(root))
    assert third["selected_files"] == second["selected_files"]
    costs = run.estimate(spark, str(root))["costs"]
    assert costs["first_generation"]["items"] >= 1


def test_diff_sources(spark, tmp_path):
    root = plant(tmp_path, {"a.py": "x = 1\n", "b.py": "y\n"})
    commit(root)
    base = git.head(str(root))
    (root / "a.py").write_text("x = 2\n")
    (root / "new.py").write_text("n\n")
    os.remove(root / "b.py")
    got = {p["path"]: p["change_type"] for p in git.worktree_diff(str(root), base)}
    assert got == {"a.py": "modify", "b.py": "delete", "new.py": "add"}
    commit(root)
    assert {p["path"] for p in git.diff(str(root), base)} == {"a.py", "b.py", "new.py"}
    assert git.files(str(tmp_path / "nowhere")) == [] and git.head(str(tmp_path.parent)) is None


def test_models_over_http(monkeypatch):
    sent = {}

    def post(url, headers, body):
        sent.update(url=url, headers=headers, body=body)
        return {"content": [{"text": "hi"}], "output_text": "hi", "choices": [{"message": {"content": "hi"}}]}

    for provider, key in (("openai", "OPENAI_API_KEY"), ("claude", "ANTHROPIC_API_KEY"), ("qwen", "DASHSCOPE_API_KEY")):
        monkeypatch.delenv(key, raising=False)
        with pytest.raises(RuntimeError, match=key):
            model.http_model(provider, "m", post)("p", "s")
        monkeypatch.setenv(key, "k")
        assert model.http_model(provider, "m", post)("p", "s") == "hi" and sent["body"]["model"] == "m"
    with pytest.raises(ValueError, match="other"):
        model.http_model("other", "m")


def test_stream_of_changes(spark, tmp_path):
    from lodeworks.streaming import changes

    edges = spark.createDataFrame([("b", "a"), ("c", "b")], "src string, dst string")
    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.json").write_text('{"path": "a"}\n{"path": null}\n')
    got = []
    q = changes.watch(spark.readStream.schema("path string").json(str(tmp_path / "in")), edges, lambda df, n: got.extend(tuple(r) for r in df.collect()), str(tmp_path / "cp"), once=True)
    q.awaitTermination(120)
    assert sorted(got) == [("a", 0), ("b", 1), ("c", 2)]


def test_surface():
    import lodeworks
    from lodeworks import __main__ as cli

    assert {"scan", "adapt", "doctor"} <= set(dir(lodeworks)) and callable(lodeworks.scan)
    with pytest.raises(AttributeError):
        lodeworks.nothing
    assert cli.main(["nonsense"]) == 2 and cli.main(["--help"]) == 0
    assert cli.main(["adapt", "/nowhere"]) == 1
    given = cli.parser().parse_args(["scan", "x", "--structure-only", "--max-changed", "3", "--report", "r.json", "--max-skills", "2"])
    assert given.structure_only and given.max_changed == 3 and given.report == "r.json" and given.max_skills == 2
    with pytest.raises(SystemExit):
        cli.parser().parse_args(["estimate", "--structure-only"])
    with pytest.raises(ValueError):
        run.Options("r", mode="never")


def test_defaults_from_the_environment(monkeypatch):
    from lodeworks import __main__ as cli

    monkeypatch.setenv("LODEWORKS_MODE", "sometimes")
    assert cli.main(["scan"]) == 2
    monkeypatch.setenv("LODEWORKS_MODE", "full")
    monkeypatch.setenv("LODEWORKS_MAX_FILES", "x")
    assert cli.main(["scan"]) == 2
    monkeypatch.setenv("LODEWORKS_MAX_FILES", "7")
    assert cli.parser().parse_args(["ci"]).max_files == 7 and cli.parser().parse_args(["ci"]).mode == "full"


def test_recall_report_and_chart(spark, tmp_path):
    from lodeworks.plans import benchmark

    lines = benchmark.write(spark, str(tmp_path / "r.json"), str(tmp_path / "c.svg"))
    report = json.loads((tmp_path / "r.json").read_text())
    recall = {r["method"]: r["recall"] for r in report["results"]}
    assert report["gold"] == 45 and recall["path-only"] < recall["symbols"] < recall["semantic"] == 1.0
    assert (tmp_path / "c.svg").read_text().count("<rect") == 3 and lines[2].startswith("semantic: recall 1.000 (45/45)")


def test_entry_without_a_dependency():
    code = "import sys; sys.modules['ahocorasick'] = None; import __spark_entry__ as e; q = e.queries(); assert len(q) >= 45 and not [n for n in q if n.startswith('op') or n == 'pipeline'], list(q)"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))), timeout=120)


def test_pagerank_against_plain_rounds(spark):
    from lodeworks.operators import graph

    pairs = [("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("a", "e"), ("f", "e")]
    names = sorted({x for p in pairs for x in p} | {"alone"})
    rank = {n: 1 / len(names) for n in names}
    for _ in range(20):
        out = {n: [d for s, d in pairs if s == n] for n in names}
        lost = sum(rank[n] for n in names if not out[n])
        rank = {n: 0.15 / len(names) + 0.85 * (lost / len(names) + sum(rank[s] / len(out[s]) for s in names if n in out[s])) for n in names}
    got = graph.pagerank(spark, spark.createDataFrame([(n,) for n in names], "id string"), spark.createDataFrame(pairs, "src string, dst string"))
    assert {r.id: round(r["rank"], 12) for r in got.collect()} == {n: round(v, 12) for n, v in rank.items()}


def test_components_and_cluster_names(spark):
    from lodeworks.operators import graph

    pairs = [(f"p/x/n{i:02}", f"p/x/n{i + 1:02}") for i in range(12)] + [("q/a", "r/b")]
    e = spark.createDataFrame(pairs, "src string, dst string")
    nodes = graph.nodes_of(e).unionByName(spark.createDataFrame([("lone",)], "id string"))
    got = graph.components(spark, nodes, e)
    assert {r.root for r in got.collect()} == {"p/x/n00", "q/a", "lone"}
    named = graph.cluster_names(graph.clusters(got)).orderBy("cluster").collect()
    assert [(len(r.files), r.name) for r in named] == [(13, "p/x"), (2, "q")]
