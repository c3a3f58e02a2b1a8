"""Whole runs over a source tree: scan, estimate, ci, adapt, doctor."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import vocabulary as V
from ..functions import paths as P
from ..functions.text import parse_diff
from ..operators import blueprint, config, cost, extract, graph, impact, patterns, resolve, scoring, selection, sets, sinks
from ..sources import git, state, tree
from ..storage import Scratch
from . import model as M
from . import render as R

_PATCH = "path string, change_type string, previous_path string"


@dataclass
class Options:
    root: str
    command: str = "scan"
    output: str = V.OWN_FOLDER
    mode: str = "full"
    base: str | None = None
    head: str | None = None
    diff_file: str | None = None
    max_files: int = V.MAX_FILES
    max_kb: int = V.MAX_FILE_KB
    max_chars: int = V.MAX_TOTAL_CHARS
    max_changed: int = 64
    pricing: str | None = None
    model: M.Model | None = None
    max_skills: int = 8
    structure_only: bool = False
    report: str | None = None
    write: bool = True
    #: "plan", "generate" and "update" may be replaced by functions of the arguments of those in ``model``
    prompts: dict = field(default_factory=dict)

    def __post_init__(self):
        if self.command not in ("scan", "estimate", "ci") or self.mode not in ("auto", "full", "incremental"):
            raise ValueError(f"no run is called {self.command!r} in mode {self.mode!r}")
        self.root = os.path.realpath(os.path.expanduser(self.root))
        for name in ("diff_file", "pricing"):
            if (given := getattr(self, name)) is not None:
                setattr(self, name, self.resolve(given))
        if self.structure_only:
            self.model = None

    def resolve(self, path: str) -> str:
        """A path of the user's, taken from the root where it is relative."""
        return os.path.realpath(os.path.join(self.root, os.path.expanduser(path)))

    @property
    def folder(self) -> str:
        return self.resolve(self.output)

    @property
    def report_path(self) -> str:
        return self.resolve(self.report) if self.report else os.path.join(self.folder, "report.json")

    @property
    def state_path(self) -> str:
        return os.path.join(self.folder, "state", "analysis-state.json")


@dataclass
class Analysis:
    files: DataFrame
    records: DataFrame
    configs: DataFrame
    edges: DataFrame
    method: str
    scratch: Scratch
    parts: dict = field(default_factory=dict)


def analyse(spark: SparkSession, o: Options, saved: DataFrame | None = None) -> Analysis:
    """Candidates, records, dependency graph, refined scores and the final selection."""
    scratch = Scratch(spark)
    found, method = tree.scan(spark, o.root, o.max_kb)
    files = scratch.write(found)
    python = files.where(F.col("language").isin(*extract.EXTRACTORS))
    summary = F.to_json(F.struct(*[c.split(" ")[0] for c in _columns(extract.SCHEMA)]))
    if saved is None:
        records = scratch.write(extract.records(python))
    else:  # records of files with the same content come from the state
        marked = state.reuse(python, state.files_of(saved)).withColumn("old", F.from_json("saved_summary", extract.SCHEMA))
        old = marked.where("old is not null").select("old.*")
        fresh = extract.records(marked.where("old is null").select("path", "role", "content", "language", "gitignored"))
        records = scratch.write(old.unionByName(fresh))
    records_json = records.select("path", summary.alias("summary"))
    configs = config.strict(config.configs(files)).withColumn("pos", F.row_number().over(Window.orderBy("path")) - 1)
    configs = scratch.write(configs)
    edges = scratch.write(resolve.dependency_edges(records, files.select("path")))
    nodes = records.select(F.col("path").alias("id"))
    degree = scratch.write(graph.degrees(nodes, edges))
    ranks = graph.pagerank(spark, nodes, edges)
    hub = scratch.write(graph.hubs(degree))
    scored = files.join(records.drop("short_doc_summary", "confidence"), "path", "left").withColumn("score", F.col("priority"))
    code = scoring.refine_content(scored.where("functions is not null")).select("path", "role", "score", "reasons")
    rest = scored.where("functions is null").select("path", "role", "score", "reasons")
    refined = scoring.refine_graph(code.unionByName(rest), degree, ranks, graph.entry_points(degree), hub)
    base = files.drop("role", "reasons").withColumnRenamed("priority", "base_priority")
    refined = base.join(refined.select("path", "role", F.col("score").alias("priority"), F.array_distinct(F.concat("reasons", "graph_reasons")).alias("reasons")), "path")
    refined = refined.withColumn("ord", F.row_number().over(Window.orderBy(*selection.order_key())))
    chosen = scratch.write(selection.select_within_budget(refined, o.max_files, o.max_chars))
    deps = graph.dependencies(edges).withColumnRenamed("id", "path")
    full = records.join(deps, "path", "left").withColumn("internal_dependencies", F.coalesce("internal_dependencies", F.array().cast("array<string>")))
    full = scratch.write(full.join(chosen.select("path", "role", "language", "ord", "selected", "priority"), "path"))
    return Analysis(chosen, full, configs, edges, method, scratch, {"hub": hub, "degree": degree, "nodes": nodes, "summaries": records_json})


def _columns(ddl: str) -> list[str]:
    out, depth, start = [], 0, 0
    for i, c in enumerate(ddl + ","):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(ddl[start:i].strip())
            start = i + 1
    return out


def rules(records: DataFrame, configs: DataFrame) -> DataFrame:
    """(name, text, evidence, confidence, ord) of what most files of a role have in common."""
    pick = lambda kind, c: F.struct(F.lit(kind).alias("kind"), F.col(c).alias("values"))
    bases = F.struct(F.lit("base class").alias("kind"), F.flatten(F.transform("class_details", lambda c: c["bases"])).alias("values"))
    names = F.struct(F.lit("method").alias("kind"), F.transform("methods", lambda m: F.element_at(F.split(m, r"\."), -1)).alias("values"))
    groups = patterns.group_sizes(records).where("n >= 2")
    rows = records.join(groups.select("role"), "role", "left_semi")
    each = rows.select("role", "path", F.explode(F.array(bases, names, pick("import", "imports"), pick("decorator", "decorators"), pick("export", "export_styles"))).alias("l")).select("role", "path", "l.kind", F.explode("l.values").alias("feature"))
    found = patterns.common_features(each, groups)
    shape = patterns.modal_structure(records.select("role", "path", "ord", F.col("file_structure").alias("structure")), groups)
    both = found.select("role", "kind", "feature", "coverage", "evidence").unionByName(shape.select("role", F.lit("structure").alias("kind"), F.array_join("structure", " -> ").alias("feature"), "coverage", F.array().cast("array<string>").alias("evidence")))
    n = patterns.numbered(both)
    out = n.select(F.concat_ws("-", "role", "number").alias("name"), F.concat(F.lit("Most "), F.col("role"), F.lit(" files share the "), F.col("kind"), F.lit(" "), F.col("feature")).alias("text"), F.slice("evidence", 1, 8).alias("evidence"), F.col("coverage").alias("confidence"))
    stems = records.select("role", "path", "ord", P.stem("path").alias("name"))
    styled = patterns.naming(stems)
    whole = blueprint.repository_naming(records).select(F.lit("file-naming").alias("name"), F.concat(F.lit("Most files are named in "), F.col("case_style")).alias("text"), "evidence", "confidence")
    affix = F.concat(F.when(F.col("prefix") != "", F.concat(F.lit(", beginning with "), F.col("prefix"))).otherwise(""), F.when(F.col("suffix") != "", F.concat(F.lit(", ending in "), F.col("suffix"))).otherwise(""))
    named = styled.select(F.concat_ws("-", "role", F.lit("naming")).alias("name"), F.concat(F.lit("Most "), F.col("role"), F.lit(" files are named in "), F.col("case_style"), affix).alias("text"), F.col("examples").alias("evidence"), F.col("coverage").alias("confidence"))
    return out.unionByName(named).unionByName(whole).unionByName(blueprint.heuristic_rules(records, configs)).withColumn("ord", F.row_number().over(Window.orderBy(F.desc("confidence"), "name")))


def describe(spark: SparkSession, a: Analysis, root: str = "") -> dict:
    """The blueprint: what the selected sources and all configuration say, as plain data."""
    src = a.scratch.write(a.records.where("selected"))
    rows = lambda df: [r.asDict(recursive=True) for r in df.collect()]
    folders = a.files.select(P.parent("path").alias("folder"), "role", "path", "ord")
    nodes = a.parts["nodes"]
    profile = a.scratch.write(blueprint.classify(a.files, src, a.configs))
    cluster = a.scratch.write(graph.cluster_names(graph.clusters(graph.components(spark, nodes, a.edges)).where("cluster <= 6")))
    key = selection.module_key(src)
    ranked = src.withColumn("pos", F.row_number().over(Window.orderBy(*key)))
    first_of_role = ranked.where(F.col("role").isin(*selection.ROLE_ORDER)).withColumn("r", F.row_number().over(Window.partitionBy("role").orderBy("pos"))).where("r <= 2")
    flows = blueprint.workflows(src)
    members = cluster.select("cluster", F.explode("files").alias("path")).join(ranked.select("path", "pos"), "path").groupBy("cluster").agg(F.min_by("path", "pos").alias("path")).select("path", F.col("cluster").alias("pos"))
    lists = [profile.select(F.posexplode("entrypoints").alias("pos", "path")).select("path", "pos"), a.parts["hub"].where("pos <= 8").select(F.col("id").alias("path"), "pos"), members, flows.select(F.posexplode("evidence").alias("pos", "path")).where("pos < 3").select("path", "pos"), first_of_role.select("path", "pos"), ranked.select("path", "pos")]
    core = selection.core_modules([x.join(src.select("path"), "path", "left_semi") for x in lists])
    domains = blueprint.domains(src)
    names = core.join(src, "path").orderBy("source", "pos", "path")
    hubs = [r.id for r in a.parts["hub"].orderBy("pos").select("id").collect()]
    entry = [r.id for r in graph.entry_points(a.parts["degree"]).orderBy("id").limit(20).collect()]
    return {
        "project_profile": {"name": os.path.basename(root)} | rows(profile)[0],
        "tech_stack": rows(blueprint.tech_stack(profile, a.configs))[0],
        "directory_summary": rows(blueprint.directory_summary(folders)),
        "domains": rows(domains.orderBy("domain")),
        "key_configs": rows(a.configs.orderBy("pos").limit(12).select("path", "kind", "summary", "framework_signals", "entrypoints", "details")),
        "core_modules": rows(names.select("path", "role", "short_doc_summary", "classes", "functions", "routes", "call_targets", "type_references", "internal_dependencies")),
        "important_apis": rows(blueprint.apis(src)),
        "abstract_rules": rows(rules(src, a.configs).orderBy("ord").limit(40)),
        "concrete_workflows": rows(flows),
        "evidence_coverage": rows(blueprint.coverage(src))[0],
        "import_graph": rows(graph.stats(nodes, a.edges))[0] | {"hubs": hubs, "entry_files": entry, "clusters": rows(cluster.orderBy("cluster").select("name", "files"))},
        "recommended_skills": rows(blueprint.recommendations(profile, domains, flows, src).drop("pos")),
    }


def _call_items(spark: SparkSession, b: dict) -> dict[str, DataFrame]:
    """The parts of a blueprint that go into the call of a skill whose evidence they share: (key, evidence, chars)."""
    parts = {"module": [(m["path"], [m["path"]], m) for m in b["core_modules"]], "rule": [(r["name"], r["evidence"], r) for r in b["abstract_rules"]], "workflow": [(w["workflow"], w["evidence"], w) for w in b["concrete_workflows"]], "api": [(f"{x['source']}:{x['name']}", [x["source"]], x) for x in b["important_apis"]]}
    size = lambda x: len(json.dumps(x, ensure_ascii=False, indent=2, default=str))
    return {kind: spark.createDataFrame([(k, e, size(x)) for k, e, x in items], "key string, evidence array<string>, chars long") for kind, items in parts.items()}


def changes(spark: SparkSession, o: Options, head_of_state: str | None) -> DataFrame:
    """Patches by the first that applies: a diff file, a base to compare with, the commit of the last run."""
    if o.diff_file:
        with open(o.diff_file, encoding="utf-8", errors="ignore") as f:
            text = f.read()
        found = parse_diff(text)
        if text.strip() and not found:
            raise ValueError(f"{o.diff_file} is not a unified diff")
    elif o.base:
        found = git.diff(o.root, o.base, o.head or "HEAD")
    elif head_of_state and git.is_repository(o.root):
        found = git.worktree_diff(o.root, head_of_state)
    else:
        found = []
    return spark.createDataFrame([(p["path"], p["change_type"], p["previous_path"]) for p in found], _PATCH), found


def execute(spark: SparkSession, o: Options) -> dict:
    """One run; the report. scan and ci write the bundle and the state, estimate only the report."""
    saved = state.load(spark, o.state_path, o.root)
    head = saved.first().head_commit if saved is not None else None
    diffs, patches = changes(spark, o, head)
    changed = sets.changed_paths(diffs, o.output)
    mode, notes = impact.choose_mode(o.mode, changed, saved is not None, git.is_repository(o.root), bool(o.diff_file), o.max_changed)
    a = analyse(spark, o, saved if mode == "incremental" else None)
    b = describe(spark, a, o.root)
    old_edges = state.edges_of(saved) if saved is not None else None
    edges = a.edges if old_edges is None else a.edges.unionByName(old_edges).distinct()
    affected = a.scratch.write(impact.affected_files(spark, mode, a.files.where("selected"), changed, edges))
    skills = spark.createDataFrame([(s["name"], s["purpose"], s["source_evidence"]) for s in b["recommended_skills"]], "name string, purpose string, source_evidence array<string>")
    index = impact.skill_index(skills)
    index = index if saved is None else sets.merge_index(index, state.index_of(saved))
    index = a.scratch.write(index)
    touched = [r.name for r in impact.affected_skills(affected, index).collect()]
    artifacts = R.render(b)
    price = config.pricing(o.pricing)
    shared = sum(map(len, artifacts.values()))
    context = len(json.dumps({k: b[k] for k in ("project_profile", "tech_stack")}, ensure_ascii=False, indent=2, default=str))
    sized = skills.withColumn("chars", F.length(F.to_json(F.struct("name", "purpose", "source_evidence"))) + F.lit(context))
    calls = a.scratch.write(cost.calls(sized, _call_items(spark, b), shared))
    first = cost.estimate(calls, price)
    extra = cost.diff_chars(changed, affected).first().diff_chars
    again = cost.estimate(calls.where(F.col("name").isin(touched) if touched else F.lit(False)).select("name", (F.col("input_chars") - len(artifacts["project-summary.md"]) + extra).alias("input_chars"), cost.output_chars("name", F.lit(3)).alias("output_chars")), price)
    totals = {s: cost.total(df, s).first().asDict() for s, df in (("first_generation", first), ("incremental_rewrite", again), ("incremental_patch", cost.patch(again)))}
    chosen = [r.path for r in a.files.where("selected").orderBy("ord").select("path").collect()]
    entries = write_documents(spark, o, a, b, mode, touched, patches, artifacts, saved) if o.model and o.command != "estimate" else None
    report = {"command": o.command, "requested_mode": o.mode, "mode": mode, "structure_only": o.structure_only, "root": o.root, "output": o.folder, "model": getattr(o.model, "name", None), "repo_type": b["project_profile"]["repo_type"], "candidate_count": a.files.count(), "total_chars": a.files.where("selected").agg(F.coalesce(F.sum("char_count"), F.lit(0))).first()[0], "notes": notes, "selected_files": chosen, "changed_files": [r.path for r in changed.collect()], "affected_files": [r.path for r in affected.orderBy("path").collect()], "affected_skills": touched, "costs": totals, "pricing": price, "discovery_method": a.method, "written_files": [], "updated_files": [], "removed_files": []}
    if o.write and o.command != "estimate":
        report["written_files"], report["updated_files"] = sinks.write_outputs(spark, o.folder, artifacts)
        if entries is not None:
            report["removed_files"] = sinks.prune(o.folder, [e["name"] for e in entries])
        save_state(o, a, index, edges, chosen)
    bundle = [*report["written_files"], os.path.relpath(o.report_path, o.folder), *(["state/analysis-state.json"] if o.write and o.command != "estimate" else [])]
    report["final_products"], report["intermediate_files"] = R.partition(bundle)
    os.makedirs(os.path.dirname(o.report_path), exist_ok=True)
    with open(o.report_path, "w", encoding="utf-8") as f:
        json.dump(report, f, ensure_ascii=False, indent=2)
    return report


def write_documents(spark, o: Options, a: Analysis, b: dict, mode: str, touched: list[str], patches: list[dict], artifacts: dict[str, str], saved: DataFrame | None = None) -> list[dict]:
    """Adds planned documents to the artifacts: all of them, or on an incremental ci run those that a
    change bears on, by section; a skill that the plan lacks brings a new plan."""
    path = os.path.join(o.folder, "skill-plan.json")
    texts = {r.path: r.content for r in a.files.select("path", "content").collect() if r.content is not None}
    old = json.load(open(path, encoding="utf-8"))["skills"] if o.command == "ci" and mode == "incremental" and os.path.exists(path) else None
    affected = {p for p in (x["path"] for x in patches)}
    due = None if old is None else [e for e in old if affected & set(e["read_files"])]
    entries = old if old is not None and (due or not set(touched) - {e["name"] for e in old}) else M.plan(o.model, b, set(texts), o.max_skills, o.prompts.get("plan"))
    wide = spark.createDataFrame([(e["name"], " ".join([e["name"], e["title"], e["scope"], e["why"], *e["read_files"]]), e["read_files"]) for e in entries], "name string, text string, read_files array<string>")
    rule = spark.createDataFrame([(r["name"], r["text"], r["evidence"], float(r["confidence"]), r["ord"]) for r in b["abstract_rules"]], "name string, text string, evidence array<string>, confidence double, ord int")
    fits: dict[str, list[str]] = {}
    for r in impact.relevant_rules(rule, wide).join(rule.select(F.col("name").alias("rule"), "text"), "rule").orderBy("skill", "rank").collect():
        fits.setdefault(r.skill, []).append(r.text)
    wanted = sorted({p for e in entries for p in e["read_files"]})
    known = {r.path: r.asDict(recursive=True) for df in (a.records, a.configs) for r in df.where(F.col("path").isin(wanted)).collect()} if wanted else {}
    before = {r.path: json.loads(r.summary) for r in state.files_of(saved).where("summary is not null").select("path", "summary").collect()} if saved is not None else {}
    diffs = spark.createDataFrame([(p["path"], i) for i, p in enumerate(patches)], "path string, n int")
    for e in entries:
        place = os.path.join(o.folder, "skills", f"{e['name']}.md")
        files = [M.context(p, texts.get(p), known.get(p)) for p in e["read_files"]]
        if entries is old and os.path.exists(place):
            if e in due:
                wanted = spark.createDataFrame(list(enumerate(e["read_files"])), "pos int, path string")
                mine = [patches[r.n] for r in impact.relevant_diffs(diffs, wanted).orderBy("pos", "n").collect()]
                was = "\n\n".join(M.skeleton(p["path"], before.get(p["path"])) for p in mine)
                with open(place, encoding="utf-8") as f:
                    artifacts[f"skills/{e['name']}.md"] = M.update(o.model, f.read(), mine, was, o.prompts.get("update"))
        else:
            artifacts[f"skills/{e['name']}.md"] = M.generate(o.model, e, files, fits.get(e["name"], []), o.prompts.get("generate"))
    artifacts["skills/index.md"] = M.index(entries)
    artifacts["skill-plan.json"] = json.dumps({"skills": entries}, ensure_ascii=False, indent=2) + "\n"
    return entries


def save_state(o: Options, a: Analysis, index: DataFrame, edges: DataFrame, chosen: list[str]) -> None:
    files = a.files.join(a.parts["summaries"], "path", "left")
    rows = files.select("path", "sha256", "language", "role", "base_priority", "priority", "size_bytes", "char_count", "selected", "gitignored", "summary").orderBy("path").collect()
    ignore = os.path.join(o.root, ".gitignore")
    state.save(o.state_path, {
        "version": 1, "repo_root": os.path.realpath(o.root), "selected_paths": chosen, "head_commit": git.head(o.root), "generated_at": f"{datetime.now(timezone.utc):%Y-%m-%dT%H:%M:%S+00:00}",
        "directory_counts": {r.folder: r["count"] for r in a.files.groupBy(P.parent("path").alias("folder")).count().collect()},
        "gitignore_patterns": open(ignore, encoding="utf-8", errors="ignore").read().splitlines() if os.path.exists(ignore) else [],
        "discovery_method": a.method, "candidate_count": len(rows), "total_chars": sum(r.char_count for r in rows if r.selected), "bytes_read": sum(r.size_bytes for r in rows),
        "files": [r.asDict() for r in rows], "reverse_dependencies": {r.id: r.importers for r in graph.reverse_dependencies(edges).collect()},
        "skill_index": [r.asDict() for r in index.collect()],
    })


def scan(spark: SparkSession, root: str, **options) -> dict:
    return execute(spark, Options(root, "scan", **options))


def estimate(spark: SparkSession, root: str, **options) -> dict:
    return execute(spark, Options(root, "estimate", **options))


def run_ci(spark: SparkSession, root: str, **options) -> dict:
    return execute(spark, Options(root, "ci", **{"mode": "auto", **options}))


def adapt(root: str, target: str = "all", source: str | None = None) -> list[str]:
    return sinks.adapt(root, target, source or os.path.join(root, V.OWN_FOLDER, "skills"))


def doctor(spark: SparkSession, root: str, output: str = V.OWN_FOLDER, target: str | None = None) -> dict:
    found = sinks.checks(spark, root, os.path.join(root, output), target)
    return sinks.readiness(found).first().asDict() | {"checks": [r.asDict() for r in found.collect()]}
