"""Aggregates that describe a repository: folders, coverage, domains, workflows, stack."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import vocabulary as V
from ..functions import paths as P


def directory_summary(files: DataFrame, cap: int = 16) -> DataFrame:
    """(folder, file_count, dominant_roles, sample_files) of files (folder, role, path, ord): the three
    commonest roles, of equally common ones the first seen, and the first three files."""
    roles = files.groupBy("folder", "role").agg(F.count("*").alias("c"), F.min("ord").alias("o"))
    top = roles.withColumn("r", F.row_number().over(Window.partitionBy("folder").orderBy(F.desc("c"), "o"))).where("r <= 3").groupBy("folder").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "role"))), lambda x: x["role"]).alias("dominant_roles"))
    sample = files.withColumn("r", F.row_number().over(Window.partitionBy("folder").orderBy("ord"))).where("r <= 3").groupBy("folder").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "path"))), lambda x: x["path"]).alias("sample_files"))
    counts = files.groupBy("folder").agg(F.count("*").alias("file_count"))
    return counts.join(top, "folder").join(sample, "folder").orderBy(F.desc("file_count"), "folder").limit(cap)


_COUNTED = {"class_count": "classes", "function_count": "functions", "route_count": "routes", "call_target_count": "call_targets", "type_reference_count": "type_references", "data_flow_edge_count": "data_flow_edges", "dynamic_import_count": "dynamic_imports", "raised_exception_count": "raised_exceptions", "model_or_schema_count": "models_or_schemas", "internal_dependency_count": "internal_dependencies"}
_SIGNAL = [c for k, c in _COUNTED.items() if k not in ("class_count", "function_count")]


def coverage(records: DataFrame) -> DataFrame:
    """One row of twelve counts over extracted records."""
    high = P.any_of(F.size(c) > 0 for c in _SIGNAL)
    return records.agg(F.count("*").alias("source_file_count"), F.count_if(high).alias("high_signal_file_count"), *(F.coalesce(F.sum(F.size(c)), F.lit(0)).alias(k) for k, c in _COUNTED.items()))


def domains(records: DataFrame) -> DataFrame:
    """(domain, evidence): the first eight paths of each domain, in order of path."""
    d = records.select(P.domain("role").alias("domain"), "path").distinct()
    return d.withColumn("r", F.row_number().over(Window.partitionBy("domain").orderBy("path"))).where("r <= 8").groupBy("domain").agg(F.array_sort(F.collect_list("path")).alias("evidence"))


#: name, roles that have to occur, roles of its evidence (none: all files), what it is about, and its steps
WORKFLOWS = (
    (
        "api-flow", ("route", "service", "model"), ("route", "service", "model"),
        "Requests come in at routes, are worked on in services, and rest on models.",
        ("Find the route that takes the request.", "Read the service it hands over to.", "Check the models that validate or store the data."),
    ),
    (
        "feature-adding-flow", ("route", "service"), (),
        "A new feature starts at an entry for users and goes on in the layers next to it.",
        ("Choose the route, command or job that users meet.", "Put the logic in a service or repository beside it.", "Bring validation, interfaces and tests of these layers up to date."),
    ),
)


def workflows(records: DataFrame) -> DataFrame:
    """(workflow, summary, steps, evidence) of the workflows whose roles all occur, in the order of the table;
    evidence is the first eight files of its roles."""
    have = records.agg(F.collect_set("role").alias("roles"))
    lits = lambda xs: F.array(*map(F.lit, xs)).cast("array<string>")
    rows = [F.struct(F.lit(i).alias("n"), F.lit(w).alias("workflow"), lits(need).alias("need"), lits(shown).alias("shown"), F.lit(text).alias("summary"), lits(steps).alias("steps")) for i, (w, need, shown, text, steps) in enumerate(WORKFLOWS)]
    on = have.select("roles", F.explode(F.array(*rows)).alias("w")).where(F.size(F.array_except("w.need", "roles")) == 0).select("w.*")
    rows = records.select("role", "path", "ord").join(F.broadcast(on), (F.size("shown") == 0) | F.array_contains("shown", F.col("role")))  # two workflows at most
    first = rows.withColumn("r", F.row_number().over(Window.partitionBy("n").orderBy("ord"))).where("r <= 8")
    found = first.groupBy("n", "workflow", "summary", "steps").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "path"))), lambda x: x["path"]).alias("evidence"))
    return found.orderBy("n").select("workflow", "summary", "steps", "evidence")


def apis(records: DataFrame, cap: int = 16, per_file: int = 4) -> DataFrame:
    """(kind, name, source, details): file by file its routes, then of a service the first four functions and methods."""
    routes = records.select("ord", F.lit(0).alias("rank"), F.posexplode("routes").alias("pos", "r")).select("ord", "rank", "pos", F.lit("route").alias("kind"), F.concat_ws(" ", "r.method", "r.path").alias("name"), F.col("r.handler").alias("details"))
    entries = F.slice(F.concat("functions", "methods"), 1, per_file)
    service = records.where("role = 'service'").select("ord", F.lit(1).alias("rank"), "short_doc_summary", F.posexplode(entries).alias("pos", "name")).select("ord", "rank", "pos", F.lit("service").alias("kind"), "name", F.col("short_doc_summary").alias("details"))
    both = routes.unionByName(service).join(records.select("ord", F.col("path").alias("source")), "ord")
    return both.orderBy("ord", "rank", "pos").limit(cap).select("kind", "name", "source", "details")


def classify(files: DataFrame, records: DataFrame, configs: DataFrame) -> DataFrame:
    """One row: languages of all files (path, language), framework signals and entrypoints, what kind of
    repository it is, how it is laid out, and the evidence for that.

    A framework of the backend counts 2, a route, service or model 1, a top folder that says so 2.
    configs have pos, their order; the first four are evidence.
    """
    flat = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    signals = configs.agg(flat("framework_signals").alias("framework_signals"), flat("entrypoints").alias("config_entrypoints"), F.array_sort(F.collect_list(F.when(F.col("pos") < 4, F.col("path")))).alias("config_paths"))
    code = records.agg(F.array_sort(F.collect_set(F.when(F.col("role") == "entrypoint", F.col("path")))).alias("entry_files"), F.count_if(F.col("role").isin("route", "service", "model")).alias("layers"))
    top = F.split_part("path", F.lit("/"), F.lit(1))
    some = lambda *names: F.coalesce(F.bool_or(top.isin(*names)), F.lit(False))
    tree = files.agg(F.array_sort(F.collect_set("language")).alias("languages"), some("apps", "packages", "services").alias("many"), some("api", "backend", "server").alias("serves"))
    backend = F.array(*map(F.lit, sorted(V.BACKEND_FRAMEWORKS)))
    score = F.size(F.array_intersect("framework_signals", backend)) * 2 + F.col("layers") + F.when(F.col("serves"), 2).otherwise(0)
    entry = F.array_sort(F.array_union("entry_files", "config_entrypoints"))
    out = code.crossJoin(signals).crossJoin(tree).select("languages", "framework_signals", entry.alias("entrypoints"), score.cast("int").alias("backend_score"), "many", "config_paths")
    kind = F.when(F.col("many"), "monorepo").when(F.col("backend_score") > 0, "backend").otherwise("infra_lib")
    layout = F.when(F.col("many"), "workspace").otherwise("single-package")
    return out.select(kind.alias("repo_type"), layout.alias("package_topology"), "languages", "framework_signals", "entrypoints", "backend_score", F.array_sort(F.array_union("entrypoints", "config_paths")).alias("evidence"))


def tech_stack(profile: DataFrame, configs: DataFrame) -> DataFrame:
    """One row of four sorted lists: languages, frameworks, package_managers, tools."""
    used = configs.agg(F.array_sort(F.collect_set(F.when(F.col("kind").isin("pyproject", "requirements"), F.lit("python")))).alias("package_managers"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("framework_signals")))).alias("tools"))
    return profile.select("languages", F.col("framework_signals").alias("frameworks")).crossJoin(used)


def recommendations(profile: DataFrame, domain: DataFrame, flows: DataFrame, records: DataFrame, cap: int = 8) -> DataFrame:
    """(pos, name, purpose, scope, source_evidence): an overview, the backend where there is one, then each
    workflow; of equal names the first."""
    overview = profile.select(F.lit(0).alias("pos"), F.lit("project-overview").alias("name"), F.lit("How the repository is laid out, what it is built on, and which boundaries hold.").alias("purpose"), F.lit("The whole project.").alias("scope"), F.slice("evidence", 1, 6).alias("source_evidence"))
    layers = records.where(F.col("role").isin("route", "service", "model")).withColumn("r", F.row_number().over(Window.orderBy("ord"))).where("r <= 8").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "path"))), lambda x: x["path"]).alias("source_evidence"))
    backend = layers.join(domain.where("domain = 'backend'").limit(1).select("domain")).select(F.lit(1).alias("pos"), F.lit("backend-architecture").alias("name"), F.lit("How routes, services, models and validation fit together.").alias("purpose"), F.lit("Handling of requests and boundaries of data on the server.").alias("scope"), "source_evidence")
    order = {w: i for i, (w, *_) in enumerate(WORKFLOWS)}
    place = F.coalesce(*[F.when(F.col("workflow") == w, F.lit(2 + i)) for w, i in order.items()], F.lit(2 + len(order)))
    each = flows.select(place.alias("pos"), F.col("workflow").alias("name"), F.concat(F.lit("How to go about "), F.col("workflow"), F.lit(".")).alias("purpose"), F.col("summary").alias("scope"), F.slice("evidence", 1, 6).alias("source_evidence"))
    every = overview.unionByName(backend).unionByName(each)
    first = every.groupBy("name").agg(F.min_by(F.struct(*[c for c in every.columns if c != "name"]), "pos").alias("m")).select("m.pos", "name", "m.purpose", "m.scope", "m.source_evidence")
    return first.orderBy("pos", "name").limit(cap)


#: Columns of ``coverage`` in the lines of the documents.
COVERAGE_LINES = (
    ("Source files", (("analysed", "source_file_count"), ("with strong signals", "high_signal_file_count"))),
    ("Symbols", (("classes", "class_count"), ("functions", "function_count"), ("models or schemas", "model_or_schema_count"))),
    ("Behaviour", (("routes", "route_count"), ("calls", "call_target_count"), ("types", "type_reference_count"), ("data flows", "data_flow_edge_count"))),
    ("At run time", (("dynamic imports", "dynamic_import_count"), ("raised", "raised_exception_count"), ("internal dependencies", "internal_dependency_count"))),
)


def coverage_lines(row: dict | None) -> list[str]:
    """The twelve counts as four lines; one line where there are none."""
    if row is None:
        return ["not available"]
    return [f"{title}: {', '.join(f'{label} {row[c]}' for label, c in parts)}" for title, parts in COVERAGE_LINES]


def heuristic_rules(records: DataFrame, configs: DataFrame) -> DataFrame:
    """(name, text, evidence, confidence) of what roles and configuration alone suggest."""
    first = lambda rows, k: F.transform(F.slice(F.array_sort(F.collect_list(F.struct("ord", "path"))), 1, k), lambda x: x["path"])
    roles = records.agg(F.collect_set("role").alias("roles"))

    def of(rows: DataFrame, k: int, name: str, text: str, confidence: float) -> DataFrame:
        top = rows.select("ord", "path").orderBy("ord").limit(k)
        return top.agg(first(top, k).alias("evidence")).where(F.size("evidence") > 0).select(F.lit(name).alias("name"), F.lit(text).alias("text"), "evidence", F.lit(confidence).alias("confidence"))

    layered = of(records.where(F.col("role").isin("route", "service", "model")), 8, "layered-backend", "Routes are kept apart from services and models.", 0.45)
    layered = layered.crossJoin(roles).where(F.array_contains("roles", "route") & F.array_contains("roles", "service")).drop("roles")
    central = of(configs.select(F.col("pos").alias("ord"), "path"), 4, "root-configs", "A few configuration files at the root rule builds and dependencies.", 0.4)
    tested = of(records.where("role = 'test'"), 8, "testing-convention", "There are tests of their own, to be kept in step with what they test.", 0.35)
    return layered.unionByName(central).unionByName(tested)


def repository_naming(files: DataFrame) -> DataFrame:
    """At most one row (case_style, evidence, confidence): the commonest style of all file names (path, ord), of
    equally common ones the first seen, with the first five files of any style; no more than half sure."""
    named = files.select("ord", "path", P.name_style(P.stem("path")).alias("style"))
    styles = named.where("style is not null").groupBy("style").agg(F.count("*").alias("k"), F.min("ord").alias("o"))
    top = styles.agg(F.min(F.struct((-F.col("k")).alias("k"), "o", "style")).alias("m")).where("m is not null").select(F.col("m.style").alias("case_style"), (-F.col("m.k")).alias("k"))
    first = named.where("style is not null").orderBy("ord").limit(5).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "path"))), lambda x: x["path"]).alias("evidence"))
    total = named.agg(F.count("*").alias("n"))
    return top.crossJoin(first).crossJoin(total).select("case_style", "evidence", F.least(F.lit(0.5), F.col("k") / F.col("n")).alias("confidence"))
