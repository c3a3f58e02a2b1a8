"""Registered queries over the driver's tables, and their SQL.

The tables hold no source tree, so relations of the engine stand on stand-ins: ``documents`` are
files (path from source, language and id), parts and suppliers that share a line item are
modules that depend on each other, events are the features of files, conversations are model
calls. Every query reads its whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import vocabulary as V
from ..functions import paths as P
from ..operators import gitignore, graph, patterns, selection, sets
from ..storage import Scratch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as files: (path, char_count, content, role, ord)."""
    d = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", "source", "lang", F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".md")))
    return d.select(path.alias("path"), F.col("n_chars").alias("char_count"), F.col("text").alias("content"), F.col("lang").alias("role"), F.col("doc_id").alias("ord"))


_FILES = "(SELECT source || '/' || lang || '/doc_' || doc_id || '.md' AS path, n_chars AS char_count, text AS content, lang AS role, doc_id AS ord FROM documents)"


def deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges of ``modules``, one for each line item."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("src"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("dst"))


def modules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges from each part to each supplier that delivers it."""
    return graph.clean_edges(deliveries(spark, sf_dir))


_EDGES = "edges AS (SELECT DISTINCT 'p' || l_partkey AS src, 's' || l_suppkey AS dst FROM lineitem), nodes AS (SELECT src AS id FROM edges UNION SELECT dst FROM edges), deg AS (SELECT id, (SELECT count(*) FROM edges e WHERE e.dst = n.id) AS in_degree, (SELECT count(*) FROM edges e WHERE e.src = n.id) AS out_degree FROM nodes n)"


def url_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages as paths with varied names: (page_id, path, size)."""
    p = table(spark, sf_dir, "pages")
    bare = F.regexp_replace(F.regexp_replace("url", r"^[a-z]+://", ""), r"[?#].*$", "")
    ends = F.array(*map(F.lit, _NAMES))
    return p.select("page_id", F.concat(bare, F.lit("/"), F.element_at(ends, (F.col("page_id") % len(_NAMES) + 1).cast("int"))).alias("path"), F.length("html").alias("size"))


_NAMES = ("README.md", "app.min.js", "yarn.lock", "logo.svg", "site.css", "dist/out.txt", "router.py", "report.py", "model.py", "util.py", "inspect.py", "main.py", "x.snap", "Dockerfile.dev", "notes", "a.map")
_URLS = f"""(SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') || '/' || list_extract([{', '.join(repr(n) for n in _NAMES)}], CAST(page_id % {len(_NAMES)} AS INTEGER) + 1) AS path, length(html) AS size FROM pages)"""


@query("SELECT path, char_count, sha256(content) AS sha256, regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder, CAST(NULL AS VARCHAR) AS language FROM " + _FILES)
def candidate_projection(spark, sf_dir):
    f = files(spark, sf_dir)
    return f.select("path", "char_count", F.sha2("content", 256).alias("sha256"), P.parent("path").alias("folder"), P.language("path").alias("language"))


_HIGH = "(regexp_extract(path, '[^/]*$') IN ('README.md', 'main.py') OR regexp_extract(path, '[^/]*$') LIKE 'Dockerfile.%')"


@query(f"""
SELECT page_id, path, d.include AS include, d.reason AS reason FROM (SELECT *, CASE
  WHEN regexp_matches(path, '(^|/)dist/') THEN {{'include': false, 'reason': 'ignored directory'}}
  WHEN path LIKE '%/yarn.lock' THEN {{'include': false, 'reason': 'low-value lock file'}}
  WHEN path LIKE '%.snap' THEN {{'include': false, 'reason': 'snapshot file'}}
  WHEN path LIKE '%.svg' OR path LIKE '%.map' THEN {{'include': false, 'reason': 'binary or bundled asset'}}
  WHEN path LIKE '%.min.js' THEN {{'include': false, 'reason': 'minified asset'}}
  WHEN size > 4096 AND NOT {_HIGH} THEN {{'include': false, 'reason': 'file exceeds size budget'}}
  WHEN path LIKE '%.css' THEN {{'include': true, 'reason': 'style file'}}
  WHEN path LIKE '%/README.md' THEN {{'include': true, 'reason': 'high-value config or documentation'}}
  ELSE {{'include': true, 'reason': 'text candidate'}} END AS d FROM {_URLS}) x""")
def path_filter_reason(spark, sf_dir):
    u = url_paths(spark, sf_dir).withColumn("d", P.path_decision("path", "size", max_kb=4))
    return u.select("page_id", "path", "d.include", "d.reason")


_RULES = ("*.py", "!main.py", "/www.*", "notes", "# comment", "", "!*/en/*/report.py", "docs/", "*.css")


@query(f"""
SELECT page_id, path, coalesce(arg_max(NOT negate, pos), false) AS gitignored
FROM {_URLS} LEFT JOIN (VALUES (1, false, '(^|/)[^/]*\\.py$'), (2, true, '(^|/)main\\.py$'), (3, false, '^www\\.'), (4, false, '(^|/)notes(/|$)'), (5, true, '^.*/en/.*/report\\.py$'), (6, false, '^docs/'), (7, false, '(^|/)[^/]*\\.css$')) r(pos, negate, re) ON regexp_matches(path, re)
GROUP BY page_id, path""")
def gitignore_last_match(spark, sf_dir):
    u = url_paths(spark, sf_dir)
    return gitignore.mark(spark, u, _RULES).select("page_id", "path", "gitignored")


@query("SELECT path, NOT (content LIKE '%do not edit%') AND trim(content) <> '' AS include, regexp_matches(lower(content), 'licen[sc]e|copyright') AS licensed FROM " + _FILES)
def content_marker_filter(spark, sf_dir):
    f = files(spark, sf_dir)
    return f.select("path", P.content_decision("path", "content")["include"].alias("include"), F.lower("content").rlike("licen[sc]e|copyright").alias("licensed"))


_TOKENS = {"route": "route|router|controller|/api/|handler", "service": "service|repository|repo|client", "model": "model|schema|entity|dto", "utility": "util|utils|helper", "test": "test|spec"}


@query(f"""
SELECT page_id, path, CAST(CASE WHEN n = 0 THEN 10 ELSE best + least(n - 1, 3) END AS INTEGER) AS score,
       CASE WHEN n = 0 THEN 'source' ELSE list_extract(['config','documentation','entrypoint','config','route','service','model','utility','test','source'], list_position(m, true)) END AS role
FROM (SELECT *, CAST(len(list_filter(m, lambda x: x)) AS INTEGER) AS n, list_extract([100,95,92,90,85,82,79,64,52,20], list_position(m, true)) AS best FROM (
  SELECT page_id, path, [path LIKE '%/README.md', lower(regexp_extract(path, '[^/]*$')) LIKE 'readme%', path LIKE '%/main.py', path LIKE '%/README.md',
    {', '.join(f"path LIKE '%.py' AND regexp_matches(lower(path), '{t}')" for t in _TOKENS.values())}, path LIKE '%.py'] AS m FROM {_URLS}) a) b""")
def path_priority_score(spark, sf_dir):
    u = url_paths(spark, sf_dir).withColumn("p", P.priority("path"))
    return u.select("page_id", "path", "p.score", "p.role")


@query(f"SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) AS folder, count(*) AS file_count FROM {_FILES} GROUP BY 1")
def dir_counts(spark, sf_dir):
    return files(spark, sf_dir).groupBy(P.parent("path").alias("folder")).agg(F.count("*").alias("file_count"))


@query(f"""
WITH f AS (SELECT *, source AS folder FROM (SELECT *, split_part(path, '/', 1) AS source FROM {_FILES}) x),
r AS (SELECT folder, role, count(*) AS c, min(ord) AS o FROM f GROUP BY ALL),
top AS (SELECT folder, list(role ORDER BY c DESC, o)[:3] AS dominant_roles FROM r GROUP BY folder),
s AS (SELECT folder, count(*) AS file_count, list(path ORDER BY ord)[:3] AS sample_files FROM f GROUP BY folder)
SELECT folder, file_count, array_to_string(dominant_roles, ',') AS dominant_roles, array_to_string(sample_files, ',') AS sample_files FROM s JOIN top USING (folder) ORDER BY file_count DESC, folder LIMIT 16""")
def dir_summary(spark, sf_dir):
    from ..operators import blueprint

    f = files(spark, sf_dir).withColumn("folder", F.split_part("path", F.lit("/"), F.lit(1)))
    out = blueprint.directory_summary(f)
    return out.select("folder", "file_count", F.array_join("dominant_roles", ",").alias("dominant_roles"), F.array_join("sample_files", ",").alias("sample_files"))


@query(f"""
WITH RECURSIVE o AS (SELECT path, char_count, row_number() OVER (ORDER BY char_count, path) AS n FROM {_FILES} WHERE char_count <= 20000),
walk AS (SELECT 0::BIGINT AS n, 0::BIGINT AS taken, 0::BIGINT AS total, NULL::VARCHAR AS path
  UNION ALL SELECT o.n, w.taken + ok, w.total + ok * o.char_count, CASE WHEN ok = 1 THEN o.path END
  FROM (SELECT *, 0 AS x FROM walk) w JOIN o ON o.n = w.n + 1, LATERAL (SELECT CASE WHEN w.taken < 40 AND w.total + o.char_count <= 20000 THEN 1 ELSE 0 END AS ok) k)
SELECT f.path, f.char_count, w.path IS NOT NULL AS selected, CASE WHEN w.path IS NOT NULL THEN w.total END AS running_chars
FROM {_FILES} f LEFT JOIN (SELECT path, total FROM walk WHERE path IS NOT NULL) w ON f.path = w.path""")
def budget_select(spark, sf_dir):
    f = files(spark, sf_dir).select("path", "char_count", F.lit(10).alias("priority"))
    return selection.select_within_budget(f, 40, 20_000).select("path", "char_count", "selected", "running_chars")


@query(f"WITH {_EDGES} SELECT id, in_degree, out_degree FROM deg")
def graph_degrees(spark, sf_dir):
    e = modules(spark, sf_dir)
    d = graph.degrees(graph.nodes_of(e), e)
    return d.select("id", F.col("in_degree").cast("long").alias("in_degree"), F.col("out_degree").cast("long").alias("out_degree"))


@query(f"WITH {_EDGES} SELECT id, in_degree, out_degree, row_number() OVER (ORDER BY in_degree DESC, out_degree DESC, id) AS pos FROM deg ORDER BY pos LIMIT 20")
def graph_hubs(spark, sf_dir):
    return graph.hubs(graph_degrees(spark, sf_dir)).select("id", "in_degree", "out_degree", F.col("pos").cast("long").alias("pos"))


@query(f"WITH {_EDGES} SELECT id FROM deg WHERE in_degree = 0")
def graph_leaves(spark, sf_dir):
    e = modules(spark, sf_dir)
    return graph.leaves(graph.nodes_of(e), e)


@query(f"WITH {_EDGES} SELECT id FROM deg WHERE in_degree = 0 AND out_degree > 0")
def graph_entry_points(spark, sf_dir):
    return graph.entry_points(graph_degrees(spark, sf_dir))


@query(f"WITH {_EDGES} SELECT count(*) AS nodes, CAST(sum(out_degree) AS BIGINT) AS internal_edges, count(*) FILTER (in_degree = 0 AND out_degree > 0) AS entry_points, count(*) FILTER (in_degree = 0) AS leaves, count(*) FILTER (in_degree = 0 AND out_degree = 0) AS isolated FROM deg")
def graph_stats(spark, sf_dir):
    e = modules(spark, sf_dir)
    return graph.stats(graph.nodes_of(e), e)


@query(f"""
WITH RECURSIVE {_EDGES},
out AS (SELECT src, count(*) AS n FROM edges GROUP BY src),
links AS (SELECT e.src, e.dst, o.n FROM edges e JOIN out o USING (src)),
total AS (SELECT count(*) AS n FROM nodes),
r AS (
  SELECT 0 AS i, id, 1.0::DOUBLE / (SELECT n FROM total) AS rank FROM nodes
  UNION ALL
  SELECT i + 1, id, 0.15 / (SELECT n FROM total) + 0.85 * (sum(got) + max(spread) / (SELECT n FROM total)) FROM (
    SELECT r.i, l.dst AS id, r.rank / l.n AS got, 0.0 AS spread FROM r JOIN links l ON l.src = r.id WHERE r.i < 20
    UNION ALL
    SELECT a.i, n.id, 0.0, a.spread FROM nodes n, (SELECT i, sum(CASE WHEN id LIKE 's%' THEN rank ELSE 0 END) AS spread FROM r WHERE i < 20 GROUP BY i) a
  ) x GROUP BY i, id)
SELECT id, round(rank, 9) AS rank FROM r WHERE i = 20""")
def graph_pagerank(spark, sf_dir):
    e = modules(spark, sf_dir)
    return graph.pagerank(spark, graph.nodes_of(e), e).select("id", F.round("rank", 9).alias("rank"))


@query(f"""
WITH RECURSIVE {_EDGES},
pairs AS (SELECT DISTINCT a.dst AS a, b.dst AS b FROM edges a JOIN edges b USING (src)),
reach AS (SELECT a, b FROM pairs UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON p.a = r.b),
root AS (SELECT a, least(min(e.src), min(r.b)) AS root FROM reach r JOIN edges e ON e.dst = r.b GROUP BY a)
SELECT n.id, min(root) AS root FROM nodes n LEFT JOIN edges e ON n.id = e.src JOIN root r ON r.a = coalesce(e.dst, n.id) GROUP BY n.id""")
def graph_components(spark, sf_dir):
    return graph.components(spark, None, deliveries(spark, sf_dir))


@query(f"""
WITH RECURSIVE {_EDGES}, t AS (SELECT n_nationkey AS id, n_regionkey AS up FROM nation),
seed AS (SELECT DISTINCT 's' || s_suppkey AS id FROM supplier WHERE s_acctbal < 3000),
hit AS (SELECT id, 0 AS depth FROM seed UNION SELECT e.src, 1 FROM edges e JOIN seed s ON e.dst = s.id)
SELECT id, CAST(min(depth) AS INTEGER) AS depth FROM hit GROUP BY id""")
def affected_files(spark, sf_dir):
    seeds = table(spark, sf_dir, "supplier").where("s_acctbal < 3000").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"))
    return graph.reachable_from(spark, seeds, modules(spark, sf_dir))


@query(f"WITH {_EDGES} SELECT dst AS id, array_to_string(list(src ORDER BY src), ',') AS importers FROM edges GROUP BY dst")
def reverse_dependencies(spark, sf_dir):
    return graph.reverse_dependencies(modules(spark, sf_dir)).select("id", F.array_join("importers", ",").alias("importers"))


@query(f"WITH {_EDGES} SELECT src AS id, array_to_string(list(dst ORDER BY dst), ',') AS internal_dependencies FROM edges GROUP BY src")
def internal_dependencies(spark, sf_dir):
    return graph.dependencies(modules(spark, sf_dir)).select("id", F.array_join("internal_dependencies", ",").alias("internal_dependencies"))


@query(f"""
WITH {_EDGES}, base AS (SELECT 'p' || p_partkey AS id, CAST(p_size AS INTEGER) AS score FROM part),
hub AS (SELECT id FROM deg ORDER BY in_degree DESC, out_degree DESC, id LIMIT 20)
SELECT b.id, CAST(b.score + 3 * coalesce(in_degree, 0) + round_even(50 * (coalesce(out_degree, 0) / 400.0), 0) + CASE WHEN in_degree = 0 AND out_degree > 0 THEN 20 ELSE 0 END
  + CASE WHEN b.id IN (SELECT id FROM hub) THEN 15 ELSE 0 END - CASE WHEN coalesce(in_degree, 0) = 0 AND coalesce(out_degree, 0) = 0 THEN 10 ELSE 0 END AS INTEGER) AS score
FROM base b LEFT JOIN deg USING (id)""")
def refine_score(spark, sf_dir):
    from ..operators import scoring

    d = Scratch(spark).write(graph_degrees(spark, sf_dir))
    base = table(spark, sf_dir, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("path"), F.col("p_size").alias("score"))
    ranks = d.select("id", (F.col("out_degree") / 400).alias("rank"))
    return scoring.refine_graph(base, d, ranks, graph.entry_points(d), graph.hubs(d)).select(F.col("path").alias("id"), "score")


_FEATURES = "f AS (SELECT DISTINCT user_id AS role, CAST(ts AS DATE) AS path, event_type AS feature FROM events), sizes AS (SELECT role, count(DISTINCT path) AS n FROM f GROUP BY role)"


def _features(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("role"), F.to_date("ts").cast("string").alias("path"), F.lit("event").alias("kind"), F.col("event_type").alias("feature")).distinct()


@query(f"WITH {_FEATURES}, s AS (SELECT role, feature, count(*) AS support FROM f GROUP BY ALL) SELECT role, feature, support, round(support / n, 9) AS coverage, row_number() OVER (PARTITION BY role ORDER BY support / n DESC, feature) AS number FROM s JOIN sizes USING (role) WHERE support >= greatest(1, floor(0.6 * n + 0.9999))")
def pattern_support(spark, sf_dir):
    f = _features(spark, sf_dir)
    got = patterns.numbered(patterns.common_features(f, patterns.group_sizes(f)))
    return got.select("role", "feature", "support", F.round("coverage", 9).alias("coverage"), F.col("number").cast("long").alias("number"))


@query("""
WITH d AS (SELECT l_linestatus AS role, l_orderkey AS path, array_to_string(list(DISTINCT l_returnflag ORDER BY l_returnflag), '>') AS structure FROM lineitem GROUP BY ALL),
sizes AS (SELECT role, count(*) AS n FROM d GROUP BY role), s AS (SELECT role, structure, count(*) AS support, min(path) AS o FROM d GROUP BY ALL),
t AS (SELECT *, row_number() OVER (PARTITION BY role ORDER BY support DESC, o) AS r FROM s)
SELECT role, structure, support FROM t JOIN sizes USING (role) WHERE r = 1 AND support >= greatest(1, floor(0.1 * n + 0.9999))""")
def modal_structure(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_linestatus").alias("role"), F.col("l_orderkey").alias("path"), F.col("l_returnflag").alias("part")).distinct()
    s = li.groupBy("role", "path").agg(F.array_sort(F.collect_list("part")).alias("structure")).withColumn("ord", F.col("path"))
    return patterns.modal_structure(s, patterns.group_sizes(li), 0.1).select("role", F.array_join("structure", ">").alias("structure"), "support")


@query("""
WITH r AS (SELECT p_brand AS role, p_partkey AS ord, replace(p_name, ' ', CASE p_partkey % 5 WHEN 0 THEN '-' WHEN 1 THEN '' ELSE '_' END) AS name FROM part),
s AS (SELECT *, CASE WHEN contains(name, '-') THEN 'kebab-case' WHEN contains(name, '_') THEN 'snake_case' WHEN regexp_matches(name, '^[A-Z]') THEN 'PascalCase' WHEN regexp_matches(name, '[A-Z]') THEN 'camelCase' END AS style FROM r),
k AS (SELECT role, style, count(*) AS k, min(ord) AS o FROM s WHERE style IS NOT NULL GROUP BY ALL),
t AS (SELECT role, arg_min(style, (-k, o)) AS case_style, max(k) AS k FROM k GROUP BY role),
n AS (SELECT role, count(*) AS n FROM s GROUP BY role)
SELECT role, case_style, round(k / n, 9) AS coverage FROM t JOIN n USING (role) WHERE n >= 2 AND k / n >= 0.6""")
def naming_style(spark, sf_dir):
    glue = F.when(F.col("p_partkey") % 5 == 0, "-").when(F.col("p_partkey") % 5 == 1, "").otherwise("_")
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("role"), F.col("p_partkey").alias("ord"), F.expr("p_name").alias("raw"), glue.alias("glue")).withColumn("name", F.replace("raw", F.lit(" "), "glue")).withColumn("path", F.col("name"))
    return patterns.naming(p).select("role", "case_style", F.round("coverage", 9).alias("coverage"))


@query("""
WITH v AS (SELECT 'c' || c_nationkey AS g, c_name AS v FROM customer UNION ALL SELECT 's', s_name FROM supplier),
cut AS (SELECT g, v, unnest(range(2, length(v) + 1)) AS n FROM v), total AS (SELECT g, count(*) AS t FROM v GROUP BY g),
pre AS (SELECT g, substr(v, 1, n) AS a, count(*) AS k FROM cut GROUP BY ALL), suf AS (SELECT g, right(v, n) AS a, count(*) AS k FROM cut GROUP BY ALL)
SELECT t.g, coalesce((SELECT arg_max(a, length(a)) FROM pre p WHERE p.g = t.g AND p.k = t.t), '') AS prefix, coalesce((SELECT arg_max(a, length(a)) FROM suf p WHERE p.g = t.g AND p.k = t.t), '') AS suffix FROM total t""")
def common_affix(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_nationkey").cast("string")).alias("g"), F.col("c_name").alias("v"))
    s = table(spark, sf_dir, "supplier").select(F.lit("s").alias("g"), F.col("s_name").alias("v"))
    return patterns.affixes(c.unionByName(s), "g", "v")


@query(f"SELECT role, array_to_string(list(path ORDER BY ord, path)[:8], ',') AS evidence FROM {_FILES} GROUP BY role")
def role_evidence_topk(spark, sf_dir):
    return selection.evidence(files(spark, sf_dir), "role").select("role", F.array_join("evidence", ",").alias("evidence"))


# -- the embedded source tree: its oracle rows are read off the files, not off the engine -----


def fixture_files(spark: SparkSession) -> DataFrame:
    from .fixture import FILES

    rows = [(p, c, "source", i) for i, (p, c) in enumerate(FILES.items())]
    return spark.createDataFrame(rows, "path string, content string, role string, ord int")


def _values(rows: list[tuple], names: str) -> str:
    show = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(show, r)) + ')' for r in rows)}) t({names})"


def _fixture_relations(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Files, Python files, and their records, written once so that the syntax trees are made once."""
    from ..operators import extract

    f = fixture_files(spark)
    python = f.where(F.col("path").endswith(".py"))
    return f, python, Scratch(spark).write(extract.records(python))


def fact_methods(spark: SparkSession) -> dict[str, DataFrame]:
    """Facts of the embedded tree by paths alone, by symbols, and by all that is extracted and resolved."""
    from ..operators import extract, resolve

    f, python, r = _fixture_relations(spark)
    scratch = Scratch(spark)
    every = scratch.write(extract.facts(r))
    edges = scratch.write(resolve.dependency_edges(r, f)).select(F.format_string("dependency:%s->%s", "src", "dst").alias("fact"))
    roles = python.select(F.concat_ws(":", F.lit("role"), "path", P.priority("path")["role"]).alias("fact"))
    return {"path-only": roles, "symbols": every.where("kind in ('import', 'class', 'function', 'method')").select("fact"), "semantic": roles.unionByName(every.select("fact")).unionByName(edges)}


def gold_recall(spark, sf_dir):
    """Recall of the gold facts, by paths alone, by symbols, and by all facts."""
    from .fixture import GOLD

    gold = spark.createDataFrame([(g,) for g in GOLD], "fact string")
    out = None
    for name, facts in fact_methods(spark).items():
        one = sets.compare_with_gold(facts, gold).select(F.lit(name).alias("method"), "gold", "hits", "missed", F.round("recall", 6).alias("recall"))
        out = one if out is None else out.unionByName(one)
    return out


def dependency_edges(spark, sf_dir):
    from ..operators import resolve

    f, _, r = _fixture_relations(spark)
    return resolve.dependency_edges(r, f)


def config_summaries(spark, sf_dir):
    from ..operators import config

    c = config.configs(fixture_files(spark))
    return c.select("path", "kind", F.array_join("framework_signals", ",").alias("signals"), F.array_join("entrypoints", "|").alias("entrypoints"), F.array_join(F.from_json(F.get_json_object("details", "$.dependencies"), "array<string>"), ",").alias("dependencies"))


def diff_patches(spark, sf_dir):
    from ..functions import text
    from .fixture import DIFF

    d = text.diffs(spark.createDataFrame([(DIFF,), (None,), ("",)], "diff string"))
    return d.select("path", "change_type", "previous_path", F.size("hunks").alias("hunks"))


def tolerant_json(spark, sf_dir):
    from ..functions import text
    from .fixture import REPLIES

    r = spark.createDataFrame(list(enumerate(REPLIES)), "id int, raw string")
    return r.select("id", text.json_object("raw").alias("object"))


def markdown_sections(spark, sf_dir):
    from ..functions import text
    from .fixture import DOCUMENT

    d = spark.createDataFrame([(1, DOCUMENT), (2, "no heading"), (3, "# T\nbody")], "doc int, markdown string").withColumn("m", text.markdown_document("markdown"))
    return d.select("doc", F.col("m.title").alias("title"), F.array_join(F.transform("m.sections", lambda s: s["heading"]), ",").alias("headings"), F.col("m.error").isNotNull().alias("invalid"))


def ungrounded_blocks(spark, sf_dir):
    from ..functions import text
    from .fixture import DOCUMENT, FILES

    docs = spark.createDataFrame([(1, DOCUMENT), (2, "# A\n```\nMAX_LENGTH = 400\n```\n")], "doc int, markdown string")
    held = spark.createDataFrame([(d, FILES["src/harbour/ships.py"]) for d in (1, 2)], "doc int, content string")
    return text.violations(docs, held)


def _register_fixture() -> None:
    from .fixture import GOLD, PARSED

    n = len(GOLD)
    paths = sum(g.startswith("role:") for g in GOLD)
    symbols = sum(g.split(":")[0] in ("import", "class", "function", "method") for g in GOLD)
    at = lambda name: f"src/harbour/{name}.py"
    edges = [("__init__", "ships"), ("service", "__init__"), ("service", "ships"), ("web", "service"), ("web", "__init__"), ("cli", "web"), ("uses", "a_util")]
    ORACLE_SQL.update({
        "dependency_edges": _values([(at(a), at(b)) for a, b in edges], "src, dst"),
        "gold_recall": _values([("path-only", n, paths, n - paths, round(paths / n, 6)), ("symbols", n, symbols, n - symbols, round(symbols / n, 6)), ("semantic", n, n, 0, 1.0)], "method, gold, hits, missed, recall").replace("SELECT *", "SELECT method, CAST(gold AS BIGINT) AS gold, CAST(hits AS BIGINT) AS hits, CAST(missed AS BIGINT) AS missed, CAST(recall AS DOUBLE) AS recall"),
        "config_summaries": _values([("pyproject.toml", "pyproject", "flask,pytest", "harbour.cli:start", "Flask,pytest-cov,sqlalchemy"), ("requirements.txt", "requirements", "django,flask", "", "django-filter,flask,numpy"), ("Dockerfile", "docker", "", 'ENTRYPOINT ["harbour"]|CMD ["serve"]', None)], "path, kind, signals, entrypoints, dependencies"),
        "diff_patches": _values([("one.py", "modify", None, 2), ("new name.py", "rename", "old name.py", 0), ("gone.py", "delete", None, 1), ("fresh.py", "add", None, 1)], "path, change_type, previous_path, hunks"),
        "tolerant_json": _values(list(enumerate(PARSED)), "id, object"),
        "markdown_sections": _values([(1, "# Harbour", "Core Rules,Typical Patterns", False), (2, None, None, True), (3, "# T", "Body", False)], "doc, title, headings, invalid"),
        "ungrounded_blocks": _values([(1, "made up")], "doc, block"),
    })
    QUERIES.update({f.__name__: f for f in (gold_recall, dependency_edges, config_summaries, diff_patches, tolerant_json, markdown_sections, ungrounded_blocks)})


_register_fixture()


# -- more relational operators over the driver's tables ----------------------------------------

_PRICE = {"model": "m", "input_per_1m": 3.0, "output_per_1m": 15.0, "chars_per_token": 4.0}
_CALLS = "calls AS (SELECT 'c' || conv_id AS name, sum(CASE WHEN role <> 'assistant' THEN length(text) ELSE 0 END) AS i, sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS o FROM conversations GROUP BY conv_id), est AS (SELECT name, i, o, CAST(ceil(i / 4.0) AS BIGINT) AS it, CAST(ceil(o / 4.0) AS BIGINT) AS ot FROM calls), usd AS (SELECT *, round_even(it / 1000000.0::DOUBLE * 3 + ot / 1000000.0::DOUBLE * 15, 6) AS usd FROM est)"


def _calls(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    n = F.coalesce(F.length("text"), F.lit(0))
    return c.groupBy("conv_id").agg(F.sum(F.when(F.col("role") != "assistant", n).otherwise(0)).alias("input_chars"), F.sum(F.when(F.col("role") == "assistant", n).otherwise(0)).alias("output_chars")).select(F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("name"), "input_chars", "output_chars")


@query(f"WITH {_CALLS} SELECT name, CAST(i AS BIGINT) AS input_chars, it AS input_tokens, CAST(o AS BIGINT) AS output_chars, ot AS output_tokens, usd AS estimated_usd FROM usd")
def cost_first_generation(spark, sf_dir):
    from ..operators import cost

    return cost.estimate(_calls(spark, sf_dir), _PRICE)


@query(f"WITH {_CALLS} SELECT 'patch' AS strategy, count(*) AS items, CAST(sum(ceil(i * 0.45::DOUBLE)) AS BIGINT) AS input_chars, CAST(sum(ceil(it * 0.45::DOUBLE)) AS BIGINT) AS input_tokens, CAST(sum(ceil(o * 0.35::DOUBLE)) AS BIGINT) AS output_chars, CAST(sum(ceil(ot * 0.35::DOUBLE)) AS BIGINT) AS output_tokens, round_even(sum(round_even(usd * 0.4::DOUBLE, 6)), 6) AS estimated_usd FROM usd")
def cost_incremental_patch(spark, sf_dir):
    from ..operators import cost

    return cost.total(cost.patch(cost.estimate(_calls(spark, sf_dir), _PRICE)), "patch")


@query("WITH facts AS (SELECT DISTINCT doc_id FROM documents WHERE n_chars > 400), gold AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1), h AS (SELECT count(*) AS hits FROM facts JOIN gold USING (doc_id)) SELECT (SELECT count(*) FROM facts) AS emitted, (SELECT count(*) FROM gold) AS gold, hits, (SELECT count(*) FROM gold) - hits AS missed, hits / (SELECT count(*) FROM gold) AS recall FROM h")
def gold_comparison(spark, sf_dir):
    facts = table(spark, sf_dir, "documents").where("n_chars > 400").select(F.col("doc_id").cast("string").alias("fact"))
    return sets.compare_with_gold(facts, table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").cast("string").alias("fact")))


@query("""
WITH a AS (SELECT 's' || l_suppkey AS id, 'p' || l_partkey AS src FROM lineitem WHERE l_returnflag = 'A'), b AS (SELECT 's' || l_suppkey, 'p' || l_partkey FROM lineitem WHERE l_returnflag = 'R')
SELECT id, array_to_string(list(src ORDER BY src), ',') AS importers FROM (SELECT * FROM a UNION SELECT * FROM b) u GROUP BY id""")
def merge_reverse_dependencies(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("src"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("dst"), "l_returnflag")
    part = lambda flag: graph.reverse_dependencies(li.where(F.col("l_returnflag") == flag))
    return sets.merge_reverse(part("A"), part("R")).select("id", F.array_join("importers", ",").alias("importers"))


@query("SELECT 'n' || n_nationkey AS name, n_name AS purpose, 'new' AS origin FROM nation WHERE n_regionkey < 2 UNION ALL SELECT 'n' || n_nationkey, n_name, 'old' FROM nation WHERE n_regionkey >= 2")
def merge_skill_index(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    old = n.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("name"), F.col("n_name").alias("purpose"), F.lit("old").alias("origin"))
    new = n.where("n_regionkey < 2").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("name"), F.col("n_name").alias("purpose"), F.lit("new").alias("origin"))
    return sets.merge_index(new, old)


@query("SELECT DISTINCT 'n' || c_nationkey AS name FROM customer WHERE c_acctbal < 0 ORDER BY name")
def affected_skills(spark, sf_dir):
    from ..operators import impact

    c = table(spark, sf_dir, "customer").select(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("name"), F.col("c_name").alias("path"), "c_acctbal")
    skills = c.groupBy("name").agg(F.collect_set("path").alias("related_paths"))
    return impact.affected_skills(c.where("c_acctbal < 0").select("path"), skills)


_TOKEN_SQL = "list_distinct(list_filter(regexp_split_to_array(lower({0}), '[^a-zA-Z0-9_/.-]+'), lambda x: x <> ''))"


@query(f"""
WITH skills AS (SELECT r_regionkey AS skill, r_name || ' europe asia economy red' AS text FROM region), rules AS (SELECT 'p' || p_partkey AS rule, p_name || ' ' || p_type AS text, (p_size % 5) / 10.0::DOUBLE AS confidence, p_brand AS ev FROM part),
s AS (SELECT *, {_TOKEN_SQL.format('text')} AS t, 'Brand#' || (skill + 11) AS read FROM skills), r AS (SELECT *, {_TOKEN_SQL.format('text')} AS t FROM rules),
sc AS (SELECT CAST(skill AS VARCHAR) AS skill, rule, confidence, CAST(len(list_intersect(s.t, r.t)) + CASE WHEN ev = read THEN 5 ELSE 0 END + floor(confidence * 3) AS BIGINT) AS score FROM s, r)
SELECT skill, rule, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY skill ORDER BY score DESC, confidence DESC, rule) AS rank FROM sc WHERE score > 0) x WHERE rank <= 8""")
def rule_relevance(spark, sf_dir):
    from ..operators import impact

    s = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("string").alias("name"), F.concat("r_name", F.lit(" europe asia economy red")).alias("text"), F.array(F.concat(F.lit("Brand#"), (F.col("r_regionkey") + 11).cast("string"))).alias("read_files"))
    r = table(spark, sf_dir, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("name"), F.concat_ws(" ", "p_name", "p_type").alias("text"), ((F.col("p_size") % 5) / 10).alias("confidence"), F.array("p_brand").alias("evidence"), F.col("p_partkey").alias("ord"))
    out = impact.relevant_rules(r, s)
    return out.select("skill", "rule", F.col("score").cast("long").alias("score"), F.col("rank").cast("long").alias("rank"))


@query("WITH s AS (SELECT DISTINCT l_partkey AS path, 's' || l_suppkey AS symbol FROM lineitem), u AS (SELECT symbol FROM s GROUP BY symbol HAVING count(DISTINCT path) = 1), n AS (SELECT c_name AS symbol, count(DISTINCT c_nationkey) AS c, min(c_nationkey) AS path FROM customer GROUP BY c_name) SELECT symbol, CAST(path AS VARCHAR) AS path FROM s JOIN u USING (symbol) UNION ALL SELECT symbol, CAST(path AS VARCHAR) FROM n WHERE c = 1")
def symbol_resolution_unique(spark, sf_dir):
    from ..operators import resolve

    s = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").cast("string").alias("path"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("symbol"))
    n = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("string").alias("path"), F.col("c_name").alias("symbol"))
    return resolve.unique_symbols(s.unionByName(n).distinct())


@query("WITH w AS (SELECT p_partkey, p_name, regexp_replace(regexp_replace(lower(p_type || ' ' || p_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS kebab FROM part) SELECT p_partkey, kebab, array_to_string(list_sort(list_distinct(string_split(p_name, ' '))), ',') AS words FROM w")
def text_scalars(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", P.kebab(F.concat_ws(" ", "p_type", "p_name")).alias("kebab"), F.array_join(P.unique_sorted(F.split("p_name", " ")), ",").alias("words"))


@query("WITH e AS (SELECT o_custkey, list('o' || o_orderkey ORDER BY o_orderkey) AS v FROM orders GROUP BY o_custkey) SELECT o_custkey, array_to_string(v[:3], ', ') || CASE WHEN len(v) > 3 THEN ', +' || (len(v) - 3) || ' more' ELSE '' END AS shown, CASE WHEN len(v) >= 15 THEN 'high' WHEN len(v) >= 10 THEN 'medium' ELSE 'low' END AS badge FROM e")
def limited_lists(spark, sf_dir):
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("k"))
    v = F.transform("k", lambda k: F.concat(F.lit("o"), k.cast("string")))
    return o.select("o_custkey", P.join_limited(v, 3).alias("shown"), P.confidence_badge(F.size("k") / 20).alias("badge"))


@query(f"SELECT CASE WHEN role IN ('en', 'de') THEN 'backend' WHEN role = 'fr' THEN 'quality' ELSE 'shared' END AS domain, array_to_string(list(path ORDER BY path)[:8], ',') AS evidence FROM {_FILES} GROUP BY 1")
def domain_summary(spark, sf_dir):
    from ..operators import blueprint

    role = F.when(F.col("role") == "en", "route").when(F.col("role") == "de", "model").when(F.col("role") == "fr", "test").otherwise("utility")
    d = blueprint.domains(files(spark, sf_dir).withColumn("role", role))
    return d.select("domain", F.array_join("evidence", ",").alias("evidence"))


@query("WITH old AS (SELECT doc_id AS path, sha256(text) AS sha FROM documents WHERE lang <> 'fr'), new AS (SELECT doc_id AS path, sha256(CASE WHEN source = 'src1' THEN text || '!' ELSE text END) AS sha FROM documents) SELECT n.path, coalesce(n.sha = o.sha, false) AS reused FROM new n LEFT JOIN old o USING (path)")
def state_reuse(spark, sf_dir):
    from ..sources import state

    d = table(spark, sf_dir, "documents")
    saved = d.where("lang <> 'fr'").select(F.col("doc_id").alias("path"), F.sha2("text", 256).alias("sha256"), F.lit("{}").alias("summary"))
    now = d.select(F.col("doc_id").alias("path"), F.sha2(F.when(F.col("source") == "src1", F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("sha256"))
    return state.reuse(now, saved).select("path", "reused")


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rank FROM lineitem) SELECT l_suppkey, l_orderkey, l_linenumber, rank FROM r WHERE rank <= 2")
def first_k_per_group(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")
    out = selection.first_k(li, ["l_suppkey"], [F.desc("l_extendedprice"), "l_orderkey", "l_linenumber"], 2)
    return out.select("l_suppkey", "l_orderkey", "l_linenumber", F.col("rank").cast("long").alias("rank"))


@query("WITH p AS (SELECT doc_id, 'src/' || lang || '/d' || doc_id || '.py' AS path FROM documents), m AS (SELECT 'src.' || lang || '.d' || doc_id AS module, 'src/' || lang || '/d' || doc_id || '.py' AS path FROM documents UNION ALL SELECT lang || '.d' || doc_id, 'src/' || lang || '/d' || doc_id || '.py' FROM documents) SELECT module, path FROM m")
def module_index(spark, sf_dir):
    from ..operators import resolve

    d = table(spark, sf_dir, "documents").select(F.format_string("src/%s/d%d.py", "lang", "doc_id").alias("path"))
    return resolve.module_index(d)


from . import catalogue_runs  # noqa: E402, F401  registers its queries here
