"""Dependencies, entrypoints and framework signals of configuration files."""

from __future__ import annotations

import json
import tomllib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocabulary as V
from ..functions import paths as P
from ..functions.text import split_lines


def dependency_names(values: Column) -> Column:
    """Package names of requirement lines, sorted: cut at versions and extras; comments and anything
    that begins with ``python`` are none."""
    kept = F.filter(F.transform(values, lambda v: F.trim(v)), lambda v: (v != "") & ~v.startswith("#") & ~v.startswith("python"))
    return P.unique_sorted(F.transform(kept, lambda v: F.trim(F.regexp_extract(v, r"^[^\[=<>!~]*", 0))))


def framework_signals(names: Column) -> Column:
    """Frameworks of which an alias is, or begins, one of the names."""
    low = F.transform(names, F.lower)

    def begins(aliases: tuple[str, ...]):
        return lambda n: P.any_of(n.startswith(a) for a in aliases)

    hit = [F.when(F.exists(low, begins(aliases)), F.lit(f)) for f, aliases in sorted(V.FRAMEWORK_ALIASES.items())]
    return F.filter(F.array(*hit), lambda x: x.isNotNull())


def _toml(text: str) -> Column:
    return F.arrow_udf(_pyproject, "struct<name:string,dependencies:array<string>,scripts:array<string>,error:string>")(text)


def _pyproject(text: pa.Array) -> pa.Array:
    def table(v) -> dict:
        return v if isinstance(v, dict) else {}

    def one(t: str | None) -> dict:
        try:
            data = tomllib.loads(t or "")
        except tomllib.TOMLDecodeError as e:
            return {"name": None, "dependencies": [], "scripts": [], "error": str(e)}
        project, poetry = table(data.get("project")), table(table(data.get("tool")).get("poetry"))
        listed = project.get("dependencies")
        names = [d for d in (listed if isinstance(listed, list) else []) if isinstance(d, str)]
        scripts = (v for v in table(project.get("scripts")).values() if v and not isinstance(v, dict))
        named = [str(t["name"]) for t in (project, poetry) if t.get("name")]
        return {"name": named[0] if named else None, "dependencies": [*names, *map(str, table(poetry.get("dependencies")))], "scripts": sorted(map(str, scripts)), "error": None}

    s = pa.string()
    return pa.array([one(t) for t in text.to_pylist()], pa.struct([("name", s), ("dependencies", pa.list_(s)), ("scripts", pa.list_(s)), ("error", s)]))


def configs(files: DataFrame) -> DataFrame:
    """(path, kind, summary, framework_signals, entrypoints, details, error) of files (path, content) that
    are configuration: TOML in Python, the rest in the JVM. details is JSON."""
    none = F.array().cast("array<string>")
    f = files.select("path", F.regexp_replace("content", "^\ufeff", "").alias("content")).withColumn("kind", F.when(P.name("path") == "pyproject.toml", "pyproject").when(P.name("path") == "requirements.txt", "requirements").when(P.name("path").startswith("Dockerfile"), "docker")).where("kind is not null")
    toml = f.where("kind = 'pyproject'").withColumn("t", _toml("content")).select("path", "kind", F.slice(dependency_names(F.col("t.dependencies")), 1, 20).alias("names"), dependency_names(F.col("t.dependencies")).alias("all"), F.col("t.scripts").alias("entrypoints"), F.col("t.name").alias("name"), F.col("t.error").alias("error"))
    rest = f.where("kind <> 'pyproject'").withColumn("lines", split_lines(F.coalesce("content", F.lit(""))))
    docker = F.filter(F.transform("lines", lambda v: F.trim(v)), lambda v: v.startswith("CMD ") | v.startswith("ENTRYPOINT "))
    names = F.when(F.col("kind") == "requirements", dependency_names(F.col("lines"))).otherwise(none)
    rest = rest.select("path", "kind", F.slice(names, 1, 30).alias("names"), names.alias("all"), F.when(F.col("kind") == "docker", docker).otherwise(none).alias("entrypoints"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("error"))
    out = toml.unionByName(rest).withColumn("framework_signals", framework_signals(F.col("all")))
    listed = F.array_join("framework_signals", ", ")
    some = F.size("framework_signals") > 0
    summary = (
        F.when(F.col("kind") == "docker", "How the container is built.")
        .when(F.col("kind") == "pyproject", F.when(some, F.concat(F.lit("Python project metadata; signals: "), listed)).otherwise("Python project metadata"))
        .otherwise(F.when(some, F.concat(F.lit("Python requirements; signals: "), listed)).otherwise("Python requirements"))
    )
    details = F.when(F.col("kind") == "docker", F.lit("{}")).otherwise(F.to_json(F.struct("name", F.col("names").alias("dependencies"))))
    return out.select("path", "kind", summary.alias("summary"), "framework_signals", "entrypoints", details.alias("details"), "error")


def strict(found: DataFrame) -> DataFrame:
    """``found``; a file that does not parse raises when it is read."""
    return found.withColumn("error", F.when(F.col("error").isNotNull(), F.raise_error(F.concat("path", F.lit(": "), "error"))).otherwise(F.lit(None).cast("string")))


def pricing(path: str | None) -> dict:
    """Prices of a JSON file, by default none at four characters a token."""
    out = {"model": "heuristic", "input_per_1m": 0.0, "output_per_1m": 0.0, "chars_per_token": 4.0}
    if path:
        with open(path, encoding="utf-8") as f:
            given = json.load(f)
        out |= {k: type(v)(given[k]) for k, v in out.items() if k in given}
    return out
