"""Import and symbol resolution as joins over exploded candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Folders under which module names start anew.
ROOTS = ("packages", "lib", "python", "src")


def _join(parts: Column) -> Column:
    return F.array_join(parts, ".")


def module_index(files: DataFrame) -> DataFrame:
    """(module, path): each module name of each Python file; a file under a source root has several."""
    bare = F.regexp_replace(F.regexp_replace("path", r"\.py$", ""), r"(^|/)__init__$", "")
    parts = F.filter(F.split(bare, "/"), lambda p: p != "")
    rows = files.where(F.col("path").endswith(".py")).select("path", parts.alias("parts"))
    tails = F.transform(F.filter(F.sequence(F.lit(1), F.size("parts") - 1), lambda i: F.get("parts", i - 1).isin(*ROOTS)), lambda i: F.slice("parts", i + 1, F.size("parts")))
    names = F.when(F.size("parts") > 1, F.concat(F.array("parts"), tails)).otherwise(F.array("parts"))
    return rows.select("path", F.explode(names).alias("p")).select(_join(F.col("p")).alias("module"), "path").where("module <> ''").distinct()


def _imports(records: DataFrame) -> DataFrame:
    """(src, kind, module, name, alias, target): target is the dotted name that one imported name stands for."""
    d = records.select(F.col("path").alias("src"), F.explode("import_details").alias("d"))
    pairs = F.when(F.size("d.names") > 0, F.arrays_zip(F.col("d.names").alias("name"), F.col("d.aliases").alias("alias"))).otherwise(F.array(F.struct(F.lit(None).cast("string").alias("name"), F.element_at(F.concat("d.aliases", F.array(F.lit(None).cast("string"))), 1).alias("alias"))))
    rows = d.select("src", "d.kind", "d.module", F.explode(pairs).alias("p"))
    glue = F.when(F.col("module").endswith(".") | (F.col("module") == ""), "").otherwise(".")
    return rows.select("src", "kind", "module", "p.name", F.coalesce(F.nullif("p.alias", F.lit("")), "p.name").alias("alias")).withColumn("target", F.when(F.col("name").isNull() | (F.col("name") == "*"), F.col("module")).otherwise(F.concat("module", glue, "name")))


def absolute(module: Column, src: Column) -> Column:
    """A relative module as slash-separated path parts from the root; null above the root."""
    level = F.length(module) - F.length(F.regexp_replace(module, r"^\.+", ""))
    folder = F.slice(F.split(src, "/"), 1, F.greatest(F.size(F.split(src, "/")) - 1, F.lit(0)))
    up = F.size(folder) - (level - 1)
    rest = F.filter(F.split(F.substring(module, level + 1, F.length(module)), r"\."), lambda p: p != "")
    return F.when(up >= 0, F.array_join(F.concat(F.slice(folder, 1, F.greatest(up, F.lit(0))), rest), "/"))


def resolve_names(wanted: DataFrame, files: DataFrame, index: DataFrame) -> DataFrame:
    """``wanted`` (src, module, …) joined to the files (path) that each module names.

    Absolute names go by the index and by their own place from the root, relative ones by theirs
    only; all candidates meet the known paths in one join.
    """
    relative = F.col("module").startswith(".")
    place = F.when(relative, absolute(F.col("module"), F.col("src"))).otherwise(F.replace("module", F.lit("."), F.lit("/")))
    at = F.array(F.concat(place, F.lit(".py")), F.concat(F.when(place == "", "").otherwise(F.concat(place, F.lit("/"))), F.lit("__init__.py")))
    own = files.select("path", F.col("path").alias("at"), F.lit(None).cast("string").alias("m"))
    known = own.unionByName(index.select("path", F.lit(None).cast("string").alias("at"), F.col("module").alias("m"))).select("path", F.coalesce(F.concat(F.lit("p:"), "at"), F.concat(F.lit("m:"), "m")).alias("key"))
    keys = F.concat(F.transform(F.filter(at, lambda a: a.isNotNull()), lambda a: F.concat(F.lit("p:"), a)), F.when(relative, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("m:"), F.col("module")))))
    return wanted.withColumn("key", F.explode(keys)).join(known, "key").drop("key").distinct()


def import_edges(records: DataFrame, files: DataFrame, index: DataFrame) -> DataFrame:
    """(src, dst) by import statements: the module itself, and each imported name that is a module."""
    i = _imports(records)
    wanted = i.select("src", "module").unionByName(i.select("src", F.col("target").alias("module"))).where("module <> ''").distinct()
    return resolve_names(wanted, files, index).select("src", F.col("path").alias("dst")).distinct()


def declared(records: DataFrame) -> DataFrame:
    """(path, symbol) of what a file defines at its top level."""
    return records.select("path", F.explode(F.concat("top_level_symbols", "exports", "classes", "functions")).alias("symbol")).where("symbol <> ''").distinct()


def symbol_index(records: DataFrame, files: DataFrame, index: DataFrame) -> DataFrame:
    """(name, path): full names of declared symbols, re-exports, modules, and plain names of one file only."""
    d = declared(records)
    full = d.join(index, "path").select(F.concat_ws(".", "module", "symbol").alias("name"), "path")
    i = _imports(records).where("kind = 'from' and name is not null and name <> '*'")
    # an imported name is what its module's file declares, or the module it is
    wanted = i.select("src", "alias", "module").unionByName(i.select("src", "alias", F.col("target").alias("module")))
    through = resolve_names(wanted, files, index).select(F.col("src").alias("via"), "alias", "path")
    again = through.join(index.select(F.col("path").alias("via"), "module"), "via").select(F.concat_ws(".", "module", "alias").alias("name"), "path")
    plain = unique_symbols(d)
    return full.unionByName(again).unionByName(index.select(F.col("module").alias("name"), "path")).unionByName(plain.select(F.col("symbol").alias("name"), "path")).distinct()


def unique_symbols(declared_: DataFrame) -> DataFrame:
    """(symbol, path) of symbols that one file alone declares."""
    return declared_.groupBy("symbol").agg(F.min("path").alias("path"), F.max("path").alias("last")).where("path = last").select("symbol", "path")


def references(records: DataFrame) -> DataFrame:
    """(src, reference) of calls, instantiations, types, raises and decorators."""
    return records.select(F.col("path").alias("src"), F.explode(F.concat("call_targets", "instantiated_classes", "type_references", "raised_exceptions", "decorators")).alias("reference")).where("reference <> ''").distinct()


def semantic_edges(records: DataFrame, symbols: DataFrame) -> DataFrame:
    """(src, dst) by use: a reference, with its first part also replaced by what the file imports
    under that name, and all of its dotted prefixes, meet the symbol index."""
    i = _imports(records)
    last = F.element_at(F.split("module", r"\."), -1)
    root = F.element_at(F.split("module", r"\."), 1)
    named = i.where("kind = 'from' and name is not null and name <> '*'").select("src", "alias", F.col("target").alias("stands_for"))
    whole = i.where("kind <> 'from'")
    alias = named.unionByName(whole.select("src", F.coalesce("alias", last).alias("alias"), F.col("module").alias("stands_for"))).unionByName(whole.select("src", root.alias("alias"), root.alias("stands_for"))).distinct()
    r = references(records).withColumn("alias", F.element_at(F.split("reference", r"\."), 1))
    swapped = r.join(alias, ["src", "alias"]).select("src", F.concat("stands_for", F.substring(F.col("reference"), F.length("alias") + 1, F.length("reference"))).alias("reference"))
    names = r.select("src", "reference").unionByName(swapped)
    parts = F.split("reference", r"\.")
    prefixes = names.select("src", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: _join(F.slice(parts, 1, k)))).alias("name")).where("name <> ''").distinct()
    return prefixes.join(symbols, "name").select("src", F.col("path").alias("dst")).where("src <> dst").distinct()


def dependency_edges(records: DataFrame, files: DataFrame) -> DataFrame:
    """All edges (src, dst) between files, by import and by use, without loops."""
    index = module_index(files)
    both = import_edges(records, files, index).unionByName(semantic_edges(records, symbol_index(records, files, index)))
    return both.where("src <> dst").distinct()
