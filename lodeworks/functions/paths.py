"""Column functions over paths, names and file contents. All stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import vocabulary as V


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def glob_regex(pattern: str) -> str:
    """A shell pattern as a Java regular expression; ``*`` crosses slashes."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[" and (end := pattern.find("]", i + (pattern[i : i + 1] in ("!", "]")) + (pattern[i : i + 2] == "!]"))) > 0:
            body = pattern[i:end].replace("\\", "\\\\")
            out += "[" + ("^" + body[1:] if body.startswith("!") else body) + "]"
            i = end + 1
        else:
            out += f"\\{c}" if not c.isalnum() and c.isascii() else c
    return rf"(?s)\A{out}\z"


def name(path: Column | str) -> Column:
    return F.element_at(F.split(_col(path), "/"), -1)


def suffix(path: Column | str) -> Column:
    """The last suffix with its dot, lower case; empty where the only dot leads the name."""
    return F.lower(F.regexp_extract(name(path), r"(?s)^.+(\.[^.]+)$", 1))


def suffixes(path: Column | str) -> Column:
    """All suffixes of the name, lower case."""
    bare = F.lower(F.regexp_replace(name(path), r"^\.+", ""))
    return F.when(bare.endswith("."), F.array().cast("array<string>")).otherwise(F.transform(F.slice(F.split(bare, r"\."), 2, 1000), lambda s: F.concat(F.lit("."), s)))


def stem(path: Column | str) -> Column:
    return F.regexp_replace(name(path), r"(?s)(?<=.)\.[^.]+$", "")


def parent(path: Column | str) -> Column:
    """The folder of a path, ``.`` at the root."""
    return F.coalesce(F.nullif(F.regexp_extract(_col(path), r"(?s)^(.*)/[^/]*$", 1), F.lit("")), F.lit("."))


def language(path: Column | str) -> Column:
    s = suffix(path)
    return reduce(lambda acc, kv: acc.when(s == kv[0], kv[1]), list(V.LANGUAGES.items())[1:], F.when(s == next(iter(V.LANGUAGES)), next(iter(V.LANGUAGES.values()))))


def matches_glob(path: Column | str, patterns: Iterable[str]) -> Column:
    p = _col(path)
    return any_of(x.rlike(glob_regex(g)) for g in patterns for x in (name(p), p))


def high_value(path: Column | str) -> Column:
    return name(path).isin(*V.HIGH_VALUE_NAMES, *V.ENTRYPOINT_NAMES) | matches_glob(path, V.HIGH_VALUE_GLOBS)


def path_decision(path: Column | str, size: Column | str, gitignored: Column | None = None, max_kb: int = V.MAX_FILE_KB) -> Column:
    """struct(include, reason): the first rule that fits decides."""
    p, n = _col(path), F.lower(name(path))
    ignored = F.lit(False) if gitignored is None else gitignored
    high = high_value(p)
    folders = F.slice(F.split(p, "/"), 1, F.greatest(F.size(F.split(p, "/")) - 1, F.lit(0)))
    deny = lambda reason: F.struct(F.lit(False).alias("include"), F.lit(reason).alias("reason"))
    allow = lambda reason: F.struct(F.lit(True).alias("include"), F.lit(reason).alias("reason"))
    return (
        F.when(F.arrays_overlap(folders, F.array(*map(F.lit, sorted(V.IGNORED_FOLDERS)))), deny("ignored directory"))
        .when(n.isin(*V.LOCK_FILES) & ~high, deny("low-value lock file"))
        .when(n.endswith(".snap"), deny("snapshot file"))
        .when(F.arrays_overlap(suffixes(p), F.array(*map(F.lit, sorted(V.BINARY_SUFFIXES)))), deny("binary or bundled asset"))
        .when(n.endswith(".min.js") | n.endswith(".min.css"), deny("minified asset"))
        .when(n.endswith(".map"), deny("source map"))
        .when((_col(size) > max_kb * 1024) & ~high, deny("file exceeds size budget"))
        .when(ignored & ~high, deny("ignored by .gitignore"))
        .when(matches_glob(p, V.IMAGE_GLOBS), deny("image asset"))
        .when(suffix(p).isin(*V.STYLE_SUFFIXES), allow("style file"))
        .when(name(p).isin(*V.HIGH_VALUE_NAMES), allow("high-value config or documentation"))
        .otherwise(allow("text candidate"))
    )


def generated(content: Column | str) -> Column:
    low = F.lower(_col(content))
    return any_of(low.contains(m) for m in V.GENERATED_MARKERS)


def blank(content: Column | str) -> Column:
    """Only white space, of any script."""
    return ~_col(content).rlike(r"(?U)[^\s\x1c-\x1f]")


def content_decision(path: Column | str, content: Column | str) -> Column:
    out = lambda ok, reason: F.struct(F.lit(ok).alias("include"), F.lit(reason).alias("reason"))
    return F.when(generated(content) & ~high_value(path), out(False, "generated file")).when(blank(content), out(False, "empty file")).otherwise(out(True, "content accepted"))


def binary_blob(data: Column | str) -> Column:
    """A NUL in the first KB of a binary column, or more control bytes than text has."""
    head = F.hex(F.substring(_col(data), 1, 1024))
    low = F.size(F.filter(F.regexp_extract_all(head, F.lit("(..)"), F.lit(1)), lambda b: b < "09"))
    size = F.length(head) / 2
    return (head.rlike("^(..)*00")) | (low > F.greatest(F.lit(8), F.floor(size / 10)))


def supported_non_source(path: Column | str) -> Column:
    return high_value(path) | matches_glob(path, V.CONFIG_GLOBS) | suffix(path).isin(".md", ".txt", ".toml")


def rule_matches(path: Column | str) -> list[Column]:
    """One boolean a path rule, in the order of PATH_RULES."""
    p, low, python = _col(path), F.lower(_col(path)), F.coalesce(language(path) == "python", F.lit(False))
    role = lambda r: python & any_of(low.contains(t) for t in V.ROLE_TOKENS[r])
    named = name(p).isin(*V.HIGH_VALUE_NAMES)
    return [
        named,
        F.lower(name(p)).startswith("readme") | F.lower(stem(p)).contains("architecture"),
        name(p).isin(*V.ENTRYPOINT_NAMES) | (python & F.lower(stem(p)).isin(*V.ENTRYPOINT_STEMS)),
        named | matches_glob(p, V.CONFIG_GLOBS),
        role("route"),
        role("service"),
        role("model"),
        role("utility"),
        role("test"),
        python,
    ]


def priority(path: Column | str, more: Iterable[tuple[Callable[[Column], Column], int, str, str]] = ()) -> Column:
    """struct(score, reasons, role): the best rule, and up to three points for further ones.

    ``more`` are further rules (matches, score, reason, role), matches being a function of the path.
    """
    own = list(zip(rule_matches(path), V.PATH_RULES, strict=True)) + [(matches(_col(path)), rule) for matches, *rule in more]
    own.sort(key=lambda x: -x[1][0])
    rules = [F.when(m, F.struct(F.lit(s).alias("score"), F.lit(r).alias("reason"), F.lit(role).alias("role"))) for m, (s, r, role) in own]
    hit = F.filter(F.array(*rules), lambda x: x.isNotNull())
    found = F.struct((hit[0]["score"] + F.least(F.size(hit) - 1, F.lit(3))).alias("score"), F.transform(hit, lambda x: x["reason"]).alias("reasons"), hit[0]["role"].alias("role"))
    return F.when(F.size(hit) > 0, found).otherwise(F.struct(F.lit(10).alias("score"), F.array(F.lit("fallback candidate")).alias("reasons"), F.lit("source").alias("role")))


def domain(role: Column | str) -> Column:
    r = _col(role)
    return F.when(r.isin("route", "service", "model"), "backend").when(r == "test", "quality").otherwise("shared")


def name_style(value: Column | str) -> Column:
    """kebab, snake, PascalCase or camelCase; null for anything else."""
    v = _col(value)
    return F.when(v.contains("-"), "kebab-case").when(v.contains("_"), "snake_case").when(v.rlike(r"\A\p{Lu}"), "PascalCase").when(v.rlike(r"\p{Lu}"), "camelCase")


def kebab(value: Column | str) -> Column:
    bare = F.regexp_replace(F.regexp_replace(F.lower(_col(value)), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")
    return F.coalesce(F.nullif(bare, F.lit("")), F.lit("unnamed-skill"))


EMOJI = r"[\x{1F300}-\x{1FAFF}\x{1F1E6}-\x{1F1FF}\x{2600}-\x{27BF}\x{FE0F}]"


def plain_text(value: Column | str) -> Column:
    """Without emoji, white space collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(_col(value), EMOJI, ""), r"\s+", " "))


def tokens(text: Column | str) -> Column:
    """Distinct lower-case tokens of names, paths and words."""
    return F.array_distinct(F.filter(F.split(F.lower(_col(text)), r"[^a-zA-Z0-9_/.\-]+"), lambda t: t != ""))


def unique_sorted(values: Column | str) -> Column:
    return F.array_sort(F.array_distinct(F.filter(_col(values), lambda v: v != "")))


def unique_ordered(values: Column | str) -> Column:
    """Each value once, where it stands first; empty ones go."""
    return F.array_distinct(F.filter(_col(values), lambda v: v != ""))


def join_limited(values: Column | str, limit: int) -> Column:
    """Comma-separated, at most ``limit`` of them, and how many more there are."""
    v = _col(values)
    head = F.array_join(F.slice(v, 1, limit), ", ")
    more = F.format_string(", +%d more", F.size(v) - limit)
    return F.when(F.size(v) == 0, "-").when(F.size(v) > limit, F.concat(head, more)).otherwise(head)


def confidence_badge(confidence: Column | str) -> Column:
    c = _col(confidence)
    return F.when(c >= 0.75, "high").when(c >= 0.5, "medium").otherwise("low")
