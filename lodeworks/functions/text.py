"""Tolerant JSON, Markdown documents and unified diffs; plain functions and their Arrow columns."""

from __future__ import annotations

import ast
import json
import re
import textwrap
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_FENCED = r"(?s)`{3}[^\n]*\n(.*?)`{3}"
FENCE = re.compile(_FENCED)
EMOJI = re.compile("[\U0001f1e6-\U0001f1ff\U0001f300-\U0001faff☀-➿️]")
UPDATED = "<!-- UPDATED -->"
UNSURE = "- [Needs confirmation] "


# -- JSON ------------------------------------------------------------------------------------


def _outside_strings(text: str) -> Iterator[tuple[int, str]]:
    """Characters outside of JSON strings, with their places."""
    quoted, i = False, 0
    while i < len(text):
        c = text[i]
        if c == "\\":
            i += 2
            continue
        if c == '"':
            quoted = not quoted
        elif not quoted:
            yield i, c
        i += 1


def balanced_objects(text: str) -> list[str]:
    """Outermost {…} of a text, braces within strings left alone."""
    out, depth, start = [], 0, 0
    for i, c in _outside_strings(text):
        if c == "{":
            start, depth = (i if not depth else start), depth + 1
        elif c == "}" and depth:
            depth -= 1
            if not depth:
                out.append(text[start : i + 1])
    return out


def without_trailing_commas(text: str) -> str:
    drop, last = set(), None
    for i, c in _outside_strings(text):
        if c in "}]" and last is not None and not text[last + 1 : i].strip():
            drop.add(last)
        if not c.isspace():
            last = i if c == "," else None
    return "".join(c for i, c in enumerate(text) if i not in drop)


def json_candidates(raw: str) -> list[str]:
    """What in a reply may be the object: all of it, fenced blocks, balanced braces, each also
    without a leading ``json`` and without trailing commas."""
    text = raw.lstrip("\ufeff").strip()
    blocks = [text, *re.findall(r"(?is)`{3}(?:json)?\s*(.*?)`{3}", text), *balanced_objects(text)]
    bare = lambda s: re.sub(r"(?i)\Ajson\b\s*", "", s.strip())
    return list(dict.fromkeys(v.strip() for b in blocks for v in (b, bare(b), without_trailing_commas(b), without_trailing_commas(bare(b))) if v.strip()))


def repair_prompt(raw: str, key: str | None, hint: str | None) -> str:
    lines = ["Return the following reply as one valid JSON object and nothing else."]
    lines += [f'Its top-level key is "{key}".'] if key else []
    lines += [hint] if hint else []
    return "\n".join([*lines, "", "Reply:", raw])


def parse_json_object(raw: str, repair: Callable[[str], str] | None = None, key: str | None = None, hint: str | None = None, context: str = "no JSON object in the reply") -> dict:
    """The first candidate that is a JSON object; else the one in what ``repair`` makes of the reply."""
    error = ""
    for source in (lambda: raw, (lambda: repair(repair_prompt(raw, key, hint))) if repair else None):
        if source is None:
            continue
        for c in json_candidates(source()):
            try:
                value = json.loads(c)
            except ValueError as e:
                error = str(e)
                continue
            if isinstance(value, dict):
                return value
            error = "not an object"
    raise ValueError(f"{context}: {error}" if error else context)


def json_object(raw: Column | str) -> Column:
    """The tolerant object as compact JSON, null where there is none."""
    return F.arrow_udf(_json_object, "string")(raw)


def _json_object(raw: pa.Array) -> pa.Array:

    def one(t: str | None) -> str | None:
        try:
            return None if t is None else json.dumps(parse_json_object(t), ensure_ascii=False, separators=(",", ":"))
        except ValueError:
            return None

    return pa.array([one(t) for t in raw.to_pylist()], pa.string())


# -- Markdown --------------------------------------------------------------------------------


def sanitise_markdown(text: str) -> str:
    text = EMOJI.sub("", textwrap.dedent(text.replace("\r\n", "\n"))).strip()
    return "\n".join(line.rstrip() for line in text.split("\n")) + "\n"


def parse_document(markdown: str) -> tuple[str, str, list[tuple[str, str]]]:
    """(title, preamble, [(heading, content)]): sections at level two; with none, one called Body."""
    text = markdown.strip()
    if not text.startswith("# "):
        raise ValueError("the document is empty" if not text else "the document does not start with a level-1 heading")
    title, *lines = text.splitlines()
    heads = [i for i, line in enumerate(lines) if line.startswith("## ")]
    if not heads:
        body = "\n".join(lines).strip()
        return title.strip(), body, [("Body", "\n".join(["## Body", *filter(None, [body])]))]
    cuts = [*heads, len(lines)]
    return title.strip(), "\n".join(lines[: heads[0]]).strip(), [(lines[a][3:].strip(), "\n".join(lines[a:b]).strip()) for a, b in zip(cuts, cuts[1:], strict=False)]


def assemble(title: str, preamble: str, sections: list[tuple[str, str]]) -> str:
    return sanitise_markdown("\n\n".join(p.strip() for p in (title, preamble, *(c for _, c in sections)) if p.strip()))


def update_sections(document: str, updates: list[dict]) -> str:
    """The document with some sections replaced and marked; a heading it hasn't raises."""
    title, preamble, sections = parse_document(document)
    new = {}
    for u in updates:
        heading, content = (str(u.get(k, "")).strip() for k in ("heading", "content"))
        if heading not in {h for h, _ in sections}:
            raise ValueError(f"no section has the heading {heading!r}")
        body = re.sub(r"\A## [^\n]*\n?", "", content).replace(UPDATED, "").strip()
        new[heading] = f"## {heading}\n{UPDATED}\n{body}".strip()
    return assemble(title, preamble if sections[0][0] != "Body" or "Body" not in new else "", [(h, new.get(h, c)) for h, c in sections])


def ungrounded(markdown: str, contexts: list[str]) -> list[str]:
    """Fenced blocks that no context holds as they are."""
    known = ["\n".join(c.split("\r\n")) for c in contexts]
    return [b.strip() for b in FENCE.findall(markdown) if b.strip() and not any(b.strip() in c for c in known)]


def snippets(content: str, python: bool, most: int = 2, lines: int = 12) -> list[str]:
    """The first definitions of a file, cut to some lines; else its first non-blank lines."""
    text = re.sub("\r\n", "\n", content).strip("\n")
    rows = text.splitlines()
    try:
        defs = [n for n in ast.parse(text).body if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef))] if python else []
    except (SyntaxError, ValueError):
        defs = []
    out = ["\n".join(rows[n.lineno - 1 : min(n.end_lineno, n.lineno - 1 + lines)]).strip() for n in defs[:most]]
    rest = [r for r in rows if r.strip()]
    return [s for s in out if s] or (["\n".join(rest[:8])] if rest else [])


def ground(markdown: str, files: list[tuple[str, str]], section: str = "Typical Patterns") -> str:
    """The document as it is if all its code stands in the files (path, content); else its section of
    patterns quotes the files instead."""
    clean = sanitise_markdown(markdown)
    if not ungrounded(clean, [c for _, c in files]):
        return clean
    quotes = [f"Source: {p}\n```{'python' if p.endswith('.py') else ''}\n{s}\n```" for p, c in files for s in snippets(c, p.endswith(".py"))][:3]
    body = "\n\n".join(quotes) or UNSURE + "The files hold no snippet to quote."
    title, preamble, sections = parse_document(clean)
    return assemble(title, preamble, [(h, f"## {h}\n{body}" if h == section else c) for h, c in sections])


LOW_VALUE = [re.compile(p, re.I) for p in (r"\bfollow (the )?(existing|project) (style|conventions?)\b", r"\bwrite (clean|readable|maintainable) code\b", r"\bkeep (it|code|functions) (simple|small)\b", r"\badd (tests|comments)( where needed)?\.?$", r"\bbest practices?\b", r"\bmeaningful names?\b")]


def drop_low_value_rules(text: str, section: str = "Core Rules") -> str:
    """Without rules of a section that say nothing; a section that loses all says so."""
    out: list[str] = []
    inside, kept = False, 0

    def close() -> None:
        if inside and not kept:
            out.append(UNSURE + "The context does not give rules of value.")

    for line in text.splitlines():
        bare = line.strip()
        if bare.startswith("## "):
            close()
            inside, kept = bare == f"## {section}", 0
        elif inside and bare.startswith("- "):
            if any(p.search(bare) for p in LOW_VALUE):
                continue
            kept += 1
        out.append(line)
    close()
    return "\n".join(out).strip() + "\n"


_SECTIONS = "array<struct<heading:string,content:string>>"


def markdown_document(text: Column | str) -> Column:
    """parse_document as a column; what isn't a document has an error and nothing else."""
    return F.arrow_udf(_markdown_document, f"struct<title:string,preamble:string,sections:{_SECTIONS},error:string>")(text)


def _markdown_document(text: pa.Array) -> pa.Array:

    def one(t: str | None) -> dict | None:
        if t is None:
            return None
        try:
            title, preamble, sections = parse_document(t)
            return {"title": title, "preamble": preamble, "sections": [{"heading": h, "content": c} for h, c in sections], "error": None}
        except ValueError as e:
            return {"title": None, "preamble": None, "sections": None, "error": str(e)}

    s = pa.string()
    kind = pa.struct([("title", s), ("preamble", s), ("sections", pa.list_(pa.struct([("heading", s), ("content", s)]))), ("error", s)])
    return pa.array([one(t) for t in text.to_pylist()], kind)


def violations(documents: DataFrame, contexts: DataFrame) -> DataFrame:
    """(doc, block) of fenced blocks that no context of the document holds.

    documents (doc, markdown), contexts (doc, content): blocks meet the contexts of their own
    document only, by an equi-join on doc.
    """
    found = documents.select("doc", F.explode(F.regexp_extract_all("markdown", F.lit(_FENCED), F.lit(1))).alias("raw"))
    blocks = found.select("doc", F.regexp_replace("raw", r"\A\s+|\s+\z", "").alias("block")).where("block <> ''").distinct()
    held = blocks.join(contexts.select("doc", F.replace("content", F.lit("\r\n"), F.lit("\n")).alias("c")), "doc").where(F.col("c").contains(F.col("block"))).select("doc", "block").distinct()
    return blocks.join(held, ["doc", "block"], "left_anti")


def patch_sections(sections: DataFrame, updates: DataFrame) -> DataFrame:
    """(doc, markdown): sections (doc, pos, heading, content) with updates (doc, heading, content) put in,
    in order, below whatever precedes them (pos 0 holds the title, 1 the preamble)."""
    u = updates.select("doc", "heading", F.concat(F.lit("## "), F.col("heading"), F.lit(f"\n{UPDATED}\n"), F.col("content")).alias("new"))
    joined = sections.join(u, ["doc", "heading"], "left").select("doc", "pos", F.coalesce("new", "content").alias("text")).where("text <> ''")
    return joined.groupBy("doc").agg(F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "\n\n"), F.lit("\n")).alias("markdown"))


# -- diffs -----------------------------------------------------------------------------------

PATCH = "path string, change_type string, previous_path string, patch string, hunks array<struct<header:string,lines:array<string>>>"


def parse_diff(raw: str) -> list[dict]:
    """Patches (PATCH) of a unified diff; text before the first file header is skipped."""
    blocks: list[list[str]] = []
    for line in raw.splitlines():
        if line[:11] == "diff --git ":
            blocks.append([])
        if blocks:
            blocks[-1].append(line)
    return [p for p in map(_patch, blocks) if p]


def _patch(lines: list[str]) -> dict | None:
    side: dict[str, str | None] = {"old": None, "new": None}
    change, hunks = "modify", []
    heads = {"rename from ": "old", "rename to ": "new", "--- ": "old", "+++ ": "new"}
    for line in lines:
        head = next((h for h in heads if line.startswith(h)), None)
        if head:
            name = line[len(head) :].split("\t", 1)[0].strip()
            side[heads[head]] = (name[2:] if head in ("--- ", "+++ ") and name[:2] in ("a/", "b/") else name) or None
        elif mode := re.match(r"(new|deleted) file mode ", line):
            change = {"new": "add", "deleted": "delete"}[mode[1]]
        elif line.startswith("@@"):
            hunks.append({"header": line, "lines": [line]})
        elif hunks:
            hunks[-1]["lines"].append(line)
    old, new = (None if v == "/dev/null" else v for v in side.values())
    if change == "modify" and old and new and old != new:
        change = "rename"
    path = new or old
    return {"path": path, "change_type": change, "previous_path": old if old != path else None, "hunks": hunks, "patch": "\n".join([*lines]).rstrip() + "\n"} if path else None


def diffs(texts: DataFrame, column: str = "diff") -> DataFrame:
    """Patches (PATCH) of every diff text in a column."""
    s = pa.string()
    schema = pa.schema([("path", s), ("change_type", s), ("previous_path", s), ("patch", s), ("hunks", pa.list_(pa.struct([("header", s), ("lines", pa.list_(s))])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [p for t in b.column(0).to_pylist() if t for p in parse_diff(t)]
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return texts.select(column).mapInArrow(run, PATCH)


def split_lines(c: Column | str) -> Column:
    return F.split(c, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]")
