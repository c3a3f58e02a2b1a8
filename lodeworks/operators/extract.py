"""Structural facts of Python source files, one Arrow pass over (path, role, content)."""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_LISTS = (
    "imports exports top_level_symbols classes functions methods decorators models_or_schemas state_signals call_targets instantiated_classes raised_exceptions"
    " type_references dynamic_imports data_flow_edges file_structure export_styles notes"
).split()
_IMPORT = "struct<module:string,kind:string,is_relative:boolean,is_dynamic:boolean,names:array<string>,aliases:array<string>>"
_FUNCTION = "struct<name:string,signature:string,decorators:array<string>,return_type:string,parameters:array<string>,calls:array<string>,raises:array<string>,type_references:array<string>>"
_CLASS = "struct<name:string,bases:array<string>,methods:array<string>,decorators:array<string>,attributes:array<string>>"
_ROUTE = "struct<method:string,path:string,handler:string,framework:string>"
SCHEMA = ", ".join([
    "path string", "short_doc_summary string", "confidence double", *(f"{c} array<string>" for c in _LISTS),
    f"import_details array<{_IMPORT}>", f"function_details array<{_FUNCTION}>", f"class_details array<{_CLASS}>", f"routes array<{_ROUTE}>",
])
_VERBS = frozenset("WEBSOCKET ROUTE DELETE PATCH PUT POST GET".split())
_FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)
#: Names of module state.
_STATE = re.compile("(state|cache|registry)$", re.I)


def _text(node: ast.AST | None) -> str:
    try:
        return ast.unparse(node) if node is not None else ""
    except Exception:  # unparse gives up on trees that no source makes
        return ""


def _callee(node: ast.AST) -> str:
    """The dotted name that is called; calls and subscripts within the chain are skipped over."""
    tail: list[str] = []
    while True:
        match node:
            case ast.Attribute(value=ast.Constant(), attr=attr):
                return ".".join([attr, *reversed(tail)])
            case ast.Attribute(value=inner, attr=attr):
                tail.append(attr)
                node = inner.func if isinstance(inner, ast.Call) else inner
            case ast.Subscript(value=inner):
                node = inner
            case _:
                head = node.id if isinstance(node, ast.Name) else _text(node)
                return ".".join(([head] if head else []) + tail[::-1])


def _names(target: ast.AST) -> list[str]:
    match target:
        case ast.Name(id=name):
            return [name]
        case ast.Attribute():
            return [_text(target)]
        case ast.Tuple(elts=parts) | ast.List(elts=parts):
            return [n for p in parts for n in _names(p)]
    return []


def _annotation(shown: ast.AST | None) -> list[str]:
    parts = ast.walk(shown) if shown is not None else ()
    return [_text(x) for x in parts if isinstance(x, (ast.Attribute, ast.Name))]


def _origin(value: ast.AST | None) -> str:
    match value:
        case ast.Call(func=f):
            return _callee(f)
        case ast.Subscript() | ast.Attribute() | ast.Name():
            return _text(value)
        case ast.Dict() | ast.Set() | ast.Tuple() | ast.List():
            kind = type(value).__name__
            return kind.lower()
        case _:
            return ""


def _distinct(items) -> list[str]:
    return sorted({x for x in items if x})


def _signals(root: ast.AST) -> dict:
    """Calls, raises, type references and dynamic imports anywhere below a node."""
    calls, raises, types, dynamic = set(), set(), set(), set()
    for n in ast.walk(root):
        if isinstance(n, ast.Call):
            name = _callee(n.func)
            calls.add(name)
            if name in ("__import__", "importlib.import_module") and n.args and isinstance(n.args[0], ast.Constant) and isinstance(n.args[0].value, str):
                dynamic.add(n.args[0].value)
        elif isinstance(n, ast.Raise) and n.exc is not None:
            raises.add(_callee(n.exc.func) if isinstance(n.exc, ast.Call) else _text(n.exc))
        elif isinstance(n, ast.ClassDef):
            types.update(map(_text, n.bases))
        else:
            types.update(_annotation(getattr(n, "returns", None) if isinstance(n, _FUNCTIONS) else getattr(n, "annotation", None)))
    return {"calls": _distinct(calls), "raises": _distinct(raises), "types": _distinct(types), "dynamic": _distinct(dynamic)}


def _flows(node: ast.AST, scope: str, out: list[str]) -> None:
    """scope:target<-source of assignments, with items and loops; scope is the innermost definition."""
    pairs: list[tuple[list[ast.AST], ast.AST | None]] = []
    match node:
        case ast.Assign(targets=targets, value=value):
            pairs = [(targets, value)]
        case ast.AnnAssign(target=target, value=value):
            pairs = [([target], value)]
        case ast.For(target=target, iter=value) | ast.AsyncFor(target=target, iter=value):
            pairs = [([target], value)]
        case ast.With(items=items):
            pairs = [([i.optional_vars], i.context_expr) for i in items if i.optional_vars is not None]
    for targets, value in pairs:
        if source := _origin(value):
            out += [f"{scope}:{name}<-{source}" for t in targets for name in _names(t)]
    inner = node.name if isinstance(node, (*_FUNCTIONS, ast.ClassDef)) else scope
    for child in ast.iter_child_nodes(node):
        _flows(child, inner, out)


def _parameters(a: ast.arguments) -> list[str]:
    show = lambda x: f"{x.arg}: {t}" if (t := _text(x.annotation)) else x.arg
    star = ["*" + show(a.vararg)] if a.vararg else ["*"] if a.kwonlyargs else []
    return [*map(show, a.posonlyargs + a.args), *star, *map(show, a.kwonlyargs), *(["**" + show(a.kwarg)] if a.kwarg else [])]


def _decorators(node) -> list[str]:
    return [t for d in node.decorator_list if (t := _text(d.func if isinstance(d, ast.Call) else d))]


def _routes(f) -> list[dict]:
    out = []
    for d in f.decorator_list:
        if not (isinstance(d, ast.Call) and isinstance(d.func, ast.Attribute) and d.func.attr.upper() in _VERBS):
            continue
        strings = lambda xs: [x.value for x in xs if isinstance(x, ast.Constant) and isinstance(x.value, str)]
        verb = d.func.attr.upper()
        if verb == "ROUTE":
            given = [strings(k.value.elts) for k in d.keywords if k.arg == "methods" and isinstance(k.value, (ast.List, ast.Tuple))]
            verb = next((",".join(x).upper() for x in given if x), verb)
        out.append({"method": verb, "path": next(iter(strings(d.args[:1])), "/"), "handler": f.name, "framework": _text(d.func.value) or "unknown"})
    return out


def _function(f) -> dict:
    s, p = _signals(f), _parameters(f.args)
    return {"name": f.name, "signature": f"{f.name}({', '.join(p)})", "decorators": _decorators(f), "return_type": _text(f.returns) or None, "parameters": p, "calls": s["calls"], "raises": s["raises"], "type_references": s["types"]}


def _is_model(c: ast.ClassDef) -> bool:
    return any(t in c.name.lower() for t in ("serializer", "schema", "model")) or any(t in _text(b).lower() for b in c.bases for t in ("dataclass", "schema", "model"))


def _is_guard(test: ast.AST) -> bool:
    return isinstance(test, ast.Compare) and _text(test.left) == "__name__" and isinstance(test.comparators[0], ast.Constant) and test.comparators[0].value == "__main__"


def extract(path: str, role: str | None, content: str | None, gitignored: bool | None = False) -> dict:
    """The record (SCHEMA) of one file; what doesn't parse gives an empty one of confidence 0.2."""
    r: dict = {"path": path, "confidence": 0.96, **{c: [] for c in _LISTS}, "import_details": [], "function_details": [], "class_details": [], "routes": []}
    try:
        tree = ast.parse(content or "")
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        return r | {"confidence": 0.2, "short_doc_summary": "Not valid Python; only its path is known.", "notes": [f"syntax-error:{getattr(e, 'msg', type(e).__name__)}"]}

    def section(kind: str) -> None:
        if r["file_structure"][-1:] != [kind]:
            r["file_structure"].append(kind)

    for n in tree.body:
        if isinstance(n, (ast.Import, ast.ImportFrom)):
            section("imports")
            if isinstance(n, ast.Import):
                for a in n.names:
                    r["imports"].append(a.name)
                    r["import_details"].append({"module": a.name, "kind": "import", "is_relative": False, "is_dynamic": False, "names": [], "aliases": [a.asname or a.name.split(".")[-1]]})
            else:
                module = "." * n.level + (n.module or "")
                r["imports"].append(module)
                r["import_details"].append({"module": module, "kind": "from", "is_relative": n.level > 0, "is_dynamic": False, "names": [a.name for a in n.names], "aliases": [a.asname or a.name for a in n.names]})
        elif isinstance(n, _FUNCTIONS):
            section("functions")
            r["functions"].append(n.name)
            r["top_level_symbols"].append(n.name)
            r["function_details"].append(_function(n))
            r["decorators"] += _decorators(n)
            r["routes"] += _routes(n)
            r["exports"] += [n.name] * (not n.name.startswith("_"))
            r["state_signals"] += [n.name] * bool(_STATE.search(n.name))
        elif isinstance(n, ast.ClassDef):
            section("classes")
            own = [c.name for c in n.body if isinstance(c, _FUNCTIONS)]
            attributes = _distinct(x for c in n.body if isinstance(c, (ast.Assign, ast.AnnAssign)) for t in (c.targets if isinstance(c, ast.Assign) else [c.target]) for x in _names(t))
            r["classes"].append(n.name)
            r["top_level_symbols"].append(n.name)
            r["methods"] += [f"{n.name}.{m}" for m in own]
            r["decorators"] += _decorators(n)
            r["class_details"].append({"name": n.name, "bases": [t for b in n.bases if (t := _text(b))], "methods": own, "decorators": _decorators(n), "attributes": attributes})
            r["models_or_schemas"] += [n.name] * _is_model(n)
        elif isinstance(n, (ast.Assign, ast.AnnAssign)):
            section("assignments")
            names = [x for t in (n.targets if isinstance(n, ast.Assign) else [n.target]) for x in _names(t)]
            r["top_level_symbols"] += names
            r["exports"] += filter(str.isupper, names)
            r["state_signals"] += filter(_STATE.search, names)
        elif isinstance(n, ast.If) and _is_guard(n.test):
            r["notes"] = ["has_main_guard"]
    s = _signals(tree)
    flows: list[str] = []
    _flows(tree, "module", flows)
    for module in s["dynamic"]:
        r["imports"].append(module)
        r["import_details"].append({"module": module, "kind": "dynamic", "is_relative": False, "is_dynamic": True, "names": [], "aliases": []})
    doc = (ast.get_docstring(tree) or "").strip()
    if gitignored:
        r["notes"].append("gitignored_but_preserved")
    r |= {"export_styles": ["named"] if r["exports"] else [], "call_targets": s["calls"], "raised_exceptions": s["raises"], "type_references": s["types"], "dynamic_imports": s["dynamic"], "data_flow_edges": _distinct(flows)}
    r["instantiated_classes"] = _distinct(c for c in s["calls"] if c.rsplit(".", 1)[-1][:1].isupper())
    # definitions stay in the order of the source; the rest are sets
    for c in ("imports", "exports", "top_level_symbols", "decorators", "models_or_schemas", "state_signals"):
        r[c] = _distinct(r[c])
    return r | {"short_doc_summary": doc.splitlines()[0] if doc else f"Python {role or 'source'} module."}


def _arrow_schema() -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(SCHEMA))


#: Language -> function of (path, role, content, gitignored) that gives a record; ``register`` adds one.
EXTRACTORS: dict[str, Callable[..., dict]] = {"python": extract}


def register(language: str, extractor: Callable[..., dict]) -> None:
    """Files of ``language`` get their records from ``extractor``. Fields that it leaves out are empty."""
    EXTRACTORS[language] = extractor


def _complete(record: dict) -> dict:
    return {"confidence": 0.0, "short_doc_summary": "", **{c: [] for c in (*_LISTS, "import_details", "function_details", "class_details", "routes")}} | record


def records(files: DataFrame) -> DataFrame:
    """Records (SCHEMA) of files (path, role, content, and language and gitignored if there), by the extractor
    of their language, Python where it isn't given. Rows with a null path, or of other languages, have none."""
    schema, known = _arrow_schema(), dict(EXTRACTORS)
    optional = {"language": F.lit("python"), "gitignored": F.lit(False)}
    files = files.select("path", "role", "content", *(F.col(c) if c in files.columns else v.alias(c) for c, v in optional.items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [_complete(known[lang](path, role, text, ignored)) for path, role, text, lang, ignored in zip(*(c.to_pylist() for c in b.columns), strict=True)]
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return files.where(F.col("path").isNotNull() & F.col("language").isin(*known)).mapInArrow(run, SCHEMA)


#: kind of fact -> list column
FACTS = {"import": "imports", "class": "classes", "function": "functions", "method": "methods", "export": "exports", "decorator": "decorators", "model": "models_or_schemas", "call": "call_targets", "instantiates": "instantiated_classes", "raises": "raised_exceptions", "type": "type_references", "dynamic": "dynamic_imports", "flow": "data_flow_edges", "state": "state_signals"}


def facts(extracted: DataFrame) -> DataFrame:
    """(path, kind, value, pos, fact) in long form; fact is kind:path:value."""
    lists = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(c).alias("values")) for k, c in FACTS.items()), F.struct(F.lit("route").alias("kind"), F.transform("routes", lambda r: F.concat_ws(" ", r["method"], r["path"])).alias("values")))
    rows = extracted.select("path", F.explode(lists).alias("l")).select("path", "l.kind", F.posexplode("l.values").alias("pos", "value"))
    return rows.select("path", "kind", "value", "pos", F.concat_ws(":", "kind", "path", "value").alias("fact"))
