"""Documents of a blueprint: JSON, and Markdown for people."""

from __future__ import annotations

import json

from ..operators.blueprint import coverage_lines


def badge(confidence: float) -> str:
    return "high" if confidence >= 0.75 else "medium" if confidence >= 0.5 else "low"


def _items(values, empty: str = "none") -> str:
    return "\n".join(f"- {v}" for v in values) or f"- {empty}"


def _listed(values, cap: int | None = None) -> str:
    return ", ".join(list(values)[:cap]) or "none"


def _document(title: str, sections: list[tuple[str, str]]) -> str:
    return f"# {title}\n\n" + "\n\n".join(f"## {name}\n{text}" for name, text in sections) + "\n"


def _profile(p: dict) -> str:
    return _items([f"type: {p['repo_type']}", f"layout: {p['package_topology']}", f"languages: {_listed(p['languages'])}", f"frameworks: {_listed(p['framework_signals'])}"])


def summary(b: dict) -> str:
    stack, graph = b["tech_stack"], b["import_graph"]
    return _document("Project summary", [
        ("Profile", _profile(b["project_profile"])),
        ("Evidence", _items(coverage_lines(b["evidence_coverage"]))),
        ("Stack", _items(f"{k.replace('_', ' ')}: {_listed(v)}" for k, v in stack.items())),
        ("Entrypoints", _items(b["project_profile"]["entrypoints"][:10])),
        ("Folders", _items(f"{d['folder']}: {d['file_count']} files, mostly {_listed(d['dominant_roles'])}, such as {_listed(d['sample_files'])}" for d in b["directory_summary"])),
        ("Domains", _items(f"{d['domain']}: {_listed(d['evidence'])}" for d in b["domains"])),
        ("Configuration", _items(f"{c['path']} ({c['kind']}): {c['summary']}" for c in b["key_configs"])),
        ("Core modules", _items(f"{m['path']} ({m['role']}): {m['short_doc_summary']} Calls {_listed(m['call_targets'], 5)}; types {_listed(m['type_references'], 5)}" for m in b["core_modules"])),
        ("Dependencies", _items([f"internal edges: {graph['internal_edges']}", f"hubs: {_listed(graph['hubs'])}", f"entry points: {_listed(graph['entry_files'])}", *(f"{c['name']}: {_listed(c['files'], 4)}" for c in graph["clusters"])])),
        ("Rules", _items(f"{r['text']} ({badge(r['confidence'])}, {r['confidence']:.0%})" for r in b["abstract_rules"])),
        ("Workflows", _items(w["summary"] for w in b["concrete_workflows"])),
    ])


def adoption(b: dict) -> str:
    steps = ("`estimate` shows what a run selects, touches and costs.", "`scan` with a provider and a model writes the documents of `skills/`.", "Read `skills/index.md` and the documents it links.", "`adapt --target` publishes them to the files of a coding tool.", "`doctor --target` checks that everything is in place.")
    return _document("Adoption", [
        ("Repository", _profile(b["project_profile"])),
        ("First steps", "\n".join(f"{i}. {s}" for i, s in enumerate(steps, 1))),
        ("What to review", _items(["project-summary.md: the repository in short", "references/: rules, style, workflows and APIs", "skills/: one document for each topic", "report.json: selected files, modes, costs and what changed"])),
        ("Documents proposed", _items(f"{s['name']}: {s['purpose']}" for s in b["recommended_skills"])),
        ("Upkeep", "Run `ci --mode auto` with a base after the first bundle is committed, and keep the `state` folder between runs, so that only documents a change bears on are written again."),
    ])


def architecture(b: dict) -> str:
    def rule(r: dict) -> str:
        return "\n".join([r["text"], "", f"Confidence: {badge(r['confidence'])} ({r['confidence']:.0%})", "", "Evidence:", _items(r["evidence"])])

    rules = [(r["name"], rule(r)) for r in b["abstract_rules"]]
    return _document("Architecture", [*(rules or [("Rules", "No rule was found.")]), ("Clusters", _items(f"{c['name']}: {len(c['files'])} files" for c in b["import_graph"]["clusters"]))])


def code_style(b: dict) -> str:
    fit = [r for r in b["abstract_rules"] if any(w in r["name"] for w in ("naming", "config", "testing", "structure"))]
    return _document("Code style", [("Naming and style", _items((f"{r['text']} ({badge(r['confidence'])}). Seen in {_listed(r['evidence'])}" for r in fit), "no strong signal"))])


def workflows(b: dict) -> str:
    parts = [(w["workflow"], f"{w['summary']}\n\nSteps:\n" + "\n".join(f"{i}. {s}" for i, s in enumerate(w["steps"], 1)) + f"\n\nEvidence:\n{_items(w['evidence'])}") for w in b["concrete_workflows"]]
    return _document("Workflows", parts or [("Workflows", "None was found.")])


def api_usage(b: dict) -> str:
    return _document("API usage", [("Entries", _items(f"{a['kind']} {a['name']} in {a['source']}" + (f": {a['details']}" if a["details"] else "") for a in b["important_apis"]))])


def render(b: dict) -> dict[str, str]:
    """Markdown and JSON artifacts of a blueprint, by path in the output folder."""
    return {
        "project-summary.md": summary(b),
        "adoption.md": adoption(b),
        "references/architecture.md": architecture(b),
        "references/code-style.md": code_style(b),
        "references/workflows.md": workflows(b),
        "references/api-usage.md": api_usage(b),
        "skill-blueprint.json": json.dumps(b, ensure_ascii=False, indent=2, default=str) + "\n",
    }


def partition(paths: list[str]) -> tuple[list[str], list[str]]:
    """(what is for readers, what later steps need) of the paths of a bundle, each once, in order."""
    once = list(dict.fromkeys(paths))
    last = [p for p in once if p in ("project-summary.md", "adoption.md") or p.startswith(("skills/", "references/"))]
    return last, [p for p in once if p not in last]


def summary_lines(report: dict) -> list[str]:
    """What the command line says of a run."""
    costs = report["costs"]
    lines = [f"command: {report['command']}", f"mode: {report['mode']}", f"structure only: {str(report['structure_only']).lower()}", f"root: {report['root']}"]
    if report["model"]:
        lines.append(f"model: {report['model']}")
    lines += [f"type: {report['repo_type']}", f"selected: {len(report['selected_files'])} of {report['candidate_count']} files, {report['total_chars']} characters"]
    lines += [f"changed: {len(report['changed_files'])}"] if report["changed_files"] else []
    lines += [f"affected skills: {', '.join(report['affected_skills'])}"] if report["affected_skills"] else []
    lines += [f"{k.replace('_', ' ')}: {c['items']} calls, {c['input_tokens']} + {c['output_tokens']} tokens, {c['estimated_usd']:.6f} USD" for k, c in costs.items()]
    lines += [f"note: {n}" for n in report["notes"]]
    lines += [f"product: {p}" for p in report["final_products"]]
    lines += [f"intermediate files: {len(report['intermediate_files'])}"] if report["intermediate_files"] else []
    return lines + [f"updated: {p}" for p in report["updated_files"]] + [f"removed: {p}" for p in report["removed_files"]]


def readiness_lines(found: dict, root: str, output: str) -> list[str]:
    """What the command line says of a check."""
    lines = ["command: doctor", f"root: {root}", f"output: {output}", f"ready: {str(found['ready']).lower()}", f"score: {found['score']}"]
    lines += [f"{c['status']}: {c['name']}" + (f" - {c['message']}" if c["message"] else "") for c in found["checks"]]
    return lines + [f"next: {s}" for s in found["next_steps"]]
