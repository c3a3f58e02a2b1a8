"""Recall of the embedded tree's facts, as a report and a chart."""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import SparkSession

from .catalogue import fact_methods
from .fixture import GOLD

_WIDTH, _BAR, _LEFT = 640, 34, 130


def run(spark: SparkSession) -> dict:
    """The report: for each method how many facts it finds, which of the gold facts, and which not."""
    gold = set(GOLD)
    results = []
    for name, facts in fact_methods(spark).items():
        found = {r.fact for r in facts.distinct().collect()}
        results.append({"method": name, "facts": len(found), "hits": len(found & gold), "gold": len(gold), "recall": len(found & gold) / len(gold), "hit_facts": sorted(found & gold), "missed_facts": sorted(gold - found)})
    return {"name": "structural-facts", "generated_at": f"{datetime.now(timezone.utc):%Y-%m-%dT%H:%M:%S+00:00}", "gold": len(gold), "scope": "Facts found in source files before any model is called.", "results": results}


def svg(report: dict) -> str:
    """Bars of recall as SVG."""
    rows = []
    for i, r in enumerate(report["results"]):
        y = 50 + i * (_BAR + 16)
        wide = round((_WIDTH - _LEFT - 90) * r["recall"])
        rows.append(f'<text x="{_LEFT - 10}" y="{y + 22}" text-anchor="end">{r["method"]}</text><rect x="{_LEFT}" y="{y}" width="{max(wide, 2)}" height="{_BAR}" fill="#2a6f97"/><text x="{_LEFT + wide + 10}" y="{y + 22}">{r["recall"]:.3f} ({r["hits"]}/{r["gold"]})</text>')
    high = 60 + len(report["results"]) * (_BAR + 16)
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{_WIDTH}" height="{high}" font-family="sans-serif" font-size="14"><text x="10" y="26" font-size="16">Recall of {report["gold"]} gold facts</text>{"".join(rows)}</svg>\n'


def write(spark: SparkSession, report: str, chart: str) -> list[str]:
    """Writes both files; the lines that say so."""
    made = run(spark)
    with open(report, "w", encoding="utf-8") as f:
        json.dump(made, f, indent=2)
    with open(chart, "w", encoding="utf-8") as f:
        f.write(svg(made))
    return [*(f"{r['method']}: recall {r['recall']:.3f} ({r['hits']}/{r['gold']})" for r in made["results"]), f"wrote {report}", f"wrote {chart}"]
