"""Command line: scan, estimate, ci, adapt, doctor, benchmark."""

from __future__ import annotations

import argparse
import os
import sys


_MODES, _PROVIDERS = ("auto", "full", "incremental"), ("openai", "claude", "qwen")


def _one_of(name: str, value: str | None, choices: tuple[str, ...]) -> str | None:
    """A default from the environment, which argparse doesn't check."""
    if value and value.strip().lower() not in choices:
        raise ValueError(f"LODEWORKS_{name} has to be one of {', '.join(choices)}, not {value!r}")
    return value.strip().lower() if value else None


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("lodeworks", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    env = lambda name, default=None: os.environ.get(f"LODEWORKS_{name}", default)
    for name, mode in (("scan", "full"), ("estimate", "auto"), ("ci", "auto")):
        s = sub.add_parser(name)
        s.add_argument("root", nargs="?", default=".")
        s.add_argument("--output", default=env("OUTPUT", ".lodeworks"))
        s.add_argument("--mode", choices=_MODES, default=_one_of("MODE", env("MODE", mode), _MODES))
        s.add_argument("--base", default=env("BASE"))
        s.add_argument("--head", default=env("HEAD"))
        s.add_argument("--diff-file", default=env("DIFF_FILE"))
        for limit, value in (("files", 40), ("kb", 256), ("chars", 120_000)):
            s.add_argument(f"--max-{limit}", type=int, default=int(env(f"MAX_{limit.upper()}", str(value))))
        s.add_argument("--max-changed", type=int, default=int(env("MAX_CHANGED", "64")), help="with more changed files than this a run is a full one")
        s.add_argument("--pricing", default=env("PRICING"), help="a JSON file of prices")
        s.add_argument("--report", default=env("REPORT"), help="where the report goes, by default into the output folder")
        if name != "estimate":
            s.add_argument("--structure-only", action="store_true", help="no documents written by a model")
            s.add_argument("--max-skills", type=int, default=int(env("MAX_SKILLS", "8")))
            s.add_argument("--provider", choices=_PROVIDERS, default=_one_of("PROVIDER", env("PROVIDER"), _PROVIDERS))
            s.add_argument("--model", default=env("MODEL", ""))
    a = sub.add_parser("adapt")
    a.add_argument("root", nargs="?", default=".")
    a.add_argument("--target", default="all")
    a.add_argument("--source")
    d = sub.add_parser("doctor")
    d.add_argument("root", nargs="?", default=".")
    d.add_argument("--output", default=".lodeworks")
    d.add_argument("--target")
    b = sub.add_parser("benchmark")
    b.add_argument("--report", default="structural-facts.json")
    b.add_argument("--chart", default="structural-facts.svg")
    return p


def main(argv=None) -> int:
    """0 done, 1 failed, 2 bad arguments, 130 interrupted."""
    try:
        given = vars(parser().parse_args(argv))
    except SystemExit as e:
        return int(e.code or 0)
    except ValueError as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    command = given.pop("command")
    try:
        from .plans import benchmark, model, render, run

        if command == "adapt":
            print("\n".join(run.adapt(**given)))
            return 0
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.appName("lodeworks").getOrCreate()
        if command == "doctor":
            out = run.doctor(spark, **given)
            print("\n".join(render.readiness_lines(out, given["root"], given["output"])))
            return 0 if out["ready"] else 1
        if command == "benchmark":
            print("\n".join(benchmark.write(spark, **given)))
            return 0
        provider, name = given.pop("provider", None), given.pop("model", "")
        given["model"] = model.http_model(provider, name) if provider and not given.get("structure_only") else None
        report = {"scan": run.scan, "estimate": run.estimate, "ci": run.run_ci}[command](spark, **given)
        print("\n".join(render.summary_lines(report)))
        return 0
    except KeyboardInterrupt:
        return 130
    except Exception as e:  # the command line reports any failure in one line
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
