"""Spark-native repository and document evidence engine.

Names of the public API load on first use, so importing the package is cheap and starts nothing.
"""

from __future__ import annotations

from importlib import import_module

__version__ = "0.1.0"

_WHERE = {
    **dict.fromkeys(("Options", "scan", "estimate", "run_ci", "adapt", "doctor", "execute", "analyse", "describe"), "plans.run"),
    **dict.fromkeys(("render", "partition", "summary_lines", "readiness_lines"), "plans.render"),
    **dict.fromkeys(("extract", "register"), "operators.extract"),
    "http_model": "plans.model",
    "read_tree": "sources.tree",
}
__all__ = ["__version__", *_WHERE]


def __getattr__(name: str):
    if name not in _WHERE:
        raise AttributeError(name)
    return getattr(import_module(f"{__name__}.{_WHERE[name]}"), name)


def __dir__():
    return sorted({*globals(), *_WHERE})
