"""git on the driver: listings, heads and diffs. What git can't answer is empty."""

from __future__ import annotations

import difflib
import os
import subprocess

from ..functions.text import parse_diff


_DIFF = "diff --diff-filter=ACDMR --unified=3".split()


def _git(root: str, *args: str) -> str | None:
    run = subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, errors="ignore", check=False)
    return run.stdout if run.returncode == 0 else None


def is_repository(root: str) -> bool:
    return "true" in (_git(root, *"rev-parse --is-inside-work-tree".split()) or "")


def head(root: str) -> str | None:
    return (_git(root, "rev-parse", "HEAD") or "").strip() or None


def _paths(out: str | None) -> list[str]:
    return sorted({p for p in (out or "").split("\0") if p})


def files(root: str) -> list[str]:
    return [p for p in _paths(_git(root, *"ls-files -z --exclude-standard --others --cached".split())) if os.path.isfile(os.path.join(root, p))]


def untracked(root: str) -> list[str]:
    return _paths(_git(root, *"ls-files -z --exclude-standard --others".split()))


def diff(root: str, base: str, head_ref: str = "HEAD", merge_base: bool = True) -> list[dict]:
    """Patches between two commits, by default from where they parted."""
    return parse_diff(_git(root, *_DIFF, f"{base}{'...' if merge_base else '..'}{head_ref}") or "")


def worktree_diff(root: str, base: str) -> list[dict]:
    """Patches of the work tree against a commit, with untracked files as additions, in order of path."""
    tracked = parse_diff(_git(root, *_DIFF, base) or "")
    known = {p["path"] for p in tracked}
    return sorted(tracked + [addition(root, p) for p in untracked(root) if p not in known], key=lambda p: p["path"])


def addition(root: str, path: str) -> dict:
    with open(os.path.join(root, path), encoding="utf-8", errors="ignore") as f:
        lines = f.read().splitlines()
    body = "\n".join(difflib.unified_diff([], lines, "/dev/null", f"b/{path}", lineterm=""))
    return parse_diff(f"diff --git a/{path} b/{path}\nnew file mode 100644\n{body}")[0]
