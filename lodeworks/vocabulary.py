"""Constant tables: which paths, suffixes and names mean what."""

from __future__ import annotations


def _set(text: str) -> frozenset[str]:
    return frozenset(text.split())


OWN_FOLDER = ".lodeworks"
IGNORED_FOLDERS = _set("vendor node_modules venv .venv .git .idea .vscode __pycache__ .pytest_cache target build dist out obj bin coverage temp tmp .nuxt .next") | {OWN_FOLDER}
LOCK_FILES = _set("yarn.lock cargo.lock poetry.lock pnpm-lock.yaml package-lock.json")
HIGH_VALUE_NAMES = _set("setup.py setup.cfg requirements.txt pyproject.toml Dockerfile README README.txt README.md")
HIGH_VALUE_GLOBS = ("Dockerfile.*",)
CONFIG_GLOBS = ("docker-compose*.yaml", "docker-compose*.yml", ".env.example")
ENTRYPOINT_NAMES = _set("server.py manage.py main.py app.py")
ENTRYPOINT_STEMS = _set("server app main cli")
STYLE_SUFFIXES = _set(".less .sass .scss .css")
BINARY_SUFFIXES = _set(
    ".zip .tar .gz .7z .jar .class .so .o .a .dll .dylib .exe .pyc .lockb .pdf .png .jpg .jpeg .gif .ico .svg .webp"
    " .mp3 .wav .flac .mp4 .mov .avi .webm .ttf .otf .eot .woff .woff2 .map .min.js .min.css"
)
IMAGE_GLOBS = ("*.svg", "*.gif", "*.jpeg", "*.jpg", "*.png")
GENERATED_MARKERS = ("do not edit", "automatically generated", "auto-generated", "@generated")
LANGUAGES = {".py": "python"}
BACKEND_FRAMEWORKS = _set("flask fastapi django")
FRAMEWORK_ALIASES = {"pytest": ("pytest",), "flask": ("flask",), "fastapi": ("fastapi",), "django": ("djangorestframework", "django")}
SOURCE_ROOTS = _set("src lib app packages")
CRUD = _set("list get create update delete")

#: (score, reason, role) of the path rules, best first.
PATH_RULES = (
    (100, "root config", "config"),
    (95, "architecture documentation", "documentation"),
    (92, "project entrypoint", "entrypoint"),
    (90, "workspace or build config", "config"),
    (85, "route or controller", "route"),
    (82, "service or repository layer", "service"),
    (79, "model or schema", "model"),
    (64, "utility", "utility"),
    (52, "test", "test"),
    (20, "general source", "source"),
)
ROLE_TOKENS = {
    "route": ("handler", "/api/", "controller", "router", "route"),
    "service": ("client", "repo", "repository", "service"),
    "model": ("dto", "entity", "schema", "model"),
    "utility": ("helper", "utils", "util"),
    "test": ("spec", "test"),
}
DOMAINS = {"route": "backend", "service": "backend", "model": "backend", "test": "quality"}

MAX_FILES, MAX_FILE_KB, MAX_TOTAL_CHARS = 40, 256, 120_000
