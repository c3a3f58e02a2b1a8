"""An embedded source tree with the facts that a reader finds in it, for queries and tests."""

from __future__ import annotations

FILES: dict[str, str] = {
    "pyproject.toml": '[project]\nname = "harbour"\ndependencies = ["Flask>=3", "sqlalchemy[asyncio]==2.0", "python-dotenv", "pytest-cov~=5"]\n[project.scripts]\nharbour = "harbour.cli:start"\n',
    "requirements.txt": "# pinned\nflask==3.0\nnumpy>1\n\ndjango-filter!=2\n",
    "Dockerfile": 'FROM python:3\nCOPY . .\nENTRYPOINT ["harbour"]\n  CMD ["serve"]\n',
    "src/harbour/__init__.py": "from .ships import Ship\n",
    "src/harbour/ships.py": '"""Ships and their berths."""\n\nfrom dataclasses import dataclass\n\nMAX_LENGTH = 400\n\n\n@dataclass\nclass Ship:\n    name: str\n    length: int\n\n\nclass ShipTooLong(ValueError):\n    pass\n\n\ndef check(ship: Ship) -> Ship:\n    if ship.length > MAX_LENGTH:\n        raise ShipTooLong(ship.name)\n    return ship\n',
    "src/harbour/service.py": "from harbour import Ship\nfrom . import ships as fleet\nimport json\n\n\nclass BerthService:\n    def create(self, name: str) -> Ship:\n        ship = fleet.check(Ship(name, 10))\n        return ship\n\n    def list(self):\n        for row in self.rows:\n            yield json.dumps(row)\n",
    "src/harbour/web.py": "from flask import Flask\nfrom harbour.service import BerthService\n\napp = Flask(__name__)\n\n\n@app.get('/ships')\ndef ships():\n    return BerthService().list()\n\n\n@app.route('/ships', methods=['POST', 'put'])\nasync def add():\n    async with lock() as held:\n        return held\n",
    "src/harbour/cli.py": "import importlib\n\n\ndef start(*names, verbose=False, **rest):\n    web = importlib.import_module('harbour.web')\n    with open('x') as handle:\n        text = handle.read()\n    return web, text\n\n\ndef _private():\n    pass\n\n\nif __name__ == '__main__':\n    start()\n",
    "src/harbour/a_util.py": "def shared_name():\n    return 1\n\n\ndef only_here():\n    return 2\n",
    "src/harbour/b_util.py": "ship_cache = {}\n\n\ndef shared_name():\n    return 2\n",
    "src/harbour/uses.py": "def run():\n    only_here()\n    shared_name()\n",
    "src/harbour/broken.py": "def broken(:\n",
}

#: Facts in the form kind:path:value, and dependency:from->to, found by reading the files.
_P = "src/harbour/"
GOLD = [
    f"import:{_P}__init__.py:.ships", f"import:{_P}ships.py:dataclasses", f"class:{_P}ships.py:Ship", f"class:{_P}ships.py:ShipTooLong", f"function:{_P}ships.py:check", f"export:{_P}ships.py:MAX_LENGTH", f"export:{_P}ships.py:check",
    f"decorator:{_P}ships.py:dataclass", f"raises:{_P}ships.py:ShipTooLong", f"type:{_P}ships.py:Ship", f"type:{_P}ships.py:ValueError", f"call:{_P}ships.py:ShipTooLong", f"instantiates:{_P}ships.py:ShipTooLong",
    f"class:{_P}service.py:BerthService", f"method:{_P}service.py:BerthService.create", f"method:{_P}service.py:BerthService.list", f"call:{_P}service.py:fleet.check", f"call:{_P}service.py:json.dumps", f"flow:{_P}service.py:create:ship<-fleet.check", f"flow:{_P}service.py:list:row<-self.rows", f"type:{_P}service.py:str",
    f"route:{_P}web.py:GET /ships", f"route:{_P}web.py:POST,PUT /ships", f"flow:{_P}web.py:module:app<-Flask", f"call:{_P}web.py:BerthService.list", f"instantiates:{_P}web.py:BerthService", f"decorator:{_P}web.py:app.get",
    f"dynamic:{_P}cli.py:harbour.web", f"function:{_P}cli.py:start", f"function:{_P}cli.py:_private", f"export:{_P}cli.py:start", f"flow:{_P}cli.py:start:handle<-open", f"flow:{_P}cli.py:start:text<-handle.read", f"flow:{_P}cli.py:start:web<-importlib.import_module",
    f"dependency:{_P}__init__.py->{_P}ships.py", f"dependency:{_P}service.py->{_P}__init__.py", f"dependency:{_P}service.py->{_P}ships.py", f"dependency:{_P}web.py->{_P}service.py", f"dependency:{_P}cli.py->{_P}web.py", f"dependency:{_P}uses.py->{_P}a_util.py",
    f"role:{_P}cli.py:entrypoint", f"role:{_P}service.py:service", f"function:{_P}uses.py:run", f"call:{_P}uses.py:only_here", f"state:{_P}b_util.py:ship_cache",
]

DIFF = """noise before
diff --git a/one.py b/one.py
--- a/one.py
+++ b/one.py
@@ -1 +1 @@
-a
+b
@@ -9 +9 @@
-c
+d
diff --git a/old name.py b/new name.py
similarity index 90%
rename from old name.py
rename to new name.py
diff --git a/gone.py b/gone.py
deleted file mode 100644
--- a/gone.py
+++ /dev/null
@@ -1,2 +0,0 @@
-x
-z
diff --git a/fresh.py b/fresh.py
new file mode 100644
--- /dev/null
+++ b/fresh.py
@@ -0,0 +1,2 @@
+y
+w
"""

REPLIES = ['Here: {"a": 1}', "```json\n{\"a\": [1, 2,], \"b\": \"x,}\",}\n```", "json {\"k\": {\"n\": null}}", "nothing", "[1, 2]", '﻿{"t": "a \\" } b"} tail {"u": 2}']
PARSED = ['{"a":1}', '{"a":[1,2],"b":"x,}"}', '{"k":{"n":null}}', None, None, '{"t":"a \\" } b"}']

DOCUMENT = "# Harbour\nIntro line.\n\n## Core Rules\n- Write clean code\n- Ships over 400 m raise ShipTooLong\n\n## Typical Patterns\n```python\nmade up\n```\n"
