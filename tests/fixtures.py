"""Tiny source repositories written for these tests (same shapes as the reference's
three fixture repos: a flat Python package, a src-layout package, a small JS app)."""

PY_APP = {
    "pkg/__init__.py": '"""Package."""\n',
    "pkg/__main__.py": '"""Entry."""\nfrom pkg.core import run\n\n\nif __name__ == "__main__":\n    run()\n',
    "pkg/core.py": '"""Core."""\nfrom pkg.util import fetch\nfrom pkg.models import Item\n\n\ndef run():\n    return Item(fetch("x"))\n',
    "pkg/models.py": '"""Models."""\nfrom pkg.core import run  # circular on purpose\n\n\nclass Item:\n    pass\n',
    "pkg/sub/helper.py": '"""Helper."""\nfrom ..util import fetch\n',
    "pkg/util.py": '"""Util."""\nimport requests\n\n\ndef fetch(u):\n    return requests.get(u)\n',
    "pyproject.toml": '[project]\nname = "py-app"\ndependencies = [\n    "requests>=2.0",\n    "click>=8.0",\n]\n\n[project.scripts]\npy-app = "pkg.__main__:main"\n',
}

PY_SRC_APP = {
    "cli/__init__.py": '"""CLI."""\n',
    "cli/main.py": 'import json\n\nfrom app.config import settings\nfrom app.core import run\n',
    "src/app/__init__.py": '"""App."""\n',
    "src/app/config.py": 'settings = {}\n',
    "src/app/core.py": 'from .config import settings\n',
    "pyproject.toml": '[project]\nname = "src-app"\ndependencies = [\n    "requests>=2.0",\n]\n\n[project.scripts]\nsrc-app = "cli.main:main"\n',
}

JS_APP = {
    "package.json": '{"name": "js-app", "scripts": {"start": "node src/index.js", "test": "node t.js"}, '
                    '"dependencies": {"react": "18.2.0", "lodash": "4.17.21"}}',
    "src/app.js": "// app\nimport { greet } from './lib/util';\nimport React from 'react';\n",
    "src/index.js": "// entry\nimport { App } from './app';\n\nApp();\n",
    "src/lib/util.js": "import { missing } from './does-not-exist';\n",
}
