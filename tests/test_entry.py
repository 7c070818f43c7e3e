from __future__ import annotations

import builtins
import importlib
import subprocess
import sys
from pathlib import Path


def test_entry_imports_without_the_optional_parts(monkeypatch):
    real = builtins.__import__

    def without(name, globals=None, locals=None, fromlist=(), level=0):
        if name == "corpus_pipeline" or name.startswith("repopulse.llm"):
            raise ImportError(name, name=name)
        return real(name, globals, locals, fromlist, level)

    for name in [n for n in sys.modules if n in ("__spark_entry__", "corpus_pipeline") or n.startswith("repopulse.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setattr(builtins, "__import__", without)
    entry = importlib.import_module("__spark_entry__")
    names = entry.queries()
    assert "t1_top_active" in names and not any(n.startswith("op") or n == "pipeline" for n in names)
    assert set(entry.oracle_sql()) <= set(names)
    sys.modules.pop("__spark_entry__", None)


def test_entry_imports_without_a_session():
    root = Path(__file__).resolve().parent.parent
    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries())"
    assert subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True).returncode == 0
