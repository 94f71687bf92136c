"""The entry file lists its queries without a session, with and without the training-data operators."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).parent.parent


def listed(code):
    return subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120, check=True).stdout.split()


def test_lists_without_session():
    names = listed("import __spark_entry__ as e; print(*e.queries())")
    known = listed("import __spark_entry__ as e; print(*e.oracle_sql())")
    assert len(names) > 150 and set(known) <= set(names)


def test_lists_without_llm():
    hide = "import sys; sys.modules['corpus_pipeline'] = None\nclass Hide:\n  def find_spec(self, name, *a):\n    if name in ('corpus_pipeline', 'graphweave.llm'): raise ModuleNotFoundError(name=name)\nsys.modules.pop('corpus_pipeline'); sys.meta_path.insert(0, Hide())\n"
    names = listed(hide + "import __spark_entry__ as e; print(*e.queries())")
    assert len(names) > 150 and not [n for n in names if n.startswith("op") or n == "pipeline"]
