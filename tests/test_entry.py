"""The entry module must import and keep its other queries without the optional subpackage."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
HIDDEN = """
import importlib.abc, sys
class Hide(importlib.abc.MetaPathFinder):
    def find_spec(self, name, path=None, target=None):
        if name.startswith(("hearthframe.llm", {also!r})):
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Hide())
import importlib.util
found = importlib.util.find_spec
def find_spec(name, package=None):
    return None if name.startswith(("hearthframe.llm", {also!r})) else found(name, package)
importlib.util.find_spec = find_spec
import __spark_entry__ as e
names = set(e.queries())
assert "flagship_comparable_errors" in names and len(names) > 150
assert not any(n.startswith("op") or n == "pipeline" for n in names)
assert set(e.oracle_sql()) <= names
"""


def run(also):
    return subprocess.run([sys.executable, "-c", HIDDEN.format(also=also)], cwd=ROOT, capture_output=True, text=True, check=False)


def test_import_without_the_subpackage():
    done = run("hearthframe.llm")
    assert done.returncode == 0, done.stderr


def test_import_without_subpackage_and_pipeline():
    done = run("corpus_pipeline")
    assert done.returncode == 0, done.stderr
