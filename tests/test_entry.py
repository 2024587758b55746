"""The entry point with modules taken away, in a process of its own."""

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
HIDE = """
import sys
class Hide:
    def find_spec(self, name, path=None, target=None):
        if name in {names!r} or any(name.startswith(n + ".") for n in {names!r}):
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Hide())
sys.path.insert(0, {root!r})
import __spark_entry__ as entry
keys = entry.queries()
print(len([k for k in keys if not k.startswith("op") and k != "pipeline"]), len([k for k in keys if k.startswith("op")]),
      "pipeline" in keys, set(entry.oracle_sql()) <= set(keys))
"""


@pytest.mark.parametrize("names", [["tallyho.llm"], ["zstandard"], ["corpus_pipeline"], ["tallyho.llm", "corpus_pipeline"]])
def test_other_queries_stay(names):
    made = subprocess.run([sys.executable, "-c", HIDE.format(names=names, root=ROOT)], capture_output=True, text=True, timeout=120)
    own, llm, pipeline, oracles = made.stdout.split()
    assert int(own) >= 134 and oracles == "True"
    if names != ["corpus_pipeline"]:
        assert llm == "0"
    if "tallyho.llm" in names or "corpus_pipeline" in names:
        assert pipeline == "False"


def test_a_fault_of_the_main_library_is_not_hidden():
    made = subprocess.run([sys.executable, "-c", HIDE.format(names=["tallyho.operators.compare"], root=ROOT)],
                          capture_output=True, text=True, timeout=120)
    assert made.returncode != 0
