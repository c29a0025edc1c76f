"""The driver's entry with and without the optional operators."""
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("gone", ["corvane.llm", "corpus_pipeline", "xxhash", "sentencepiece_is_not_asked_for"])
def test_queries_without(gone):
    code = f"""
import sys
sys.modules[{gone!r}] = None
import __spark_entry__ as entry
from corvane.plans.queries import QUERIES, SQL
left = set(entry.queries()) - set(QUERIES)
assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql()) <= set(entry.queries())
assert all(q.startswith("op") or q == "pipeline" for q in left)
print(len(left))
"""
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    assert (done.stdout.split()[-1] == "0") or gone == "sentencepiece_is_not_asked_for"


@pytest.mark.parametrize("error", ["ImportError('broken')", "OSError('no file')"])
def test_queries_where_an_operator_cannot_be_loaded(error):
    code = f"""
import sys
class Broken:
    def find_spec(self, name, *rest):
        if name == "corvane.llm.licences":
            raise {error}
sys.meta_path.insert(0, Broken())
import __spark_entry__ as entry
from corvane.plans.queries import QUERIES
assert set(entry.queries()) == set(QUERIES)
"""
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
