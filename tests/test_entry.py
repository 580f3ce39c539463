"""The library loads, and registers its own queries, where the corpus operators cannot be imported."""

import subprocess
import sys

import pytest

CODE = """
import sys

class Blocked:
    def find_spec(self, name, path=None, target=None):
        if name == BLOCKED or name.startswith(BLOCKED + "."):
            raise ImportError(name)

sys.meta_path.insert(0, Blocked())
import __spark_entry__ as entry
names = set(entry.queries())
assert set(entry.oracle_sql()) <= names
print(len(names), sum(n.startswith("op") for n in names), "pipeline" in names)
"""


@pytest.mark.parametrize("blocked", ["siftline.llm", "corpus_pipeline", "public_tokenizers", "xxhash"])
def test_missing_modules_leave_the_other_queries(blocked):
    out = subprocess.run(
        [sys.executable, "-c", f"BLOCKED = {blocked!r}\n{CODE}"], capture_output=True, text=True, cwd=__file__.rsplit("/", 2)[0], timeout=120
    )
    assert out.returncode == 0, out.stderr
    n, corpus, pipeline = out.stdout.split()
    assert int(n) > 120 and pipeline == "False" and (int(corpus) == 0 or blocked == "corpus_pipeline")
