"""The entry points on copies of the tree without the training-data subpackage."""

import pathlib
import shutil
import subprocess
import sys

import pytest

ROOT = pathlib.Path(__file__).resolve().parents[1]
RUN = """
import __spark_entry__ as e
from effectgrid.session import local_session
assert not [q for q in e.queries() if q == "pipeline" or q.startswith("op")], list(e.queries())
assert set(e.oracle_sql()) <= set(e.queries())
print(e.queries()["label_counts"](local_session("entry", "2"), "/root/testdata/sf0.001").count())
"""


@pytest.mark.parametrize("also", [["corpus_pipeline.py"], []])
def test_core_works_without_the_subpackage(tmp_path, also):
    tree = tmp_path / "tree"
    gone = {"llm", ".git", "__pycache__", *also}
    shutil.copytree(ROOT, tree, ignore=lambda _, names: gone & set(names))
    out = subprocess.run([sys.executable, "-B", "-c", RUN], cwd=tree, capture_output=True, text=True, timeout=300, env=None)
    assert out.returncode == 0, out.stderr[-2000:]
    assert int(out.stdout.split()[-1]) > 0
