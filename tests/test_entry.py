"""The entry file with and without the subpackage of training-data operators."""

import json
import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
LISTED = "import json, __spark_entry__ as e; print(json.dumps([sorted(e.queries()), sorted(e.oracle_sql())]))"


def listed(folder) -> tuple[set, set]:
    found = subprocess.run([sys.executable, "-c", LISTED], cwd=folder, capture_output=True, text=True, check=True,
                           env={**os.environ, "PYTHONPATH": os.environ.get("PYTHONPATH", "")})
    return tuple(map(set, json.loads(found.stdout.splitlines()[-1])))


@pytest.mark.parametrize("without", [(), ("corpus_pipeline.py",)])
def test_entry_without_llm(tmp_path, without):
    """Neither the subpackage nor, in the second case, the pipeline is there."""
    leave = shutil.ignore_patterns("llm", ".git", "__pycache__", ".pytest_cache", "spark-warehouse", *without)
    shutil.copytree(ROOT, tmp_path / "copy", ignore=leave)
    queries, oracles = listed(tmp_path / "copy")
    assert "a3_candidate_identity" in queries and "pipeline" not in queries
    assert not any(name.startswith("op") for name in queries) and oracles <= queries
    if os.path.isdir(os.path.join(ROOT, "orthomark", "llm")):
        whole, _ = listed(ROOT)
        assert queries < whole and "pipeline" in whole
