from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
SHOW = "import __spark_entry__ as e; print(' '.join(sorted(e.queries()))); print(' '.join(sorted(e.oracle_sql())))"


def names(folder: Path) -> tuple[set[str], set[str]]:
    out = subprocess.run([sys.executable, "-c", SHOW], cwd=folder, capture_output=True, text=True, check=True).stdout.splitlines()
    return set(out[0].split()), set(out[1].split())


@pytest.mark.parametrize("with_pipeline", [True, False])
def test_the_rest_stands_without_the_training_data_subpackage(tmp_path, with_pipeline):
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (ROOT / name).exists() and (with_pipeline or name != "corpus_pipeline.py"):
            shutil.copy(ROOT / name, tmp_path / name)
    shutil.copytree(ROOT / "panelspark", tmp_path / "panelspark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    queries, sql = names(tmp_path)
    whole, whole_sql = names(ROOT)
    apart = {q for q in whole if q == "pipeline" or (q.startswith("op") and q.split("_")[0][2:].isdigit())}
    assert queries == whole - apart and sql == whole_sql - apart and queries
