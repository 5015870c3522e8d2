"""Every registered query of the library against its SQL, on the smallest tables."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from iqlake import plans
from tests.parity import connect, same


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(plans.ORACLE))
def test_parity(spark, sf_dir, con, name):
    same(plans.QUERIES[name](spark, sf_dir), con, plans.ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLE)))
def test_runs(spark, sf_dir, name):
    assert plans.QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 15
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("pipeline", [True, False])
def test_entry_after_the_corpus_operators_are_deleted(tmp_path, pipeline):
    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "iqlake", tmp_path / "iqlake", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", *(["corpus_pipeline.py"] if pipeline else [])):
        if (root / name).exists():
            shutil.copy(root / name, tmp_path)
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q) and 'pipeline' not in q; print(len(q), e.__file__)"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
    assert done.stdout.split() == [str(len(plans.QUERIES)), str(tmp_path / "__spark_entry__.py")]
