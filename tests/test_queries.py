import os
import shutil
import subprocess
import sys

import pytest

import __spark_entry__
from cellweave import queries
from tests.conftest import ROOT
from tests.oracle import connect, differences


@pytest.mark.parametrize("name", [n for n in queries.queries() if n in queries.oracle_sql()])
def test_query_equals_its_sql(spark, sf_dir, name):
    assert differences(__spark_entry__.queries()[name](spark, sf_dir), connect(sf_dir), queries.oracle_sql()[name]) == ""


def test_profile_has_ten_stages(spark, sf_dir):
    assert queries.queries()["stage_profile"](spark, sf_dir).count() == 10


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_entry_works_without_the_text_operators(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'dbscan_events' in q and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    outside = [p for p in sys.path if p and not os.path.realpath(p).startswith(os.path.realpath(ROOT))]
    env = os.environ | {"PYTHONPATH": os.pathsep.join(outside)}  # without the whole repository
    subprocess.run([sys.executable, "-c", code], cwd=copy, env=env, check=True, timeout=120)
    rest = ["tests/test_components.py", "tests/test_queries.py", "-k", "not without and not dbscan"]
    subprocess.run([sys.executable, "-m", "pytest", "-q", "-x", *rest], cwd=copy, env=env, check=True, timeout=900)


def test_no_module_outside_imports_the_text_operators():
    for folder, _, names in os.walk(os.path.join(ROOT, "cellweave")):
        if os.path.basename(folder) != "llm":
            for n in names:
                if n.endswith(".py"):
                    with open(os.path.join(folder, n), encoding="utf-8") as f:
                        assert "cellweave.llm" not in f.read(), n
