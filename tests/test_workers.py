"""Queries whose plan holds Python run from any working directory: batch functions travel by value."""

import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

PROGRAM = """
import sys
sys.path.insert(0, sys.argv[1])
import __spark_entry__
from tripleloom.session import local_session
spark = local_session(2, "elsewhere", **{"spark__checkpoint__dir": sys.argv[2], "spark__driver__memory": "2g"})
print("ROWS", __spark_entry__.queries()[sys.argv[3]](spark, "/root/testdata/sf0.001").count())
"""


@pytest.mark.parametrize("name", ["m04_soft_assign", "t12_dep_path_between_sets"])
def test_query_from_an_empty_folder(tmp_path, name):
    (tmp_path / "cwd").mkdir()
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run(
        [sys.executable, "-c", PROGRAM, ROOT, str(tmp_path / "shared"), name],
        cwd=tmp_path / "cwd", env=env, capture_output=True, text=True, timeout=240,
    )
    assert "ROWS" in done.stdout, done.stderr[-2000:]
