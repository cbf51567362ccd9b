from __future__ import annotations

import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parents[1]
PROGRAM = """
import __spark_entry__ as e
from pyspark import SparkContext
names, sql = e.queries(), e.oracle_sql()
assert SparkContext._active_spark_context is None
print('NAMES', *names)
print('SQL', *sql)
"""


def test_queries_are_read_without_a_session():
    said = subprocess.run([sys.executable, "-B", "-c", PROGRAM], cwd=REPO, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0, said.stderr
    names, sql = (next(line.split()[1:] for line in said.stdout.splitlines() if line.startswith(word)) for word in ("NAMES", "SQL"))
    assert {n.split("_")[0] for n in names} >= {f"op{i}" for i in range(1, 14)} | {"pipeline", "r9"}
    assert set(sql) <= set(names)
