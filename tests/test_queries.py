"""Every query against its SQL, on the smallest tables."""

import os
import subprocess
import sys

import pytest

from tessera.queries import ORACLE_SQL, QUERIES

from .oracle import connect, differences

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLE_SQL:
        assert (d := differences(df, connect(SF), ORACLE_SQL[name])) is None, d
    else:
        assert df.count() > 0


def test_entry_imports_without_a_session():
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert 'health_report' in q and set(o) <= set(q)"
    assert subprocess.run([sys.executable, "-c", code], cwd=root).returncode == 0
