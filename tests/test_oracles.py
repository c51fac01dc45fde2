"""Registered queries against DuckDB on the smallest tables.

Set ``AUDITLAKE_QUICK=1`` to run a selection only.
"""

import os

import pytest

import __spark_entry__ as entry
from harness.check import compare, duck

SF = "/root/testdata/sf0.001"
QUICK = (
    "a2 a5 a9 b1_ b2 b5 b8 b13 c4 c6 c9 c11 d4 d8 d9_d12_r e7 e8 e10 e13 f9 f20 f21 g1 g5 g7 g8 g10 g13 g16 h4 i2 i12 j1 m1 m4_r m9_evidence_digest r7 r12 t1"
).split()
ORACLES = entry.oracle_sql()
NAMES = [n for n in ORACLES if not os.environ.get("AUDITLAKE_QUICK") or any(n.startswith(q) for q in QUICK)]


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not mounted")
@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, con, name):
    got = entry.queries()[name](spark, SF).toArrow()
    assert compare(got, con.sql(ORACLES[name]).to_arrow_table()) == []


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(entry.queries())
