"""The driver contract: entry() runs, every query has a callable, and every
query with an oracle matches DuckDB at sf0.001."""

import os
import subprocess
import sys

import __spark_entry__ as E

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0 and df.columns


def test_oracles_are_for_registered_queries():
    assert set(E.oracle_sql()) <= set(E.queries())
    assert len(E.queries()) >= 90


def test_all_queries_match_oracles_at_smallest_scale():
    """Every query of the library beside its SQL; the training-data queries have their own tests."""
    from vitrine.plans import registry
    registry.load_all()
    r = subprocess.run([sys.executable, os.path.join(ROOT, "tools", "oracle_check.py"), "--sf", "/root/testdata/sf0.001",
                        *sorted(registry.ORACLES)], capture_output=True, text=True, timeout=3600)
    bad = [ln for ln in r.stdout.splitlines() if ln.startswith("FAIL")]
    assert r.returncode == 0 and not bad, "\n".join(bad) or r.stderr[-2000:]
    assert r.stdout.count("OK   ") == len(registry.ORACLES)
