import importlib.util
import os

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def _entry():
    spec = importlib.util.spec_from_file_location("spark_entry", os.path.join(ROOT, "__spark_entry__.py"))
    m = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(m)
    return m


def test_entry_runs(spark):
    m = _entry()
    df = m.entry(spark)
    assert df.count() > 0
    assert "risk_level" in df.columns and "category" in df.columns


def test_contract_keys():
    m = _entry()
    assert set(m.oracle_sql()) <= set(m.queries())
    assert len(m.queries()) >= 100
