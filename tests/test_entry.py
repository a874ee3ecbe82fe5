import importlib.util
import os
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def load():
    spec = importlib.util.spec_from_file_location("entry_module", os.path.join(ROOT, "__spark_entry__.py"))
    m = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(m)
    return m


def test_registry_is_consistent():
    m = load()
    q, o = m.queries(), m.oracle_sql()
    assert set(o) <= set(q) and {"p4_found", "p5_found"} <= set(q)


def test_core_does_not_import_the_text_subpackage():
    code = "import sys, quireflow.engine, quireflow.queries, quireflow.streaming.ingest, quireflow.sources.pdf; assert not any('quireflow.llm' in m for m in sys.modules)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.001"), reason="test tables not here")
def test_entry_runs(spark):
    df = load().entry(spark)
    assert df.columns == ["rank", "score", "id", "title"] and df.count() <= 5
