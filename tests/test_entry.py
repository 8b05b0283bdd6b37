import os
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]


def test_sql_belongs_to_queries():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert {"p2_found", "p4_found", "p5_found"} <= set(entry.queries())


def test_core_does_not_import_the_removable_package():
    code = "import sys, pkgutil, importlib\nsys.modules['graphloom.llm'] = None\nimport graphloom\n" "for m in pkgutil.walk_packages(graphloom.__path__, 'graphloom.'):\n    if not m.name.startswith('graphloom.llm'): importlib.import_module(m.name)\n" "import __spark_entry__ as e\nassert 'p2_found' in e.queries() and 'p1_found' not in e.queries()\n"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=ROOT)


@pytest.mark.skipif(not os.path.exists("/root/testdata/sf0.001"), reason="no test tables here")
def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
