"""The driver's entry: it imports without a session, and names match."""

import subprocess
import sys
from pathlib import Path

import __spark_entry__

ROOT = Path(__spark_entry__.__file__).parent


def test_entry_imports_without_a_session():
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q) and len(q) >= 50, (len(q), set(o) - set(q))"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


def test_every_query_is_called_by_its_name():
    for name, f in __spark_entry__.queries().items():
        assert name == "pipeline" or f.__name__ == name
