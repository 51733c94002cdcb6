"""The entry point without the pipeline operators."""

import subprocess
import sys
from pathlib import Path

ROOT = str(Path(__file__).resolve().parent.parent)


def test_queries_without_a_module_of_the_pipeline():
    """A library that can't be imported takes the pipeline's queries with it, and no others."""
    code = "import sys; sys.modules['ahocorasick'] = None; import __spark_entry__ as e; q = e.queries(); s = e.oracle_sql(); print(len(q), any(n.startswith('op') or n == 'pipeline' for n in q), set(s) <= set(q))"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True).stdout.split()
    assert int(out[0]) >= 29 and out[1:] == ["False", "True"]
