"""The entry module without a package that the corpus operators need."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).parent.parent.parent


def test_a_missing_package_takes_no_other_query_along():
    code = (
        "import sys, warnings\n"
        "sys.modules['xxhash'] = None\n"
        "import __spark_entry__ as e\n"
        "with warnings.catch_warnings(record=True) as said:\n"
        "    warnings.simplefilter('always')\n"
        "    assert 'overlay_locked_edges' in e.queries() and 'pipeline' not in e.queries()\n"
        "assert 'xxhash' in str(said[0].message)\n"
    )
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
