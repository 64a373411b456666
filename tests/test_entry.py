"""The entry module, with and without the corpus subpackage."""

import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).parent.parent


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).count() == 64


def test_without_the_corpus_subpackage():
    code = (
        "import sys\n"
        "class Gone:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name.startswith('kinograph.llm') or name == 'corpus_pipeline':\n"
        "            raise ModuleNotFoundError(name, name=name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "assert 'overlay_locked_edges' in e.queries() and not any(n.startswith('op') and n[2:3].isdigit() or n == 'pipeline' for n in e.queries())\n"
        "assert set(e.queries()) - set(e.oracle_sql()) == {'marching_fill'}\n"
    )
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
