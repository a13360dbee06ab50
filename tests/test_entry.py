"""The entry module without the training-data subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_entry_without_the_subpackage(tmp_path):
    """A left-over folder with nothing but compiled files counts as absent."""
    shutil.copytree(ROOT / "lakewright", tmp_path / "lakewright", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    command = "import __spark_entry__ as e; names = e.queries(); print(len(names), any(n.startswith('op') for n in names))"
    for leftover in (None, tmp_path / "lakewright" / "llm" / "__pycache__"):
        if leftover:
            leftover.mkdir(parents=True)
        out = subprocess.run([sys.executable, "-c", command], cwd=tmp_path, capture_output=True, text=True, check=True)
        n, found = out.stdout.split()
        assert int(n) > 150 and found == "False"
