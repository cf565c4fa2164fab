import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent


@pytest.mark.parametrize("hidden", [["llm"], ["llm", "corpus_pipeline.py"]])
def test_entry_without_the_optional_subpackage(tmp_path, hidden):
    shutil.copytree(ROOT / "cuespan", tmp_path / "cuespan", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if name not in hidden and (ROOT / name).exists():
            shutil.copy(ROOT / name, tmp_path)
    said = subprocess.run(
        [sys.executable, "-c", "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); print(len(q), len(o), 'pipeline' in q)"],
        cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0, said.stderr
    n, checked, pipeline = said.stdout.split()[-3:]
    assert int(n) > 150 and int(checked) > 100 and pipeline == "False"
