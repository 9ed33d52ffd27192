"""The driver contract's modules load with and without the optional folders."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
SAY = "import __spark_entry__ as e; print(len(e.queries()), sum(k.startswith('op') or k == 'pipeline' for k in e.queries()), len(e.oracle_sql()))"


def _loaded(root: Path) -> list[int]:
    return list(map(int, subprocess.run([sys.executable, "-B", "-c", SAY], cwd=root, capture_output=True, text=True, check=True, timeout=120).stdout.split()))


@pytest.mark.parametrize("gone", [["lodestone/llm"], ["lodestone/llm", "corpus_pipeline.py"], ["corpus_pipeline.py"]])
def test_loads_without_the_optional_parts(tmp_path, gone):
    root = tmp_path / "copy"
    shutil.copytree(ROOT, root, ignore=shutil.ignore_patterns(".git", "__pycache__", "tests"))
    for name in gone:
        shutil.rmtree(root / name, ignore_errors=True)
        (root / name).unlink(missing_ok=True)
    n, optional, sql = _loaded(root)
    assert n > 60 and sql > 60
    assert (optional > 0) == ((root / "lodestone/llm").exists())


def test_other_import_errors_show(tmp_path):
    root = tmp_path / "copy"
    shutil.copytree(ROOT, root, ignore=shutil.ignore_patterns(".git", "__pycache__", "tests"))
    (root / "corpus_pipeline.py").write_text("import no_such_module\n")
    with pytest.raises(subprocess.CalledProcessError):
        _loaded(root)
