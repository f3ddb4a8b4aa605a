"""The library without the training-data folders: it must import, list its queries and run them."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
PROBE = """
import __spark_entry__ as e
q, o = e.queries(), e.oracle_sql()
assert len(q) > 100 and set(o) <= set(q), len(q)
assert not any(n == "pipeline" or n.startswith("op") and n[2].isdigit() for n in q)
"""


def copied(to: Path, *without: str) -> Path:
    for name in ("__spark_entry__.py", "corpus_pipeline.py", "lakeweft"):
        source = ROOT / name
        if source.is_dir():
            shutil.copytree(source, to / name, ignore=shutil.ignore_patterns("__pycache__"))
        elif source.exists():
            shutil.copy(source, to / name)
    for name in without:
        path = to / name
        shutil.rmtree(path) if path.is_dir() else path.unlink(missing_ok=True)
    return to


def probed(folder: Path, code: str) -> subprocess.CompletedProcess:
    return subprocess.run([sys.executable, "-c", code], cwd=folder, capture_output=True, text=True, timeout=120, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(folder)})


def test_without_folders(tmp_path):
    done = probed(copied(tmp_path, "lakeweft/llm"), PROBE)
    assert done.returncode == 0, done.stderr


def test_without_folders_and_pipeline(tmp_path):
    done = probed(copied(tmp_path, "lakeweft/llm", "corpus_pipeline.py"), PROBE)
    assert done.returncode == 0, done.stderr


def test_other_import_errors_show(tmp_path):
    folder = copied(tmp_path, "corpus_pipeline.py")
    if not (folder / "lakeweft/llm").exists():
        return
    (folder / "lakeweft/llm/queries.py").write_text("import no_such_module\n")
    done = probed(folder, "import __spark_entry__ as e; e.queries()")
    assert done.returncode and "no_such_module" in done.stderr
