"""The entry without the training-data package, or with one of its packages absent: all other queries remain."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).parent.parent
CODE = """
import sys
for name in {absent!r}:
    sys.modules[name] = None
import __spark_entry__ as e
from quillon.plans import catalogue
names = set(e.queries())
assert set(catalogue.queries()) <= names and set(e.oracle_sql()) <= names, names
print(len(names) - len(catalogue.queries()))
"""


@pytest.mark.parametrize(("keep", "absent"), [((), ()), (("corpus_pipeline.py",), ()), (("quillon/llm", "corpus_pipeline.py"), ("ahocorasick",)), (("quillon/llm",), ())])
def test_core_queries_survive(tmp_path, keep, absent):
    shutil.copytree(ROOT / "quillon", tmp_path / "quillon", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    for name in keep:
        if (ROOT / name).is_dir():
            shutil.copytree(ROOT / name, tmp_path / name, ignore=shutil.ignore_patterns("__pycache__"))
        elif (ROOT / name).exists():
            shutil.copy(ROOT / name, tmp_path)
    found = subprocess.run([sys.executable, "-c", CODE.format(absent=absent)], cwd=tmp_path, capture_output=True, text=True)
    assert found.returncode == 0, found.stderr
    assert int(found.stdout) in ((0,) if "quillon/llm" not in keep or absent else (0, 10))


def test_training_queries_are_registered():
    pytest.importorskip("quillon.llm")
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert {name.split("_")[0] for name in names if name.startswith("op")} >= {f"op{k}" for k in range(1, 11)} or "pipeline" not in names
