"""The entry module without its optional part."""

import pathlib
import shutil
import subprocess
import sys

ROOT = pathlib.Path(__file__).resolve().parent.parent
CODE = """
import __spark_entry__ as e
names = set(e.queries())
assert len(names) > 200 and set(e.oracle_sql()) <= names, len(names)
assert not [n for n in names if n.startswith("op") and n[2].isdigit()], names
print("pipeline" in names)
"""


def left_over(folder, *also):
    shutil.copytree(ROOT / "chronoplex", folder / "chronoplex", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", *also):
        shutil.copy(ROOT / name, folder / name)
    done = subprocess.run([sys.executable, "-c", CODE], cwd=folder, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr[-2000:]
    return done.stdout.strip()


def test_entry_without_the_training_data_folder(tmp_path):
    assert left_over(tmp_path) == "False"


def test_entry_with_a_pipeline_whose_folder_is_gone(tmp_path):
    also = ["corpus_pipeline.py"] if (ROOT / "corpus_pipeline.py").exists() else []
    assert left_over(tmp_path, *also) == "False"
