"""The driver's contract, with and without the training-data subpackage."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SF = os.environ.get("LUMIQUARRY_TESTDATA", "/root/testdata/sf0.001")


def test_names_agree():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 60


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0


def test_imports_without_the_training_data_folders(tmp_path):
    for name in ("lumiquarry", "tests"):
        shutil.copytree(os.path.join(ROOT, name), tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    code = f"""
import __spark_entry__ as e
from lumiquarry.session import local_session
assert not any(n.startswith('op') or n == 'pipeline' for n in e.queries()) and len(e.queries()) > 60 and e.oracle_sql()
spark = local_session(2, '1g')
assert e.entry(spark).count() > 0
for name in ('tag_counts', 'primary_tag', 'vector_topk', 'exact_dups'):
    assert e.queries()[name](spark, '{SF}').count() > 0
"""
    subprocess.run([sys.executable, "-W", "error::UserWarning:__spark_entry__", "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})


def test_a_missing_library_of_the_training_data_folders_leaves_the_rest(tmp_path):
    for name in ("lumiquarry", "tests"):
        shutil.copytree(os.path.join(ROOT, name), tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    (tmp_path / "lumiquarry" / "llm").mkdir()
    (tmp_path / "lumiquarry" / "llm" / "registry.py").write_text("import no_such_library\n")
    (tmp_path / "corpus_pipeline.py").write_text("")
    code = "import __spark_entry__ as e; assert len(e.queries()) > 60"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert "no_such_library" in done.stderr
