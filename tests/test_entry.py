import shutil
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parent.parent
ASK = "import __spark_entry__ as e; q = e.queries(); s = e.oracle_sql(); assert 'q_point_in_interval' in q and set(s) <= set(q); assert 'pipeline' not in q; assert not any(x.startswith('op') for x in q); from pyspark.sql import SparkSession; spark = SparkSession.builder.master('local[2]').config('spark.sql.shuffle.partitions', 2).config('spark.ui.enabled', 'false').getOrCreate(); print('rows', e.entry(spark).count())"


@pytest.mark.parametrize("with_pipeline", [True, False])
def test_the_rest_works_without_the_training_data_operators(tmp_path, with_pipeline):
    gone = shutil.ignore_patterns("llm", ".git", "__pycache__", *([] if with_pipeline else ["corpus_pipeline.py"]))
    shutil.copytree(REPO, tmp_path / "repo", ignore=gone)
    ran = subprocess.run([sys.executable, "-c", ASK], cwd=tmp_path / "repo", capture_output=True, text=True, timeout=300)
    assert ran.returncode == 0, ran.stderr[-2000:]
    assert int(ran.stdout.split("rows")[-1]) > 0


def test_other_import_errors_are_raised(tmp_path):
    gone = shutil.ignore_patterns(".git", "__pycache__")
    shutil.copytree(REPO, tmp_path / "repo", ignore=gone)
    if not (tmp_path / "repo/spanforge/llm/registry.py").exists():
        pytest.skip("taken out")
    (tmp_path / "repo/spanforge/llm/registry.py").write_text("import no_such_module\n")
    ran = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; e.queries()"], cwd=tmp_path / "repo", capture_output=True, text=True, timeout=300)
    assert ran.returncode != 0 and "no_such_module" in ran.stderr
