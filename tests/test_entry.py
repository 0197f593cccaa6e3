"""The driver's entry on a copy without the training-data subpackage."""

import os
import shutil
import subprocess
import sys

HOME = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def copy_without(folder, *gone):
    shutil.copytree(os.path.join(HOME, "logweir"), f"{folder}/logweir", ignore=shutil.ignore_patterns("__pycache__", *gone))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if name not in gone and os.path.exists(os.path.join(HOME, name)):
            shutil.copy(os.path.join(HOME, name), folder)
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); print(len(q), len(o), sum(n.startswith('op') for n in q), 'pipeline' in q, 'query_logs' in q)"
    ran = subprocess.run([sys.executable, "-c", code], cwd=folder, capture_output=True, text=True, timeout=300)
    assert ran.returncode == 0, ran.stderr
    return ran.stdout.split()


def test_without_the_subpackage(tmp_path):
    queries, with_sql, numbered, pipeline, other = copy_without(str(tmp_path), "llm", "corpus_pipeline.py")
    assert (numbered, pipeline, other) == ("0", "False", "True") and int(with_sql) > 150


def test_without_the_folder_alone(tmp_path):
    queries, with_sql, numbered, pipeline, other = copy_without(str(tmp_path), "llm")
    assert (numbered, pipeline, other) == ("0", "False", "True") and int(queries) > 150
