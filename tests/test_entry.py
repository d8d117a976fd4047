"""The entry works without the folders of the pipeline operators."""

import os
import shutil
import subprocess
import sys

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SAYS = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert set(o) <= set(q); print(len(q), sum(n.startswith('op') for n in q), 'pipeline' in q)"


def counts(folder, **more):
    done = subprocess.run([sys.executable, "-c", SAYS], cwd=folder, env=os.environ | {"PYTHONPATH": ""} | more, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    return done.stdout.split()[-3:]


def copied(tmp_path, *left_out):
    folder = tmp_path / "copy"
    shutil.copytree(HERE, folder, ignore=shutil.ignore_patterns(".git", "__pycache__"))
    for name in left_out:
        path = folder / name
        shutil.rmtree(path) if path.is_dir() else path.unlink(missing_ok=True)
    return folder


def test_without_the_folders(tmp_path):
    n, of_pipeline, pipeline = counts(copied(tmp_path, "dialoom/llm", "tests/llm"))
    assert int(n) > 200 and (of_pipeline, pipeline) == ("0", "False")


def test_without_the_pipeline_file_too(tmp_path):
    n, of_pipeline, pipeline = counts(copied(tmp_path, "dialoom/llm", "tests/llm", "corpus_pipeline.py"))
    assert int(n) > 200 and (of_pipeline, pipeline) == ("0", "False")


def test_an_error_inside_is_not_hidden(tmp_path):
    folder = copied(tmp_path)
    if not (folder / "dialoom/llm/queries.py").exists():
        return
    (folder / "dialoom/llm/queries.py").write_text("raise ImportError('planted')")
    done = subprocess.run([sys.executable, "-c", SAYS], cwd=folder, env=os.environ | {"PYTHONPATH": ""}, capture_output=True, text=True, timeout=120)
    assert done.returncode and "planted" in done.stderr
