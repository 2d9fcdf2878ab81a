"""The entry module works with and without the training-data subpackage."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_without_the_subpackage(tmp_path):
    for name in os.listdir(ROOT):
        if name not in ("corpus_pipeline.py", "riskspark", "tests", ".git"):
            os.symlink(f"{ROOT}/{name}", tmp_path / name)
    (tmp_path / "riskspark").mkdir()
    for name in os.listdir(f"{ROOT}/riskspark"):
        if name != "llm":
            os.symlink(f"{ROOT}/riskspark/{name}", tmp_path / "riskspark" / name)
    code = ("import sys; sys.path.insert(0, '.'); import __spark_entry__ as e; e.__file__; "
            "q, o = e.queries(), e.oracle_sql(); assert len(q) >= 40 and set(o) == set(q) and not any(n.startswith('op') for n in q)")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    entry = tmp_path / "__spark_entry__.py"
    text = entry.read_text()
    entry.unlink()
    entry.write_text(text)                     # a real file, so that its own folder is searched
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env=env, check=True, timeout=120)


def test_nothing_imports_the_subpackage():
    for folder, _, files in os.walk(f"{ROOT}/riskspark"):
        if "/llm" not in folder:
            for f in files:
                if f.endswith(".py"):
                    with open(os.path.join(folder, f)) as source:
                        assert "riskspark.llm" not in source.read(), f


def test_entry_survives_an_import_that_fails_inside(tmp_path):
    for name in os.listdir(ROOT):
        if name not in ("corpus_pipeline.py", "tests", ".git", "__spark_entry__.py"):
            os.symlink(f"{ROOT}/{name}", tmp_path / name)
    with open(f"{ROOT}/__spark_entry__.py") as source:
        (tmp_path / "__spark_entry__.py").write_text(source.read())
    (tmp_path / "corpus_pipeline.py").write_text("import a_module_that_is_not_there\n")
    code = "import sys; sys.path.insert(0, '.'); import __spark_entry__ as e; q = e.queries(); assert len(q) >= 40 and not any(n.startswith('op') for n in q)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env=env, check=True, timeout=120, capture_output=True, text=True)
    assert "left out" in done.stderr
