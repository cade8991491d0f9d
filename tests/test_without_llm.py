import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_the_rest_stands_alone(tmp_path):
    """Without the subpackage for training data the registry still imports and has the engine's own queries."""
    shutil.copytree(f"{ROOT}/reelquilt", tmp_path / "reelquilt", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pooled_best' in q and 'p6_found' in q and 'p8_found' not in q; assert set(e.oracle_sql()) <= set(q)"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr


def test_nothing_imports_it():
    for folder, _, files in os.walk(f"{ROOT}/reelquilt"):
        if "llm" not in folder:
            for f in files:
                if f.endswith(".py"):
                    with open(os.path.join(folder, f)) as text:
                        assert "reelquilt.llm" not in text.read(), f
