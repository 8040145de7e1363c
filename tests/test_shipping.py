import subprocess
import sys
from pathlib import Path

SCRIPT = """
import sys
sys.path.insert(0, sys.argv[1])
import __spark_entry__ as entry
from veridex.session import build_session
spark = build_session(2)
print("rows", entry.queries()["title_keys"](spark, sys.argv[2]).count(), entry.queries()["title_keys"](spark, sys.argv[2]).count())
"""


def test_workers_get_the_package(small, tmp_path):
    """From another folder and without a search path, Python workers still find the package."""
    import os

    root = str(Path(__file__).resolve().parent.parent)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT, root, small], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "rows" in done.stdout, done.stderr[-2000:]
