"""Python workers that have this package only if it is sent to them, as on executors elsewhere."""

import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
CODE = f"""
import sys
sys.path.insert(0, {str(ROOT)!r})
from loomspan.operators import intervals
from loomspan.session import local_session
rows = local_session(2, "1g", 2).createDataFrame([(1, 0, 9, 1), (1, 5, 12, 2), (1, 20, 25, 3)], "s int, b long, e long, id long")
print(intervals.overlapping_pairs(rows, seq="s", begin="b", end="e", id="id").count())
"""


def test_overlap_join_sends_the_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", CODE], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.stdout.strip() == "1", done.stderr[-2000:]
