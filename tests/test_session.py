"""The working folder where the configuration names none."""

import os
import subprocess
import sys
from pathlib import Path

CODE = """
from lensframe.session import local_session, materialise, shared_dir
s = local_session("1", 1)
assert not s.conf.get("spark.checkpoint.dir", None)
assert materialise(s.range(3), "x").count() == 3 and shared_dir(s) == shared_dir(s)
"""


def test_a_local_session_needs_no_setting(tmp_path):
    """An empty configuration folder: no defaults of this machine."""
    env = {k: v for k, v in os.environ.items() if not k.startswith(("SPARK_", "PYSPARK_"))}
    env |= {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": str(Path(__file__).resolve().parents[1]), "TMPDIR": str(tmp_path)}
    r = subprocess.run([sys.executable, "-c", CODE], env=env, capture_output=True, text=True, timeout=180)
    assert r.returncode == 0, r.stderr[-2000:]
