from __future__ import annotations

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_intermediate_tables_without_any_setting(tmp_path, sf_dir):
    """No shared folder is configured: the command line uses one of its own and changes no setting."""
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": ROOT}
    command = [sys.executable, "-m", "pairloom", "seeded_shuffle", "--data", sf_dir, "--rows", "2", "--master", "local[2]"]
    done = subprocess.run(command, cwd=ROOT, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0 and "position" in done.stdout, done.stderr[-2000:]
