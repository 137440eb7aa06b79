"""Smoke test: the end-to-end walkthrough runs on the smallest tables."""
import os
import subprocess
import sys

from conftest import SF001

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_walkthrough_runs(tmp_path):
    out = tmp_path / "out"
    res = subprocess.run([sys.executable, os.path.join(ROOT, "scripts", "walkthrough.py"), SF001, str(out)],
                         capture_output=True, text=True, timeout=900)
    assert res.returncode == 0, res.stderr[-2000:]
    assert "baseline records" in res.stdout
    for sub in ("sections", "description", "generated", "splits", "packed", "results_baseline",
                "results_architecture"):
        assert (out / sub).exists(), sub
