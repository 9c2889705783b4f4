"""Executors need no copy of the package: helpers and models travel with the tasks."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = f"""
import sys
sys.path.insert(0, {ROOT!r})
from sparkvec.session import get_spark
from sparkvec.catalog import QUERIES
spark = get_spark("shipping", cores="2", shuffle_partitions=2)
for name in ("C1_topk_encode", "C7_forward", "C9_ae_encode", "C13_pca_project", "S6_raw_dense_cache", "R6_dense_search",
             "E1_E7_embed"):
    assert QUERIES[name](spark, {os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")!r}).count() > 0, name
print("done")
"""


def test_queries_run_from_another_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SCRIPT], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert out.returncode == 0 and "done" in out.stdout, out.stderr[-3000:]
