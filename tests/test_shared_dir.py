"""Without ``spark.checkpoint.dir`` a local session writes below a folder of its own."""

import os
import subprocess
import sys

SCRIPT = """
from lexispark.session import local_session, shared_dir
spark = local_session("2", 2, "1g")
assert not spark.conf.get("spark.checkpoint.dir", None)
from lexispark.plans.tables import scratch
path = scratch(spark, "x")
assert path.startswith("file:///") and shared_dir(spark) == shared_dir(spark)
spark.range(3).write.parquet(path)
print("rows", spark.read.parquet(path).count())
"""


def test_scratch_without_a_checkpoint_folder(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": root}
    done = subprocess.run([sys.executable, "-c", SCRIPT], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=180)
    assert "rows 3" in done.stdout, done.stderr[-2000:]
