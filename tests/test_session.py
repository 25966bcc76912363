import os
import subprocess
import sys
import time
from types import SimpleNamespace

import pytest

from passagekit.session import shared_dir

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
JOB = """
from passagekit.session import get_spark, scratch_path
spark = get_spark("local[1]", shuffle_partitions=1, extra={"spark.checkpoint.dir": "%s"})
path = scratch_path(spark, "t")
spark.range(5).write.parquet(path)
assert spark.read.parquet(path).count() == 5
print(path)
"""


def test_cluster_without_shared_folder_is_an_error():
    context = SimpleNamespace(master="spark://host:1", getCheckpointDir=lambda: None)
    spark = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: default), sparkContext=context)
    with pytest.raises(ValueError):
        shared_dir(spark)


def test_scratch_goes_with_its_application(tmp_path):
    other = tmp_path / "passagekit" / "another-application"
    other.mkdir(parents=True)
    run = subprocess.run([sys.executable, "-c", JOB % tmp_path], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert run.returncode == 0, run.stderr
    base = os.path.dirname(run.stdout.split()[-1])
    assert os.path.dirname(base) == str(other.parent)
    for _ in range(100):                                 # the JVM ends a little after the process
        if not os.path.exists(base):
            break
        time.sleep(0.2)
    assert not os.path.exists(base) and other.exists()
