"""Executors need no copy of the package: workers here find it on no path."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

REPO, SF = Path(__file__).resolve().parents[2], "/root/testdata/sf0.001"
SCRIPT = f"""
import sys
sys.path.insert(0, {str(REPO)!r})
from pyspark.sql import SparkSession
import __spark_entry__ as contract
spark = (SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false").getOrCreate())
def there(_):
    import importlib.util
    return importlib.util.find_spec("galeframe") is not None
assert not spark.sparkContext.parallelize([0], 1).map(there).first()
for name, query in contract.queries().items():
    if name.startswith("op") or name == "M01_band_ensemble":
        print(name, len(query(spark, {SF!r}).collect()), flush=True)
"""


@pytest.mark.skipif(not Path(SF).exists(), reason="needs the driver's tables")
def test_operators_run_where_workers_lack_the_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert done.returncode == 0, done.stdout + "".join(x for x in done.stderr.splitlines(True) if "Error" in x)[:3000]
    assert len([line for line in done.stdout.splitlines() if line.startswith("op")]) == 13
