import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
from inkfold.ship import ship
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.driver.host", "127.0.0.1").getOrCreate()
ship(spark)
ship(spark)
def named(batches):
    import pyarrow as pa

    from inkfold.functions.html import normalized

    for batch in batches:
        yield pa.RecordBatch.from_pydict({{"t": [normalized(x) for x in batch.column("t").to_pylist()]}})
df = spark.createDataFrame([(" a  b ",)], "t string").mapInArrow(named, "t string")
print("GOT", df.first().t)
"""


def test_workers_elsewhere_get_the_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"SPARK_LOCAL_IP": "127.0.0.1"}
    run = subprocess.run([sys.executable, "-c", SCRIPT.format(repo=REPO)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    assert "GOT a b" in run.stdout, run.stderr[-2000:]
