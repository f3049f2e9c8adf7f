import os
import subprocess
import sys
from pathlib import Path

PROGRAM = """
import sys
sys.path.insert(0, sys.argv[1])
from riverstone.session import build_session
spark = build_session(master="local[2]", spark_sql_shuffle_partitions=2, spark_ui_enabled="false")
sys.path.remove(sys.argv[1])
from pyspark.sql import functions as F
from riverstone.sources.streams import file_stream
from riverstone.streaming import coreset_stream
spark.range(300).select("id", F.array(F.col("id").cast("double")).alias("features")).write.parquet("in")
made = coreset_stream.stream_coresets(file_stream(spark, "in", "id long, features array<double>"), 20)
made.writeStream.outputMode("update").option("checkpointLocation", "state").trigger(availableNow=True).format("noop").start().awaitTermination()
print("mass", coreset_stream.stored_answers(spark, "state").agg(F.sum("weight")).first()[0])
"""


def test_streams_of_a_driver_in_another_folder(tmp_path):
    """Without PYTHONPATH and away from the package's folder, workers of the driver and of tasks find the package."""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    root = str(Path(__file__).resolve().parent.parent)
    done = subprocess.run([sys.executable, "-c", PROGRAM, root], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=180)
    assert "mass 300.0" in done.stdout, done.stderr[-2000:]
