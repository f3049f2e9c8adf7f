import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from riverstone import __main__ as program
from riverstone.sources import binary, generate


def test_sizes():
    assert program.size_of(None) == 10_000 and program.size_of("25") == 25
    for bad in ("x", "-3", "0"):
        with pytest.warns(UserWarning):
            assert program.size_of(bad) == 10_000


def test_files_to_files(spark, tmp_path, capsys):
    binary.register(spark)
    points = generate.blobs(spark, 3000, 2, 3, separation=100).coalesce(1)
    points.select("id", "features").write.format("points_bin").mode("overwrite").save(f"{tmp_path}/in")
    points.select("id", "label").write.format("labels_bin").mode("overwrite").save(f"{tmp_path}/true")
    with warnings.catch_warnings():
        warnings.simplefilter("error", UserWarning)
        program.main([f"{tmp_path}/in", f"{tmp_path}/out", "60", "--labels", f"{tmp_path}/true"])
    made = spark.read.format("coreset_bin").load(f"{tmp_path}/out/coreset")
    assert made.count() == 60 and made.agg(F.sum("weight")).first()[0] == 3000
    assert spark.read.format("labels_bin").load(f"{tmp_path}/out/labels").count() == 3000
    assert sum(1 for _ in (tmp_path / "out" / "coreset_60").glob("*.csv")) == 1
    said = capsys.readouterr().out
    assert said.startswith("accuracy") and 0.3 < float(said.split()[1]) <= 1
    assert np.array(sorted(r[0] for r in spark.read.csv(f"{tmp_path}/out/timings").collect())).tolist() == ["coreset", "kmeans", "labels", "write"]
