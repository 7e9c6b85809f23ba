"""Tables from a log's files and profiles merged from sketches."""

import pytest
from pyspark.sql import functions as F

from evalcube.operators import sketches as SK
from evalcube.plans.from_files import listing_key, tables_from_files
from evalcube.sources.fixtures import judged_records
from evalcube.sources.readers import RECORD_DDL

COLUMNS = [c.split()[0] for c in RECORD_DDL.split(", ")]


def test_new_files_are_another_state(spark, sf_dir, tmp_path):
    recs = judged_records(spark, sf_dir).select(*COLUMNS)
    log = str(tmp_path / "log.json")
    recs.filter("id < 200").write.json(log)
    key, first = listing_key(spark, log), tables_from_files(spark, log)
    again = tables_from_files(spark, log)
    assert listing_key(spark, log) == key
    assert again["scored"].inputFiles() == first["scored"].inputFiles()  # staged once
    n = first["scored"].count()
    recs.filter("id >= 200 and id < 300").write.mode("append").json(log)
    assert listing_key(spark, log) != key
    assert tables_from_files(spark, log)["scored"].count() > n
    assert first["scored"].count() == n


def test_unknown_suffix_ends_the_query(spark, tmp_path):
    (tmp_path / "log.txt").write_text("x")
    with pytest.raises(ValueError, match="unsupported response log format"):
        tables_from_files(spark, str(tmp_path / "log.txt"))


def test_sketches_merge(spark, tmp_path):
    path = str(tmp_path / "sketches")
    df = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise("b").alias("k"),
                                    F.pmod(F.xxhash64("id"), F.lit(1000)).cast("double").alias("v"), (F.col("id") % 500).alias("g"))
    odd = spark.createDataFrame([("none", None, None), ("none", float("nan"), 7), (None, 1.0, 1)], "k string, v double, g bigint")
    for batch, part in (("a", df.filter("g % 2 = 0")), ("b", df.filter("g % 2 = 1")), ("c", odd), ("b", df.filter("g % 2 = 1"))):
        SK.append_batch(part, path, batch, ["k"], "v", "g")
    prof = SK.merged_profile(spark, path, ["k"])
    got = {r["k"]: r for r in prof.collect()}
    assert got["hot"]["n_rows"] + got["b"]["n_rows"] == 20_000
    assert abs(got["hot"]["n_distinct"] - 500) <= 30
    assert (got["none"]["n_rows"], got["none"]["n_values"], got["none"]["p50"], got["none"]["mean"], got["none"]["n_distinct"]) == (2, 0, None, None, 1)
    assert (got[None]["p05"], got[None]["max"]) == (1.0, 1.0)
    for r in SK.rank_errors(df, prof, ["k"], "v").collect():
        assert max(r[n] for n in SK.PCT_NAMES) <= 0.02
