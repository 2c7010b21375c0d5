"""Files in, files out."""

import zipfile

import numpy as np

from cinderspark.params import Box
from cinderspark.plans import files
from cinderspark.schemas import DETECTIONS
from cinderspark.sources import granules, sinks, tables

HEADER = ",".join(f.name for f in DETECTIONS.fields)
LINE = "30.1,79.2,310.5,1.0,1.1,{day},130,Terra,MODIS,80,61.03,290.1,12.5,D,0"


def test_archives(spark, tmp_path):
    for year in (2020, 2021):
        with zipfile.ZipFile(tmp_path / f"modis_{year}_all_countries.zip", "w") as z:
            lines = [LINE.format(day=f"{year}-03-0{i}") for i in range(1, 4)] + [LINE.format(day=f"{year}-04-01").replace("79.2", "99.0")]
            z.writestr(f"modis/{year}/modis_{year}_India.csv", "\n".join([HEADER, *lines]))
            z.writestr(f"modis/{year}/modis_{year}_Nepal.csv", "\n".join([HEADER, *lines]))
    feed = tables.read_detection_archives(spark, str(tmp_path))
    assert feed.schema.simpleString() == DETECTIONS.simpleString() and feed.count() == 8
    out = tables.consolidate([feed], Box(28.7, 31.5, 77.5, 81.0)).collect()
    assert len(out) == 6 and [r["acq_date"] for r in out] == sorted(r["acq_date"] for r in out)


def test_empty_feed_keeps_its_header(spark, tmp_path):
    path = str(tmp_path / "empty")
    tables.write_detections(spark.createDataFrame([], DETECTIONS), path)
    text = "".join(p.read_text() for p in (tmp_path / "empty").glob("part-*"))
    assert text.strip() == HEADER
    assert tables.read_detections_csv(spark, path).count() == 0


def test_elevation_tiles(spark, tmp_path):
    first, second = np.arange(100, dtype=">i2").reshape(10, 10), np.full((10, 10), -7, dtype=">i2")
    (tmp_path / "N30E079.hgt").write_bytes(first.tobytes())
    for name in ("N30E079", "S05W010"):
        with zipfile.ZipFile(tmp_path / f"{name}.hgt.zip", "w") as z:
            z.writestr(f"{name}.hgt", second.tobytes())
    cells = tables.read_elevation_tiles(spark, str(tmp_path)).toPandas()
    assert len(cells) == 200
    plain = cells[cells.file == "N30E079"].sort_values(["row", "col"])
    assert plain.elevation.tolist() == list(range(100)) and set(plain.south) == {30} and set(plain.west) == {79}
    zipped = cells[cells.file == "S05W010"]
    assert set(zipped.elevation) == {-7.0} and set(zipped.south) == {-5} and set(zipped.west) == {-10}


def test_file_listing(spark, tmp_path):
    (tmp_path / "2020").mkdir()
    (tmp_path / "2020" / "chirps-v2.0.2020.060.tif").write_bytes(b"x" * 2048)
    (tmp_path / "2020" / "MYD09GA.AA2020061.h24v05.061.B03.tif").write_bytes(b"x")
    (tmp_path / "2020" / "notes.txt").write_bytes(b"x")
    rows = {r["dataset"]: r for r in granules.catalog(granules.list_files(spark, str(tmp_path))).collect()}
    assert str(rows["rain"]["day"]) == "2020-02-29" and rows["rain"]["size_mb"] == 2048 / 1048576
    assert (rows["reflectance"]["tile"], rows["reflectance"]["band"], str(rows["reflectance"]["day"])) == ("h24v05", "B03", "2020-03-01")


def test_rename_skips_taken_names(spark):
    names = ["MYD09GA.A2020001.h24v05.061.B01.tif", "MYD09GA.A2020002.h24v05.061.B01.tif", "MYD09GA.AA2020002.h24v05.061.B01.tif"]
    files = spark.createDataFrame([(n, 1) for n in names], "name string, size long")
    assert [tuple(r) for r in granules.normalise_names(files).collect()] == [(names[0], "MYD09GA.AA2020001.h24v05.061.B01.tif")]


def test_stage_is_reused_unless_forced(spark, tmp_path):
    path, built = str(tmp_path / "stage"), []

    def build():
        built.append(1)
        return spark.range(3)

    for force in (False, False, True):
        assert sinks.stage(spark, path, build, force).count() == 3
    assert len(built) == 2


def test_year_pruning(spark, tmp_path):
    from pyspark.sql import functions as F

    path = str(tmp_path / "cells")
    cells = spark.range(100).select(
        F.lit("rain").alias("product"), F.lit("h24v05").alias("tile"), F.col("id").cast("int").alias("row"), F.lit(0).alias("col"),
        F.date_add(F.lit("2019-12-01").cast("date"), F.col("id").cast("int")).alias("day"), F.lit("mm").alias("band"), F.col("id").cast("double").alias("raw"),
    )
    tables.write_cells(cells, path)
    part = tables.read_cells(spark, path, "rain", "2020-01-01", "2020-01-31")
    assert part.count() == 31
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "year" in plan.split("PartitionFilters")[1].split("]")[0]


def test_elevation_tiles_of_large_keys_and_gaps(spark, tmp_path):
    """Four digits of longitude, tiles that lack parts, and a key that comes twice."""
    keys = [3, 99, 120_000, 120_057, 654_321, 654_321]
    spark.createDataFrame([(k, 900.5 + k % 10) for k in keys], "p_partkey long, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    got = sorted(tuple(r) for r in files.s10(spark, str(tmp_path)).collect())
    assert got == sorted(
        (f"N{k // 100 % 90:02d}E{k // 100:03d}", k // 100 % 90, k // 100, k % 100 // 10, k % 10, -32768.0 if k % 17 == 0 else 900.0 + k % 10) for k in keys
    )


def test_listing_is_read_from_what_was_written(spark):
    """Conditions on file names must not reach the rows of the tables."""
    assert files.file_listing(spark, "/root/testdata/sf0.001").inputFiles() == []
