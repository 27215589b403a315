"""CSV of long texts in files of bounded size."""

from pyspark.sql import functions as F

from memaudit.sources import files


def test_csv_of_texts_in_bounded_files(spark, tmp_path):
    rows = spark.range(200).select(F.col("id").alias("page_id"), F.concat(F.lit('a "quoted"\nline, '), F.repeat(F.lit("x"), 1000)).alias("html")).coalesce(1)
    path = str(tmp_path / "csv")
    files.write_csv(files.in_parts(rows, "html", 20_000), path, parts=True)
    sizes = [f.stat().st_size for f in (tmp_path / "csv").glob("part-*")]
    assert len(sizes) >= 10 and max(sizes) < 40_000
    assert sorted(map(tuple, files.scan_csv(spark, path, "page_id long, html string").collect())) == sorted(map(tuple, rows.collect()))


def test_no_rows_are_one_file(spark, tmp_path):
    none = spark.createDataFrame([], "page_id long, html string")
    files.write_csv(files.in_parts(none, "html"), str(tmp_path / "csv"), parts=True)
    assert files.scan_csv(spark, str(tmp_path / "csv"), "page_id long, html string").count() == 0
