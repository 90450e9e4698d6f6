"""Exports of many files are, end to end, the documents of one row each."""

import zipfile

from pyspark.sql import functions as F

from threadline.operators import render as R
from threadline.sources import snapshots as SRC

def comments(spark, n, runs=3):
    rows = spark.range(n).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("r"), F.col("id") % runs)).alias("run_id"), F.col("id").alias("seq"), F.col("id").alias("likes"), (F.col("id") % 2).alias("replyCount"))
    text = F.when(F.col("seq") % 7 == 0, "").when(F.col("seq") % 11 == 0, F.lit(None)).otherwise(F.concat(F.lit('é "quoted"\nline\t'), F.col("seq")))
    arrival = F.struct(F.lit(0).alias("pass"), F.col("seq").alias("snapshot_seq"), F.lit(0).cast("long").alias("thread_ord"))
    return rows.select("run_id", arrival.alias("arrival_seq"), text.alias("text"), "likes", "replyCount")


def test_files_end_to_end_are_the_documents(spark, tmp_path):
    rows = comments(spark, 3000)
    titles = rows.select("run_id").distinct().withColumn("title", F.concat(F.lit("Title "), "run_id"))
    for form, whole in (("txt", R.fmt_txt), ("json", R.fmt_json)):
        path = str(tmp_path / form)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        try:
            SRC.write_export_lines(R.export_lines(rows, form), titles, form, path)
        finally:
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        found = {}
        for r in SRC.read_exports(spark, path).orderBy("name", "part").collect():
            found.setdefault(r.name, []).append(r.value)
        want = {f"Title-{r.run_id}-comments.{form}": r.body for r in whole(rows).collect()}
        assert {k: "".join(v) for k, v in found.items()} == {k: v + "\n" for k, v in want.items()}
        assert len(found[f"Title-hot-comments.{form}"]) > 1  # the large run was written by several tasks


def test_lines_of_no_and_of_single_comments(spark):
    rows = comments(spark, 1)
    assert R.export_lines(rows.limit(0), "json").collect() == []
    assert [r.value for r in R.export_lines(rows, "json").collect()] == [r.body for r in R.fmt_json(rows).collect()]


def test_many_names_make_few_files(spark, tmp_path):
    """The number of files follows the size of the exports, not the number of names; left-over packages are not read."""
    rows = spark.range(4000).select(F.concat(F.lit("r"), F.col("id") % 2000).alias("run_id"), F.col("id").alias("arrival_seq"), F.concat(F.lit("é\n"), "id").alias("value"))
    titles = rows.select("run_id").distinct().withColumn("title", F.concat(F.lit("Ünï "), "run_id"))
    path = tmp_path / "exports"
    SRC.write_export_lines(rows, titles, "txt", str(path), most_names=900)
    files = [p for p in path.rglob("*") if p.is_file() and p.suffix != ".crc"]
    assert len(files) < 100
    packages = [p for p in files if p.suffix == ".zip"]
    assert len(packages) >= 3 and sum(len(zipfile.ZipFile(p).namelist()) for p in packages) == 2000
    (packages[0].parent / "exports-00000-00000-failed.zip").write_bytes(packages[0].read_bytes())  # of a task that was run again
    got = {r.name: r.value for r in SRC.read_exports(spark, str(path)).collect()}
    assert got == {f"Ünï-r{i}-comments.txt": f"é\n{i}\né\n{i + 2000}\n" for i in range(2000)}
    SRC.write_export_lines(rows.limit(0), titles, "txt", str(tmp_path / "none"))
    assert SRC.read_exports(spark, str(tmp_path / "none")).collect() == []


def test_a_long_document_lies_in_several_packages(spark, tmp_path):
    rows = spark.range(500).select(F.lit("r").alias("run_id"), F.col("id").alias("arrival_seq"), F.concat(F.col("id"), F.lit("x" * 100)).alias("value"))
    titles = spark.createDataFrame([("r", "T")], "run_id string, title string")
    SRC.write_export_lines(rows, titles, "txt", str(tmp_path / "e"), most=10_000)
    parts = SRC.read_exports(spark, str(tmp_path / "e")).orderBy("part").collect()
    assert len(parts) >= 5 and "".join(p.value for p in parts) == "".join(f"{i}{'x' * 100}\n" for i in range(500))
