"""The history of runs, scans of a growing folder and pages of an index."""

import datetime as dt

from pyspark.sql import functions as F

from loomwright.operators import history as hs
from loomwright.operators import vector_index as vi
from loomwright.sources import files as fl


def test_history(spark, tmp_path):
    store = hs.HistoryStore(spark, str(tmp_path / "runs"))
    day = lambda d: dt.datetime(2024, 1, d)
    schema = "run_id string, user_id string, source string, score double, tier string, detail string, at timestamp"
    rows = [("1", "ann", "csv", 80.0, "green", "{}", day(1)), ("2", "ann", "db", 50.0, "red", None, day(3)), ("3", "bo", "db", 10.0, "red", None, day(2)), ("", "bo", "db", 1.0, "red", None, day(2)), ("4", None, "db", 1.0, "red", None, day(2))]
    store.record(spark.createDataFrame(rows, schema))
    store.record(spark.createDataFrame([("1", "ann", "csv", 90.0, "green", "{}", day(4))], schema))
    assert [(r.run_id, r.score) for r in store.recent("ann", 5).collect()] == [("1", 90.0), ("2", 50.0)]
    store.delete(spark.createDataFrame([("2", "ann"), ("3", "ann"), ("9", "bo")], "run_id string, user_id string"))
    assert {(r.user_id, r.runs, r.mean_score) for r in store.users().collect()} == {("ann", 1, 90.0), ("bo", 1, 10.0)}
    assert store.recent("nobody", 3).collect() == [] and [r.run_id for r in store.recent("bo", 1).collect()] == ["3"]


def test_a_growing_folder_is_read_once(spark, tmp_path):
    folder, ledger = tmp_path / "in", str(tmp_path / "ledger")
    folder.mkdir()
    names = lambda df: sorted(r.path.rsplit("/", 1)[1] for r in df.collect())
    for n in ("a.txt", "b.txt", "c.csv"):
        (folder / n).write_text(n)
    first = fl.new_files(spark, str(folder), ledger, "*.txt")
    assert names(first) == ["a.txt", "b.txt"] == names(fl.new_files(spark, str(folder), ledger, "*.txt"))  # not remembered yet
    fl.remember(first, ledger)
    assert names(fl.new_files(spark, str(folder), ledger, "*.txt")) == []
    (folder / "d.txt").write_text("d")
    changed = (folder / "a.txt").stat().st_mtime + 60
    __import__("os").utime(folder / "a.txt", (changed, changed))
    second = fl.new_files(spark, str(folder), ledger)
    assert names(second) == ["a.txt", "c.csv", "d.txt"]
    fl.remember(second, ledger)
    assert names(fl.new_files(spark, str(folder), ledger)) == []


def test_pages_of_an_index(spark, tmp_path):
    points = spark.range(1, 26).select(F.col("id").alias("point_id"), F.array(F.cos("id"), F.sin("id")).alias("v"), (F.col("id") % 2).alias("odd"))
    index = vi.build_index(points, str(tmp_path / "index"), lists=4)
    seen, cursor = [], None
    while page := [r.point_id for r in vi.scrolled(index, spark, cursor, 7).collect()]:
        seen += page
        cursor = page[-1]
    assert seen == list(range(1, 26))
    assert [r.point_id for r in vi.scrolled(index, spark, 10, 3, "odd = 0").collect()] == [12, 14, 16]
