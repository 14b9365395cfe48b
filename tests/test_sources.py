"""Sources and streams on files of the test's own."""

import shutil

from loomwright.sources import files
from loomwright.streaming import events as st


def test_delimited(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id|name|x\n1|"a|b"|NA\n2|n/a|2.5\n')
    got = files.typed(files.delimited(spark, str(tmp_path / "a.csv")))
    assert [f.dataType.typeName() for f in got.schema] == ["long", "string", "double"]
    assert [tuple(r) for r in got.collect()] == [(1, "a|b", None), (2, None, 2.5)]
    assert files.sniffed_separator("a;b\n1,5;2") == ";" and files.sniffed_separator("") == ","


def test_folder_and_json(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "x.jsonl").write_text('{"a": 1}\nnot json\n{"a": 2}\n')
    (tmp_path / "d" / "skip.tmp").write_text("x")
    assert sorted(r.a for r in files.json_lines(spark, str(tmp_path / "d" / "x.jsonl"), "a int").collect() if r.a) == [1, 2]
    found = files.folder(spark, str(tmp_path / "d"), exclude=[r"\.tmp$"]).collect()
    assert len(found) == 1 and found[0].length == 27 and len(found[0].checksum) == 64


def test_dictionary(spark):
    frame = spark.createDataFrame([("id", "key", "yes")], ["Column Name", "Meaning", "Odd One"])
    row = files.renamed(frame, {"meaning": "definition"}, ["column_name", "definition", "owner"]).first()
    assert (row.column_name, row.definition, row.owner, row.extensions) == ("id", "key", None, {"odd_one": "yes"})


def test_stream_counts_equal_batch(spark, tmp_path):
    shutil.copytree("/root/testdata/sf0.001", tmp_path / "in", ignore=lambda d, n: [x for x in n if x != "events.parquet"])
    path = str(tmp_path / "in")
    stream = st.window_counts(st.event_stream(spark, path), size="30 days")
    query = stream.writeStream.outputMode("complete").format("memory").queryName("counts").start()
    query.processAllAvailable()
    query.stop()
    batch = st.window_counts(spark.read.parquet(path).selectExpr("* EXCEPT (ts)", "CAST(ts AS TIMESTAMP) AS ts"), size="30 days")
    key = lambda rows: {(r.start, r.event_type, r.n) for r in rows}
    assert key(spark.table("counts").collect()) == key(batch.collect())
