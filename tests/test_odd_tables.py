"""Queries against their SQL on documents such as large tables hold some of: empty, null, blank and oddly spaced ones."""

import math

import duckdb
from pyspark.sql import functions as F

import __spark_entry__ as entry
from loomwright.functions import scores as sc

ODD = ["", None, " ", "\u00a0\u3000wide\u2003", "\tplain\n", "plain words", "   padded on both sides   "]


def both(spark, tmp_path, name, texts, sizes=None):
    """The rows of a query and of its SQL over documents of these texts."""
    rows = [(i, t, "en", "crawl", sizes[i] if sizes else len(t or "")) for i, t in enumerate(texts)]
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(2).write.parquet(path)
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
    want = connection.execute(entry.oracle_sql()[name]).fetchall()
    plain = lambda v: "nan" if isinstance(v, float) and math.isnan(v) else v
    return [sorted(tuple(map(plain, r)) for r in found) for found in (entry.queries()[name](spark, str(tmp_path)).collect(), want)]


def test_coverage_of_items_without_size(spark, tmp_path):
    got, want = both(spark, tmp_path, "V03_chunk_coverage", ODD * 2, [len(t or "") for t in ODD] + [0, 5, None, 0, 7, 1000, -3])
    assert got == want == [(5, 14)]


def test_noise_of_odd_texts(spark, tmp_path):
    """Shares that lie between two hundredths, empty texts, and white space that only some engines take for such."""
    texts = [*ODD, *ODD, "Page 1 of 2\n  \n\x0bconfidential", "\u00a0index\n index \r\n\x85appendix", "TABLE OF CONTENT\u017f\n \n\nCopyright\n\u2028proprietary", "Index\n   \nconfidential", "page \u0663 of 4", "\x1cpage 3 of 4\n"]
    got, want = both(spark, tmp_path, "C19_noise", [t for t in texts for _ in range(4)])
    assert got == want and any(r[1] == "nan" for r in want)
    sizes = (91, 107, 109, 111, 113)  # of 4000 characters: shares between two hundredths
    frame = spark.createDataFrame([("\n" * (n - 12) + "confidential" + "x" * (4000 - n),) for n in sizes], "t string")
    half = [duckdb.sql(f"SELECT round_even(100.0 * {n} / 4000, 2)").fetchall()[0][0] for n in sizes]
    assert [r.p for r in frame.select(sc.matched_percent(F.col("t")).alias("p")).collect()] == half
