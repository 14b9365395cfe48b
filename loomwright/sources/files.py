"""File sources: delimited text with a sniffed separator, folders, JSON lines, dictionaries, catalogued tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SEPARATORS = ",;\t|"
#: Tokens that a delimited file means as null.
NULL_TOKENS = ["", "NA", "N/A", "n/a", "null", "NULL", "None", "nan", "NaN", "#N/A", "<NA>"]


def sniffed_separator(head: str) -> str:
    """The separator that splits most lines into equally many fields, the most frequent of the header among equals."""
    lines = [line for line in head.splitlines() if line.strip()][:20]
    if not lines:
        return ","
    score = lambda s: (lines[0].count(s) > 0, sum(line.count(s) == lines[0].count(s) for line in lines), lines[0].count(s))
    return max(SEPARATORS, key=score)


def delimited(spark: SparkSession, path: str, separator: str | None = None, rows: int | None = None) -> DataFrame:
    """A delimited file with a header; null tokens become null before types are inferred from what is left."""
    if separator is None:
        head = "\n".join(r[0] for r in spark.read.text(path).limit(20).collect())
        separator = sniffed_separator(head.lstrip("﻿"))
    raw = spark.read.csv(path, sep=separator, header=True, multiLine=True, escape='"')
    clean = raw.select(*[F.when(~F.col(f"`{c}`").isin(NULL_TOKENS), F.col(f"`{c}`")).alias(c.lstrip("﻿").strip()) for c in raw.columns])
    return clean if rows is None else clean.limit(rows)


def typed(df: DataFrame) -> DataFrame:
    """String columns cast to long, double or boolean where every value parses: one aggregation decides for all columns."""
    kinds = ("bigint", "double", "boolean")
    text = [f.name for f in df.schema if f.dataType.typeName() == "string"]
    if not text:
        return df
    counts = [F.count(f"`{c}`").alias(f"n{i}") for i, c in enumerate(text)]
    parsed = [F.count(F.expr(f"try_cast(`{c}` AS {k})")).alias(f"{k}{i}") for i, c in enumerate(text) for k in kinds]
    found = df.agg(*counts, *parsed).first()
    kind = {c: next((k for k in kinds if found[f"n{i}"] and found[f"{k}{i}"] == found[f"n{i}"]), "string") for i, c in enumerate(text)}
    return df.withColumns({c: F.col(f"`{c}`").cast(kind[c]) for c in text})


def folder(spark: SparkSession, path: str, include: str | None = None, exclude: list[str] | None = None, max_bytes: int = 100 << 20) -> DataFrame:
    """(path, length, modificationTime, checksum) of the files below a folder; contents are hashed where they are read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = (reader.option("pathGlobFilter", include) if include else reader).load(path).where(F.col("length") <= max_bytes)
    for pattern in exclude or []:
        files = files.where(~F.col("path").rlike(pattern))
    return files.select("path", "length", "modificationTime", F.sha2("content", 256).alias("checksum"))


def new_files(spark: SparkSession, path: str, ledger: str, include: str | None = None) -> DataFrame:
    """(path, length, modificationTime) of files below a folder that no scan with this ledger has told before; lazy.

    A file counts again when it was modified. Contents are not read. Call remember() with what was taken, after it was
    handled: a scan that fails before is repeated, and one after reads only what is new.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = (reader.option("pathGlobFilter", include) if include else reader).load(path).select("path", "length", "modificationTime")
    return files.join(told(spark, ledger), ["path", "modificationTime"], "left_anti").select("path", "length", "modificationTime")


def told(spark: SparkSession, ledger: str) -> DataFrame:
    """(path, modificationTime) of all files that were remembered; none for a ledger that is not there yet."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema("path string, modificationTime timestamp").parquet(ledger)
    except AnalysisException as fault:
        if fault.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "path string, modificationTime timestamp")


def remember(files: DataFrame, ledger: str) -> None:
    """Adds files to the ledger, by appending."""
    files.select("path", "modificationTime").write.mode("append").parquet(ledger)


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of JSON lines; lines that do not parse are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def renamed(df: DataFrame, aliases: dict[str, str], known: list[str]) -> DataFrame:
    """A data dictionary with its headers normalised and mapped; unknown columns go into the map `extensions`."""
    plain = {c: "_".join(c.strip().lower().split()) for c in df.columns}
    target = {c: aliases.get(p, p) for c, p in plain.items()}
    fixed = [F.col(f"`{c}`").alias(t) for c, t in target.items() if t in known]
    rest = [x for c, t in target.items() if t not in known for x in (F.lit(t), F.col(f"`{c}`").cast("string"))]
    extensions: Column = F.map_filter(F.create_map(*rest), lambda _, v: v.isNotNull()) if rest else F.create_map().cast("map<string,string>")
    return df.select(*fixed, *[F.lit(None).cast("string").alias(k) for k in known if k not in target.values()], extensions.alias("extensions"))


def point_id(key: Column) -> Column:
    """The id of a vector point: 15 hex digits of an MD5 as a number."""
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")


def write_json_lines(df: DataFrame, path: str) -> None:
    """A JSON object a row, in UTF-8, nulls included; the folder must be new."""
    df.write.option("ignoreNullFields", "false").json(path)


def metrics(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The objects of JSON arrays, one array a file."""
    return spark.read.schema(schema).option("multiLine", "true").json(path)


def archived(df: DataFrame, when: str, before: str, path: str) -> DataFrame:
    """Writes the rows dated before a day to path, in folders by month, and returns the rest; a row without a date stays.

    The archive is written once, by one pass over df; what it holds of a month is read without the others.
    """
    old = F.coalesce(F.col(when) < F.lit(before).cast("date"), F.lit(False))
    df.where(old).withColumn("month", F.date_format(when, "yyyy-MM")).write.partitionBy("month").parquet(path)
    return df.where(~old)
