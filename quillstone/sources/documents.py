"""Reading and writing documents as text columns, through Spark's own readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions.jsontext import json_parse, json_print
from quillstone.functions.xmltext import xml_parse, xml_print


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """One document a line: text."""
    return spark.read.text(path).select(F.col("value").alias("text"))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """One document a file: path, text."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_json(spark: SparkSession, path: str, whole_files: bool = False) -> DataFrame:
    """Documents with their strict parse: text, ok, canonical, position, message."""
    df = read_files(spark, path) if whole_files else read_lines(spark, path)
    return df.withColumn("p", json_parse(F.col("text"))).select(*df.columns, "p.*")


def read_xml(spark: SparkSession, path: str, whole_files: bool = True) -> DataFrame:
    """Documents with their strict parse: path, text, ok, tree, printed, position, message."""
    df = read_files(spark, path) if whole_files else read_lines(spark, path)
    return df.withColumn("p", xml_parse(F.col("text"))).select(*df.columns, "p.*")


def write_lines(df: DataFrame, column: str, path: str) -> None:
    df.select(F.col(column).cast("string").alias("value")).write.text(path)


def log_json(df: DataFrame, column: str, indent: int = 4, rows: int = 20) -> None:
    """Prints some documents, indented."""
    for r in df.select(json_print(F.col(column), indent)).limit(rows).collect():
        print(r[0])


def log_xml(df: DataFrame, column: str, indent: int = 4, rows: int = 20) -> None:
    for r in df.select(xml_print(F.col(column), indent)).limit(rows).collect():
        print(r[0])
