"""Where results go: text, JSON, CSV and Parquet, all written in parallel by the tasks that hold the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def json_lines(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def csv_lines(df: DataFrame) -> DataFrame:
    return df.select(F.to_csv(F.struct(*df.columns)).alias("value"))


def xml_rows(df: DataFrame, tag: str = "item") -> Column:
    return F.to_xml(F.struct(*df.columns), {"rowTag": tag})


def write_tracker_csv(rows: DataFrame, path: str) -> None:
    """The tracker table with its header and any extra columns; column order is kept."""
    rows.write.mode("overwrite").option("header", True).csv(path)


def write_report(lines: DataFrame, path: str) -> None:
    """Markdown lines in the order of the report.  A report is a few hundred lines, sorted by range, not collected."""
    lines.orderBy("section", "line_ord", "line").select(F.col("line").alias("value")).write.mode("overwrite").text(path)


def scan_payloads(df_reader, path: str, fmt: str = "binaryFile") -> DataFrame:
    """Payload files as rows; ``binaryFile`` for mails, ``text`` (whole files) for pages, ``json`` with bad lines kept."""
    if fmt == "text":
        return df_reader.option("wholetext", True).text(path)
    if fmt == "json":
        return df_reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    return df_reader.format(fmt).load(path)
