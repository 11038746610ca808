"""Report writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from riskweave.functions import fixed


def write_csv(df: DataFrame, path: str, single_file: bool = False) -> None:
    """A report as CSV with header; small reports may go into one file."""
    (df.coalesce(1) if single_file else df).write.mode("overwrite").option("header", "true").csv(path)


def what_if_text(found: DataFrame, row_id: str = "row_id") -> DataFrame:
    """One text value per row: heading, statement, rule."""
    return found.select(what_if_value(row_id).alias("value"))


def what_if_value(row_id: str) -> Column:
    return F.concat_ws(
        "\n", F.format_string(fixed.WHAT_IF_ROW_HEAD, F.col(row_id).cast("string")), F.col("statement"),
        F.lit(fixed.WHAT_IF_ROW_RULE), F.lit(""),
    )


def write_what_if(found: DataFrame, path: str, row_id: str = "row_id") -> None:
    """Statements as text, the disclaimer first.

    The header is one more row that sorts first, then rows by ``row_id``, numbers as
    numbers; a few statements (the usual
    case) end in one file, many stay split over ordered files.
    """
    spark = found.sparkSession
    header = spark.range(1).select(
        F.lit(0).alias("__o"), F.lit(None).cast(found.schema[row_id].dataType).alias("__k"),
        F.lit(fixed.WHAT_IF_DISCLAIMER + "\n\n" + fixed.WHAT_IF_RULE + "\n").alias("value"),
    )
    body = found.select(F.lit(1).alias("__o"), F.col(row_id).alias("__k"), what_if_value(row_id).alias("value"))
    header.unionByName(body).orderBy("__o", "__k").select("value").write.mode("overwrite").text(path)
