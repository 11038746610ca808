"""Cohort and external scans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, types as T

from riskweave.functions import fixed
from riskweave.operators import cleaning


def text_schema(columns: list[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def read_site(spark: SparkSession, path: str, site: str, header: bool = True,
              trusted: str = fixed.TRUSTED_SITE) -> DataFrame:
    """One site's file, cleaned and tagged.

    Every column is read as text with an explicit schema (no inference pass over
    the data), then cast tolerantly.
    """
    raw = (
        spark.read.schema(text_schema(fixed.COHORT_COLUMNS))
        .option("header", str(header).lower())
        .option("nullValue", fixed.MISSING_TOKEN)
        .option("enforceSchema", "false" if header else "true")
        .csv(path)
    )
    return cleaning.clean_site(raw, site, trusted=trusted)


def read_sites(spark: SparkSession, paths: dict[str, str], header: bool = True,
               trusted: str = fixed.TRUSTED_SITE) -> DataFrame:
    """All sites as one cohort; the scans stay separate until the union."""
    scans = [read_site(spark, path, site, header, trusted) for site, path in paths.items()]
    return reduce(DataFrame.unionByName, scans)


def read_trusted_site(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    return read_site(spark, path, fixed.TRUSTED_SITE, header)


def read_external(spark: SparkSession, path: str) -> DataFrame:
    """The external cohort, 16 columns as text; harmonising casts them."""
    return (
        spark.read.schema(text_schema(fixed.EXTERNAL_COLUMNS))
        .option("header", "true").option("enforceSchema", "false")
        .csv(path)
    )
