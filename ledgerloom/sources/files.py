"""Scans of landed CSV files into RAW records (without seq)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ledgerloom.functions import labels
from ledgerloom.functions.text import blank_to_null, digits_to_int, strip
from ledgerloom.schemas import CONFIDENCE, DEFAULT_CONFIDENCE, DEFAULT_KIND, RAW
from ledgerloom.sources import lines
from ledgerloom.sources.mapping import mapped, match_columns
from ledgerloom.sources.registry import Portal, hints_of

Paths = str | Sequence[str]


def _listed(paths: Paths) -> list[str]:
    return [paths] if isinstance(paths, str) else list(paths)


def raw_records(df: DataFrame, **columns: Column) -> DataFrame:
    """RAW columns (without seq) from the given expressions; the rest is NULL."""
    defaults = {"source_kind": F.lit(DEFAULT_KIND), "confidence": F.lit(DEFAULT_CONFIDENCE)}
    return df.select(*[
        columns.get(f.name, defaults.get(f.name, F.lit(None))).cast(f.dataType).alias(f.name)
        for f in RAW.fields if f.name != "seq"])


def read_csv(spark: SparkSession, paths: Paths, multi_line: bool = False) -> DataFrame:
    """Header CSV, all text, byte-order mark removed.

    Files are split over tasks. A caller who declares that a source quotes line
    breaks sets ``multi_line``, which reads each file in one task, or reads it with
    ``lines.read_records``, which splits it and tells what is malformed.
    """
    df = (
        spark.read.option("header", True).option("multiLine", multi_line)
        .option("escape", '"').option("encoding", "UTF-8").option("mode", "PERMISSIVE")
        .csv(_listed(paths))
    )
    plain = [name.lstrip("﻿").strip('"') if i == 0 else name for i, name in enumerate(df.columns)]
    return df if plain == df.columns else df.withColumnsRenamed(dict(zip(df.columns, plain)))


def _value(df: DataFrame, column: str) -> Column:
    return F.coalesce(F.col(f"`{column}`"), F.lit("")) if column in df.columns else F.lit("")


def federal_registry(
    spark: SparkSession,
    paths: Paths,
    inactive_paths: Paths = (),
    province: str | None = None,
    source_name: str = "corporations_canada_federal",
    multi_line: bool = False,
) -> DataFrame:
    """The federal corporation files; ``inactive_paths`` adds the dissolved ones."""
    df = read_csv(spark, _listed(paths) + _listed(inactive_paths), multi_line)
    return federal_records(df.withColumn(lines.FILE, F.col("_metadata.file_path")), province, source_name)


def federal_registry_checked(
    spark: SparkSession,
    paths: Paths,
    inactive_paths: Paths = (),
    province: str | None = None,
    source_name: str = "corporations_canada_federal",
    strict: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """The same files with quoted line breaks, read in splits: (records, rows of the reject table)."""
    df, malformed = lines.read_records(spark, _listed(paths) + _listed(inactive_paths), strict=strict)
    return federal_records(df, province, source_name), lines.as_rejects(malformed, source_name)


def federal_records(df: DataFrame, province: str | None, source_name: str) -> DataFrame:
    """Records of federal corporation rows, which name their file in ``landed_file``."""
    def text(column: str) -> Column:
        return strip(_value(df, column))

    name = strip(F.coalesce(
        blank_to_null(_value(df, "Corporate name - form 1")),
        blank_to_null(_value(df, "Corporate name - form 2")), F.lit("")))
    kept = name != ""
    if province:
        here = text("Province/territory")
        kept = kept & ((here == "") | (F.upper(here) == province.upper()))
    street, unit = text("Street"), text("Street 2")
    return raw_records(
        df.where(kept),
        legal_name=name,
        province=text("Province/territory"),
        city=text("City/town"),
        address_line1=F.when(unit != "", strip(F.concat(street, F.lit(" "), unit))).otherwise(street),
        postal_code=text("Postal code"),
        corporation_number=blank_to_null(text("Corporation number")),
        business_number=blank_to_null(text("Business number (BN)")),
        incorporation_date=blank_to_null(text("Anniversary date")),
        business_status=labels.registry_status(_value(df, "Status")),
        employee_count_min=digits_to_int(_value(df, "Minimum number of directors")),
        employee_count_max=digits_to_int(_value(df, "Maximum number of directors")),
        source_name=F.lit(source_name),
        source_kind=F.lit("federal_registry"),
        source_url=F.col(lines.FILE),
        confidence=F.lit("0.90").cast(CONFIDENCE),
    )


def portal_records(df: DataFrame, source: Portal, headers: Sequence[str] | None = None,
                   source_url: Column | None = None) -> DataFrame:
    """Header-mapped rows of one portal resource."""
    names = match_columns(headers or df.columns, hints_of(source))
    values = {field: mapped(column) for field, column in names.items()}
    if source.default_city:
        values["city"] = F.coalesce(blank_to_null(values["city"]), F.lit(source.default_city))
    if source.family == "opendatasoft":
        values["business_status"] = labels.portal_status(values["business_status"])
    return raw_records(
        df.where(source.where) if source.where else df,
        **values,
        province=F.lit(source.province),
        source_name=F.lit(source.name),
        source_kind=F.lit(source.kind),
        source_url=source_url if source_url is not None else F.lit(source.name),
        confidence=F.lit(source.confidence).cast(CONFIDENCE),
    )


def portal_scan(spark: SparkSession, source: Portal, resources: Sequence[Paths], multi_line: bool = False) -> DataFrame:
    """All resources of a portal dataset.

    CKAN resources may differ in their headers, so each is mapped on its own. A
    paged export is one resource whose pages share the first page's headers.
    """
    frames = []
    for resource in resources:
        df = read_csv(spark, resource, multi_line)
        headers = df.columns
        frames.append(portal_records(
            df.withColumn(lines.FILE, F.col("_metadata.file_path")), source, headers, F.col(lines.FILE)))
    return reduce(DataFrame.unionByName, frames)


def portal_scan_checked(
    spark: SparkSession, source: Portal, resources: Sequence[Paths], strict: bool = False
) -> tuple[DataFrame, DataFrame]:
    """The same resources with quoted line breaks, read in splits: (records, rows of the reject table)."""
    frames, rejects = [], []
    for resource in resources:
        df, malformed = lines.read_records(spark, resource, strict=strict)
        headers = [name for name in df.columns if name != lines.FILE]
        frames.append(portal_records(df, source, headers, F.col(lines.FILE)))
        rejects.append(lines.as_rejects(malformed, source.name))
    return reduce(DataFrame.unionByName, frames), reduce(DataFrame.unionByName, rejects)


def csv_resources(manifests: DataFrame) -> DataFrame:
    """(dataset, url) of the resources to read, from manifest JSON text.

    The CSV resources of a dataset; if it has none, every resource with a URL.
    """
    schema = "result struct<resources: array<struct<format: string, url: string>>>"
    parsed = manifests.select("dataset", F.from_json("manifest", schema)["result"]["resources"].alias("resources"))
    listed = F.filter("resources", lambda r: F.lower(r["format"]) == "csv")
    other = F.filter("resources", lambda r: F.coalesce(r["url"] != "", F.lit(False)))
    picked = F.when(F.size(listed) > 0, listed).otherwise(other)
    return parsed.select("dataset", F.explode(picked).alias("r")).select("dataset", F.col("r")["url"].alias("url"))
