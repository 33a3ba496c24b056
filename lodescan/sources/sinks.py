"""Findings written for readers outside: a JSON document per unit, clean ones included, and the values as lines of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodescan.engine.tiers import rank_name
from lodescan.operators.findings import sheet_of


def report_rows(units: DataFrame, clubs: DataFrame, errors: DataFrame | None = None, *, scan_time: str | None = None, seconds: float | None = None) -> DataFrame:
    """Per unit: unit_id, object, sheet, findings (name, type, confidence, total_count, n_values), scan_time, time_taken and error.

    A unit's findings are at most as many as there are detectors. Units repeated count once.
    """
    club = F.struct(
        F.col("detector").alias("name"), F.col("category").alias("type"), rank_name(F.col("tier")).alias("confidence"), F.col("total_count").alias("total_count"),
        F.col("n_values").cast("long").alias("n_values"),
    )
    packed = clubs.groupBy("unit_id").agg(F.sort_array(F.collect_list(club)).alias("findings"))
    rows = units.select("unit_id").distinct().join(packed, "unit_id", "left")
    rows = rows.withColumn("findings", F.coalesce("findings", F.array().cast(packed.schema["findings"].dataType)))
    if errors is not None:
        rows = rows.join(errors.groupBy("unit_id").agg(F.min("error").alias("error")), "unit_id", "left")
    thing, sheet = sheet_of(F.col("unit_id"))
    return rows.withColumn("object", thing).withColumn("sheet", sheet).withColumn("scan_time", F.lit(scan_time)).withColumn("time_taken", F.lit(seconds))


def summary_row(rows: DataFrame) -> DataFrame:
    """One row about a whole scan: units scanned, with findings and with errors, findings in all."""
    failed = F.count_if(F.col("error").isNotNull()) if "error" in rows.columns else F.lit(0).cast("long")
    total = F.aggregate("findings", F.lit(0).cast("long"), lambda a, x: a + x["total_count"])
    return rows.agg(F.count_distinct("object").alias("files_scanned"), F.count_if(F.size("findings") > 0).alias("with_findings"), failed.alias("failed"), F.sum(total).alias("total_count"))


def write_report(rows: DataFrame, path: str, values: DataFrame | None = None) -> None:
    """The units' documents under ``path``; with ``values`` (``club_values``) the whole values and their places under ``path``/values."""
    rows.write.mode("overwrite").json(f"{path}/units" if values is not None else path)
    if values is not None:
        values.write.mode("overwrite").partitionBy("detector").json(f"{path}/values")
