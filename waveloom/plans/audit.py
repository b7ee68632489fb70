"""Stage and status audits: what has run for each case, what is missing, and how runs ended."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waveloom.operators.relational import stage_gaps


def stage_audit(cases: DataFrame, stages: dict[str, DataFrame], key: str) -> DataFrame:
    """A flag for each stage that has rows of a case, the names of those that have none, and whether the case is complete."""
    out = cases.select(key).distinct()
    for name, rows in stages.items():
        out = out.join(rows.select(key).distinct().withColumn(name, F.lit(1)), key, "left")
    out = out.fillna(0, list(stages)).withColumn("gaps", stage_gaps(list(stages)))
    return out.withColumn("complete", (F.col("gaps") == "").cast("int"))


def status_crosstab(rows: DataFrame, mode: str, status: str, values: list[str]) -> DataFrame:
    return rows.groupBy(mode).agg(*(F.count_if(F.col(status) == v).alias(v) for v in values), F.count("*").alias("total"))


def gap_reasons(audit: DataFrame) -> DataFrame:
    """How often each gap occurs, most frequent first."""
    return audit.filter("gaps != ''").select(F.explode(F.split("gaps", ",")).alias("gap")).groupBy("gap").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "gap")


def rolled_up(files: DataFrame, key: str, status: str = "status") -> DataFrame:
    """A case's state from those of its files: error if any failed, else downloaded."""
    return files.groupBy(key).agg(F.count_if(F.col(status) == "error").alias("errors"), F.count("*").alias("files")).withColumn("state", F.when(F.col("errors") > 0, "error").otherwise("downloaded"))
