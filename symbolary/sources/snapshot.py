"""Snapshots: a folder of Parquet tables with a manifest that is written last."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = 1


def write(tables: dict[str, DataFrame], out: str, coverage: dict | None = None) -> str:
    """Write tables under out/<stamp>/ and then the manifest, which names them; readers see the old or the new one whole."""
    import time

    spark = next(iter(tables.values())).sparkSession
    stamp = f"v{time.time_ns()}"
    for name, df in tables.items():
        df.write.parquet(f"{out}/{stamp}/{name}")
    manifest = json.dumps({"schema": VERSION, "at": stamp, "tables": sorted(tables), "coverage": coverage or {}}, sort_keys=True)
    spark.sql("select 1").select(F.lit(manifest).alias("value")).coalesce(1).write.mode("overwrite").text(f"{out}/_manifest")
    return stamp


def read(spark: SparkSession, out: str) -> dict[str, DataFrame]:
    """The tables of the latest snapshot; errors say what to do."""
    try:
        text = "".join(r.value for r in spark.read.text(f"{out}/_manifest").collect())
    except Exception as e:
        raise FileNotFoundError(f"no snapshot at {out}: build one first") from e
    try:
        manifest = json.loads(text)
    except ValueError as e:
        raise ValueError(f"the manifest at {out} is no JSON: build the snapshot again") from e
    if manifest.get("schema") != VERSION:
        raise ValueError(f"the snapshot at {out} has version {manifest.get('schema')}, this engine reads {VERSION}: build it again")
    return {t: spark.read.parquet(f"{out}/{manifest['at']}/{t}") for t in manifest["tables"]}


def export_json(df: DataFrame, out: str) -> None:
    """One JSON object a line, for other tools."""
    df.write.mode("overwrite").json(out)
