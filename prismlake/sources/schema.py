"""Versioned schemas: additive steps with defaults, applied in order; a newer version is refused."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: (step, column, type, default): what each version adds to the assets table.
STEPS = (
    ("0002_quality", "sharpness", "double", None), ("0003_sources", "asset_source", "string", "photokit"), ("0004_paths", "file_path", "string", None),
    ("0005_titles", "title", "string", None), ("0006_review", "sensitive_score", "double", None), ("0007_override", "sensitive_override", "boolean", None), ("0008_rules", "rule", "string", None),
)
CHECKS = {"media_type": ("image", "video"), "availability": ("local", "cloud_only", "shared")}


def migrate(df: DataFrame, version: int) -> DataFrame:
    if not 1 <= version <= len(STEPS) + 1:
        raise ValueError(f"version {version} is unknown to this library")
    for _, column, kind, default in STEPS[version - 1 :]:
        if column not in df.columns:
            df = df.withColumn(column, F.lit(default).cast(kind))
    return df


def violations(df: DataFrame) -> DataFrame:
    """Rows that break a check, with its column; three-valued, so null passes."""
    bad = F.array_compact(F.array(*[F.when(~F.col(c).isin(*v), c) for c, v in CHECKS.items() if c in df.columns]))
    return df.withColumn("broken", bad).filter(F.size("broken") > 0)
