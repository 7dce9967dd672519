"""Settings of a run, by the engine's names, and hints for one DataFrame."""

from __future__ import annotations

import contextlib

from pyspark.sql import DataFrame, SparkSession

#: The engine's names of settings that can change between runs, and Spark's.
NAMES = {
    "partitions": "spark.sql.shuffle.partitions",
    "scan_bytes": "spark.sql.files.maxPartitionBytes",
    "adaptive": "spark.sql.adaptive.enabled",
    "broadcast_bytes": "spark.sql.autoBroadcastJoinThreshold",
    "codegen": "spark.sql.codegen.wholeStage",
    "batch_rows": "spark.sql.execution.arrow.maxRecordsPerBatch",
    "time_zone": "spark.sql.session.timeZone",
}


@contextlib.contextmanager
def settings(spark: SparkSession, **values):
    """Settings that hold within the block; those before return after it. Unknown names raise."""
    unknown = set(values) - set(NAMES)
    if unknown:
        raise KeyError(f"unknown settings: {sorted(unknown)}")
    before = {n: spark.conf.get(NAMES[n], None) for n in values}
    try:
        for n, v in values.items():
            spark.conf.set(NAMES[n], str(v).lower() if isinstance(v, bool) else str(v))
        yield spark
    finally:
        for n, v in before.items():
            if v is None:
                spark.conf.unset(NAMES[n])
            else:
                spark.conf.set(NAMES[n], v)


def hinted(df: DataFrame, partitions: int | None = None, by: list[str] | None = None, join: str | None = None) -> DataFrame:
    """Hints for one DataFrame: the number of its partitions, dealt by columns or evenly, and how it is joined
    (merge, shuffle_hash). Results never depend on them."""
    if partitions is not None:
        df = df.repartition(partitions, *(by or []))
    if join is not None:
        if join not in ("merge", "shuffle_hash"):
            raise ValueError("a join hint is merge or shuffle_hash; a side is broadcast by its counted size alone")
        df = df.hint(join)
    return df
