"""Session settings the plans count on; all are plain Spark options."""

from __future__ import annotations

from pyspark.sql import SparkSession


# A shuffled join whose one side is cut by a filter cuts the other one before it is shuffled: a
# window of documents is met by a few of the lines. The filter is of a fixed size, 1 MB: the driver
# holds each several times over, as a result, in the plan and in the tasks it sends, and several plans
# run side by side. Spark stops at ten filters a plan; plans of many windows need more.
RUNTIME_FILTERS = {
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "16MB",
    "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "1TB",
    "spark.sql.optimizer.runtime.bloomFilter.expectedNumItems": "3000000",
    "spark.sql.optimizer.runtime.bloomFilter.numBits": "8388608",
    "spark.sql.optimizer.runtimeFilter.number.threshold": "64",
}


def filter_early(spark: SparkSession) -> SparkSession:
    """Set ``RUNTIME_FILTERS`` in a session that does not say otherwise."""
    said = spark.conf.getAll
    for k, v in RUNTIME_FILTERS.items():
        if k not in said:
            spark.conf.set(k, v)
    return spark


def settings(cores: int, broadcast_mb: int = 64) -> dict[str, str]:
    """Options for a session with ``cores`` executor cores in all.

    Shuffles start with three partitions per core and adaptive execution merges
    small ones; a partition far above the median, as a hot key makes it, is split.
    A side is broadcast only when its measured size is below ``broadcast_mb``.
    """
    mb = f"{broadcast_mb}MB"
    return {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128MB",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": mb,
        "spark.sql.autoBroadcastJoinThreshold": mb,
        **RUNTIME_FILTERS,
        "spark.sql.shuffle.partitions": str(max(cores * 3, 8)),
        "spark.sql.files.maxPartitionBytes": "256MB",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }


def session(app: str, cores: int, **extra: str) -> SparkSession:
    b = SparkSession.builder.appName(app)
    for k, v in {**settings(cores), **extra}.items():
        b = b.config(k, v)
    return b.getOrCreate()
