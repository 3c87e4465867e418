"""Where the state of streams lives."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import SparkSession

STORE = "spark.sql.streaming.stateStore"
# State in RocksDB on the executors' disks, changes written to the checkpoint; no disk taken before there is something to hold.
ON_DISK = {
    f"{STORE}.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    f"{STORE}.rocksdb.changelogCheckpointing.enabled": "true",
    f"{STORE}.rocksdb.allowFAllocate": "false",
}


@contextmanager
def state_on_disk(spark: SparkSession):
    """Streams started in this block keep their state on disk."""
    before = {k: spark.conf.get(k, None) for k in ON_DISK}
    for k, v in ON_DISK.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
