"""Tables kept for training."""

from pyspark import StorageLevel
from pyspark.sql import DataFrame

_MERGE = "spark.sql.optimizer.canChangeCachedPlanOutputPartitioning"


def keep(df: DataFrame) -> DataFrame:
    """Persists the table on the executors' disks, letting Spark merge small shuffle partitions as it does for any other query.

    By default it keeps all shuffle partitions of a persisted table, and every pass over it would then run
    that many tasks, however small the table is.

    Not in memory: a table larger than what Spark grants to tables fills that share of the heap for as long as it is
    held. Its columns are arrays of megabytes, which take up half as much again as Spark counts, and a row group that
    another executor asks for is written out in memory once more; what is left then is too little for the training itself.
    From disk a pass holds the row groups of its running tasks, however long the table is.
    """
    conf = df.sparkSession.conf
    before = conf.get(_MERGE, None)
    conf.set(_MERGE, "true")
    try:
        return df.persist(StorageLevel.DISK_ONLY)
    finally:
        if before is None:
            conf.unset(_MERGE)
        else:
            conf.set(_MERGE, before)
