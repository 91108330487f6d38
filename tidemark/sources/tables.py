"""Table reads."""

from pyspark.sql import DataFrame


def spread(scan: DataFrame) -> DataFrame:
    """Give a scan that has fewer partitions than the cluster has cores one partition per core.

    A scan partition is at most ``spark.sql.files.maxPartitionBytes``, so what is moved here is small
    by construction; a scan with enough partitions is returned as it is. Only for plain scans: the
    partition count of those is known without running anything.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan
