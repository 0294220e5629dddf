"""New season files landed as they appear.

The pull is resumable: what is there is skipped. As a stream that is a file source with a
checkpoint, run until nothing new is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from throughline.config import PITCH, Cols
from throughline.sources.landing import check_required


def land_new_files(spark: SparkSession, incoming: str, root: str, checkpoint: str,
                   schema: T.StructType, c: Cols = PITCH) -> None:
    """Append rows of files not seen before to the season-partitioned table at `root`.

    A file is read once: the checkpoint remembers it. A batch that is retried after a failure
    replaces its own earlier attempt, as each batch writes its own partition.
    """
    files = spark.readStream.schema(schema).parquet(incoming)
    check_required(files)

    def land(batch: DataFrame, batch_id: int) -> None:
        (
            batch.withColumn(c.season, F.year(c.date)).withColumn("batch", F.lit(batch_id))
            .sortWithinPartitions(*c.key)
            .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            .partitionBy("batch", c.season).parquet(root)
        )

    query = (files.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    query.awaitTermination()
