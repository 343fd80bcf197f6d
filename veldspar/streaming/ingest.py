"""Source files that arrive in a folder, extracted as they come.

The only stream of this library: what changed is parsed, and its facts are
upserted per file. A batch may be delivered again; files whose content hash is
already stored are left out, so a repetition changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from veldspar.operators.extract import extract_python

_SOURCE = "repo string, relpath string, text string"


def fresh(batch: DataFrame, stored: DataFrame | None) -> DataFrame:
    """Rows of a batch whose (repo, relpath, sha) is not stored; one per key."""
    one = batch.withColumn("sha", F.sha1(F.coalesce("text", F.lit("")).cast("binary"))).dropDuplicates(["repo", "relpath", "sha"])
    if stored is None:
        return one
    return one.join(stored.select("repo", "relpath", "sha").distinct(), ["repo", "relpath", "sha"], "left_anti")


def ingest(spark: SparkSession, inbox: str, out: str, checkpoint: str) -> StreamingQuery:
    """Starts the stream: JSON lines of (repo, relpath, text) in ``inbox``.

    ``out/files`` gets a row per new version, ``out/facts`` its facts, both
    partitioned by batch, so that a repeated batch overwrites itself.
    """

    def one(batch: DataFrame, batch_id: int) -> None:
        s = batch.sparkSession
        try:
            stored = s.read.parquet(f"{out}/files").where(F.col("batch") != batch_id)
        except Exception:  # noqa: BLE001  nothing stored yet
            stored = None
        new = fresh(batch, stored).persist()
        new.select("repo", "relpath", "sha").write.mode("overwrite").parquet(f"{out}/files/batch={batch_id}")
        extract_python(new).write.mode("overwrite").parquet(f"{out}/facts/batch={batch_id}")
        new.unpersist()

    stream = spark.readStream.schema(_SOURCE).json(inbox)
    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
