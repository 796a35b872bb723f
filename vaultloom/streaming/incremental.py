"""Scans driven by arrivals: each micro-batch of newly landed files runs a scan of the directories it touches."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths


def scan_on_arrival(archive, landing: str = "", checkpoint: str | None = None, **trigger):
    """Starts a query over files that land under `landing`; the archive's scan settles what changed. trigger: as for DataStreamWriter.trigger."""
    top = os.path.join(archive.root, landing)
    stream = archive.spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", True).option("pathGlobFilter", "*").load(top).select("path")

    def settle(batch: DataFrame, _: int) -> None:
        inside = F.regexp_replace(F.col("path"), "^file:/*/", "/")
        rel = F.substring(inside, len(archive.root) + 2, 1 << 30)
        touched = [r["d"] for r in batch.select(paths.parent(rel).alias("d")).where("d not like '\\_state%'").distinct().limit(1000).collect()]
        if touched:
            archive.scan(touched if len(touched) < 1000 else None)

    place = checkpoint or os.path.join(archive.state, "stream")
    return stream.writeStream.foreachBatch(settle).option("checkpointLocation", place).trigger(**(trigger or {"availableNow": True})).start()
