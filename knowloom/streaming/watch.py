"""Watching a directory: a stream of files that are new or changed. Spark's own file stream never reports a changed file again."""

from __future__ import annotations

import json
import os

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader
from pyspark.sql.streaming import StreamingQuery

from ..sources.files import SUFFIXES


def watched(path: str) -> bool:
    return os.path.splitext(path)[1].lower() in SUFFIXES


def listing(folder: str) -> dict[str, list[int]]:
    found = {}
    for d, _, names in os.walk(folder):
        for n in names:
            if watched(n) and os.path.isfile(p := os.path.join(d, n)):
                s = os.stat(p)
                found[p] = [s.st_mtime_ns, s.st_size]
    return found


class _Reader(SimpleDataSourceStreamReader):
    """The offset is the listing: it grows with the directory, so very large trees should be watched by sub-directory."""

    def __init__(self, folder: str):
        self.folder = folder

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def read(self, start: dict):
        now = listing(self.folder)
        known = json.loads(start["files"]) if start else {}
        changed = [(p, v[0]) for p, v in sorted(now.items()) if known.get(p) != v]
        return iter(changed), {"files": json.dumps(now)}

    def readBetweenOffsets(self, start: dict, end: dict):  # noqa: N802
        known, now = (json.loads(o["files"]) if o else {} for o in (start, end))
        return iter([(p, v[0]) for p, v in sorted(now.items()) if known.get(p) != v])


class ChangedFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "changed_files"

    def schema(self) -> str:
        return "path string, modified long"

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:  # noqa: N802
        return _Reader(self.options["path"])


def watch(spark: SparkSession, folder: str, handle, checkpoint: str, debounce_ms: int = 1000, once: bool = False) -> StreamingQuery:
    """Calls handle(paths) once for the new and changed files of a batch, each path once; deleted files are ignored. What handle raises is printed, and the stream goes on."""
    spark.dataSource.register(ChangedFiles)

    def batch(df, _: int) -> None:
        paths = sorted(p for (p,) in df.select("path").distinct().toLocalIterator() if os.path.isfile(p))
        if paths:
            try:
                handle(paths)
            except Exception as e:  # noqa: BLE001
                print(f"{len(paths)} files: {e}")

    stream = spark.readStream.format("changed_files").option("path", folder).load()
    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{debounce_ms} milliseconds")).start()
