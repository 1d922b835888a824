"""``format("blobfiles")``: one file per row of ``(path, content)``.

Paths are relative to option ``path``. A blob's name comes from its content, so
writing it again gives the same file: each task puts a temporary file and
renames it, and nothing is left for the driver to move.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from setwright.sinks.shared_files import open_base


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        filesystem, base = open_base(self.path)
        attempt = TaskContext.get().taskAttemptId()
        made = set()
        for batch in iterator:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                final = f"{base}/{name}"
                folder, leaf = final.rsplit("/", 1)
                if folder not in made:
                    filesystem.create_dir(folder, recursive=True)
                    made.add(folder)
                temporary = f"{folder}/_{leaf}.{attempt}"
                with filesystem.open_output_stream(temporary) as out:
                    out.write(content.as_buffer())
                filesystem.move(temporary, final)
        return WriterCommitMessage()

    def commit(self, messages: list) -> None:
        """Nothing to do: every file is in place under its content's name."""

    def abort(self, messages: list) -> None:
        """Nothing to do: complete files are valid, and a new run writes the same ones."""


class BlobFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "blobfiles"

    def schema(self) -> str:
        return "path string, content binary"

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        if "path" not in self.options:
            raise ValueError("option path is required")
        if set(schema.names) != {"path", "content"}:
            raise ValueError("blobfiles takes the columns path and content")
        return _Writer(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(BlobFiles)
