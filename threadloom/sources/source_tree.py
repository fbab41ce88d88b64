"""Source trees as a table: ``spark.read.format("source_tree").load(root)``.

Hidden names and unsupported files are pruned while listing. The built-in binary reader is no choice
here, as it silently leaves out names that begin with an underscore.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from threadloom.functions.paths import LANGUAGES

FILES_PER_TASK = 256


class PathBatch(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


def list_sources(root: str) -> Iterator[str]:
    """Paths of supported files below ``root``; nothing when the root itself is hidden."""
    if os.path.basename(os.path.normpath(root)).startswith("."):
        return

    def fail(error: OSError) -> None:
        raise error

    for folder, subfolders, names in os.walk(root, onerror=fail):
        subfolders[:] = sorted(d for d in subfolders if not d.startswith("."))
        for name in sorted(names):
            extension = os.path.splitext(name)[1].lower()
            if not name.startswith(".") and extension in LANGUAGES:
                yield os.path.join(folder, name)


class SourceTreeReader(DataSourceReader):
    def __init__(self, root: str, batch: int):
        self.root, self.batch = root, batch

    def partitions(self) -> list[PathBatch]:
        """Batches of paths; like any file source, only names pass through the driver."""
        paths = list_sources(self.root)
        batches = []
        while chunk := list(islice(paths, self.batch)):
            batches.append(PathBatch(chunk))
        return batches or [PathBatch([])]

    def read(self, partition: PathBatch) -> Iterator[tuple[str, str]]:
        """An unreadable file fails the job."""
        for path in partition.paths:
            with open(path, "rb") as file:
                yield path, file.read().decode("utf-8", errors="replace")


class SourceTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return "file_path string, content string"

    def reader(self, schema) -> SourceTreeReader:  # noqa: ANN001
        return SourceTreeReader(
            self.options["path"], int(self.options.get("files_per_task", FILES_PER_TASK))
        )


def read_tree(spark: SparkSession, root: str, files_per_task: int = FILES_PER_TASK) -> DataFrame:
    """All source files below ``root`` (a path every executor can read)."""
    spark.dataSource.register(SourceTree)
    return (
        spark.read.format("source_tree").option("files_per_task", str(files_per_task)).load(root)
    )
