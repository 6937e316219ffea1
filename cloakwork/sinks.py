"""Files out: one named file for each document, by a data source of Spark's own kind.

df.write.format("masked_files").option("path", folder).mode("append").save() writes rows of (name string, content binary)
as files of these names. A task writes under a staging folder that no reader sees; only when all tasks are done does
the driver move their files to their places, by rename, and a failed job's staging folder goes. Tasks that run again write under a
name of their own, so a retry or a lost executor leaves no half file and none twice; saving the same rows again replaces
files by equal ones. Names are made harmless (functions.text.safe_name's signs); rows without content are left out, and
names that come more than once in a save are an error, as one would hide the other.

The folder is any place that pyarrow.fs opens by its address: file://, hdfs://, s3://, gs://, or a plain local path that
driver and executors share.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

SCHEMA = "name string, content binary"
_HARMFUL = re.compile(r"[^A-Za-z0-9_.\-]")


def _opened(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def harmless(name: str) -> str:
    """Without signs that lead to other folders; never empty and never hidden."""
    return _HARMFUL.sub("_", name).lstrip(".") or "_"


@dataclass
class Written(WriterCommitMessage):
    """What one task has written: names and their places under the staging folder."""

    files: list[tuple[str, str]]


class FilesWriter(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path = path.rstrip("/")
        self.staging = f"{self.path}/_staging-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> Written:
        system, root = _opened(self.staging)
        system.create_dir(root, recursive=True)
        attempt, files = uuid.uuid4().hex, []
        for batch in iterator:
            for name, content in zip(batch.column("name"), batch.column("content")):
                if name.as_py() is None or not content.is_valid:
                    continue
                place = f"{attempt}-{len(files)}"
                with system.open_output_stream(f"{root}/{place}") as out:
                    out.write(content.as_buffer())
                files.append((harmless(name.as_py()), place))
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = _opened(self.staging)
        files = [f for m in messages if m for f in m.files]
        names = {name for name, _ in files}
        if len(names) < len(files):
            self.abort(messages)
            raise ValueError(f"{len(files) - len(names)} files have the name of another")
        target = root.rpartition("/")[0]
        for name, place in files:
            system.move(f"{root}/{place}", f"{target}/{name}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        system, root = _opened(self.staging)
        if system.get_file_info(root).type != fs.FileType.NotFound:
            system.delete_dir(root)


class MaskedFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "masked_files"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema, overwrite: bool) -> FilesWriter:
        if overwrite:
            raise ValueError("masked_files only appends: save with mode append")
        if not self.options.get("path"):
            raise ValueError("masked_files needs a path")
        return FilesWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    """Makes masked_files known to this session."""
    spark.dataSource.register(MaskedFiles)
