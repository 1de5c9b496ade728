"""Objects by key as a data source: ``df.write.format("quizmill_objects").mode("append").save(folder)`` for rows (key, content).

Tasks write to a staging folder of the job; keys appear when all tasks are done, and
none does if one fails. What speculative or repeated attempts have written is never
moved; a task that outlives its job's end may leave a hidden staging folder behind.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import Row, StructType

FORMAT = "quizmill_objects"


@dataclass
class Staged(WriterCommitMessage):
    """A task's objects: where they lie, and their keys."""

    folder: str
    keys: list[str]


class ObjectSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return ObjectWriter(schema, self.options["path"])


class ObjectWriter(DataSourceWriter):
    def __init__(self, schema: StructType, folder: str):
        if set(schema.names) != {"key", "content"}:
            raise ValueError("objects are rows (key, content)")
        self.folder, self.staging = folder, f".staging-{uuid.uuid4().hex}"

    def _store(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.folder)

    def write(self, iterator: Iterator[Row]) -> Staged:
        store, root = self._store()
        folder, keys = f"{root}/{self.staging}/{uuid.uuid4().hex}", []
        store.create_dir(folder)
        for row in iterator:
            if not row["key"] or any(part in ("", ".", "..") for part in row["key"].split("/")):
                raise ValueError(f"no key: {row['key']!r}")
            with store.open_output_stream(f"{folder}/{len(keys)}") as out:
                out.write(bytes(row["content"] or b""))
            keys.append(row["key"])
        return Staged(folder, keys)

    def commit(self, messages: list[Staged | None]) -> None:
        """Moves every object to its key, one rename each; a key that is there is replaced."""
        store, root = self._store()
        for message in filter(None, messages):
            for n, key in enumerate(message.keys):
                store.create_dir(f"{root}/{key}".rpartition("/")[0])
                store.move(f"{message.folder}/{n}", f"{root}/{key}")
        self._clear(store, root)

    def abort(self, messages: list[Staged | None]) -> None:
        self._clear(*self._store())

    def _clear(self, store: fs.FileSystem, root: str) -> None:
        if store.get_file_info(f"{root}/{self.staging}").type == fs.FileType.Directory:
            store.delete_dir(f"{root}/{self.staging}")


def put(objects: DataFrame, folder: str) -> None:
    """Writes rows (key, content) as the files of their keys below ``folder``, all or none; of rows with one key either stays."""
    objects.sparkSession.dataSource.register(ObjectSource)
    rows = objects.selectExpr("key", "cast(content as binary) as content")
    rows.write.format(FORMAT).mode("append").save(folder)
