"""A job queue as a streaming source and sink that publish each batch once.

A queue is a folder. A task of the sink writes its jobs to a file of its own; the batch's commit lists these files in a manifest named after
producer and batch, and a manifest that is there already is left alone, so a batch that runs again after a crash publishes nothing
twice. The source's offsets count each producer's manifests, so every reader with a checkpoint takes each job once.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceStreamWriter, DataSourceWriter, InputPartition, WriterCommitMessage

SCHEMA = "job string"
_NAME = re.compile(r"([\w.-]+)-(\d{12})\.json")


@dataclass
class Written(WriterCommitMessage):
    """What a task has written: a file's name (none for no jobs)."""

    name: str | None


class JobFile(InputPartition):
    def __init__(self, name: str):
        self.name = name


class Folder:
    """The queue's files, by any scheme that Arrow's file systems know."""

    def __init__(self, uri: str):
        self.uri = uri

    def open(self):
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(self.uri)
        for sub in ("jobs", "batches"):
            system.create_dir(f"{path}/{sub}", recursive=True)
        return system, path

    def put(self, name: str, body: bytes) -> None:
        """The whole file or none: it is written under another name first."""
        system, path = self.open()
        with system.open_output_stream(temp := f"{path}/{name}.{uuid.uuid4().hex}.part") as f:
            f.write(body)
        system.move(temp, f"{path}/{name}")

    def get(self, name: str) -> bytes:
        system, path = self.open()
        with system.open_input_stream(f"{path}/{name}") as f:
            return f.read()

    def published(self) -> dict[str, list[int]]:
        """The batches of each producer, ascending."""
        from pyarrow import fs

        system, path = self.open()
        out: dict[str, list[int]] = {}
        for info in system.get_file_info(fs.FileSelector(f"{path}/batches")):
            if m := _NAME.fullmatch(info.base_name):
                out.setdefault(m[1], []).append(int(m[2]))
        return {k: sorted(v) for k, v in out.items()}

    def files(self, producer: str, batch: int) -> list[str]:
        return json.loads(self.get(f"batches/{producer}-{batch:012d}.json"))

    def publish(self, producer: str, batch: int, names: list[str]) -> None:
        if batch not in self.published().get(producer, []):
            self.put(f"batches/{producer}-{batch:012d}.json", json.dumps(sorted(names)).encode())


class _Writing:
    """What batch and stream writers share."""

    def __init__(self, folder: Folder, producer: str):
        self.folder, self.producer = folder, producer

    def write(self, rows: Iterator) -> Written:
        jobs = [r[0] for r in rows if r[0] is not None]
        if not jobs:
            return Written(None)
        name = f"jobs/{uuid.uuid4().hex}.jsonl"
        self.folder.put(name, "".join(json.dumps(j) + "\n" for j in jobs).encode())
        return Written(name)


class QueueWriter(_Writing, DataSourceWriter):
    def commit(self, messages: list) -> None:
        self.folder.publish(self.producer, 0, [m.name for m in messages if m and m.name])

    def abort(self, messages: list) -> None:
        """Files without a manifest are never read."""


class QueueStreamWriter(_Writing, DataSourceStreamWriter):
    def commit(self, messages: list, batchId: int) -> None:
        self.folder.publish(self.producer, batchId, [m.name for m in messages if m and m.name])

    def abort(self, messages: list, batchId: int) -> None:
        """Files without a manifest are never read."""


class QueueStreamReader(DataSourceStreamReader):
    def __init__(self, folder: Folder):
        self.folder = folder

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {k: len(v) for k, v in self.folder.published().items()}

    def partitions(self, start: dict, end: dict) -> list[JobFile]:
        there = self.folder.published()
        return [JobFile(f) for producer, upto in sorted(end.items()) for batch in there[producer][start.get(producer, 0) : upto] for f in self.folder.files(producer, batch)]

    def read(self, partition: JobFile) -> Iterator[tuple]:
        for line in self.folder.get(partition.name).decode().splitlines():
            yield (json.loads(line),)

    def commit(self, end: dict) -> None:
        """Files stay for other readers."""


class QueueReader(DataSourceReader):
    """All jobs that are published now."""

    def __init__(self, folder: Folder):
        self.inner = QueueStreamReader(folder)

    def partitions(self) -> list[JobFile]:
        return self.inner.partitions({}, self.inner.latestOffset())

    def read(self, partition: JobFile) -> Iterator[tuple]:
        yield from self.inner.read(partition)


class JobQueue(DataSource):
    """``spark.dataSource.register(JobQueue)``, then format ``job_queue`` with a folder's URI as ``path``. One column, ``job``: a JSON text. Writers name
    themselves by ``producer``; a stream that goes on must keep its name. Null jobs are not published."""

    @classmethod
    def name(cls) -> str:
        return "job_queue"

    def schema(self) -> str:
        return SCHEMA

    def _folder(self) -> Folder:
        return Folder(self.options["path"])

    def reader(self, schema) -> DataSourceReader:
        return QueueReader(self._folder())

    def streamReader(self, schema) -> DataSourceStreamReader:
        return QueueStreamReader(self._folder())

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("jobs are appended to a queue")
        return QueueWriter(self._folder(), self.options.get("producer") or uuid.uuid4().hex)

    def streamWriter(self, schema, overwrite: bool) -> DataSourceStreamWriter:
        return QueueStreamWriter(self._folder(), self.options.get("producer", "stream"))
