"""Files that appear when a whole write has succeeded.

Tasks write to a hidden folder beside the target. The commit moves the files of successful
attempts into place and removes what an overwrite replaces last; an abort removes the hidden
folder. So a failed job changes nothing, and a lost executor costs its tasks only.
"""

from __future__ import annotations

import json
from abc import abstractmethod
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass
from urllib.parse import unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

THREADS = 32


def store_of(address: str) -> tuple[fs.FileSystem, str]:
    """The file system of an address as Spark writes it, and the path in it."""
    if address.startswith("file:"):
        return fs.LocalFileSystem(), "/" + unquote(address.removeprefix("file:")).lstrip("/")
    return fs.FileSystem.from_uri(address)


def openable(address: str) -> bool:
    """Whether Arrow's own file systems know the store of this address."""
    try:
        store_of(address)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError, ImportError):
        return False
    return True


def register(spark: SparkSession, source: type[DataSource]) -> str:
    """Make a data source known to a session, and to the active one, where Spark looks it up."""
    for session in (spark, SparkSession.active()):
        session.dataSource.register(source)
    return source.name()


def resolve(spark: SparkSession, path: str, mode: str) -> tuple[str, bool]:
    """The folder's address for executors, and whether to write, by Spark's save modes."""
    if mode not in ("error", "errorifexists", "overwrite", "append", "ignore"):
        raise ValueError(f"unknown save mode: {mode}")
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    address = store.makeQualified(folder).toString()
    if not store.exists(folder) or mode in ("append", "overwrite"):
        return address, True
    if mode == "ignore":
        return address, False
    raise FileExistsError(f"{path} exists already")


@dataclass
class Written(WriterCommitMessage):
    """Files of one task: (path in the hidden folder, rows)."""

    files: list[tuple[str, int]]


class Publisher(DataSourceArrowWriter):
    """Writes files ``part-<task>-<label>-c<number>.<suffix>``; subclasses say what is in them."""

    suffix = "bin"

    def __init__(self, address: str, overwrite: bool, label: str):
        self.address, self.overwrite, self.label = address, overwrite, label

    @abstractmethod
    def fill(self, task: Task, batches: Iterator[pa.RecordBatch]) -> None:
        """Write the batches of a task to files of ``task.file()``."""

    @abstractmethod
    def empty(self, sink: pa.NativeFile) -> None:
        """What a write of no rows leaves."""

    @property
    def hidden(self) -> str:
        return f".writing-{self.label}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyspark import TaskContext

        context = TaskContext.get()
        store, root = store_of(self.address)
        store.create_dir(f"{root}/{self.hidden}", recursive=True)
        task = Task(store, root, f"{self.hidden}/{context.partitionId():05d}-{context.taskAttemptId()}")
        self.fill(task, iterator)
        return Written(task.files)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, root = store_of(self.address)
        store.create_dir(root, recursive=True)
        old = [f for f in store.get_file_info(fs.FileSelector(root)) if not f.base_name.startswith(".writing-")] if self.overwrite else []
        places: list[tuple[str, str, int]] = []
        for message in messages:
            for k, (path, rows) in enumerate(message.files if message else ()):
                task = path.rsplit("/", 1)[1].split("-")[0]
                places.append((path, f"part-{task}-{self.label}-c{k:04d}.{self.suffix}", rows))
        if not places:
            with store.open_output_stream(f"{root}/part-00000-{self.label}-c0000.{self.suffix}") as sink:
                self.empty(sink)
        with ThreadPoolExecutor(THREADS) as pool:
            list(pool.map(lambda p: store.move(f"{root}/{p[0]}", f"{root}/{p[1]}"), places))
            list(pool.map(lambda f: store.delete_dir(f.path) if f.type == fs.FileType.Directory else store.delete_file(f.path), old))
        with store.open_output_stream(f"{root}/.written-{self.label}") as listing:
            listing.write(json.dumps(sorted([name, rows] for _, name, rows in places)).encode())
        self._discard(store, root)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        store, root = store_of(self.address)
        for found in store.get_file_info(fs.FileSelector(root, allow_not_found=True)):
            if found.base_name.startswith("part-") and f"-{self.label}-" in found.base_name:
                store.delete_file(found.path)
        self._discard(store, root)

    def _discard(self, store: fs.FileSystem, root: str) -> None:
        if store.get_file_info(f"{root}/{self.hidden}").type == fs.FileType.Directory:
            store.delete_dir(f"{root}/{self.hidden}")


class Task:
    """The files of one attempt of a task."""

    def __init__(self, store: fs.FileSystem, root: str, prefix: str):
        self.store, self.root, self.prefix = store, root, prefix
        self.files: list[tuple[str, int]] = []

    @contextmanager
    def file(self) -> Iterator[tuple[pa.NativeFile, list[int]]]:
        """A new file; the rows written to it are put into the list."""
        name, rows = f"{self.prefix}-{len(self.files):04d}", []
        with self.store.open_output_stream(f"{self.root}/{name}") as sink:
            yield sink, rows
        self.files.append((name, sum(rows)))


def written(address: str, label: str) -> list[tuple[str, int]]:
    """(file, rows) of a finished write."""
    store, root = store_of(address)
    with store.open_input_stream(f"{root}/.written-{label}") as listing:
        return [tuple(entry) for entry in json.loads(listing.read())]
