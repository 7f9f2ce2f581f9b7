"""Data sources of files: documents packed into containers, and e-books read member by member.

``write_documents`` puts many small documents into few ZIP files, which hold their own index, and ``read_documents`` reads
them back. ``read_books`` plans e-books by size and reads them through their central directory, so that no book need be a
value of a row. Both go by URI, in any file system that Arrow knows.
"""

from __future__ import annotations

import io
import json
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from ..functions.text import safe_filename
from .files import PART_ROWS, Book, book_parts

CONTAINER_BYTES, CONTAINER_FILES = 128_000_000, 50_000
TASK_BYTES, SMALL = 128_000_000, 64_000
MANIFESTS = "manifests"


def _fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _listed(uri: str, recursive: bool = False) -> list:
    """Files below a folder, or the file itself; none where nothing is there."""
    from pyarrow import fs

    system, path = _fs(uri)
    info = system.get_file_info(path)
    if info.type == fs.FileType.Directory:
        info = system.get_file_info(fs.FileSelector(path, recursive=recursive))
    else:
        info = [info]
    return [x for x in info if x.type == fs.FileType.File]


def _containers(uri: str) -> list[str]:
    """Names of the containers that the manifests below a folder tell of."""
    system, _ = _fs(uri)
    names: list[str] = []
    for x in sorted(_listed(f"{uri}/{MANIFESTS}"), key=lambda x: x.path):
        with system.open_input_file(x.path) as f:
            names += json.loads(f.read())["containers"]
    return names


@dataclass
class Written(WriterCommitMessage):
    containers: list[str]


class ContainerWriter(DataSourceWriter):
    """Tasks write containers under names of this job's own; the driver's manifest makes them part of the table.

    A task that fails deletes what it has begun. What an executor that was lost left is of the job, too, but no task has told
    of it: the commit deletes it.
    """

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.overwrite, self.job = options["path"].rstrip("/"), overwrite, uuid.uuid4().hex
        self.most_bytes, self.most_files = int(options.get("containerbytes", CONTAINER_BYTES)), int(options.get("containerfiles", CONTAINER_FILES))

    def _delete(self, names: list[str]) -> None:
        system, path = _fs(self.path)
        for name in names:
            try:
                system.delete_file(f"{path}/{name}")
            except FileNotFoundError:
                pass

    def write(self, iterator: Iterator) -> Written:
        system, path = _fs(self.path)
        system.create_dir(path, recursive=True)
        made: list[str] = []
        stream = container = None
        held: set[str] = set()

        def close() -> None:
            nonlocal stream, container
            if container is not None:
                container.close()
                stream.close()
                stream = container = None

        try:
            for row in iterator:
                if container is None:
                    made.append(f"{self.job}-{uuid.uuid4().hex}.zip")
                    stream = system.open_output_stream(f"{path}/{made[-1]}", compression=None)
                    container, held = zipfile.ZipFile(stream, "w", zipfile.ZIP_DEFLATED), set()
                name, n = row["name"], 1
                stem, dot, end = name.rpartition(".")
                while name in held:  # as a browser names a second download
                    n += 1
                    name = f"{stem} ({n}){dot}{end}" if dot else f"{end} ({n})"
                held.add(name)
                container.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), (row["content"] or "").encode(), zipfile.ZIP_DEFLATED)
                if stream.tell() >= self.most_bytes or len(held) >= self.most_files:
                    close()
            close()
        except BaseException:
            if stream is not None:
                stream.close()
            self._delete(made)
            raise
        return Written(made)

    def commit(self, messages: list) -> None:
        system, path = _fs(self.path)
        containers = [c for m in messages if m is not None for c in m.containers]
        before = _containers(self.path) if self.overwrite else []
        old = [x.path for x in _listed(f"{self.path}/{MANIFESTS}")] if self.overwrite else []
        system.create_dir(f"{path}/{MANIFESTS}", recursive=True)
        with system.open_output_stream(f"{path}/{MANIFESTS}/{self.job}", compression=None) as f:
            f.write(json.dumps({"containers": containers}).encode())
        for x in old:
            system.delete_file(x)
        own = [x.base_name for x in _listed(self.path) if x.base_name.startswith(self.job)]
        self._delete([*before, *(x for x in own if x not in set(containers))])

    def abort(self, messages: list) -> None:
        self._delete([x.base_name for x in _listed(self.path) if x.base_name.startswith(self.job)])


@dataclass
class Files(InputPartition):
    paths: list[str]


class ContainerReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"].rstrip("/")

    def partitions(self) -> list[InputPartition]:
        return [Files([name]) for name in _containers(self.path)] or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        system, path = _fs(self.path)
        for name in partition.paths:
            with system.open_input_file(f"{path}/{name}") as f, zipfile.ZipFile(f) as container:
                for member in container.infolist():
                    yield name, member.filename, container.read(member).decode()


class Containers(DataSource):
    """Format ``lectern_documents``: rows (name, content) to ZIP files, and (container, name, content) back."""

    @classmethod
    def name(cls) -> str:
        return "lectern_documents"

    def schema(self) -> str:
        return "container string, name string, content string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return ContainerReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return ContainerWriter(self.options, overwrite)


class BookReader(DataSourceReader):
    """E-books below a folder, so many to a task as TASK_BYTES hold; only their names and sizes are listed to plan."""

    def __init__(self, options: dict):
        self.path, self.task_bytes = options["path"], int(options.get("taskbytes", TASK_BYTES))

    def partitions(self) -> list[InputPartition]:
        out, size = [Files([])], 0
        for x in sorted(_listed(self.path, recursive=True), key=lambda x: x.path):
            if not x.path.lower().endswith(".epub"):
                continue
            if out[-1].paths and size + x.size > self.task_bytes:
                out.append(Files([]))
                size = 0
            out[-1].paths.append(x.path)
            size += x.size
        return out

    def read(self, partition: Files) -> Iterator[tuple]:
        system, _ = _fs(self.path)
        for path in partition.paths:
            book = Book()
            with system.open_input_file(path) as f:
                file = f if f.size() > SMALL else io.BytesIO(f.read())  # one read rather than several
                for i, (title, text) in enumerate(book_parts(file, book)):
                    yield path, i, title, text, book.title, book.author, None, None
            yield path, None, None, None, book.title, book.author, book.warnings, book.error


class Books(DataSource):
    """Format ``lectern_books``: the parts of e-books as they are read, then a row about the book, with warnings and error."""

    @classmethod
    def name(cls) -> str:
        return "lectern_books"

    def schema(self) -> str:
        return PART_ROWS

    def reader(self, schema: StructType) -> DataSourceReader:
        return BookReader(self.options)


def write_documents(documents: DataFrame, path: str, extension: str, mode: str = "append", **options) -> None:
    """documents (title, content) into containers below ``path``, each under its title as a file name."""
    documents.sparkSession.dataSource.register(Containers)
    named = documents.select(safe_filename(F.coalesce("title", F.lit("")), extension).alias("name"), "content")
    named.write.format(Containers.name()).options(path=path, **options).mode(mode).save()


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(container, name, content) of what ``write_documents`` has put below ``path``."""
    spark.dataSource.register(Containers)
    return spark.read.format(Containers.name()).option("path", path).load()


def read_books(spark: SparkSession, path: str, **options) -> DataFrame:
    """Rows as of ``epub_parts`` of all e-books below ``path``, read member by member.

    Parts come with title and author; warnings and the error stand in one row more for each book, which has no part number.
    """
    spark.dataSource.register(Books)
    return spark.read.format(Books.name()).options(path=path, **options).load()
