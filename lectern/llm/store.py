"""Files that tasks write to and range-read from the shared folder, by URI (local, HDFS or an object store)."""

from __future__ import annotations

import uuid


def open_fs(uri: str):
    """(file system, path) of a URI."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class Appender:
    """A new file in ``folder`` that a task fills from front to end; an attempt that fails leaves a file no row names."""

    def __init__(self, folder: str, suffix: str):
        self.uri = f"{folder}/{uuid.uuid4().hex}{suffix}"
        system, path = open_fs(self.uri)
        system.create_dir(path.rpartition("/")[0], recursive=True)
        self.out, self.size = system.open_output_stream(path, compression=None), 0

    def add(self, data: bytes) -> int:
        """The offset at which ``data`` now stands."""
        at = self.size
        self.out.write(data)
        self.size += len(data)
        return at

    def close(self) -> None:
        self.out.close()


class Ranges:
    """Reads ranges of files; keeps the last file open, so callers sort by file."""

    def __init__(self):
        self.uri, self.file = None, None

    def read(self, uri: str, offset: int, length: int) -> bytes:
        if uri != self.uri:
            self.close()
            system, path = open_fs(uri)
            self.uri, self.file = uri, system.open_input_file(path)
        return self.file.read_at(length, offset)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
            self.uri = self.file = None
