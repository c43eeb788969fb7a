"""Binary files that tasks write to and read from the shared folder.

Each attempt of a task writes a file of its own; only files named in the rows that Spark commits are
read, so a repeated or lost attempt leaves at most an unread file.
"""

from __future__ import annotations

import uuid
from urllib.parse import urlparse


def opened(uri: str):
    """(file system, path) of a URI; plain paths are local ones."""
    from pyarrow import fs

    if not urlparse(uri).scheme:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


class Output:
    """A new file ``name`` in ``folder``; ``at`` is the position of the next byte."""

    def __init__(self, folder: str, name: str, suffix: str):
        self.name = f"{name}-{uuid.uuid4().hex}{suffix}"
        self.uri = f"{folder}/{self.name}"
        system, path = opened(self.uri)
        system.create_dir(path.rsplit("/", 1)[0], recursive=True)
        self.stream, self.at = system.open_output_stream(path, compression=None), 0

    def write(self, data: bytes) -> int:
        self.stream.write(data)
        start, self.at = self.at, self.at + len(data)
        return start

    def close(self) -> None:
        self.stream.close()


def read_at(uri: str):
    """A random-access file."""
    system, path = opened(uri)
    return system.open_input_file(path)
