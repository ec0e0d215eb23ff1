"""Binary files below a folder that all executors share, and rows that are dealt to them."""

from __future__ import annotations

import posixpath

from pyarrow import fs


def _at(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


class Output:
    """A file that is written under its final name only once it is complete."""

    def __init__(self, path: str):
        self.path = path
        self.system, self.place = _at(path)
        self.system.create_dir(posixpath.dirname(self.place), recursive=True)
        self.stream = self.system.open_output_stream(self.place + ".part")
        self.size = 0

    def write(self, data: bytes) -> None:
        self.stream.write(data)
        self.size += len(data)

    def close(self) -> None:
        self.stream.close()
        self.system.move(self.place + ".part", self.place)


def read_range(path: str, start: int, length: int) -> bytes:
    system, place = _at(path)
    with system.open_input_file(place) as stream:
        stream.seek(start)
        return stream.read(length)


def read_all(path: str) -> bytes:
    system, place = _at(path)
    with system.open_input_file(place) as stream:
        return stream.read()
