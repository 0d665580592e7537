"""Whole files in the shared folder, from the driver or a task, whatever store it is in."""

from __future__ import annotations

import pyarrow.fs as pafs


def place(uri: str) -> tuple[pafs.FileSystem, str]:
    """The store of a path and the path in it."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return pafs.LocalFileSystem(), uri
    return pafs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


def make_folder(uri: str) -> None:
    fs, path = place(uri)
    fs.create_dir(path, recursive=True)


class Publishing:
    """A file that gets its name when it is complete, so that a lost or repeated task leaves no half of it."""

    def __init__(self, uri: str, attempt: int):
        self.fs, self.path = place(uri)
        self.part = f"{self.path}.{attempt}.part"
        self.stream = self.fs.open_output_stream(self.part)

    def write(self, data) -> None:
        self.stream.write(data)

    def publish(self) -> None:
        self.stream.close()
        self.fs.move(self.part, self.path)


def opened(uri: str):
    """For reading at any place."""
    fs, path = place(uri)
    return fs.open_input_file(path)
