"""Binary files in the shared folder, through pyarrow's file systems."""

from __future__ import annotations

import uuid

from pyarrow import fs as pafs


def _at(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri)


def make_dir(uri: str) -> None:
    fs, path = _at(uri)
    fs.create_dir(path, recursive=True)


def write(uri: str, data: bytes) -> None:
    """Under a name of the attempt's own first, then renamed: a file that has its name is whole,
    and a task that runs again writes the same bytes."""
    fs, path = _at(uri)
    own = f"{path}.{uuid.uuid4().hex}.attempt"
    with fs.open_output_stream(own) as out:
        out.write(data)
    fs.move(own, path)


def read(uri: str) -> bytes:
    fs, path = _at(uri)
    with fs.open_input_file(path) as f:
        return f.read()
