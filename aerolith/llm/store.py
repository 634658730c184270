"""Binary files in the shared folder, by address; executors write and read them directly.

A file is named for the attempt that wrote it, and a row with its address comes out of the
same task. Those rows are written by Spark's committed writer, so a lost executor or a
repeated task leaves at most a file that no row names.
"""

from __future__ import annotations

import uuid

from pyarrow import fs


def place(address: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(address)


def create(folder: str, suffix: str):
    """A new file's address and its open stream."""
    system, path = place(folder)
    system.create_dir(path, recursive=True)
    name = f"{uuid.uuid4().hex}{suffix}"
    return f"{folder}/{name}", system.open_output_stream(f"{path}/{name}", compression=None)


def opened(address: str):
    system, path = place(address)
    return system.open_input_file(path)
