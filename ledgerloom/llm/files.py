"""Plain binary files written and read by tasks, in any folder that pyarrow's public file systems reach.

A task writes under a name of its own and reports it in the rows it returns; only reported files are read. A task that
is repeated after a lost executor leaves an unreported file behind and nothing else.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyarrow import fs


def _place(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = uri.removeprefix("file:")
    return fs.FileSystem.from_uri(uri)


def new_name(folder: str, stem: str, ending: str) -> str:
    return f"{folder}/{stem}-{uuid.uuid4().hex}.{ending}"


@contextmanager
def writing(uri: str) -> Iterator:
    system, path = _place(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    with system.open_output_stream(path) as out:
        yield out


def size(uri: str) -> int:
    system, path = _place(uri)
    return system.get_file_info(path).size


@contextmanager
def reading(uri: str) -> Iterator:
    system, path = _place(uri)
    with system.open_input_file(path) as source:
        yield source
