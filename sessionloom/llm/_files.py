"""Plain files in the shared folder, from tasks: local paths directly, other stores through pyarrow's file systems."""

from __future__ import annotations

import os
import uuid
from contextlib import contextmanager
from urllib.parse import unquote, urlparse

from pyarrow import fs


def _place(uri: str) -> tuple[fs.FileSystem, str]:
    parts = urlparse(uri)
    if parts.scheme in ("", "file"):
        return fs.LocalFileSystem(), unquote(parts.path)
    return fs.FileSystem.from_uri(uri)


@contextmanager
def writing(uri: str):
    """A stream whose file appears under its name only when it is whole; a repeated task replaces it by an equal one."""
    system, path = _place(uri)
    system.create_dir(os.path.dirname(path), recursive=True)
    draft = f"{os.path.dirname(path)}/.{os.path.basename(path)}.{uuid.uuid4().hex}"
    with system.open_output_stream(draft) as stream:
        yield stream
    system.move(draft, path)


def reading(uri: str):
    """A random-access file."""
    system, path = _place(uri)
    return system.open_input_file(path)
