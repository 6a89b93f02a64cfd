"""Files that tasks open themselves, for formats that Spark has no reader or writer for."""

from __future__ import annotations

import re

from pyarrow import fs


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URL, and the path within it."""
    if re.match("file:/", path):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path if re.match("[a-z][a-z0-9+.-]*://", path) else f"file://{path}")
