"""Files opened by tasks themselves, in any store that ``pyarrow.fs`` knows."""

from __future__ import annotations

import re

from pyarrow import fs


def open_path(path: str) -> tuple[fs.FileSystem, str]:
    """The store of a path or URI, and the path within it."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[len("file:") :].lstrip("/")
    if re.match(r"^[a-zA-Z][a-zA-Z0-9+.-]*://", path):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path
