"""Files that tasks read and write by range, in any store that Arrow opens; a path without a scheme is a shared folder's."""

from __future__ import annotations

import os

from pyarrow import fs


def located(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)
    return fs.LocalFileSystem(), os.path.abspath(path)
