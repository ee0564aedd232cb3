"""Files that tasks write to and read from the shared scratch folder, on any file system that pyarrow knows."""

from __future__ import annotations

import re

import numpy as np
from pyarrow import fs


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder's URI and the path inside it; a plain path is local."""
    if re.match(r"^[a-z0-9+.-]+:/", uri):
        return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))
    return fs.LocalFileSystem(), uri


def mapped(uri: str, dtype: str) -> np.ndarray:
    """A file as an array: memory-mapped where the file system is local or mounted, else read."""
    store, path = file_system(uri)
    if store.get_file_info(path).size == 0:
        return np.empty(0, dtype)
    if isinstance(store, fs.LocalFileSystem):
        return np.memmap(path, dtype, "r")
    with store.open_input_file(path) as f:
        return np.frombuffer(f.read(), dtype)
