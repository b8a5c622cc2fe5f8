"""Large arrays in the shared folder, written piece by piece by tasks and mapped by others.

Where the folder is mounted (``file:``), tasks write their pieces into one file at their places, so the array is mapped
whole; a repeated task writes the same bytes. Elsewhere each piece is a file of its own, and readers put them together.
"""

from __future__ import annotations

import os
import uuid
from urllib.parse import urlparse

import numpy as np


def _local(uri: str) -> str | None:
    parts = urlparse(uri)
    return parts.path if parts.scheme in ("", "file") else None


def put(uri: str, at: int, values: np.ndarray) -> None:
    """Writes `values` as the elements from `at` on of the array `uri`."""
    if path := _local(uri):
        os.makedirs(os.path.dirname(path), exist_ok=True)
        f = os.open(path, os.O_RDWR | os.O_CREAT)
        try:
            data, done = memoryview(np.ascontiguousarray(values)).cast("B"), 0
            while done < len(data):
                done += os.pwrite(f, data[done : done + (1 << 30)], at * values.itemsize + done)
        finally:
            os.close(f)
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(path, recursive=True)
    with store.open_output_stream(part := f"{path}/.{uuid.uuid4().hex}") as f:
        f.write(np.ascontiguousarray(values).tobytes())
    store.move(part, f"{path}/{at:020d}")


def get(uri: str, kind: str, size: int) -> np.ndarray:
    """The whole array of `size` elements: mapped where the folder is mounted, else read."""
    if not size:
        return np.zeros(0, kind)
    if path := _local(uri):
        return np.memmap(path, kind, "r", shape=(size,))
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    pieces = []
    for info in sorted(store.get_file_info(fs.FileSelector(path)), key=lambda i: i.base_name):
        if not info.base_name.startswith("."):
            with store.open_input_file(info.path) as f:
                pieces.append(np.frombuffer(f.read(), kind))
    return np.concatenate(pieces)


def drop(uri: str) -> None:
    """Deletes an array that nothing reads any more."""
    if path := _local(uri):
        if os.path.exists(path):
            os.remove(path)
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    store.delete_dir(path)
