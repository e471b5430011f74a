"""Helpers the corpus operators share: Arrow text as bytes, shared-folder files."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts end to end, and the n + 1 offsets between them; null is empty."""
    flat = pc.fill_null(texts, "" if not pa.types.is_binary(texts.type) else b"").cast(pa.large_binary())
    _, offsets, data = flat.buffers()
    at = np.frombuffer(offsets, np.int64)[flat.offset : flat.offset + len(flat) + 1]
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(flat) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def byte_strings(texts: pa.Array):
    """Each text as UTF-8 bytes; null is empty.  Few of them are objects at a time."""
    own = texts.cast(pa.binary())
    return (v or b"" for a in range(0, len(own), 256) for v in own.slice(a, 256).to_pylist())


def slices(offsets: np.ndarray, limit: int):
    """Runs [a, b) of whole texts of at most ``limit`` bytes together (a longer text is a run of its own)."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, side="right")) - 1)
        yield a, min(b, n)
        a = b


def file_system(folder: str):
    """The pyarrow file system of a folder's URI, and the folder's path in it."""
    from pyarrow import fs

    if folder.startswith("file:/") and not folder.startswith("file://"):
        folder = "file://" + folder.removeprefix("file:")
    return fs.FileSystem.from_uri(folder)
