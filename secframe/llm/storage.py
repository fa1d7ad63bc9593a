"""Binary files in the shared folder, written and read by tasks."""
from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs


def open_store(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder or file; the same on every executor."""
    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


class PartFile:
    """One output file of a task attempt.

    Its name is new for every attempt, and only files that a finished task reports are ever read,
    so a lost executor or a repeated task leaves nothing but an unread file.
    """

    def __init__(self, folder: str, suffix: str):
        store, path = open_store(folder)
        store.create_dir(path, recursive=True)
        self.name = f"{uuid.uuid4().hex}{suffix}"
        self.uri = f"{folder.rstrip('/')}/{self.name}"
        self.size = 0
        self._out = store.open_output_stream(f"{path.rstrip('/')}/{self.name}", compression=None)

    def write(self, data: bytes) -> int:
        """Offset at which ``data`` begins."""
        at = self.size
        self._out.write(data)
        self.size += len(data)
        return at

    def close(self) -> None:
        self._out.close()


def slices(batches, column: int, limit: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """Parts of batches with about ``limit`` bytes of one text column each, and one row at least."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
