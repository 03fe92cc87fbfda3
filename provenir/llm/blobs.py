"""Files of raw bytes in the shared scratch folder, written and range-read by tasks.

Every writer takes a file name of its own, and readers only follow pointers
(file, offset, length) from an index table that Spark's own commit has made
visible; a file left by a lost or repeated task is named by no pointer.
"""

from __future__ import annotations

import uuid

from pyarrow import fs

#: A writer goes on in a new file beyond this size.
FILE_BYTES = 1 << 30
#: Ranges with smaller gaps are fetched in one read, up to this size together.
READ_BYTES = 4 << 20
GAP_BYTES = 64 << 10
#: Bytes that one task reads.
TASK_BYTES = 8 << 20


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


class BlobWriter:
    def __init__(self, folder: str, suffix: str):
        self.folder, self.suffix, self.file, self._out, self._at = folder, suffix, "", None, 0

    def put(self, data: bytes) -> tuple[str, int, int]:
        """Append ``data``; returns its pointer."""
        if self._out is None or self._at >= FILE_BYTES:
            self.close()
            self.file = f"{self.folder}/{uuid.uuid4().hex}{self.suffix}"
            system, path = _opened(self.file)
            system.create_dir(path.rpartition("/")[0], recursive=True)
            self._out, self._at = system.open_output_stream(path, compression=None), 0
        self._out.write(data)
        self._at += len(data)
        return self.file, self._at - len(data), len(data)

    def close(self) -> None:
        if self._out is not None:
            self._out.close()
            self._out = None


class RangeReader:
    """Reads ranges; those asked for in sorted order share their fetches."""

    def __init__(self):
        self._file, self._source, self._size, self._start, self._held = "", None, 0, 0, b""

    def get(self, file: str, offset: int, length: int, ahead: int = READ_BYTES) -> bytes:
        if file != self._file:
            self.close()
            system, path = _opened(file)
            self._source, self._file = system.open_input_file(path), file
            self._size, self._start, self._held = self._source.size(), 0, b""
        if not (self._start <= offset and offset + length <= self._start + len(self._held)):
            self._held = self._source.read_at(min(max(length, ahead), self._size - offset), offset)
            self._start = offset
        found = self._held[offset - self._start : offset - self._start + length]
        if len(found) != length:
            raise OSError(f"{file} ends before {offset + length}")
        return found

    def close(self) -> None:
        if self._source is not None:
            self._source.close()
            self._source, self._file = None, ""


def read_tasks(size: int | None) -> int:
    """How many tasks share ``size`` bytes; pointers are too small for Spark to deal them by their own size."""
    return max(1, -(-int(size or 0) // TASK_BYTES))


def coalesced(ranges: list[tuple[str, int, int]]) -> list[tuple[str, int, int, int]]:
    """Sorted ranges as (file, start, end, how many of them), near ones together."""
    out: list[tuple[str, int, int, int]] = []
    for file, offset, length in ranges:
        end = offset + length
        if out and out[-1][0] == file and offset - out[-1][2] <= GAP_BYTES and end - out[-1][1] <= READ_BYTES:
            out[-1] = (file, out[-1][1], max(end, out[-1][2]), out[-1][3] + 1)
        else:
            out.append((file, offset, end, 1))
    return out
