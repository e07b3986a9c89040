"""Files in the shared folder, written and read from tasks by URI (local, HDFS, S3 and the like)."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyarrow import fs


def _at(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def put(uri: str, data: bytes) -> None:
    """Write under a name of its own, then rename: a retried or speculative task leaves one whole file.

    Stores that don't rename over a file lose the one of the earlier attempt, which has the same bytes, first.
    """
    store, path = _at(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    temporary = f"{path.rpartition('/')[0]}/.{uuid.uuid4().hex}"
    with store.open_output_stream(temporary, compression=None) as out:
        out.write(data)
    try:
        store.move(temporary, path)
    except OSError:
        if store.get_file_info(path).type == fs.FileType.NotFound:
            raise
        store.delete_file(path)
        store.move(temporary, path)


def get(uri: str) -> bytes:
    store, path = _at(uri)
    with store.open_input_stream(path, compression=None) as f:
        return f.read()


def reader(uri: str) -> Callable[[int, int], bytes]:
    """``read(offset, length)``; a negative offset counts from the end."""
    store, path = _at(uri)
    handle = store.open_input_file(path)
    size = handle.size()

    def read(offset: int, length: int) -> bytes:
        return handle.read_at(length, offset if offset >= 0 else size + offset)

    return read
