"""Binary files in the shared folder, written and read by tasks.

Paths are URIs, opened by ``pyarrow.fs``, so local disks and remote stores look alike. A task
writes files with names of their own and reports them in its rows; files of lost attempts are not
in any row and are never read.
"""

from __future__ import annotations

from pyarrow import fs


def _split(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + uri)


def make_folder(uri: str) -> None:
    store, path = _split(uri)
    store.create_dir(path, recursive=True)


def create(uri: str):
    store, path = _split(uri)
    return store.open_output_stream(path, compression=None)


def open_file(uri: str):
    store, path = _split(uri)
    return store.open_input_file(path)
