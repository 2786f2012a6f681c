"""Open a file that Spark names, on an executor."""

from __future__ import annotations

from urllib.parse import unquote, urlparse

import pyarrow.fs as pafs


def open_input(uri: str):
    """A pyarrow random-access file for a path as ``DataFrame.inputFiles`` gives it."""
    parts = urlparse(uri)
    if parts.scheme in ("", "file"):
        return pafs.LocalFileSystem().open_input_file(unquote(parts.path))
    scheme = {"s3a": "s3", "s3n": "s3"}.get(parts.scheme, parts.scheme)
    fs, path = pafs.FileSystem.from_uri(uri.replace(f"{parts.scheme}://", f"{scheme}://", 1))
    return fs.open_input_file(path)
