"""Files as Python workers open them: on the machine's disk, or in a store that Arrow knows."""

from __future__ import annotations

from urllib.parse import unquote, urlsplit

from pyarrow import fs

#: Stores that workers open by themselves.
OPENED = ("", "file", "hdfs", "s3", "s3a", "gs", "abfs", "abfss")


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, and the path in it."""
    parts = urlsplit(uri)
    if parts.scheme in ("", "file"):
        return fs.LocalFileSystem(), unquote(parts.path) if parts.scheme else uri
    if parts.scheme not in OPENED:
        raise ValueError(f"workers can't open {parts.scheme}://; read the files with Spark instead")
    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))
