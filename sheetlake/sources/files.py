"""Opening workbook files from tasks, on any file system Spark lists."""

from __future__ import annotations

from urllib.parse import quote, urlsplit


def file_system(uri: str):
    """``(file system, path)`` for a path as Spark prints it."""
    from pyarrow import fs

    scheme = urlsplit(uri).scheme
    if scheme in ("", "file"):
        path = uri[len("file:"):] if scheme else uri
        return fs.LocalFileSystem(), "/" + path.lstrip("/")
    if scheme in ("s3a", "s3n"):
        uri, scheme = "s3" + uri[len(scheme):], "s3"
    rest = uri[len(scheme) + 3:]
    return fs.FileSystem.from_uri(f"{scheme}://{quote(rest)}")


def open_input(uri: str):
    """A seekable file: only the parts that are read are fetched."""
    system, path = file_system(uri)
    return system.open_input_file(path)
