"""Files of a shared folder, for data sources that run outside Spark's own readers."""

from __future__ import annotations

from pyarrow import fs


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def listed(path: str, recursive: bool = False) -> list[fs.FileInfo]:
    files, at = opened(path)
    return files.get_file_info(fs.FileSelector(at, recursive=recursive, allow_not_found=True))


def read_text(path: str) -> str:
    files, at = opened(path)
    with files.open_input_stream(at) as stream:
        return stream.read().decode()


def write_text(path: str, text: str) -> None:
    """Write a small file at once: it is there as a whole or not at all."""
    files, at = opened(path)
    with files.open_output_stream(f"{at}.tmp") as stream:
        stream.write(text.encode())
    files.move(f"{at}.tmp", at)
