"""Files of any store that pyarrow can open, by URI: listing, ranges, and writes that leave no half-written file."""

from __future__ import annotations

import uuid

import pyarrow as pa
import pyarrow.fs as pafs


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI or of a plain path, and the path in it."""
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    return pafs.FileSystem.from_uri(uri)


def listed(uri: str, suffixes: tuple[str, ...]) -> list[tuple[str, int]]:
    """Path and size of a file, or of the files of these suffixes below a folder, in the order of paths; names that begin with _ or . are no data."""
    fs, path = opened(uri)
    info = fs.get_file_info(path)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(uri)
    if info.type == pafs.FileType.File:
        return [(info.path, info.size)]
    found = fs.get_file_info(pafs.FileSelector(path, recursive=True))
    return sorted((f.path, f.size) for f in found if f.is_file and f.path.endswith(suffixes) and not f.base_name.startswith(("_", ".")))


class Staged:
    """Files that a task writes below ``_staging`` of a folder; the driver moves those of the tasks that count to their place."""

    def __init__(self, uri: str, job: str):
        self.uri, self.job = uri, job
        self.fs, self.root = opened(uri)

    def new(self, suffix: str) -> tuple[str, pa.NativeFile]:
        folder = f"{self.root}/_staging-{self.job}"
        self.fs.create_dir(folder, recursive=True)
        path = f"{folder}/{uuid.uuid4().hex}{suffix}"
        return path, self.fs.open_output_stream(path, compression=None)

    def publish(self, staged: list[tuple[str, str]]) -> None:
        """Move each (staged path, name) to its name in the folder."""
        for path, name in staged:
            self.fs.move(path, f"{self.root}/{name}")
        self.clear()

    def clear(self) -> None:
        if self.fs.get_file_info(f"{self.root}/_staging-{self.job}").type != pafs.FileType.NotFound:
            self.fs.delete_dir(f"{self.root}/_staging-{self.job}")
