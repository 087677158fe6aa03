"""Names, small text files and removal below a folder, on any file system Arrow reaches by its address."""

from __future__ import annotations

import uuid

from pyarrow import fs

# Hadoop's names of a store, and Arrow's.
_SCHEMES = {"s3a": "s3", "s3n": "s3"}


class Folder:
    """The folder at ``root``. Spark reads and writes the data; this only lists, points and clears away."""

    def __init__(self, root: str, filesystem: fs.FileSystem | None = None):
        scheme, colon, rest = root.partition("://")
        if filesystem is not None:
            self.fs, self.path = filesystem, rest if colon else root
        elif colon:
            self.fs, self.path = fs.FileSystem.from_uri(f"{_SCHEMES.get(scheme, scheme)}://{rest}")
        else:
            self.fs, self.path = fs.LocalFileSystem(), root.removeprefix("file:")

    def _at(self, name: str) -> str:
        return f"{self.path.rstrip('/')}/{name}" if name else self.path

    def names(self, name: str = "") -> list[str]:
        found = self.fs.get_file_info(fs.FileSelector(self._at(name), allow_not_found=True))
        return [f.base_name for f in found]

    def exists(self, name: str = "") -> bool:
        return self.fs.get_file_info(self._at(name)).type != fs.FileType.NotFound

    def text(self, name: str) -> str:
        with self.fs.open_input_stream(self._at(name)) as f:
            return f.read().decode("utf-8")

    def put(self, name: str, text: str) -> None:
        """Write a file that appears whole or not at all."""
        parent, _, last = name.rpartition("/")
        self.fs.create_dir(self._at(parent), recursive=True)
        waiting = self._at(f"{parent}/.{last}-{uuid.uuid4().hex}" if parent else f".{last}-{uuid.uuid4().hex}")
        with self.fs.open_output_stream(waiting) as f:
            f.write(text.encode("utf-8"))
        self.fs.move(waiting, self._at(name))

    def remove(self, name: str) -> None:
        """Remove a file or folder, if it is there."""
        kind = self.fs.get_file_info(self._at(name)).type
        if kind == fs.FileType.Directory:
            self.fs.delete_dir(self._at(name))
        elif kind != fs.FileType.NotFound:
            self.fs.delete_file(self._at(name))
