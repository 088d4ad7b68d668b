"""Files that executors write and read in the shared folder, by URI (file:, hdfs:, s3:, gs:)."""

from __future__ import annotations

import uuid

from pyarrow import fs


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


class NewFile:
    """A file with a name of its own. A task that is run again writes another; only the name that its task returns counts."""

    def __init__(self, folder: str, suffix: str):
        self.uri = f"{folder}/{uuid.uuid4().hex}{suffix}"
        files, path = opened(self.uri)
        files.create_dir(path.rpartition("/")[0], recursive=True)
        self.out, self.at = files.open_output_stream(path, compression=None), 0

    def write(self, data: bytes) -> int:
        """Where the data begins."""
        begins, self.at = self.at, self.at + len(data)
        self.out.write(data)
        return begins

    def close(self) -> None:
        self.out.close()


def reader(uri: str):
    files, path = opened(uri)
    return files.open_input_file(path)


def remove(uri: str) -> None:
    """Removes a folder and all in it, if it is there."""
    try:
        files, path = opened(uri)
        files.delete_dir(path)
    except OSError:
        pass  # gone already, or the store is: nothing reads the folder any more
