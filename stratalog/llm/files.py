"""Files that tasks write to and read from the shared folder, through Arrow's file systems."""

from __future__ import annotations

import uuid

from pyarrow import fs


def write_whole(uri: str, data: bytes) -> None:
    """Write under another name, then rename: a task that runs twice leaves one whole file."""
    system, path = fs.FileSystem.from_uri(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.tmp"
    with system.open_output_stream(part) as out:
        out.write(data)
    system.move(part, path)
