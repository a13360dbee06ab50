"""Files in the shared folder, written by tasks and read by Spark."""

from __future__ import annotations

import uuid

from pyarrow import fs


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI; a plain path is a local one."""
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def write_file(uri: str, data: bytes) -> None:
    """Write under a name of its own, then rename: a retried or doubled task leaves one whole file."""
    system, path = filesystem(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    draft = f"{path}.{uuid.uuid4().hex}.draft"
    with system.open_output_stream(draft) as out:
        out.write(data)
    system.move(draft, path)
