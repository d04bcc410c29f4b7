"""Files of an own format in the shared folder, written and read inside tasks."""

from __future__ import annotations

import uuid

from pyarrow import fs


def _at(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def write_file(uri: str, *parts: bytes) -> None:
    """Write under another name, then rename: a task that is repeated or lost leaves no half file under ``uri``."""
    system, path = _at(uri)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    draft = f"{path}.{uuid.uuid4().hex}.draft"
    with system.open_output_stream(draft) as out:
        for part in parts:
            out.write(part)
    system.move(draft, path)


def read_range(uri: str, start: int, length: int) -> bytes:
    """At most ``length`` bytes from ``start``; fewer at the end of the file."""
    system, path = _at(uri)
    with system.open_input_file(path) as f:
        return f.read_at(min(length, max(0, f.size() - start)), start) if length > 0 else b""


def make_folder(uri: str) -> None:
    system, path = _at(uri)
    system.create_dir(path, recursive=True)
