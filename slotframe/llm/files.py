"""Binary files in the shared folder, written by tasks and made visible by one manifest."""

from __future__ import annotations

import json
import uuid
from typing import Any

from pyarrow import fs

MANIFEST = "_manifest.json"


def resolve(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI or of an absolute path."""
    return fs.FileSystem.from_uri(path)


def read_bytes(path: str) -> bytes:
    store, at = resolve(path)
    with store.open_input_stream(at, compression=None) as f:
        return f.read()


def write_bytes(path: str, data: bytes) -> None:
    store, at = resolve(path)
    store.create_dir(at.rpartition("/")[0], recursive=True)
    with store.open_output_stream(at, compression=None) as f:
        f.write(data)


def part_name(partition: int, n: int, suffix: str) -> str:
    """A name of its own for each attempt, so that a repeated task never meets the files of a lost one."""
    return f"part-{partition:06d}-{n:04d}-{uuid.uuid4().hex}{suffix}"


def write_manifest(path: str, entries: list[dict[str, Any]]) -> None:
    """List the files of the attempts that were committed; readers see only those."""
    write_bytes(f"{path}/{MANIFEST}", json.dumps(entries).encode())


def read_manifest(path: str) -> list[dict[str, Any]]:
    return json.loads(read_bytes(f"{path}/{MANIFEST}"))
