"""Small documents on the driver's disk: atomic JSON, text and bytes, and a store that migrates old shapes."""

from __future__ import annotations

import json
import os
import tempfile
from collections.abc import Callable, Sequence
from pathlib import Path


def write_bytes(path: str | Path, content: bytes) -> None:
    """Readers see the old or the new file, never a part; the new one is on disk before it takes the name."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    handle, name = tempfile.mkstemp(dir=path.parent, prefix=f".{path.name}.")
    try:
        with os.fdopen(handle, "wb") as f:
            f.write(content)
            f.flush()
            os.fsync(f.fileno())
        os.replace(name, path)
    except BaseException:
        Path(name).unlink(missing_ok=True)
        raise


def write_json(path: str | Path, value) -> None:
    write_bytes(path, json.dumps(value, ensure_ascii=False, indent=1, sort_keys=True).encode())


class Store:
    """A JSON document with a version. ``migrations[i]`` turns version i into i + 1; a missing file is ``empty``."""

    def __init__(self, path: str | Path, migrations: Sequence[Callable[[dict], dict]] = (), empty: dict | None = None):
        self.path, self.migrations, self.empty = Path(path), migrations, empty or {}

    def load(self) -> dict:
        if not self.path.exists():
            return {**self.empty, "version": len(self.migrations)}
        value = json.loads(self.path.read_text())
        at = int(value.get("version", 0))
        if at > len(self.migrations):
            raise ValueError(f"{self.path} has version {at}; this code knows {len(self.migrations)}")
        for step in self.migrations[at:]:
            value = step(value)
        return {**value, "version": len(self.migrations)}

    def save(self, value: dict) -> None:
        write_json(self.path, {**value, "version": len(self.migrations)})
