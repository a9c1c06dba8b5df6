"""The control file, the configuration's time zone, and where a cluster keeps a relation's file."""

from __future__ import annotations

import os
import re
import struct
from dataclasses import dataclass

# States of a cluster by number.
STATES = ("starting up", "shut down", "shut down in recovery", "shutting down", "in crash recovery", "in archive recovery", "in production")


@dataclass(frozen=True)
class Control:
    system_id: int
    version: int
    catalog_version: int
    state: str
    time: int
    checkpoint: str
    redo: str
    next_xid: int | None

    @property
    def clean(self) -> bool:
        return self.state in STATES[1:3]


def _lsn(n: int) -> str:
    return f"{n >> 32:X}/{n & 0xFFFFFFFF:X}"


def parse_control(raw: bytes) -> Control | None:
    """The control file's head; None if it is too short. next_xid: the low half of the next full transaction id."""
    if len(raw) < 48:
        return None
    system, version, catalog, state, time, checkpoint, redo = struct.unpack_from("<QIIIxxxxqQQ", raw)
    name = STATES[state] if state < len(STATES) else f"state {state}"
    following = struct.unpack_from("<Q", raw, 64)[0] & 0xFFFFFFFF if len(raw) >= 72 else None
    return Control(system, version, catalog, name, time, _lsn(checkpoint), _lsn(redo), following)


def config_timezone(text: str) -> str | None:
    """The time zone of a configuration file: the last setting that isn't commented out."""
    found = re.findall(r"^\s*timezone\s*=?\s*'?([^'#\n]*?)'?\s*(?:#.*)?$", text, re.MULTILINE | re.IGNORECASE)
    return found[-1].strip() or None if found else None


def cluster_root(path: str) -> str | None:
    """The folder at most six levels up that holds a version file."""
    folder = os.path.dirname(os.path.abspath(path))
    for _ in range(7):
        if any(os.path.exists(os.path.join(folder, n)) for n in ("PG_VERSION", "SYS_VERSION")) and os.path.isdir(os.path.join(folder, "base")):
            return folder
        folder = os.path.dirname(folder)
    return None


def relation_path(root: str, database: int, filenode: int, tablespace: int = 0, version_folder: str | None = None) -> str:
    """Where a relation's main file lies: the database's folder, `global` for shared ones, or a tablespace's."""
    if database == 0:
        return os.path.join(root, "global", str(filenode))
    if tablespace in (0, 1663):
        return os.path.join(root, "base", str(database), str(filenode))
    place = os.path.join(root, "pg_tblspc", str(tablespace))
    inner = version_folder or next((n for n in sorted(os.listdir(place)) if n.startswith("PG_")), "") if os.path.isdir(place) else version_folder or ""
    return os.path.join(place, inner, str(database), str(filenode))


def databases(root: str) -> list[int]:
    """Oids of the databases that have a folder."""
    base = os.path.join(root, "base")
    return sorted(int(n) for n in os.listdir(base) if n.isdigit()) if os.path.isdir(base) else []
