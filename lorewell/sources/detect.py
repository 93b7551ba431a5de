"""What a path holds: which exports, of which kind. Runs on the driver; reads names and the beginnings of files only."""

from __future__ import annotations

import json
import mmap
import re
import sqlite3
import tarfile
from dataclasses import dataclass
from pathlib import Path

from lorewell.sources.readers import top_members

# Names by which the formats are known.
MARKERS = {"your_facebook_activity": "facebook", "your_instagram_activity": "instagram"}
TRACKER_SUFFIXES = (".dht", ".sqlite", ".sqlite3", ".db")
TRACKER_TABLES = {"messages", "channels", "users", "attachments"}
INDEX = "messages.json"


@dataclass(frozen=True)
class Source:
    """One export: ``kind`` is dyi, secure, teams or tracker."""

    kind: str
    path: Path
    platform: str

    @property
    def media_root(self) -> Path:
        return self.path.parent if self.kind == "dyi" else self.path


def is_tracker(path: Path) -> bool:
    if path.suffix.lower() not in TRACKER_SUFFIXES or not path.is_file():
        return False
    try:
        con = sqlite3.connect(f"file:{path}?mode=ro", uri=True)
        try:
            return TRACKER_TABLES <= {r[0] for r in con.execute("SELECT name FROM sqlite_master WHERE type = 'table'")}
        finally:
            con.close()
    except sqlite3.DatabaseError:
        return False


def is_index(data, begin: int = 0, end: int | None = None) -> bool:
    """Whether a buffer holds an index: a user's id as text, and a list of conversations. Members are scanned, not built."""
    seen = {}
    for name, start, stop in top_members(data, begin, end):
        seen[name] = bytes(data[start : min(stop, start + 64)]).lstrip()[:1]
        if seen.get("userId") == b'"' and seen.get("conversations") == b"[":
            return True
    return False


def is_secure_thread(path: Path) -> bool:
    """By shape: messages and participants are lists, and there is a key threadName, whatever its value."""
    try:
        raw = json.loads(path.read_bytes())
    except (OSError, ValueError):
        return False
    return isinstance(raw, dict) and isinstance(raw.get("messages"), list) and isinstance(raw.get("participants"), list) and "threadName" in raw


def _teams(path: Path) -> bool:
    if path.is_dir():
        index = path / INDEX
        if not index.is_file() or not index.stat().st_size:
            return False
        with index.open("rb") as f, mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) as data:
            return is_index(data)
    if path.suffix.lower() == ".tar" and tarfile.is_tarfile(path):
        with tarfile.open(path, "r:") as tar:
            for member in tar:
                if member.name.lstrip("./") == INDEX and member.isfile():
                    with path.open("rb") as f, mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) as data:
                        return is_index(data, member.offset_data, member.offset_data + member.size)
    return False


def _markers(path: Path) -> list[Path]:
    """The marker folder that encloses the path, else those up to two levels below it."""
    for p in (path, *path.parents):
        if p.name in MARKERS:
            return [p]
    found = {q.resolve() for depth in ("", "*/", "*/*/") for name in MARKERS for q in path.glob(f"{depth}{name}") if q.is_dir()}
    return sorted(found)


def detect(path: str | Path) -> list[Source]:
    """All exports at a path; ValueError if there is none."""
    path = Path(path)
    if path.is_file():
        if is_tracker(path):
            return [Source("tracker", path, "discord")]
        if _teams(path):
            return [Source("teams", path, "teams")]
        raise ValueError(f"{path} is no export")
    if not path.is_dir():
        raise ValueError(f"{path} is not there")
    found = [Source("dyi", m, MARKERS[m.name]) for m in _markers(path) if any(m.glob("messages/inbox/*/message_*.json"))]
    inside = {s.path.resolve() for s in found}
    for folder in sorted({path, *path.glob("messages"), *path.glob("*/messages")}):
        if folder.name == "messages" and folder.is_dir() and not any(m in folder.resolve().parents for m in inside):
            if any(is_secure_thread(f) for f in sorted(folder.glob("*.json"))):
                found.append(Source("secure", folder, "facebook"))
    seen = set()
    for candidate in [path, *sorted(p for p in path.iterdir() if p.is_dir() or p.suffix.lower() == ".tar")]:
        if (real := candidate.resolve()) not in seen and _teams(candidate):
            seen.add(real)
            found.append(Source("teams", candidate, "teams"))
    found += [Source("tracker", p, "discord") for p in sorted(path.rglob("*.dht")) if is_tracker(p)]
    if not found:
        raise ValueError(f"no export below {path}")
    return found


def media_index(names: list[str]) -> dict[str, str]:
    """Document id to file name, of first renditions: <doc>.<rendition>.<ext>; of two with one id the last counts."""
    out: dict[str, str] = {}
    for name in names:
        m = re.fullmatch(r"(.+)\.(\d+)\.([A-Za-z0-9]+)", name.rsplit("/", 1)[-1])
        if m and m[2] == "1":
            out[m[1]] = name
    return out
