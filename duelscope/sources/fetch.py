"""Driver-side fetching of pinned files.  A lock that exists is authoritative: drift aborts, bytes are never replaced."""

from __future__ import annotations

import hashlib
import json
import os
import time
import tomllib
import urllib.request
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass
from datetime import UTC, datetime
from pathlib import Path

from .books import Books
from .files import SourceError, safe_path

Downloader = Callable[[str], bytes]


@dataclass(frozen=True)
class Spec:
    """A source: one file per year, all of one pinned commit."""

    tour: str
    repository: str
    commit: str
    template: str
    first_year: int
    last_year: int

    #: what identifies the files beside address and bytes
    pins = property(lambda self: {"commit": self.commit})

    def files(self) -> list[tuple[int, str, str]]:
        """(year, relative path, url) of every file."""
        out = []
        for year in range(self.first_year, self.last_year + 1):
            name = self.template.format(year=year)
            out.append((year, f"{self.tour.lower()}/{name}", f"https://raw.githubusercontent.com/{self.repository}/{self.commit}/{name}"))
        return out


def specs(path: str) -> list[Spec]:
    """Sources from TOML: a full commit, sensible years, no path twice."""
    found = [Spec(**s) for s in tomllib.loads(Path(path).read_text())["sources"]]
    paths = [p for s in found for _, p, _ in s.files()]
    for s in found:
        if len(s.commit) != 40 or not all(c in "0123456789abcdef" for c in s.commit):
            raise SourceError(f"{s.tour}: not a full commit")
        if not 1968 <= s.first_year <= s.last_year <= 2100 or "{year}" not in s.template:
            raise SourceError(f"{s.tour}: years or template")
    if len(set(paths)) < len(paths):
        raise SourceError("a path is given twice")
    return found


def download(url: str) -> bytes:
    with urllib.request.urlopen(url, timeout=60) as r:  # noqa: S310
        return r.read()


def patient(downloader: Downloader, attempts: int = 4, sleep: Callable[[float], None] = time.sleep) -> Downloader:
    """The downloader, tried again after 1, 2, 4 .. seconds."""
    def run(url: str) -> bytes:
        for n in range(attempts):
            try:
                return downloader(url)
            except OSError:
                if n == attempts - 1:
                    raise
                sleep(2.0**n)
        raise AssertionError

    return run


def _entry(spec: Spec | Books, year: int, path: str, url: str, content: bytes) -> dict:
    return {"tour": spec.tour, "year": year, "path": path, "url": url, **spec.pins, "bytes": len(content), "sha256": hashlib.sha256(content).hexdigest()}


def write_once(path: Path, text: str) -> None:
    """Create a file whole or not at all, and never over another one."""
    path.parent.mkdir(parents=True, exist_ok=True)
    temporary = path.with_name(f"{path.name}.{os.getpid()}.tmp")
    temporary.write_text(text)
    try:
        os.link(temporary, path)
    finally:
        temporary.unlink()


def _locked(lock: Path, sources: list[dict], paths: list[str], about: dict | None) -> dict[str, dict] | None:
    """Entries of the lock by path, None without a lock; it has to be of these sources, with each of their files once."""
    if not lock.exists():
        return None
    kept = json.loads(lock.read_text())
    if sorted(e["path"] for e in kept["files"]) != sorted(paths):
        raise SourceError("the lock lists other files than the sources")
    if kept["sources"] != sources or kept.get("about") != about:
        raise SourceError("the lock is of other sources")
    return {e["path"]: e for e in kept["files"]}


def fetch(sources: list[Spec] | list[Books], folder: str, lock: str, downloader: Downloader = download, now: Callable[[], datetime] = lambda: datetime.now(UTC), threads: int = 4, check: Callable[[str, bytes], None] | None = None, about: dict | None = None) -> dict:
    """Download what the sources list.  With a lock, only missing files that match it are written.

    All contents are held against ``check`` and the lock before the first is written, so a failure leaves no file.
    """
    at = Path(lock)
    wanted = [(s, *f) for s in sources for f in s.files()]
    locked = _locked(at, [asdict(s) for s in sources], [w[2] for w in wanted], about)
    get = patient(downloader)

    def one(job: tuple[Spec | Books, int, str, str]) -> tuple[dict, Path, bytes | None]:
        spec, year, path, url = job
        full = safe_path(folder, path)
        there = full.exists()
        content = full.read_bytes() if there else get(url)
        if check is not None:
            check(path, content)
        entry = _entry(spec, year, path, url, content)
        if locked is not None and entry != locked[path]:
            raise SourceError(f"{path} is not what the lock says")
        return entry, full, None if there else content

    with ThreadPoolExecutor(threads) as pool:
        found = list(pool.map(one, wanted))
    for _, full, content in found:
        if content is not None:
            full.parent.mkdir(parents=True, exist_ok=True)
            part = full.with_name(full.name + ".part")
            part.write_bytes(content)
            part.replace(full)
    entries = sorted((e for e, _, _ in found), key=lambda e: e["path"])
    if locked is None:
        of = {} if about is None else {"about": about}
        write_once(at, json.dumps({"created": now().isoformat(), "sources": [asdict(s) for s in sources], "files": entries, **of}, indent=2, sort_keys=True))
    return {"files": len(entries), "bytes": sum(e["bytes"] for e in entries), "new_lock": locked is None}
