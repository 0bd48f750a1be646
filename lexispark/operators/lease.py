"""Exclusion of runs: one holder of a name at a time, by files that are created once, with expiry and fencing numbers.

Every lease of a name has the next number, as the file ``<name>/<number>.json``; of several that try at once, one creates
it. A lease ends by its release or when it expires; then the next number can be taken. A holder that was only slow finds
out at its next commit: the store refuses numbers that are not the last one.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from lexispark.storage import Folder

SECONDS = 3600.0


def _last(folder: Folder, name: str) -> int:
    return max((int(n.removesuffix(".json")) for n in folder.names(name) if n.endswith(".json") and not n.startswith(".")), default=0)


@dataclass(frozen=True)
class Lease:
    folder: Folder
    name: str
    number: int

    def held(self) -> bool:
        """Whether no other holder has come since."""
        return _last(self.folder, self.name) == self.number and not self._released()

    def _released(self) -> bool:
        return f"{self.number:012d}.released" in self.folder.names(self.name)

    def release(self) -> None:
        self.folder.create(f"{self.name}/{self.number:012d}.released", {})


def acquire(folder: Folder, name: str, holder: str, seconds: float = SECONDS, now: Callable[[], float] = time.time) -> Lease | None:
    """The lease of ``name``, or None while another one holds it."""
    last = _last(folder, name)
    if last:
        ended = Lease(folder, name, last)._released()
        if not ended and folder.read(f"{name}/{last:012d}.json")["expires"] > now():
            return None
    if not folder.create(f"{name}/{last + 1:012d}.json", {"holder": holder, "expires": now() + seconds}):
        return None
    return Lease(folder, name, last + 1)


def exclusive(folder: Folder, name: str, holder: str, work: Callable[[Lease], object], seconds: float = SECONDS, now: Callable[[], float] = time.time) -> dict:
    """Runs ``work`` unless another run of ``name`` is under way: status ``busy``, ``indexed`` or ``failed`` with its error."""
    lease = acquire(folder, name, holder, seconds, now)
    if lease is None:
        return {"status": "busy", "error": "Source is already being indexed.", "result": None}
    try:
        return {"status": "indexed", "error": None, "result": work(lease)}
    except Exception as e:
        return {"status": "failed", "error": str(e), "result": None}
    finally:
        lease.release()
