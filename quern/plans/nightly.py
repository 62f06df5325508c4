"""A night's work: jobs in order, each failure noted, the gate in any case."""

from __future__ import annotations

import time
from collections.abc import Callable

# The order of a night: corrections first, then what is indexed, then the gate that judges it.
ORDER = ("reconcile", "code", "history", "failure_modes", "corpus", "gate")


def nightly(jobs: dict[str, Callable[[], object]], fingerprints: dict[str, tuple[str, str]] | None = None, clock: Callable[[], float] = time.monotonic) -> list[dict]:
    """Rows (job, status, seconds, note) of the ``jobs`` that are there, in ``ORDER``, others before the gate.

    A job that raises is noted and the night goes on.  A job whose fingerprint (old,
    new) hasn't changed is skipped; the gate always runs.
    """
    names = [n for n in ORDER[:-1] if n in jobs] + [n for n in jobs if n not in ORDER] + [n for n in ORDER[-1:] if n in jobs]
    out = []
    for name in names:
        old, new = (fingerprints or {}).get(name, (None, None))
        if name != "gate" and new is not None and old == new:
            out.append({"job": name, "status": "skipped", "seconds": 0.0, "note": "nothing new"})
            continue
        start = clock()
        try:
            note, status = jobs[name](), "done"
        except Exception as e:  # a job may fail in any way; the gate still has to run
            note, status = e, "failed"
        out.append({"job": name, "status": status, "seconds": round(clock() - start, 3), "note": "" if note is None else str(note)})
    return out
