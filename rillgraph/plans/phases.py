"""Wall time and counts of a run's phases, a JSON line each; counting costs a job, so it is off by default."""

from __future__ import annotations

import json
import resource
import sys
import time
from contextlib import contextmanager


class Phases:
    def __init__(self, on: bool = False, out=None):
        self.on, self.out = on, out or sys.stderr

    @contextmanager
    def phase(self, name: str, **frames):
        """frames: DataFrames, or functions that give them, whose rows are counted at the end."""
        began = time.time()
        yield
        if self.on:
            counts = {k: (f() if callable(f) else f).count() for k, f in frames.items()}
            rss = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024
            print(json.dumps({"phase": name, "ms": round(1000 * (time.time() - began)), "rss_mb": rss, **counts}), file=self.out)
