"""How far a long command is, on one line of a terminal or a line per tenth in a log."""

from __future__ import annotations

import sys
import time
from dataclasses import dataclass, field
from typing import TextIO


@dataclass
class Progress:
    """Call it with (done, total): it writes when there is something new to see."""

    what: str
    unit: str
    out: TextIO = field(default_factory=lambda: sys.stderr)
    often: float = 0.1
    _last: tuple[float, int] = (0.0, -1)

    def __call__(self, done: int, total: int) -> None:
        share = min(1.0, max(0.0, done / total)) if total > 0 else 1.0
        alive, (when, tenth) = self.out.isatty(), self._last
        if alive and share < 1 and time.monotonic() - when < self.often or not alive and int(share * 10) == tenth:
            return
        self._last = (time.monotonic(), int(share * 10))
        line = f"{self.what}: {share:4.0%}, {done:,} of {total:,} {self.unit}"
        self.out.write(f"\r\x1b[K{line}" + "\n" * (share >= 1) if alive else line + "\n")
        self.out.flush()
