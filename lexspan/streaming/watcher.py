"""Keeps an engine's indexes fresh: changes in, rebuilds out.

Changes come from two sides: events of a stream (``changed``, which ``freshness.follow`` calls
for each trigger), and comparisons of a unit's listing with its index (``relist``). Each unit
has a clock that says when its next rebuild is due; ``tick`` does what is due. All times are
milliseconds that the caller passes, so nothing here sleeps or reads a clock of its own.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from typing import TYPE_CHECKING

from .freshness import MOST_PENDING

if TYPE_CHECKING:
    from ..engine import Engine


@dataclass(frozen=True)
class Pace:
    """How long changes may wait, and how much of the time rebuilds may take."""

    quiet_ms: int = 500  # without a change, before a rebuild
    patience_ms: int = 5_000  # from the first change on, at most
    share: int = 4  # a rebuild of t ms rests for at least this times t; 0: no rest
    rest_ms: int = 60_000  # at most
    retry_ms: int = 1_000  # after a failure, doubled by each further one
    retry_most_ms: int = 60_000
    relist_ms: int = 300_000
    relist_most: int = 8  # times ``relist_ms``, while listings find nothing that events missed


@dataclass
class Clock:
    """When a unit's next rebuild is due."""

    pace: Pace
    first: int | None = None  # of the changes that no rebuild has taken yet
    last: int = 0
    ended: int | None = None  # the last rebuild
    rest: int = 0  # after it
    failed: list[int] = field(default_factory=list)

    def change(self, now: int) -> None:
        self.first = now if self.first is None else self.first
        self.last = now

    def due(self) -> int | None:
        """The time of the next rebuild: changes have settled, the last rebuild has rested, and
        after failures the pause is over. None if nothing has changed."""
        if self.first is None:
            return None
        p = self.pace
        settled = min(self.last + p.quiet_ms, self.first + p.patience_ms)
        rested = settled if self.ended is None else self.ended + self.rest
        pause = min(p.retry_ms * 2 ** min(len(self.failed) - 1, 30), p.retry_most_ms) if self.failed else 0
        return max(settled, rested, self.failed[-1] + pause if self.failed else settled)

    def built(self, began: int, now: int, known: bool = True) -> None:
        """A rebuild that follows close on the last one's rest doubles the rest: a unit that is
        written to all the time costs less and less. One that had to list everything rests twice
        its time alone."""
        p, took = self.pace, now - began
        base = 0 if p.share == 0 else 2 * took if not known else max(p.share * took, p.quiet_ms)
        soon = known and self.ended is not None and began - self.ended <= 2 * self.rest + p.quiet_ms
        self.rest = min(max(base, 2 * self.rest) if soon and base else base, p.rest_ms)
        self.first, self.ended, self.failed = None, now, []

    def fail(self, now: int) -> None:
        self.failed.append(now)


class Watcher:
    """Over the units of an engine that have an index. Changes that arrive during a rebuild belong
    to the next one."""

    def __init__(self, engine: Engine, pace: Pace | None = None):
        self.engine, self.pace = engine, pace or Pace(relist_ms=1000 * engine.cfg.rescan_secs)
        self.clocks = {n: Clock(self.pace) for n, u in engine.units.items() if u.index is not None}
        self.idle, self.listed = 0, None

    def changed(self, unit: str, paths: Iterable[str | None], now: int) -> None:
        """Paths that changed; None stands for something unknown."""
        if unit not in self.clocks:
            return
        u, paths = self.engine.units[unit], list(paths)
        if not paths:
            return
        known = set(u.pending) | {x for x in paths if x}
        u.pending_unknown = u.pending_unknown or None in paths or len(known) > MOST_PENDING
        u.pending, u.dirty = [] if u.pending_unknown else sorted(known), True
        self.clocks[unit].change(now)

    def relist(self, now: int) -> int:
        """Compares listings with indexes; gives the number of paths that events had missed."""
        missed = 0
        for name in self.clocks:
            u = self.engine.units[name]
            paths = [r for r in self.engine.stale_paths(u, MOST_PENDING + 1) if r not in set(u.pending)]
            if paths and not u.pending_unknown:
                missed += len(paths)
                self.changed(name, paths if len(paths) <= MOST_PENDING else [None], now)
            u.watched = True
        self.idle = 0 if missed else self.idle + 1
        self.listed = now
        return missed

    def next_relist(self) -> int:
        """Listings that find nothing come half as often each time, up to a limit."""
        return 0 if self.listed is None else self.listed + self.pace.relist_ms * min(2 ** max(0, self.idle - 1), self.pace.relist_most)

    def tick(self, now: int, clock=None) -> list[str]:
        """Relists and rebuilds what is due; gives the units that were rebuilt. A rebuild that
        fails leaves the old index, and its changes pending."""
        if now >= self.next_relist():
            self.relist(now)
        done = []
        for name, c in self.clocks.items():
            at, u = c.due(), self.engine.units[name]
            if at is None or at > now:
                continue
            began, taken, unknown = now, list(u.pending), u.pending_unknown
            u.pending, u.pending_unknown, u.building = [], False, (taken, unknown)
            try:
                self.engine.rebuild(u, taken)
            except Exception as e:  # whatever it is, the unit isn't fresh and is tried again
                c.fail(now)
                u.pending, u.pending_unknown, u.dirty, u.error = sorted({*taken, *u.pending}), unknown or u.pending_unknown, True, str(e)
            else:
                ended = clock() if clock else now
                c.built(began, ended, not unknown)
                u.dirty, u.error = bool(u.pending) or u.pending_unknown, ""
                if u.dirty:
                    c.change(ended)
                u.index.beat(ended)
                u.index.vacuum(now_ms=ended)
                done.append(name)
            finally:
                u.building = None
        return done
