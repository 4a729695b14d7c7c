"""Ignore files for the driver's own walk over a tree it can see."""

from __future__ import annotations

import os
import re

from .globs import IgnoreRule, ignore_rule


class IgnoreFiles:
    """A stack of ignore files, the innermost last; the last matching line decides."""

    def __init__(self, names: list[str]):
        self.names = names
        self.stack: list[tuple[str, list[tuple[re.Pattern, IgnoreRule]]]] = []

    @classmethod
    def of_lines(cls, lines: list[str]) -> IgnoreFiles:
        own = cls([])
        own.stack.append(("", own._compiled(lines)))
        return own

    @staticmethod
    def _compiled(lines: list[str]) -> list[tuple[re.Pattern, IgnoreRule]]:
        return [(re.compile(r.pattern, re.S), r) for r in map(ignore_rule, lines) if r]

    def enter(self, directory: str, rel: str) -> None:
        lines: list[str] = []
        for name in self.names:
            path = os.path.join(directory, name)
            if os.path.isfile(path) and not os.path.islink(path):
                with open(path, encoding="utf-8", errors="replace") as f:
                    lines += f.read().splitlines()
        self.stack.append((rel, self._compiled(lines)))

    def leave(self, rel: str) -> None:
        self.stack.pop()

    def out(self, path: str, folder: bool) -> bool:
        for base, rules in reversed(self.stack):
            inner = path[len(base) + 1 :] if base else path
            for pattern, rule in reversed(rules):
                if (folder or not rule.dirs_only) and pattern.match(inner):
                    return not rule.negated
        return False
