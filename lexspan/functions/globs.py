"""Globs and ignore lines as regular expressions over relative paths.

Everything here compiles to one Java-compatible pattern per line, so path filters run as
``rlike`` inside the scan stage.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPECIAL = set("\\.^$|()[]{}+*?&~#-")


def _quoted(ch: str) -> str:
    return "\\" + ch if ch in _SPECIAL else ch


def glob_to_regex(glob: str) -> str:
    """The body of a pattern for one glob: ``*`` and ``?`` stay within a component, ``**``
    crosses them, classes and ``{a,b}`` work as usual, a backslash quotes."""
    out, i, depth = [], 0, 0
    while i < len(glob):
        ch = glob[i]
        if ch == "*":
            n = i
            while n < len(glob) and glob[n] == "*":
                n += 1
            whole = n - i == 2 and (i == 0 or glob[i - 1] == "/") and (n == len(glob) or glob[n] == "/")
            if whole and n < len(glob):
                out.append("(?:.*/)?")
                n += 1
            elif whole:
                out.append(".*" if i == 0 else ".+")
            else:
                out.append("[^/]*")
            i = n
            continue
        if ch == "?":
            out.append("[^/]")
        elif ch == "[":
            end = glob.find("]", i + 2 if i + 1 < len(glob) and glob[i + 1] not in "!^" else i + 3)
            if end < 0:
                raise ValueError(f"unclosed character class in glob {glob!r}")
            body = glob[i + 1 : end]
            negate = body[:1] in ("!", "^")
            body = body[1:] if negate else body
            # a class never matches a slash
            out.append("(?!/)[" + ("^" if negate else "") + "".join("\\" + c if c in "\\[]^&~" else c for c in body) + "]")
            i = end
        elif ch == "{":
            depth += 1
            out.append("(?:")
        elif ch == "}" and depth:
            depth -= 1
            out.append(")")
        elif ch == "," and depth:
            out.append("|")
        elif ch == "\\":
            i += 1
            if i == len(glob):
                raise ValueError(f"dangling backslash in glob {glob!r}")
            out.append(_quoted(glob[i]))
        else:
            out.append(_quoted(ch))
        i += 1
    if depth:
        raise ValueError(f"unclosed brace in glob {glob!r}")
    return "".join(out)


@dataclass(frozen=True)
class IgnoreRule:
    """One ignore line: the pattern over a path, whether it re-includes, and whether it
    holds for directories alone."""

    pattern: str
    negated: bool
    dirs_only: bool


def ignore_rule(line: str) -> IgnoreRule | None:
    """Compiles a line in gitignore syntax; comments and blank lines give None."""
    if line.startswith("#"):
        return None
    while line.endswith(" ") and not line.endswith("\\ "):
        line = line[:-1]
    negated = line.startswith("!")
    line = line[1:] if negated else line
    dirs_only = line.endswith("/")
    line = line.rstrip("/") if dirs_only else line
    if not line:
        return None
    anchored = "/" in line
    body = glob_to_regex(line.lstrip("/") if line.startswith("/") else line)
    return IgnoreRule(f"^{'' if anchored else '(?:.*/)?'}{body}$", negated, dirs_only)


def ignored(rel: Column, lines: list[str]) -> Column:
    """Whether ignore lines leave a file out: for the file and each directory above it the
    last matching line decides, and a file under a directory that is out can't come back."""
    rules = [r for r in map(ignore_rule, lines) if r]
    if not rules:
        return F.lit(False)

    def out(path: Column, is_dir: bool) -> Column:
        decided = F.lit(False)
        for r in rules:
            if is_dir or not r.dirs_only:
                decided = F.when(F.rlike(path, F.lit(r.pattern)), F.lit(not r.negated)).otherwise(decided)
        return decided

    if not any(r.negated for r in rules):
        # without exceptions any match of any line suffices: two patterns over the path do
        either = "|".join(f"(?:{r.pattern[:-1]}(?:/.*)?$)" for r in rules if not r.dirs_only)
        dirs = "|".join(f"(?:{r.pattern[:-1]}/.*$)" for r in rules if r.dirs_only)
        found = [F.rlike(rel, F.lit(p)) for p in (either, dirs) if p]
        return found[0] if len(found) == 1 else found[0] | found[1]
    parts = F.split(rel, "/")
    parents = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/"))
    above = F.exists(F.slice(parents, 1, F.size(parents) - 1), lambda p: out(p, True))
    return F.when(F.size(parts) > 1, above).otherwise(F.lit(False)) | out(rel, False)


def secret(rel: Column, lines: list[str]) -> Column:
    """Whether any component of a path matches a secret pattern, without regard to case."""
    bodies = "|".join(f"(?:{glob_to_regex(x.rstrip('/'))})" for x in lines)
    return F.rlike(rel, F.lit(f"(?i)(?:^|/)(?:{bodies})(?:/|$)"))


def overrides(rel: Column, globs: list[str]) -> Column:
    """Search globs: a plain glob keeps its matches and drops all else, ``!glob`` drops its
    matches, the last match wins. A glob without a slash holds at any depth."""
    if not globs:
        return F.lit(True)
    kept = F.lit(not any(not g.startswith("!") for g in globs))
    for g in globs:
        rule = ignore_rule(g[1:] if g.startswith("!") else g)
        if rule is None:
            continue
        pattern = rule.pattern[:-1] + "/.*$" if rule.dirs_only else rule.pattern
        kept = F.when(F.rlike(rel, F.lit(pattern)), F.lit(not g.startswith("!"))).otherwise(kept)
    return kept
