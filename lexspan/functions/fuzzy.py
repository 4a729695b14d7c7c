"""A documented fuzzy score for paths.

The query's characters must occur in order (letters without regard to case or accents, so
long as the query itself has none). Each matched character earns 16; one right after the one
before it earns 8 more, one at the start of a word or component 8 more, one in the last
component 2 more; every gap costs 3 and each further skipped character of it 1. The score is
the best over all placements. A query of several words wants each of them, scores add up;
``!word`` wants it absent, ``^word`` at the start, ``word$`` at the end, ``'word`` in one piece.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

HIT, JOINED, START, LAST, GAP, SKIP = 16, 8, 8, 2, 3, 1


def _plain(s: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", s) if not unicodedata.combining(c))


def _best(path: str, word: str) -> int | None:
    """The best placement of a word's characters, by a table over (matched, place)."""
    n = len(path)
    if len(word) > n:
        return None
    last = path.rfind("/") + 1
    none = -(10**9)
    # ended[j]: best score with the characters so far matched, the last of them at j
    ended = [none] * n
    for i, ch in enumerate(word):
        nxt, carry = [none] * n, none
        for j in range(n):
            if j and ended[j - 1] > none:
                carry = max(carry - SKIP, ended[j - 1] - GAP) if carry > none else ended[j - 1] - GAP
            elif carry > none:
                carry -= SKIP
            if path[j] != ch:
                continue
            own = HIT + (START if j == 0 or not path[j - 1].isalnum() else 0) + (LAST if j >= last else 0)
            if i == 0:
                nxt[j] = own
            else:
                joined = ended[j - 1] + JOINED if j and ended[j - 1] > none else none
                before = max(joined, carry)
                if before > none:
                    nxt[j] = own + before
        ended = nxt
    top = max(ended, default=none)
    return top if top > none else None


def score(path: str, query: str) -> int | None:
    """The score, or None if the path doesn't match."""
    low = path.lower()
    total = 0
    for word in query.lower().split():
        absent, start, piece = word.startswith("!"), word.startswith("^"), word.startswith("'")
        end = word.endswith("$") and len(word) > 1
        body = word[1:] if absent or start or piece else word
        body = body[:-1] if end else body
        if not body:
            continue
        text = low if _plain(body) != body else _plain(low)
        if absent or start or end or piece:
            found = text.startswith(body) if start else text.endswith(body) if end else body in text
            if start and end:
                found = text == body
            if found == absent:
                return None
            total += 0 if absent else (HIT + JOINED) * len(body)
            continue
        got = _best(text, body)
        if got is None:
            return None
        total += got
    return total


def fuzzy_score(rel: Column, query: str) -> Column:
    """The score of each path as a nullable int, in Arrow batches."""

    @F.pandas_udf("int")
    def each(paths: pd.Series) -> pd.Series:
        return paths.map(lambda p: None if p is None else score(p, query)).astype("Int32")

    return each(rel)
