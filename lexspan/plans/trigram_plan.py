"""From a pattern to a necessary condition over trigrams, and from that to candidates.

A pattern is outlined bottom-up: an outline is a set of skeletons, and a skeleton is a row of
byte runs with gaps of anything between them, so ``foo.*ba[rz]`` has the skeletons
``foo…bar`` and ``foo…baz``. Whatever matches reads like one of the skeletons. An outline that
grows too large gives what it knows as a clause and goes on as a gap.

The condition is a list of clauses, all of which must hold; a clause is a set of options, one
of which must hold; an option is a set of trigrams, all of which a document must have. It may
be weaker than the pattern, never stronger: it only narrows which documents are read.

Candidates come from one pass over the postings: rows of the trigrams in question, one
aggregation per document that notes which of them it has, and the condition as a boolean over
those notes.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import product
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.regex_dialect import Chars, Choice, Empty, Parsed, Repeat, Sequence
from ..functions.trigrams import fold, next_bit, pack

#: Skeletons of an outline, characters of a class that is spelled out, and repeats of a part
#: that are written out. Every trigram asked for becomes a column of the aggregation.
MOST_SKELETONS, MOST_CHARS, MOST_REPEATS = 100, 24, 3


@dataclass(frozen=True)
class Gram:
    """A trigram, and the byte that must be able to follow it."""

    tri: int
    after: int | None = None


Option = frozenset[Gram]
Clause = frozenset[Option]

#: Runs of bytes with gaps between them; the first and last run touch what stands beside the part.
Skeleton = tuple[bytes, ...]
NOTHING: Skeleton = (b"",)
GAP: Skeleton = (b"", b"")


@dataclass(frozen=True)
class Outline:
    skeletons: frozenset[Skeleton]
    clauses: tuple[Clause, ...] = ()


def _joined(a: Skeleton, b: Skeleton) -> Skeleton:
    return (*a[:-1], a[-1] + b[0], *b[1:])


class _Outliner:
    def __init__(self, ci: bool):
        self.ci = ci

    def option(self, s: Skeleton) -> Option:
        """The trigrams of a skeleton's runs, each with its next byte. Without regard to case,
        bytes beyond ASCII may differ in the text, so nothing is asked of them."""
        firm = lambda x: not self.ci or x < 0x80
        return frozenset(Gram(pack(run[i : i + 3]), run[i + 3] if i + 3 < len(run) and firm(run[i + 3]) else None) for run in s for i in range(len(run) - 2) if all(map(firm, run[i : i + 3])))

    def clause(self, skeletons: frozenset[Skeleton]) -> Clause:
        """One option for each skeleton; an option that asks for more than another is implied."""
        options = {self.option(s) for s in skeletons}
        return frozenset(o for o in options if not any(p < o for p in options))

    def closed(self, o: Outline) -> Outline:
        """A gap that remembers what the outline asked for."""
        c = self.clause(o.skeletons)
        return Outline(frozenset([GAP]), o.clauses if frozenset() in c else (*o.clauses, c))

    def then(self, a: Outline, b: Outline) -> Outline:
        if len(a.skeletons) * len(b.skeletons) > MOST_SKELETONS:
            if len(a.skeletons) >= len(b.skeletons):
                a = self.closed(a)
            else:
                b = self.closed(b)
        return Outline(frozenset(_joined(x, y) for x, y in product(a.skeletons, b.skeletons)), (*a.clauses, *b.clauses))

    def either(self, parts: list[Outline]) -> Outline:
        skeletons = frozenset().union(*(p.skeletons for p in parts))
        if not any(p.clauses for p in parts) and len(skeletons) <= MOST_SKELETONS:
            return Outline(skeletons)
        # one clause of each part speaks for it, the one with the fewest options
        told = [[c for c in (*p.clauses, self.clause(p.skeletons)) if frozenset() not in c] for p in parts]
        if not all(told):
            return Outline(frozenset([GAP]))
        return Outline(frozenset([GAP]), (frozenset().union(*(min(t, key=lambda c: (len(c), sorted(map(sorted_grams, c)))) for t in told)),))

    def outline(self, node: object) -> Outline:
        if isinstance(node, Empty):
            return Outline(frozenset([NOTHING]))
        if isinstance(node, Chars):
            if node.ranges is None or sum(b - a + 1 for a, b in node.ranges) > MOST_CHARS:
                return Outline(frozenset([GAP]))
            return Outline(frozenset((fold(chr(c).encode()),) for a, b in node.ranges for c in range(a, b + 1) if not 0xD800 <= c <= 0xDFFF))
        if isinstance(node, Sequence):
            return reduce(self.then, map(self.outline, node.parts), Outline(frozenset([NOTHING])))
        if isinstance(node, Choice):
            return self.either([self.outline(p) for p in node.parts])
        assert isinstance(node, Repeat)
        if node.least == 0 and node.most != 1:
            return Outline(frozenset([NOTHING if node.most == 0 else GAP]))
        one = self.outline(node.part)
        if node.least == 0:
            return self.either([Outline(frozenset([NOTHING])), one])
        written = reduce(self.then, [one] * min(node.least, MOST_REPEATS))
        if node.least == node.most and node.least <= MOST_REPEATS:
            return written
        return self.then(written, Outline(frozenset([GAP])))


def sorted_grams(option: Option) -> list[tuple[int, int]]:
    return sorted((g.tri, -1 if g.after is None else g.after) for g in option)


@dataclass(frozen=True)
class Plan:
    """Clauses in a fixed order; none of them asks for nothing."""

    clauses: tuple[Clause, ...] = ()

    def grams(self) -> list[Gram]:
        """The distinct trigrams that are asked for."""
        every = frozenset().union(*(o for c in self.clauses for o in c)) if self.clauses else frozenset()
        return sorted(every, key=lambda g: (g.tri, -1 if g.after is None else g.after))

    def holds(self, has) -> object:
        """The condition over ``has(gram)``, which gives Columns."""
        return reduce(and_, [reduce(or_, [reduce(and_, [has(g) for g in sorted(o, key=lambda g: (g.tri, str(g.after)))]) for o in sorted(c, key=sorted_grams)]) for c in self.clauses])

    def met_by(self, masks: dict[int, int]) -> bool:
        """The same for one document's trigrams and masks."""
        ok = lambda g: g.tri in masks and (g.after is None or masks[g.tri] & next_bit(g.after) != 0)
        return all(any(all(map(ok, o)) for o in c) for c in self.clauses)


def plan(parsed: Parsed, ci: bool = False) -> Plan:
    outliner = _Outliner(ci)
    o = outliner.closed(outliner.outline(parsed.tree))
    return Plan(tuple(sorted(set(o.clauses), key=lambda c: sorted(map(sorted_grams, c)))))


def candidates(postings: DataFrame, p: Plan) -> DataFrame | None:
    """``doc_id`` of documents that meet the plan; None stands for all of them."""
    asked = p.grams()
    if not asked:
        return None
    note = {g: f"b{i}" for i, g in enumerate(asked)}

    def has(g: Gram) -> Column:
        same = F.col("tri") == g.tri
        return same if g.after is None else same & (F.col("mask").bitwiseAND(F.lit(next_bit(g.after))) != 0)

    rows = postings.where(F.col("tri").isin(sorted({g.tri for g in asked})))
    noted = rows.groupBy("doc_id").agg(*[F.max(has(g)).alias(n) for g, n in note.items()])
    return noted.where(p.holds(lambda g: F.col(note[g]))).select("doc_id")
