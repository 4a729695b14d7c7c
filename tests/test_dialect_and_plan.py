import re

import pytest

from lexspan.functions import regex_dialect as rd
from lexspan.functions import trigrams
from lexspan.plans.trigram_plan import Gram, Plan, plan


def t(text):
    b = text.encode()
    return Gram(trigrams.pack(b[:3]), b[3] if len(b) > 3 else None)


def asks(*clauses):
    """Clauses of options of trigrams."""
    return {frozenset(frozenset(map(t, option)) for option in c) for c in clauses}


def planned(pattern, ci=False):
    return plan(rd.parse(pattern, ci), ci)


@pytest.mark.parametrize(
    "pattern, ci, want",
    [
        ("abcd", False, asks([["abcd", "bcd"]])),
        ("ABcD", True, asks([["abcd", "bcd"]])),
        ("abc|xyz", False, asks([["abc"], ["xyz"]])),
        ("ab", False, set()),
        ("a.*b", False, set()),
        ("(abc)?", False, set()),
        ("(abc)*", False, set()),
        ("(abc)+", False, asks([["abc"]])),
        ("foo.*bar", False, asks([["foo", "bar"]])),
        ("ab[cd]", False, asks([["abc"], ["abd"]])),
        (r"\bfoo\b", False, asks([["foo"]])),
        ("x[a-z]yz", False, set()),
        # an option that asks for more than another is implied by it
        ("foo|foo.*bar", False, asks([["foo"]])),
        ("(foo.*ba[rz]|xyz)q", False, asks([["foo", "barq", "arq"], ["foo", "bazq", "azq"], ["xyzq", "yzq"]])),
    ],
)
def test_plans(pattern, ci, want):
    assert set(planned(pattern, ci).clauses) == want


def test_outlines_that_grow_too_large_keep_what_they_know():
    """Eleven classes of ten make 10^11 strings: neighbours' trigrams are asked for in clauses."""
    p = planned("needle" + "[0-9]" * 11 + "haystack")
    grams = {g.tri for c in p.clauses for o in c for g in o}
    assert 1 < len(p.clauses) and len(p.grams()) < 2000 and {trigrams.pack(b"nee"), trigrams.pack(b"hay")} <= grams
    assert planned("(?:[0-9]{11}|" + "[a-z0-9]" * 9 + ")") == Plan()


@pytest.mark.parametrize("pattern", ["(", "[", "a{2,1}", "*a", "(?=a)", "(?<!a)", r"\1", r"a\q", "[z-a]", "[a--b]", "(?P<n>a)(?P<n>b)", "a)", "[]", r"\p{Nope_x}", "a{,3}"])
def test_rejected(pattern):
    with pytest.raises(rd.PatternError):
        rd.parse(pattern)


CORPUS = ["foo bar", "FOO.bar", "foo\nbar", "été", "ÉTÉ", "abcabc", "abd xyz", "straße", "kelvin K", "line_1 = 42;", "", "ab", "αβγ ΑΒΓ", "a" * 50, "tion and", "x\ty", "The (quick) [brown] {fox}"]
PATTERNS = ["foo", "foo.bar", "(?:foo|ab[cd])+.*", "a{2}b?", "(?:ab|[a-z]bc){2,}", "[a-f][a-f][a-f]", "(?:tion|[0-9]{2};) ?(?:and)?", r"foo\.bar", "ab[cd]", "(abc)+", "été", "[éè]t", "straße|bar", r"\w+_\d+", r"^The \(", "a{3,}", "k", "αβ", r"x\ty", "(?i)FOO", "(?i:foo).bar", r"[[:alpha:]]+_", r"\p{Greek}+", "b?an?d", r"[^a-z ]\w"]


@pytest.mark.parametrize("ci", [False, True])
def test_index_is_sound_and_java_agrees_with_python(spark, ci):
    """No document that matches may be left out by its plan."""
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(i, x) for i, x in enumerate(CORPUS)], "i int, x string")
    masks = [dict(zip(*map(list, trigrams.extract(x.encode())))) for x in CORPUS]

    for pattern in PATTERNS:
        parsed = rd.parse(pattern, ci)
        p = plan(parsed, ci)
        got = {r["i"] for r in docs.where(F.exists(F.split("x", "\n"), lambda z: F.rlike(z, F.lit(parsed.java)))).collect()}
        if "[:" not in pattern and "\\p" not in pattern:
            own = re.compile(pattern, re.I if ci else 0)
            assert got == {i for i, x in enumerate(CORPUS) if any(own.search(z) for z in x.split("\n"))} or "k" in pattern, pattern
        for i in got:
            assert p.met_by(masks[i]), (pattern, CORPUS[i])
            literal = rd.required_literal(parsed.tree)
            assert literal in CORPUS[i], (pattern, literal)


def test_unicode_case(spark):
    from pyspark.sql import functions as F

    for text, pattern in (("ΑΒΓ", "αβγ"), ("K", "k"), ("ſ", "S"), ("É", "é")):
        assert spark.range(1).select(F.rlike(F.lit(text), F.lit(rd.parse_literal(pattern, True).java))).first()[0]


def test_masks_reject_what_does_not_follow():
    """The byte after a trigram must be one that the pattern allows."""
    p = plan(rd.parse_literal("updateavailable", True), True)
    first, second = (dict(zip(*map(list, trigrams.extract(x)))) for x in (b"update; available", b"updateAvailable"))
    assert not p.met_by(first) and p.met_by(second)


def test_extract_against_plain_loop():
    r = __import__("random").Random(1)
    for n in [0, 1, 2, 3, 4, 50, 3000]:
        data = bytes(r.choice(b"abAB\n\xc3\xa9") for _ in range(n))
        want, low = {}, trigrams.fold(data)
        for i in range(n - 2):
            k = trigrams.pack(low[i : i + 3])
            want[k] = want.get(k, 0) | (trigrams.next_bit(low[i + 3]) if i + 3 < n else 0)
        tri, mask = trigrams.extract(data)
        assert dict(zip(tri.tolist(), mask.tolist())) == want and sorted(tri.tolist()) == tri.tolist()
