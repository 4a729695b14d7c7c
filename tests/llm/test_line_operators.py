import re
from collections import Counter, defaultdict

from lexspan.llm import line_dedup, quality_rules

from .helpers import DOCS, awkward, doc, sentence

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_dedup(rows, min_sites):
    sites, first = defaultdict(set), {}
    for i, text, _, source, *_ in rows:
        for pos, line in enumerate((text or "").split("\n")):
            t = line.replace("\t", " ").strip(" ")
            if not t:
                continue
            if source is not None:
                sites[t].add(source)
    bad = {t for t, s in sites.items() if len(s) >= min_sites}
    for i, text, *_ in sorted((r for r in rows if r[1] is not None), key=lambda r: (r[0] is None, r[0] or 0)):
        for pos, line in enumerate(text.split("\n")):
            t = line.replace("\t", " ").strip(" ")
            if t in bad:
                first.setdefault(t, (i, text, pos))
    out = []
    for i, text, *_ in rows:
        if text is None:
            out.append((i, None))
            continue
        kept = [line for pos, line in enumerate(text.split("\n")) if (t := line.replace("\t", " ").strip(" ")) not in bad or first[t] == (i, text, pos)]
        out.append((i, "\n".join(kept)))
    return Counter(out)


def test_line_dedup_matches_brute_force(spark):
    rows = awkward(sentence)
    foot, near = "Same on every site.", "On nine sites only."
    for k in range(14):
        rows.append(doc(200 + k, f"{sentence(50 + k)}\n{foot}\n\t{near if k < 9 else 'x' + str(k)}\n", f"site{k}"))
    rows.append(doc(300, foot, None))
    got = line_dedup.line_dedup(spark.createDataFrame(rows, DOCS))
    assert got.columns == [f.name for f in DOCS] + ["n_lines", "n_removed"]
    found = Counter((r["doc_id"], r["text"]) for r in got.collect())
    assert found == brute_dedup(rows, line_dedup.MIN_SITES)
    assert sum(foot in (t or "") for (_, t), n in found.items() for _ in range(n)) == 1
    assert sum(near in (t or "") for (_, t), n in found.items() for _ in range(n)) == 9


def test_line_dedup_empty(spark):
    assert line_dedup.line_dedup(spark.createDataFrame([], DOCS)).count() == 0


def brute_base(text):
    words = WORD.findall(text or "")
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = set()
    for i in range(len(words) - 7):
        if windows[tuple(words[i : i + 8])] > 1:
            covered.update(range(i, i + 8))
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_quality_rules_base_counts(spark):
    rows = awkward(sentence)
    block = " ".join(f"w{k}" for k in range(11))
    rows.append(doc(400, f"{block} x {block} y {block[:20]} {block}\n{block}\n"))
    rows.append(doc(401, "a " * 60))
    rows.append(doc(402, "b # $ % & | < > * ünï code x"))
    got = quality_rules.apply_rules(spark.createDataFrame(rows, DOCS)).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert Counter((r["doc_id"], *(r[n] for n in names)) for r in got) == Counter((r[0], *brute_base(r[1])) for r in rows)
    for r in got:
        n, _, _, _, repeat = (r[x] for x in names)
        assert r["base_failed"] == (n < 20 or 100 * repeat > 30 * n)
        assert not (r["base_failed"] and r["kept"])


def test_quality_rules_verdicts(spark):
    prose = "\n".join(sentence(k) for k in range(4))
    menu = "\n".join(["Home | News | About | Contact | Help"] * 2 + ["Products | Prices | Offers | Shops | Jobs"])
    rows = [doc(1, prose), doc(2, f"{prose}\nAll rights reserved."), doc(3, f"{menu}\n{menu.replace('News', 'Blog')}\n{sentence(1)[:40]}."), doc(4, "\n".join(sentence(k).rstrip(".") + " &&& ### $$$ %%% ***" * 3 for k in range(4)))]
    got = {r["doc_id"]: r for r in quality_rules.apply_rules(spark.createDataFrame(rows, DOCS)).collect()}
    assert [got[i]["kept"] for i in (1, 2, 3, 4)] == [True, True, False, False]
    assert got[2]["cleaned"] == prose
    assert got[1]["n_failed_lines"] == 0
    assert quality_rules.apply_rules(spark.createDataFrame([], DOCS)).count() == 0


def test_many_boilerplate_lines_in_one_text(spark):
    """A text of very many lines that all stand on ten sites: time grows with its lines."""
    import time

    lines = [f"line number {k} of the notice" for k in range(30_000)]
    rows = [doc(i, "\n".join(lines), f"s{i}") for i in range(11)]
    began = time.time()
    got = line_dedup.line_dedup(spark.createDataFrame(rows, DOCS)).select("doc_id", "text", "n_lines", "n_removed").collect()
    assert time.time() - began < 60
    assert {r["doc_id"]: r["n_removed"] for r in got} == {i: 0 if i == 0 else 30_000 for i in range(11)}
    assert all(r["n_lines"] == 30_000 and r["text"] == ("\n".join(lines) if r["doc_id"] == 0 else "") for r in got)


def test_rules_replace_clashing_names(spark):
    d = spark.createDataFrame([(1, "All rights reserved\n" + sentence(1), "x", "y", "z")], "doc_id long, text string, cleaned string, kept string, base_failed string")
    r = quality_rules.apply_rules(d).collect()
    assert len(r) == 1 and r[0]["kept"] is True and r[0]["cleaned"] == sentence(1) and r[0]["base_failed"] is False


def test_boilerplate_in_four_languages(spark):
    notes = ["Tous droits réservés à la rédaction.", "Alle Rechte vorbehalten.", "Todos los derechos reservados.", "All rights reserved."]
    d = spark.createDataFrame([(k, n + "\n" + sentence(k)) for k, n in enumerate(notes)], "doc_id long, text string")
    assert [r["n_failed_lines"] for r in quality_rules.apply_rules(d).orderBy("doc_id").collect()] == [1, 1, 1, 1]
