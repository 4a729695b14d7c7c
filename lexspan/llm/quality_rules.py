"""Quality rules, line first.

Rules for punctuation, navigation and boilerplate look at each line; lines that fail go.
A document is rejected if its base counts fail or if the lines that went hold too much of
its words. All in SQL functions, one pass, no shuffle: windows of eight words are hashed in
place, and only a text in which a hash repeats is sorted to find the words that the repeated
windows cover.

A null text has no words and no lines; it and an empty text fail the base rule (fewer than
20 words). Columns besides ``text`` pass through ``apply_rules``; names starting with
``_qr_`` are reserved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import words

SYMBOLS = "#*$%&|<>"
WINDOW_WORDS = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: A document that loses more than this part of its words with its failed lines is rejected.
MAX_LOST = 0.5

#: A line of prose ends in one of these, perhaps before closing quotes or brackets and space.
ENDS = r"""[.!?:;,…。]["'”’»)\]]*[ \t\r\x0B\x0C]*$"""
#: A character of a word.
SOLID = r"[^\x20\x09-\x0D]"
#: Fixed phrases of boilerplate, compared without case.
BOILERPLATE = [
    "all rights reserved",
    "cookie policy",
    "accept cookies",
    "privacy policy",
    "terms of use",
    "terms of service",
    "enable javascript",
    "javascript is disabled",
    "lorem ipsum",
    "click here",
    "read more",
    "sign up",
    "log in",
    "subscribe to our newsletter",
    "share this",
    "licensed under",
    "released under the",
    "general public license",
    "tous droits réservés",
    "politique de confidentialité",
    "mentions légales",
    "lire la suite",
    "cliquez ici",
    "alle rechte vorbehalten",
    "datenschutzerklärung",
    "impressum",
    "weiterlesen",
    "hier klicken",
    "todos los derechos reservados",
    "política de privacidad",
    "aviso legal",
    "leer más",
    "haga clic aquí",
]
#: Columns that the rules add; input columns of these names are replaced.
OWN = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_failed_lines", "n_lost_words", "cleaned", "base_failed", "kept"]
#: A line of more words than this is prose whatever it ends in.
LONG_LINE = 40


def _lines(text: Column) -> Column:
    """Lines that hold a word."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: F.rlike(x, F.lit(SOLID)))


def _symbols(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"[{SYMBOLS}]"))


def line_fails(line: Column, n: Column) -> Column:
    """Whether a line of ``n`` words breaks a rule. Punctuation: a line of 4 to 40 words without
    an end mark, or with a symbol for every fifth word, or all in capitals with shouting
    marks. Navigation: bars, arrows or bullets between items. Boilerplate: a fixed phrase in a
    line of under 20 words."""
    no_end = (n >= 4) & (n <= LONG_LINE) & ~F.rlike(line, F.lit(ENDS))
    symbols = (n > 1) & (_symbols(line) * 5 > n)
    shouting = (n >= 4) & F.contains(line, F.lit("!!")) & (F.upper(line) == line) & (F.lower(line) != line)
    navigation = F.rlike(line, F.lit(r"(?:\s[|»›•>]\s.*){2}"))
    boilerplate = (n < 20) & F.rlike(F.lower(line), F.lit("|".join(BOILERPLATE)))
    return no_end | symbols | shouting | navigation | boilerplate


def apply_rules(docs: DataFrame) -> DataFrame:
    """``docs`` with the base counts, ``base_failed``, ``n_failed_lines``, ``n_lost_words``,
    ``cleaned`` (the text without failed lines) and ``kept``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.withColumn("_qr_words", words(F.col("text")))
    d = d.withColumn("n_words", F.size("_qr_words").cast("long"))
    hashes = F.when(F.col("n_words") > WINDOW_WORDS, F.transform(F.sequence(F.lit(1), F.size("_qr_words") - (WINDOW_WORDS - 1)), lambda i: F.xxhash64(F.slice(F.col("_qr_words"), i, WINDOW_WORDS)))).otherwise(F.array().cast("array<bigint>"))
    d = d.withColumn("_qr_hashes", hashes)
    # only where a hash repeats: (hash, place) sorted, so that equal hashes are neighbours
    twice = F.size(F.array_distinct("_qr_hashes")) < F.size("_qr_hashes")
    placed = F.when(twice, F.array_sort(F.transform("_qr_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    d = d.withColumn("_qr_sorted", placed).drop("_qr_hashes")
    s = F.col("_qr_sorted")
    beside = lambda i, k: (i + k >= 0) & (i + k < F.size(s)) & (F.get(s, i + k)["h"] == F.get(s, i)["h"])
    starts = F.when(s.isNotNull(), F.array_sort(F.transform(F.filter(s, lambda x, i: beside(i, -1) | beside(i, 1)), lambda x: x["i"])))
    d = d.withColumn("_qr_starts", starts).drop("_qr_sorted")
    p = F.col("_qr_starts")
    # each window covers eight words from its start, less what the next one covers
    covered = F.aggregate(F.transform(p, lambda x, i: F.least(F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW_WORDS)), F.lit(WINDOW_WORDS))), F.lit(0), lambda a, x: a + x)
    d = d.withColumn("_qr_lines", F.transform(F.transform(_lines(F.col("text")), lambda x: F.struct(x.alias("line"), F.size(words(x)).alias("n"))), lambda x: F.struct(x["line"].alias("line"), x["n"].alias("n"), line_fails(x["line"], x["n"]).alias("fails"))))
    failed = F.filter("_qr_lines", lambda x: x["fails"])
    d = d.select(
        *[F.col(f"`{c}`") for c in docs.columns if c not in OWN],
        "n_words",
        F.regexp_count(text, F.lit(SOLID)).cast("long").alias("word_chars"),
        _symbols(text).cast("long").alias("n_symbols"),
        (F.size("_qr_lines") - F.size(F.array_distinct(F.transform("_qr_lines", lambda x: x["line"])))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size(failed).cast("long").alias("n_failed_lines"),
        F.aggregate(failed, F.lit(0), lambda a, x: a + x["n"]).cast("long").alias("n_lost_words"),
        F.array_join(F.transform(F.filter("_qr_lines", lambda x: ~x["fails"]), lambda x: x["line"]), "\n").alias("cleaned"),
    )
    d = d.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))
    return d.withColumn("kept", ~F.col("base_failed") & (F.col("n_lost_words") <= MAX_LOST * F.col("n_words")))


_SQL_BOILERPLATE = "|".join(BOILERPLATE)
_SQL_ENDS = ENDS.replace("'", "''")
ORACLE = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
h AS (SELECT doc_id, unnest(range(1, len(w) - 6)) AS i, w FROM d WHERE len(w) > 8),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS win FROM h),
r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM g),
c AS (SELECT doc_id, least(8, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 8)) AS covers FROM r WHERE n > 1),
cov AS (SELECT doc_id, CAST(sum(covers) AS BIGINT) AS n_repeat_words FROM c GROUP BY doc_id),
u AS (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS pos FROM d),
v AS (SELECT doc_id, line, pos, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n,
             length(line) - length(translate(line, '{SYMBOLS}', '')) AS sym,
             line AS trimmed FROM u),
f AS (SELECT *, (n >= 4 AND n <= {LONG_LINE} AND NOT regexp_matches(trimmed, '{_SQL_ENDS}'))
             OR (sym * 5 > n AND n > 1)
             OR (n >= 4 AND upper(line) = line AND lower(line) <> line AND contains(line, '!!'))
             OR regexp_matches(line, '(?:\s[|»›•>]\s.*){{2}}')
             OR (n < 20 AND regexp_matches(lower(line), '{_SQL_BOILERPLATE}')) AS fails FROM v),
a AS (SELECT doc_id, count(*) FILTER (fails) AS n_failed_lines, coalesce(sum(n) FILTER (fails), 0) AS n_lost_words,
             coalesce(length(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT fails)), 0) AS cleaned_chars FROM f GROUP BY doc_id),
b AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
             CAST(length(text) - length(translate(text, '{SYMBOLS}', '')) AS BIGINT) AS n_symbols,
             CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
             CAST(coalesce(n_failed_lines, 0) AS BIGINT) AS n_failed_lines, CAST(coalesce(n_lost_words, 0) AS BIGINT) AS n_lost_words,
             CAST(coalesce(cleaned_chars, 0) AS BIGINT) AS cleaned_chars
      FROM d LEFT JOIN cov ON cov.doc_id = d.doc_id LEFT JOIN a ON a.doc_id = d.doc_id),
e AS (SELECT *, (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) AS base_failed FROM b)
SELECT *, NOT base_failed AND n_lost_words <= {MAX_LOST} * n_words AS kept FROM e
"""
