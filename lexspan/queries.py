"""Queries over the driver's tables, one per operator family, and the same as SQL.

The table ``documents`` stands for a corpus: unit = source, path = lang/doc_id.txt.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import ITEM_OVERHEAD, SECRET_EXCLUDES, Config
from .functions.globs import ignored, secret
from .functions.regex_dialect import parse_literal
from .functions.trigrams import next_bit
from .operators import coverage, files, index, lookup, maintenance, search
from .operators.search import Search
from .plans import trigram_plan
from .sources import corpus
from .streaming import freshness

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: A fixed "now" for scores that fade with age: 2024-02-01 in milliseconds.
NOW_MS = 1_706_745_600_000
#: Word characters for engines whose \b is ASCII.
_WORD = r"[\p{L}\p{M}\p{N}_]"
# A line as an answer shows it: 2,000 bytes at most, with a mark for a character cut in two.
_FIT = "left(text, list_max(list_filter(range(500, 2001), lambda i: strlen(left(text, i)) <= 2000)))"
_SHOWN = f"CASE WHEN strlen(text) <= 2000 THEN text WHEN strlen({_FIT}) < 2000 THEN {_FIT} || chr(65533) ELSE {_FIT} END"
_LINES = """
c AS (SELECT doc_id, source AS unit, lang || '/' || doc_id || '.txt' AS rel, text AS content FROM documents),
s AS (SELECT *, string_split(content, chr(10)) AS parts FROM c),
l AS (SELECT doc_id, unit, rel, CAST(unnest(range(1, len(parts) + 1)) AS BIGINT) AS line, unnest(parts) AS text FROM s)
"""


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _lines(spark: SparkSession, sf_dir: str, s: Search) -> DataFrame:
    found = search.line_matches(corpus.documents(spark, sf_dir), s)
    return found.select(search.path_of().alias("path"), "line", "text")


@query(f"WITH {_LINES} SELECT unit || '/' || rel AS path, line, {_SHOWN} AS text FROM l WHERE contains(text, 'tion and')")
def search_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir, Search("tion and"))


@query(f"WITH {_LINES} SELECT unit || '/' || rel AS path, line, {_SHOWN} AS text FROM l WHERE regexp_matches(text, '(?i)ÇON')")
def search_literal_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir, Search("çON", ci=True))


@query(f"WITH {_LINES} SELECT unit || '/' || rel AS path, line, {_SHOWN} AS text FROM l WHERE regexp_matches(text, '(^|[^\\p{{L}}\\p{{M}}\\p{{N}}_])th{_WORD}+tion([^\\p{{L}}\\p{{M}}\\p{{N}}_]|$)')")
def search_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir, Search(r"\bth\w+tion\b", regex=True))


@query(f"WITH {_LINES} SELECT unit || '/' || rel AS path, line, {_SHOWN} AS text FROM l WHERE regexp_matches(text, '(?i)^(all|licen[sc]ed|released) .*\\.$')")
def search_regex_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir, Search(r"^(all|licen[sc]ed|released) .*\.$", regex=True, ci=True))


@query(f"WITH {_LINES} SELECT DISTINCT unit || '/' || rel AS path FROM l WHERE contains(text, 'ßen')")
def search_files_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.file_matches(corpus.documents(spark, sf_dir), Search("ßen", files_only=True)).select(search.path_of().alias("path"))


@query(f"WITH {_LINES} SELECT unit || '/' || rel AS path, count(*) AS matches FROM l WHERE contains(text, 'er') GROUP BY ALL")
def search_count_per_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.line_matches(corpus.documents(spark, sf_dir), Search("er"))
    return found.groupBy(search.path_of().alias("path")).agg(F.count(F.lit(1)).alias("matches"))


@query(f"WITH {_LINES} SELECT unit || '/' || rel AS path, line FROM l WHERE contains(text, 'the') AND regexp_matches(rel, '^(en|de)/[^/]*\\.txt$') AND NOT regexp_matches(rel, '^(.*/)?1[^/]*$')")
def search_glob(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir, Search("the", globs=("{en,de}/*.txt", "!1*"))).select("path", "line")


@query(f"WITH {_LINES} SELECT unit || '/' || rel AS path, line FROM l WHERE contains(text, 'the') AND unit = 'src3' AND starts_with(rel, 'en/')")
def search_subroot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir, Search("the", unit="src3", sub="en")).select("path", "line")


_ORDERED = f"""WITH {_LINES},
m AS (SELECT unit, rel, line, {_SHOWN} AS text, unit || '/' || rel AS path FROM l WHERE contains(text, 'tion')),
o AS (SELECT *, row_number() OVER (ORDER BY unit, string_split(rel, '/'), line) AS nr,
             dense_rank() OVER (ORDER BY unit, string_split(rel, '/')) AS file_nr,
             sum(strlen(path) + strlen(text) + {ITEM_OVERHEAD}) OVER (ORDER BY unit, string_split(rel, '/'), line) AS bytes,
             count(*) OVER () AS total FROM m)
"""


@query(_ORDERED + "SELECT path, line, text, total > 200 AS truncated FROM o WHERE nr <= 200")
def search_topn_truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = search.search(corpus.documents(spark, sf_dir), Search("tion", max_matches=200))
    return a.rows.select("path", "line", "text", F.lit(a.truncated).alias("truncated"))


@query(_ORDERED + "SELECT path, line FROM o WHERE bytes <= 50000 AND file_nr <= 20000 AND nr <= 1000")
def search_byte_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(corpus.documents(spark, sf_dir), Search("tion", max_result_bytes=50_000)).rows.select("path", "line")


@query(_ORDERED + "SELECT path, line FROM o WHERE file_nr <= 7 AND nr <= 1000")
def search_max_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(corpus.documents(spark, sf_dir), Search("tion", max_files=7)).rows.select("path", "line")


@query("SELECT doc_id FROM documents WHERE contains(text, 'Licensed under')")
def required_literal_prefilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = Search(r"Licensed under (the )?\w+", regex=True)
    return search.prefilter(corpus.documents(spark, sf_dir), s, s.parsed()).select("doc_id")


_TRIGRAMS = """
b AS (SELECT doc_id, [CAST('0x' || x AS INTEGER) FOR x IN regexp_extract_all(hex(encode(text)), '..')] AS bytes FROM documents),
p AS (SELECT doc_id, unnest(range(len(bytes))) AS pos, unnest(bytes) AS raw FROM b),
f AS (SELECT doc_id, pos, CASE WHEN raw BETWEEN 65 AND 90 THEN raw + 32 ELSE raw END AS x FROM p),
w AS (SELECT doc_id, x AS a, lead(x, 1) OVER v AS b, lead(x, 2) OVER v AS c, lead(x, 3) OVER v AS n FROM f WINDOW v AS (PARTITION BY doc_id ORDER BY pos)),
g AS (SELECT doc_id, CAST((a << 16) | (b << 8) | c AS INTEGER) AS tri, CASE WHEN n IS NULL THEN 0 ELSE 1 << (xor(n, n >> 3) & 7) END AS bit FROM w WHERE c IS NOT NULL),
t AS (SELECT doc_id, tri, CAST(bit_or(bit) AS INTEGER) AS mask FROM g GROUP BY doc_id, tri)
"""


@query(f"WITH {_TRIGRAMS} SELECT doc_id, tri, mask FROM t")
def trigram_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.postings(corpus.documents(spark, sf_dir))


@query(f"WITH {_TRIGRAMS} SELECT tri, count(*) AS df, CAST(bit_or(mask) AS INTEGER) AS mask FROM t GROUP BY tri")
def trigram_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.document_frequency(index.postings(corpus.documents(spark, sf_dir)))


@query(f"WITH {_TRIGRAMS} SELECT tri, CAST(doc_id // 65536 AS BIGINT) AS chunk, count(*) AS docs, CAST(min(doc_id) AS BIGINT) AS first_doc FROM t GROUP BY ALL")
def trigram_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = index.posting_lists(index.postings(corpus.documents(spark, sf_dir)))
    return lists.select("tri", "chunk", F.size("docs").cast("long").alias("docs"), F.col("docs")[0]["doc_id"].alias("first_doc"))


def _sql_has(text: str) -> str:
    """Documents with every trigram of a literal, each with its next byte."""
    parts = []
    for g in trigram_plan.plan(parse_literal(text)).grams():
        mask = "" if g.after is None else f" AND (mask & {next_bit(g.after)}) <> 0"
        parts.append(f"SELECT doc_id FROM t WHERE tri = {g.tri}{mask}")
    return " INTERSECT ".join(parts)


def _candidates(spark: SparkSession, sf_dir: str, s: Search) -> DataFrame:
    return trigram_plan.candidates(index.postings(corpus.documents(spark, sf_dir)), trigram_plan.plan(s.parsed(), s.ci))


@query(f"WITH {_TRIGRAMS} {_sql_has('ation')} INTERSECT {_sql_has('sted')}")
def candidates_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _candidates(spark, sf_dir, Search("ation.*sted", regex=True))


@query(f"WITH {_TRIGRAMS} ({_sql_has('ßen')}) UNION ({_sql_has('mentpa')})")
def candidates_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _candidates(spark, sf_dir, Search("ßen|mentpa", regex=True))


@query(f"WITH {_TRIGRAMS} {_sql_has('Thnt')}")
def candidates_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _candidates(spark, sf_dir, Search("Thnt"))


@query(f"WITH {_LINES} SELECT unit || '/' || rel AS path, line FROM l WHERE regexp_matches(text, 'lost.*ation|[Cc]iónes')")
def search_through_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, s = corpus.documents(spark, sf_dir), Search("lost.*ation|[Cc]iónes", regex=True)
    found = search.line_matches(search.through_index(docs, index.postings(docs), s), s)
    return found.select(search.path_of().alias("path"), "line")


# Every line of every text is a pattern.
_PATTERNS = """b AS (SELECT item_id, string_split(text, chr(10)) AS parts FROM benchmark),
p AS (SELECT CAST(item_id * 1000000 + unnest(range(len(parts))) AS BIGINT) AS pattern_id, unnest(parts) AS pattern FROM b)"""


def _patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    lines = b.select("item_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "pattern"))
    return lines.select((F.col("item_id") * 1_000_000 + F.col("pos")).cast("long").alias("pattern_id"), "pattern")


_HITS = """h AS (SELECT DISTINCT pattern_id, path, unit, rel FROM p JOIN (
    SELECT source || '/' || lang || '/' || doc_id || '.txt' AS path, source AS unit, lang || '/' || doc_id || '.txt' AS rel, text AS content FROM documents{more}) d
  ON pattern <> '' AND contains(content, pattern)),
r AS (SELECT *, row_number() OVER (PARTITION BY pattern_id ORDER BY unit, string_split(rel, '/')) AS nr FROM h),
a AS (SELECT pattern_id, string_agg(path, ';' ORDER BY nr) FILTER (nr <= 100) AS files, count(*) AS n FROM r GROUP BY pattern_id)
SELECT p.pattern_id, n IS NOT NULL AS found, coalesce(files, '') AS files, coalesce(n > 100, false) AS truncated FROM p LEFT JOIN a ON a.pattern_id = p.pattern_id"""


def _answers(patterns: DataFrame, found: DataFrame) -> DataFrame:
    return lookup.answers(patterns, found).select("pattern_id", "found", F.array_join("files", ";").alias("files"), "truncated")


@query(f"WITH {_PATTERNS}, " + _HITS.format(more=""))
def lookup_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _patterns(spark, sf_dir)
    return _answers(p, lookup.hits(corpus.documents(spark, sf_dir), p))


@query(f"WITH {_PATTERNS}, " + _HITS.format(more=""))
def lookup_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, p = corpus.documents(spark, sf_dir), _patterns(spark, sf_dir)
    return _answers(p, lookup.hits_indexed(docs, index.postings(docs), p))


@query(
    f"WITH {_PATTERNS}, "
    + _HITS.format(
        more=""" UNION ALL SELECT 'pages/html/' || page_id || '.html', 'pages', 'html/' || page_id || '.html', html FROM pages
    UNION ALL SELECT 'conversations/' || conv_id || '/' || turn || '.' || role, 'conversations', conv_id || '/' || turn || '.' || role, text FROM conversations"""
    )
)
def lookup_all_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _patterns(spark, sf_dir)
    parts = [lookup.hits(f(spark, sf_dir), p) for f in (corpus.documents, corpus.pages, corpus.conversations)]
    return _answers(p, coverage.merge_rows(parts, ["pattern_id", "unit", "rel"]))


@query("SELECT source || '/' || lang || '/' || doc_id || '.txt' AS path FROM documents WHERE regexp_matches(lang || '/' || doc_id || '.txt', '^fr/[^/]*[02468]\\.txt$')")
def files_glob(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.matching(corpus.documents(spark, sf_dir), files.Files(globs=("fr/*[02468].txt",)))


@query("SELECT source || '/' || lang || '/' || doc_id || '.txt' AS path FROM documents WHERE regexp_matches(lang || '/' || doc_id || '.txt', '^es/') OR regexp_matches(doc_id || '.txt', '^7+\\.')")
def files_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.matching(corpus.documents(spark, sf_dir), files.Files(regex=r"^es/|^7+\."))


@query("SELECT source || '/' || lang || '/' || doc_id || '.txt' AS path FROM documents ORDER BY path LIMIT 25")
def files_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.files(corpus.documents(spark, sf_dir), files.Files(max_files=25))


@query()
def files_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.files(corpus.documents(spark, sf_dir), files.Files(fuzzy="e9txt", max_files=50)).select("path", "score")


def _uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return e.groupBy(F.concat(F.lit("src"), F.pmod("user_id", F.lit(20)).cast("string"), F.lit("/en/"), F.col("user_id").cast("string"), F.lit(".txt")).alias("path")).agg(F.max(ms).alias("last_used_ms"), F.count(F.lit(1)).alias("uses"))


_USES = "u AS (SELECT 'src' || (user_id % 20) || '/en/' || user_id || '.txt' AS path, max(epoch_ms(ts)) AS last_used_ms, count(*) AS uses FROM events GROUP BY 1)"


@query(f"""WITH {_USES}, d AS (SELECT source || '/' || lang || '/' || doc_id || '.txt' AS path FROM documents)
SELECT d.path, round(coalesce(uses * pow(0.5, (greatest({NOW_MS} - last_used_ms, 0) / 86400000.0) / 30), 0.0), 4) AS frecency FROM d LEFT JOIN u ON u.path = d.path""")
def frecency_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = files.matching(corpus.documents(spark, sf_dir), files.Files())
    return files.ranked(found, _uses(spark, sf_dir), NOW_MS).select("path", F.round("frecency", 4).alias("frecency"))


@query(f"""WITH {_USES}, n AS (SELECT source || '/' || lang || '/' || doc_id || '.txt' AS path, CAST({NOW_MS} AS BIGINT) AS last_used_ms, 1 AS uses FROM documents WHERE lang = 'en'),
b AS (SELECT path, max(last_used_ms) AS last_used_ms, CAST(sum(uses) AS BIGINT) AS uses FROM (SELECT * FROM u UNION ALL SELECT * FROM n) GROUP BY path)
SELECT * FROM b ORDER BY last_used_ms DESC, path LIMIT 500""")
def frecency_persist(spark: SparkSession, sf_dir: str) -> DataFrame:
    returned = corpus.documents(spark, sf_dir).where(F.startswith("rel", F.lit("en/"))).select(search.path_of().alias("path"))
    return files.remember(_uses(spark, sf_dir), returned, NOW_MS, 500)


@query("""SELECT source || '/' || lang || '/' || doc_id || '.txt' AS path, strlen(text) AS size FROM documents
WHERE strlen(text) <= 4000 AND NOT (lang = 'fr' OR regexp_matches(lang || '/' || doc_id || '.txt', '^(.*/)?[^/]*9\\.txt$') AND lang <> 'de')""")
def corpus_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    cfg = Config(excludes=("fr/", "*9.txt", "!de/*9.txt"), max_file_size=4000)
    d = corpus.documents(spark, sf_dir).where(corpus.member(cfg, F.col("content")))
    return d.select(search.path_of().alias("path"), "size")


# Paths made of the table's own values, so that the secret list has something to refuse.
_SECRET_PATHS = "SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN 'home/.ssh/' || doc_id WHEN 1 THEN 'conf/' || doc_id || '.pem' WHEN 2 THEN 'ID_RSA.' || doc_id WHEN 3 THEN 'a/credentials/' || doc_id WHEN 4 THEN 'src/' || doc_id || '.rs' WHEN 5 THEN 'env/' || doc_id WHEN 6 THEN '.env.' || doc_id ELSE 'node_modules/' || doc_id END AS rel FROM documents"


@query(f"SELECT rel, doc_id % 8 IN (0, 1, 2, 3, 6) AS secret, doc_id % 8 = 7 OR (doc_id % 8 IN (0, 1, 6)) OR doc_id % 8 = 3 AS excluded FROM ({_SECRET_PATHS})")
def secret_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus.documents(spark, sf_dir).createOrReplaceTempView("_secret_documents")
    d = spark.sql(_SECRET_PATHS.replace("FROM documents", "FROM _secret_documents"))
    return d.select("rel", secret(F.col("rel"), SECRET_EXCLUDES).alias("secret"), ignored(F.col("rel"), Config().effective_excludes()).alias("excluded"))


@query("SELECT unnest(" + str(Config().effective_excludes()) + ") AS line")
def excludes_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(x,) for x in Config().effective_excludes()], "line string")


def _listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus as it is listed now: every tenth document is gone, every seventh has grown."""
    d = corpus.documents(spark, sf_dir).where("doc_id % 10 <> 0")
    return d.withColumn("size", F.when(F.col("doc_id") % 7 == 0, F.col("size") + 1).otherwise(F.col("size")))


def _indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus as it was indexed: without every eleventh document."""
    return corpus.documents(spark, sf_dir).where("doc_id % 11 <> 0")


def _pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.documents(spark, sf_dir).where("doc_id % 17 = 0").select("unit", "rel")


@query("""SELECT source AS unit, lang || '/' || doc_id || '.txt' AS rel,
  CASE WHEN doc_id % 10 = 0 THEN 'drop' WHEN doc_id % 11 <> 0 AND doc_id % 7 <> 0 AND doc_id % 17 <> 0 THEN 'alive' ELSE 'reindex' END AS action
FROM documents WHERE doc_id % 10 <> 0 OR doc_id % 11 <> 0""")
def incremental_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.incremental_plan(_listing(spark, sf_dir), _indexed(spark, sf_dir), _pending(spark, sf_dir))


@query("""WITH a AS (SELECT source AS unit, lang || '/' || doc_id || '.txt' AS rel, strlen(text) AS size, 1 AS gen FROM documents WHERE doc_id % 11 <> 0
  UNION ALL SELECT source, lang || '/' || doc_id || '.txt', strlen(text) + CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END, 2 FROM documents WHERE doc_id % 10 <> 0 AND (doc_id % 7 = 0 OR doc_id % 11 = 0))
SELECT unit, rel, size, gen FROM a QUALIFY row_number() OVER (PARTITION BY unit, rel ORDER BY gen DESC) = 1""")
def merge_later_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = _indexed(spark, sf_dir).select("unit", "rel", "size", F.lit(1).alias("gen"))
    new = _listing(spark, sf_dir).where("doc_id % 7 = 0 OR doc_id % 11 = 0").select("unit", "rel", "size", F.lit(2).alias("gen"))
    return index.merge_later_wins(old.unionByName(new))


@query("""SELECT coalesce(a.unit, b.unit) AS unit, CASE WHEN b.unit IS NULL THEN 'add' WHEN a.unit IS NULL THEN 'drop' ELSE 'keep' END AS action
FROM (SELECT DISTINCT source AS unit FROM documents WHERE source <> 'src1') a FULL JOIN (SELECT DISTINCT source AS unit FROM documents WHERE source <> 'src2') b ON a.unit = b.unit""")
def unit_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = corpus.documents(spark, sf_dir)
    return index.unit_sync(d.where("unit <> 'src1'"), d.where("unit <> 'src2'"))


@query("""SELECT source AS unit, CAST(sum(CAST(CAST('0x' || left(md5(lang || '/' || doc_id || '.txt|' || strlen(text) || '|0'), 15) AS BIGINT) AS HUGEINT)) AS VARCHAR) AS fingerprint, count(*) AS files
FROM documents GROUP BY source""")
def listing_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.fingerprint(corpus.documents(spark, sf_dir))


@query("SELECT source || '/' || lang || '/' || doc_id || '.txt' AS path FROM documents WHERE doc_id % 17 = 0 AND doc_id % 10 <> 0 OR doc_id % 11 <> 0 AND doc_id % 17 <> 0 AND contains(text, 'tion')")
def overlay_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    candidates = _indexed(spark, sf_dir).where(F.contains("content", F.lit("tion")))
    return search.overlay(candidates, _pending(spark, sf_dir), _listing(spark, sf_dir)).select(search.path_of().alias("path"))


@query("SELECT source || '/' || lang || '/' || doc_id || '.txt' AS path FROM documents WHERE doc_id % 11 <> 0 AND doc_id % 17 <> 0")
def pending_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _indexed(spark, sf_dir).join(_pending(spark, sf_dir), ["unit", "rel"], "left_anti").select(search.path_of().alias("path"))


def _units(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = corpus.documents(spark, sf_dir).groupBy("unit").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"), F.max("doc_id").alias("top"))
    return u.select("unit", "files", "bytes", F.lit(True).alias("ready"), (F.col("top") % 3 == 0).alias("dirty"), (F.col("top") % 2 == 0).alias("pending_unknown"), (F.col("top") % 5 != 0).alias("watched"), (F.lit(NOW_MS) - F.col("top") * 1000).alias("indexed_at_ms"), F.lit(NOW_MS - 1000).alias("beat_ms"))


_UNITS = f"u AS (SELECT source AS unit, count(*) AS files, CAST(sum(strlen(text)) AS BIGINT) AS bytes, max(doc_id) AS top, {NOW_MS} - max(doc_id) * 1000 AS indexed_at_ms FROM documents GROUP BY source)"


@query(f"WITH {_UNITS} SELECT count(*) AS units_total, count(*) AS units_ready, count(*) FILTER (top % 3 = 0) AS units_dirty, CAST(sum(files) AS BIGINT) AS files, CAST(sum(bytes) AS BIGINT) AS bytes, bool_and(top % 3 <> 0) AS fresh FROM u")
def status_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.status(_units(spark, sf_dir))


@query(f"WITH {_UNITS} SELECT unit, (top % 3 <> 0 OR top % 2 <> 0) AND (top % 5 <> 0 OR {NOW_MS} - indexed_at_ms < 600000) AS fresh FROM u")
def unit_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.freshness(_units(spark, sf_dir), NOW_MS, 300, writer=False, watch=True).select("unit", "fresh")


_ROOTS = "r AS (SELECT lang AS root, count(*) AS candidates, max(doc_id) % 2 = 0 AS covered, min(doc_id) % 3 <> 2 AS fresh, count(*) > 200 AS truncated, CASE WHEN max(doc_id) % 2 = 0 THEN 'index' ELSE 'scan' END AS backend FROM documents GROUP BY lang)"


def _roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    top, low, n = F.max("doc_id"), F.min("doc_id"), F.count(F.lit(1))
    return d.groupBy(F.col("lang").alias("root")).agg(n.alias("candidates"), (top % 2 == 0).alias("covered"), (low % 3 != 2).alias("fresh"), (n > 200).alias("truncated"), F.when(top % 2 == 0, "index").otherwise("scan").alias("backend"))


@query(f"""WITH {_ROOTS} SELECT bool_and(covered) AS covered, bool_and(fresh) AS fresh, bool_or(truncated) AS truncated, CAST(sum(candidates) AS BIGINT) AS candidates,
  bool_and(covered) AND bool_and(fresh) AND NOT bool_or(truncated) AS complete, CASE WHEN bool_or(backend = 'scan') THEN 'scan' ELSE 'index' END AS backend FROM r""")
def all_roots_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.merge_roots(_roots(spark, sf_dir))


@query(f"WITH {_ROOTS} SELECT root, covered, fresh, truncated, covered AND fresh AND NOT truncated AS complete FROM r")
def coverage_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.flags(_roots(spark, sf_dir)).select("root", "covered", "fresh", "truncated", "complete")


@query("""WITH p AS (SELECT DISTINCT source || '/' || lang || '/' || doc_id || '.txt' AS path, source, lang FROM documents)
SELECT path, CASE WHEN lang IN ('en', 'fr') THEN source || '/' || lang WHEN source <> 'src0' THEN source END AS unit FROM p""")
def unit_for_longest_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = corpus.documents(spark, sf_dir).select("unit", "rel", search.path_of().alias("path"))
    nested = d.where("startswith(rel, 'en/') OR startswith(rel, 'fr/')").select(F.concat_ws("/", "unit", F.substring_index("rel", "/", 1)).alias("unit"))
    return coverage.unit_of(d, d.select("unit").unionByName(nested), split_roots=("src0",))


# Every sixth event names the unit itself, an ignore file, an indexed, a listed or an unknown file.
_EVENT_PATHS = """SELECT event_id, 'src' || (event_id % 20) AS unit, CASE event_id % 6 WHEN 0 THEN '' WHEN 1 THEN 'en/.gitignore' WHEN 2 THEN 'en/' || (event_id % 500) || '.txt'
  WHEN 3 THEN 'fr/' || (event_id % 500) || '.txt' WHEN 4 THEN 'fr' ELSE 'tmp/' || event_id END AS rel, event_id % 6 = 4 AS is_dir FROM events"""


@query(f"""WITH e AS ({_EVENT_PATHS}),
c AS (SELECT DISTINCT source AS unit, lang || '/' || doc_id || '.txt' AS rel, doc_id % 11 <> 0 AS indexed, doc_id % 10 <> 0 AS listed FROM documents),
d AS (SELECT DISTINCT unit, split_part(rel, '/', 1) AS rel FROM c WHERE listed)
SELECT e.event_id, CASE WHEN e.rel = '' OR ends_with(e.rel, '.gitignore') THEN 'unknown' WHEN c.indexed OR c.listed THEN 'file' ELSE 'unknown' END AS kind
FROM e LEFT JOIN c ON e.unit = c.unit AND e.rel = c.rel LEFT JOIN d ON e.unit = d.unit AND e.rel = d.rel
WHERE e.rel = '' OR ends_with(e.rel, '.gitignore') OR coalesce(c.indexed, false) OR coalesce(c.listed, false) OR d.rel IS NOT NULL AND e.is_dir""")
def event_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.read.parquet(f"{sf_dir}/events.parquet").createOrReplaceTempView("_relevance_events")
    e = spark.sql(_EVENT_PATHS.replace("FROM events", "FROM _relevance_events"))
    none = e.where("false").select("unit", "rel")
    # events on one path mean the same thing: each path is judged once
    kinds = maintenance.relevant(e.select("unit", "rel", "is_dir").distinct(), _indexed(spark, sf_dir), _listing(spark, sf_dir), none)
    return e.join(kinds, ["unit", "rel"]).select("event_id", "kind")


@query(f"SELECT rel, doc_id % 8 IN (4, 5) AS reached FROM ({_SECRET_PATHS})")
def reach_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus.documents(spark, sf_dir).createOrReplaceTempView("_reach_documents")
    return maintenance.reached(spark.sql(_SECRET_PATHS.replace("FROM documents", "FROM _reach_documents")), Config())


@query("SELECT DISTINCT lang AS name, true AS is_dir FROM documents WHERE source = 'src3'")
def corpus_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintenance.entries(corpus.documents(spark, sf_dir), "src3")


@query(f"SELECT rel FROM ({_SECRET_PATHS}) WHERE NOT contains(rel, '/')")
def loose_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus.documents(spark, sf_dir).createOrReplaceTempView("_loose_documents")
    return maintenance.loose_files(spark.sql(_SECRET_PATHS.replace("FROM documents", "FROM _loose_documents"))).select("rel")


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN -1 ELSE 1000000000 * doc_id END AS stamp_ns FROM documents")
def racily_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = corpus.documents(spark, sf_dir).withColumn("stamp_ns", F.lit(1_000_000_000) * F.col("doc_id"))
    read_at = F.col("stamp_ns") + F.when(F.col("doc_id") % 3 == 0, 1_999_999_999).otherwise(2_000_000_000)
    return d.select("doc_id", index.settled_stamp(F.col("stamp_ns"), read_at).alias("stamp_ns"))


def _scratch(spark: SparkSession) -> str:
    """A folder that driver and executors share."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="streams-")
    return f"{named.rstrip('/')}/streams/{uuid.uuid4().hex}"


def _changes(spark: SparkSession, sf_dir: str, stream: bool) -> DataFrame:
    path = f"{sf_dir}/events.parquet"
    # a stream wants a pattern or a directory; the pattern fits a single file too
    e = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{sf_dir}/events.parque[t]") if stream else spark.read.parquet(path)
    return e.select(F.concat(F.lit("u"), F.pmod("user_id", F.lit(20)).cast("string")).alias("unit"), F.when(F.col("event_type") != "error", F.concat(F.lit("f/"), F.pmod("event_id", F.lit(997)).cast("string"))).alias("rel"), F.col("ts").cast("timestamp").alias("ts"), "event_type", "user_id")


@query("""SELECT 'u' || (user_id % 20) AS unit, CASE WHEN count(DISTINCT event_id % 997) > 300 THEN 0 ELSE count(DISTINCT event_id % 997) END AS pending, count(DISTINCT event_id % 997) > 300 AS unknown
FROM events WHERE event_type <> 'error' GROUP BY 1""")
def stream_pending_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    home = _scratch(spark)
    known = _changes(spark, sf_dir, True).where("rel IS NOT NULL").select("unit", "rel")
    out = freshness.drain(freshness.pending_state(known, 300), f"{home}/out", f"{home}/checkpoint", "update")
    last = out.groupBy("unit").agg(F.max_by(F.struct("pending", "unknown"), "trigger").alias("last"))
    return last.select("unit", "last.pending", "last.unknown")


@query("""WITH e AS (SELECT 'u' || (user_id % 20) AS unit, ts FROM events),
g AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS starts FROM e WINDOW w AS (PARTITION BY unit ORDER BY ts)),
s AS (SELECT *, sum(starts) OVER (PARTITION BY unit ORDER BY ts ROWS UNBOUNDED PRECEDING) AS nr FROM g)
SELECT unit, epoch_us(min(ts)) AS start_us, epoch_us(max(ts) + INTERVAL 30 MINUTE) AS end_us, count(*) AS events FROM s GROUP BY unit, nr""")
def stream_debounce(spark: SparkSession, sf_dir: str) -> DataFrame:
    home = _scratch(spark)
    # every session is wanted, the open ones too: the whole result after each trigger, the last one read
    out = freshness.drain(freshness.bursts(_changes(spark, sf_dir, True), "30 minutes"), f"{home}/out", f"{home}/checkpoint", "complete")
    b = out.join(out.agg(F.max("trigger").alias("trigger")), "trigger")
    return b.select("unit", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "events")


@query("SELECT event_type, count(*) AS events, count(DISTINCT 'u' || (user_id % 20)) AS units FROM events GROUP BY 1")
def stream_event_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    home = _scratch(spark)
    out = freshness.drain(_changes(spark, sf_dir, True).select("unit", "event_type"), f"{home}/out", f"{home}/checkpoint", "append")
    return out.groupBy("event_type").agg(F.count(F.lit(1)).alias("events"), F.countDistinct("unit").alias("units"))
