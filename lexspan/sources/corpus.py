"""Corpora as DataFrames: ``doc_id, unit, rel, content, size, stamp_ns``.

A table of texts becomes a corpus by naming its columns; a directory is listed and filtered
by the same rules, and read by executors.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import SECRET_EXCLUDES, Config
from ..functions.globs import ignored, secret
from ..functions.pathrules import IgnoreFiles
from ..shipping import ship

#: Files read at a time.
FILES = 64
COLUMNS = ["doc_id", "unit", "rel", "content", "size", "stamp_ns"]


def table_corpus(df: DataFrame, unit: Column, rel: Column, content: Column, doc_id: Column, stamp_ns: Column | None = None) -> DataFrame:
    d = df.select(doc_id.cast("long").alias("doc_id"), unit.alias("unit"), rel.alias("rel"), content.alias("content"))
    return d.withColumn("size", F.octet_length("content").cast("long")).withColumn("stamp_ns", F.lit(0).cast("long") if stamp_ns is None else stamp_ns)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return table_corpus(d, F.col("source"), F.concat(F.col("lang"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")), F.col("text"), F.col("doc_id"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return table_corpus(d, F.lit("pages"), F.concat(F.lit("html/"), F.col("page_id").cast("string"), F.lit(".html")), F.col("html"), F.col("page_id"))


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    rel = F.concat(F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string"), F.lit("."), F.col("role"))
    return table_corpus(d, F.lit("conversations"), rel, F.col("text"), F.xxhash64("conv_id", "turn", "role"))


def member(cfg: Config, content: Column | None = None) -> Column:
    """Whether a listed document belongs to the corpus: not secret, not excluded, not hidden
    unless wanted, within the size cap, and without a NUL byte if its content is at hand.
    Secrets are tested on their own, so no exclude line can bring one back."""
    rel = F.col("rel")
    kept = ~secret(rel, SECRET_EXCLUDES) & ~ignored(rel, cfg.negatable_excludes()) & (F.col("size") <= cfg.max_file_size)
    if not cfg.hidden:
        kept = kept & ~F.rlike(rel, F.lit(r"(?:^|/)\."))
    if content is not None:
        kept = kept & ~F.contains(content.cast("binary"), F.lit(b"\x00"))
    return kept


def list_tree(root: str, cfg: Config) -> list[tuple[str, int, int]]:
    """``rel, size, stamp_ns`` of a directory's regular files, by the ignore files in it;
    symbolic links are never followed. Runs on the driver, for trees it can see."""
    out: list[tuple[str, int, int]] = []
    plain = root in cfg.no_gitignore_roots or not cfg.gitignore
    rules = IgnoreFiles([] if plain else [".gitignore", ".ignore"])
    excluded = [IgnoreFiles.of_lines(SECRET_EXCLUDES), IgnoreFiles.of_lines(cfg.negatable_excludes())]

    def walk(directory: str, rel: str) -> None:
        rules.enter(directory, rel)
        with os.scandir(directory) as entries:
            for e in sorted(entries, key=lambda e: e.name):
                path = f"{rel}/{e.name}" if rel else e.name
                if e.is_symlink() or not cfg.hidden and e.name.startswith("."):
                    continue
                folder = e.is_dir(follow_symlinks=False)
                if rules.out(path, folder) or any(x.out(path, folder) for x in excluded):
                    continue
                if folder:
                    walk(e.path, path)
                elif e.is_file(follow_symlinks=False):
                    s = e.stat(follow_symlinks=False)
                    if s.st_size <= cfg.max_file_size:
                        out.append((path, s.st_size, max(s.st_mtime_ns, s.st_ctime_ns)))
        rules.leave(rel)

    walk(root, "")
    return sorted(out, key=lambda x: x[0].encode())


def tree_corpus(spark: SparkSession, root: str, cfg: Config | None = None, unit: str | None = None) -> DataFrame:
    """A directory tree as a corpus. The driver lists it (Spark's own listing leaves out names
    that begin with a dot); executors, which must see the same tree, read it. Files with a
    NUL byte, or that grew over the cap since they were listed, are left out; other bytes
    that aren't UTF-8 are replaced."""
    cfg = cfg or Config()
    ship(spark)
    root = root.rstrip("/")
    listed = spark.createDataFrame([(unit or root, *x) for x in list_tree(root, cfg)], "unit string, rel string, size long, stamp_ns long")
    most = cfg.max_file_size

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in range(0, b.num_rows, FILES):
                rows, texts = b.slice(part, FILES).to_pylist(), []
                for r in rows:
                    try:
                        with open(os.path.join(root, r["rel"]), "rb") as f:
                            data = f.read(most + 1)
                    except OSError:
                        data = b"\0"  # gone meanwhile
                    texts.append(None if len(data) > most or b"\0" in data else data.decode("utf-8", "replace"))
                kept = [(r, t) for r, t in zip(rows, texts, strict=True) if t is not None]
                yield pa.RecordBatch.from_pydict({c: pa.array([r[c] for r, _ in kept], t) for c, t in (("unit", pa.string()), ("rel", pa.string()), ("size", pa.int64()), ("stamp_ns", pa.int64()))} | {"content": pa.array([t for _, t in kept], pa.string())})

    d = listed.mapInArrow(read, "unit string, rel string, size long, stamp_ns long, content string")
    return d.withColumn("doc_id", F.xxhash64("unit", "rel")).select(*COLUMNS)
