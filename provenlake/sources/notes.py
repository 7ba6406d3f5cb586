"""Markdown note trees: scan, exclusion, front matter, passages."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import passage_id, passage_ref, pin_hash
from ..operators.chunking import split_passages

EXTENSIONS = (".md", ".markdown", ".mdx")


def scan_notes(spark: SparkSession, root: str, dotted: bool = False, listed: DataFrame | None = None) -> DataFrame:
    """path (relative to the root), raw: every note below a root, read as whole texts by Spark.

    Spark follows links, cycles too; a ``listing`` of the tree restricts the scan to the files it doesn't skip.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[mM][dDaA]*").load(root)
    base = (root if "://" in root else os.path.abspath(root)).rstrip("/") + "/"
    path = F.substring_index(F.col("path"), base, -1)
    notes = files.select(path.alias("path"), F.decode("content", "UTF-8").alias("raw")).where(F.lower("path").rlike(r"\.(md|markdown|mdx)$"))
    if listed is not None:
        notes = notes.join(listed.where("skip IS NULL").select("path"), "path", "left_semi")
    return notes if dotted else notes.where(~F.concat(F.lit("/"), F.col("path")).contains("/."))


def listing(spark: SparkSession, root: str, dotted: bool = False) -> DataFrame:
    """path, skip: the files of a local tree and why one is skipped (symlink_escape, symlink_cycle, not_regular, unreadable, dotted), else null.

    A walk of names only; contents are read by ``scan_notes``.
    """
    top, rows, seen = Path(root).resolve(), [], set()

    def walk(at: Path) -> None:
        for p in sorted(at.iterdir()):
            name = str(p.relative_to(Path(root)))
            if p.name.startswith(".") and not dotted:
                rows.append((name, "dotted"))
                continue
            real = p.resolve()
            if p.is_symlink() and top not in (real, *real.parents):
                rows.append((name, "symlink_escape"))
            elif p.is_dir():
                if real in seen or real == top:
                    rows.append((name, "symlink_cycle"))
                else:
                    seen.add(real)
                    walk(p)
            elif not p.is_file():
                rows.append((name, "not_regular"))
            elif p.suffix.lower() in EXTENSIONS:
                rows.append((name, None if os.access(p, os.R_OK) else "unreadable"))

    walk(Path(root))
    return spark.createDataFrame(rows, "path string, skip string")


def exclude_condition(path: Column, pattern: str) -> Column:
    """A pattern of one segment fits any segment of a path; of several, a prefix of whole segments. Case doesn't count."""
    clean = pattern.strip().strip("/").lower()
    parts = clean.split("/")
    if not clean or ".." in parts:
        raise ValueError(f"not a pattern inside the root: {pattern!r}")
    low = F.lower(path)
    if len(parts) == 1:
        return F.array_contains(F.split(low, "/"), clean)
    return (low == clean) | low.startswith(clean + "/")


def exclude(files: DataFrame, patterns: list[str], path_col: str = "path") -> DataFrame:
    """The files no pattern fits. A pattern that fits nothing is an error, raised before anything is written."""
    if not patterns:
        return files
    fits = [exclude_condition(F.col(path_col), p) for p in patterns]
    counts = files.agg(*[F.sum(f.cast("int")).alias(str(k)) for k, f in enumerate(fits)]).first()
    unused = [p for k, p in enumerate(patterns) if not counts[k]]
    if unused:
        raise ValueError(f"patterns that fit no file: {unused}")
    out = files
    for fit in fits:
        out = out.where(~fit)
    return out


def split_frontmatter(raw: Column) -> Column:
    """struct(title, body). A block counts only if its first line looks like a key."""
    block = r"(?s)^---(.*?)\n---"
    front = F.regexp_extract(raw, block, 1)
    first = F.regexp_extract(front, r"^\r?\n?([^\r\n]*)", 1)
    has = raw.startswith("---") & raw.rlike(block) & F.trim(first).rlike(r"^[A-Za-z_][\w-]*\s*:")
    title = F.regexp_extract(front, r"(?m)^title:\s*(.+)$", 1)
    title = F.regexp_replace(F.trim(title), "^[\"']|[\"']$", "")
    body = F.regexp_replace(raw, r"(?s)^---.*?\n---(?:\r?\n)?", "")
    return F.struct(F.when(has & (title != ""), title).alias("title"), F.when(has, body).otherwise(raw).alias("body"))


def passages_of(notes: DataFrame, root: str, kind: str = "vault_page") -> DataFrame:
    """One row a passage: id, kind, ref, path, title, body, snapshot_hash, ingest_root."""
    parts = notes.select("path", split_frontmatter(F.col("raw")).alias("n")).select("path", "n.title", "n.body")
    cut = split_passages(parts, ["path", "title"], "body")
    ref = passage_ref(F.col("path"), F.col("ordinal"))
    crumb = F.array_join(F.concat(F.array(F.coalesce("title", F.regexp_extract("path", r"([^/]+?)(?:\.[A-Za-z]+)?$", 1))), F.col("headings")), " › ")
    return cut.select(
        passage_id(F.lit(kind), F.lit(root), ref).alias("id"), F.lit(kind).alias("kind"), ref.alias("ref"), "path", crumb.alias("title"), "body",
        pin_hash(crumb, F.col("body"), ref).alias("snapshot_hash"), F.lit(root).alias("ingest_root"),
    )
