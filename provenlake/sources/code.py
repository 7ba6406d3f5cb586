"""Code trees: scan and extraction of functions and classes."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import code_chunk_hash, code_doc_id

LONGEST = 400_000
#: Files longer than this are indexed by their parts only, where there are any.
WHOLE_FILE_MOST = 2000
#: Fixed: which files are code, and what opens a block in them.
_SUFFIX = r"\.(ts|tsx|js|jsx|mjs|cjs|py)$"
_PY = re.compile(r"(def|class)\s+([A-Za-z_]\w*)")
_JS = [
    re.compile(r"\s*(?:export\s+)?(?:async\s+)?function\s+([A-Za-z_]\w*)"),
    re.compile(r"\s*(?:export\s+)?(?:const|let)\s+([A-Za-z_]\w*)\s*=\s*(?:async\s*)?\("),
    re.compile(r"\s*(?:export\s+)?class\s+([A-Za-z_]\w*)"),
]


def scan_code(spark: SparkSession, root: str) -> DataFrame:
    """path, source: code files below a root, without dependency, version-control and build folders and without very long files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    files = files.where(F.lower("path").rlike(_SUFFIX) & ~F.col("path").rlike(r"/(node_modules|\.git|dist)/"))
    base = root.rstrip("/") + "/"
    return files.select(F.substring_index("path", base, -1).alias("path"), F.decode("content", "UTF-8").alias("source")).where(F.length("source") <= LONGEST)


def _indent(line: str) -> int:
    return len(line) - len(line.lstrip())


def _python_blocks(lines: list[str]) -> Iterator[tuple[str, str, int, int]]:
    heads = [(i, m) for i, line in enumerate(lines) if (m := _PY.match(line))]
    for i, m in heads:
        end = next((j for j in range(i + 1, len(lines)) if lines[j].strip() and not _indent(lines[j])), len(lines))
        yield "class" if m[1] == "class" else "function", m[2], i, end - 1


def _brace_blocks(lines: list[str]) -> Iterator[tuple[str, str, int, int]]:
    done = -1
    for i, line in enumerate(lines):
        hit = next((m for r in _JS if (m := r.match(line))), None)
        if i <= done or not hit:
            continue
        depth, opened, done = 0, False, len(lines) - 1
        for j in range(i, len(lines)):
            depth += lines[j].count("{") - lines[j].count("}")
            opened |= "{" in lines[j]
            if opened and depth == 0:
                done = j
                break
        yield "class" if re.search(r"class\s", line) else "function", hit[1], i, done


def blocks_of(path: str, source: str) -> list[tuple[str, str, int, int, str]]:
    """(kind, name, first line, last line, body), lines counted from 1; the whole file comes last, unless it is long and has parts."""
    lines = re.split(r"\r?\n", source)
    found = [(k, n, a + 1, b + 1, "\n".join(lines[a : b + 1])) for k, n, a, b in (_python_blocks if path.endswith(".py") else _brace_blocks)(lines)]
    found = [x for x in found if x[4].strip()]
    if source.strip() and not (found and len(source) > WHOLE_FILE_MOST):
        found.append(("file", re.split(r"[/\\]", path)[-1], 1, len(lines), "\n".join(lines)))
    return found


def code_chunks(files: DataFrame) -> DataFrame:
    """path, kind, name, start_line, end_line, body, snapshot_hash, id: many rows a file."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(p, *b) for p, s in zip(pdf["path"], pdf["source"], strict=True) for b in blocks_of(p, s or "")]
            yield pd.DataFrame(rows, columns=["path", "kind", "name", "start_line", "end_line", "body"])

    out = files.select("path", "source").mapInPandas(cut, "path string, kind string, name string, start_line int, end_line int, body string")
    out = out.withColumn("snapshot_hash", code_chunk_hash(F.col("path"), F.col("start_line"), F.col("end_line"), F.col("body")))
    return out.withColumn("id", code_doc_id(F.col("snapshot_hash")))


def sweep_code(index: DataFrame, paths: DataFrame, chunks: DataFrame) -> DataFrame:
    """The code index after a new scan: rows of the scanned paths that weren't cut again go, new chunks come."""
    scanned = paths.select("path").distinct()
    kept = index.join(scanned, "path", "left_anti").select(*index.columns)
    return kept.unionByName(chunks.select(*index.columns))
