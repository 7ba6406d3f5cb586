"""Symbol graphs in JSON, in the plain form and in the protocol's own JSON form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SYMBOL = "struct<symbol:string,kind:string,display_name:string,displayName:string,documentation:string>"
_OCCURRENCE = "struct<symbol:string,range:array<int>,role:string,symbol_role:string,symbol_roles:int,symbolRoles:int>"
SCHEMA = f"format string, symbols array<{_SYMBOL}>, external_symbols array<{_SYMBOL}>, documents array<struct<relative_path:string,relativePath:string,content_hash:string,occurrences:array<{_OCCURRENCE}>>>, relationships array<struct<`from`:string,`to`:string,kind:string>>"


def scan_symbol_graph(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """symbols, occurrences and edges. A role counts as definition by name or by the lowest bit of the roles."""
    raw = spark.read.schema(SCHEMA).option("multiLine", "true").json(path)
    s = raw.select(F.explode(F.coalesce("symbols", "external_symbols")).alias("s")).where("s.symbol <> ''")
    symbols = s.select("s.symbol", "s.kind", F.coalesce("s.display_name", "s.displayName").alias("display_name"), "s.documentation")
    d = raw.select(F.explode("documents").alias("d")).select(F.coalesce("d.relative_path", "d.relativePath").alias("path"), F.explode("d.occurrences").alias("o")).where("path <> '' AND o.symbol <> ''")
    defines = (F.coalesce("o.symbol_roles", "o.symbolRoles", F.lit(0)).bitwiseAND(1) == 1) | (F.col("o.role") == "definition") | (F.col("o.symbol_role") == "definition")
    occurrences = d.select("path", "o.symbol", "o.range", F.when(F.coalesce(defines, F.lit(False)), "definition").otherwise("reference").alias("role"))
    e = raw.select(F.explode("relationships").alias("e"))
    edges = e.select(F.col("e.from").alias("src"), F.col("e.to").alias("dst"), F.col("e.kind").alias("kind"))
    return {"symbols": symbols, "occurrences": occurrences, "edges": edges}
