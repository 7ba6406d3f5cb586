"""Small structured files: anchor logs, tool manifests, skill files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ANCHOR = "seq long, checkpointId string, rootHash string, leafCount long, prevAnchorHash string, anchorHash string, createdAt string"
MANIFEST = "name string, tools array<struct<name:string,description:string,runtime:string,risk:array<string>,source:string,inputSchema:string>>"


def scan_anchors(spark: SparkSession, path: str) -> DataFrame:
    """line, raw, entry (null where the line is no JSON object): one row a non-blank line; malformed lines stay in sight."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("n", "raw")).where(F.trim("raw") != "")
    fits = F.trim("raw").startswith("{") & F.expr("try_parse_json(raw) IS NOT NULL")
    return lines.select((F.col("n") + 1).alias("line"), "raw", F.when(fits, F.from_json("raw", ANCHOR)).alias("entry"))


def scan_manifest(spark: SparkSession, path: str) -> DataFrame:
    """catalogue, name, description, runtime, risk, source, input_schema: one row a tool; a manifest without name or tools is an error."""
    raw = spark.read.schema(MANIFEST).option("multiLine", "true").json(path)
    bad = raw.where("name IS NULL OR tools IS NULL").count()
    if bad:
        raise ValueError(f"{bad} manifests without a name or tools")
    t = raw.select(F.col("name").alias("catalogue"), F.explode("tools").alias("t"))
    return t.select("catalogue", "t.name", "t.description", "t.runtime", "t.risk", "t.source", F.col("t.inputSchema").alias("input_schema"))


def scan_skills(spark: SparkSession, path: str) -> DataFrame:
    """name, description, trigger, body: one row a skill file with front matter."""
    raw = spark.read.text(path, wholetext=True).withColumnRenamed("value", "raw")
    front = F.regexp_extract("raw", r"(?s)^---\r?\n(.*?)\r?\n---", 1)
    field = lambda n: F.nullif(F.regexp_replace(F.trim(F.regexp_extract("front", rf"(?m)^{n}:\s*(.+)$", 1)), "^[\"']|[\"']$", ""), F.lit(""))
    body = F.regexp_replace("raw", r"(?s)^---\r?\n.*?\r?\n---(?:\r?\n)?", "")
    return raw.withColumn("front", front).select(field("name").alias("name"), field("description").alias("description"), field("triggers?").alias("trigger"), body.alias("body"))
