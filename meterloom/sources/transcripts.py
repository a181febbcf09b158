"""Session files: where they are, what their path says, and their sidecars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# <root>/projects/<project>/<session>.jsonl and .../<session>/subagents/agent-<id>.jsonl
_MAIN = r"^(.*)/projects/[^/]+/[^/]+\.jsonl$"
_SUB = r"^(.*)/projects/[^/]+/[^/]+/subagents/[^/]+\.jsonl$"
_AGENT = r"/subagents/agent-([^/]+)\.jsonl$"
GLOBS = ("projects/*/*.jsonl", "projects/*/*/subagents/*.jsonl")


def file_context(path: Column) -> list[Column]:
    """Root, sub-agent flag, agent id and stem, all read off the file path."""
    sub = path.rlike(_SUB)
    root = F.when(sub, F.regexp_extract(path, _SUB, 1)).otherwise(F.regexp_extract(path, _MAIN, 1))
    return [
        root.alias("root"),
        sub.alias("file_is_subagent"),
        F.nullif(F.regexp_extract(path, _AGENT, 1), F.lit("")).alias("file_agent_id"),
        F.regexp_replace(path, r"\.jsonl$", "").alias("file_stem"),
    ]


def line_columns() -> list[Column]:
    """Line text with its file context."""
    return [
        F.col("value").alias("line"),
        *file_context(F.col("_metadata.file_path")),
        F.col("_metadata.file_modification_time").alias("landed_at"),
        F.col("_metadata.file_block_start").alias("block"),
    ]


def with_position(lines: DataFrame) -> DataFrame:
    """Replace ``block`` by ``seq``, a position that grows along each file."""
    row = F.monotonically_increasing_id()
    return lines.withColumn("seq", F.struct(F.col("block"), row.alias("row"))).drop("block")


def read_lines(spark: SparkSession, root: str) -> DataFrame:
    """Lines of all session files below ``root`` (a glob may name many roots)."""
    paths = [f"{root.rstrip('/')}/{g}" for g in GLOBS]
    return with_position(spark.read.text(paths).select(*line_columns()))


def stream_lines(spark: SparkSession, root: str, max_files: int = 1000) -> DataFrame:
    """Streaming form over landed, immutable files; the checkpoint remembers which files were read.

    Apply ``with_position`` to each micro-batch: row positions exist only within one.
    """
    reader = spark.readStream.option("maxFilesPerTrigger", max_files).option("recursiveFileLookup", "true")
    lines = reader.option("pathGlobFilter", "*.jsonl").text(root)
    return lines.select(*line_columns()).filter(F.col("root") != "")


def read_sidecars(spark: SparkSession, root: str) -> DataFrame:
    """Agent types from the ``.meta.json`` files beside sub-agent files."""
    path = f"{root.rstrip('/')}/projects/*/*/subagents/*.meta.json"
    raw = spark.read.text(path, wholetext=True)
    v = F.try_parse_json("value")
    kind = F.schema_of_variant(F.try_variant_get(v, "$.agentType", "variant"))
    agent = F.when(kind == "STRING", F.try_variant_get(v, "$.agentType", "string"))
    return raw.select(
        F.regexp_replace("_metadata.file_path", r"\.meta\.json$", "").alias("file_stem"),
        F.substring(agent, 1, 100).alias("file_agent_type"),
    )


def with_agent_types(lines: DataFrame, sidecars: DataFrame) -> DataFrame:
    return lines.join(sidecars, "file_stem", "left")
