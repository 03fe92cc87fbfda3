"""Study responses as JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provenir.schemas import RESPONSES
from provenir.sources.lines import read_lines


def read_responses(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Responses with ``index``, the position in path and line order.

    The index is a sortable text key, so no global numbering is needed. ``fields`` are
    the names that the record holds, ``response_time_kind`` how its time is written.
    """
    lines = read_lines(spark, paths)
    parsed = lines.withColumn("r", F.from_json("text", RESPONSES)).withColumn("v", F.try_parse_json("text"))
    key = F.concat_ws("/", "path", F.lpad(F.col("line_no").cast("string"), 20, "0"))
    kind = F.schema_of_variant(F.try_variant_get("v", "$.response_time_ms", "variant"))
    written = F.when(kind == "STRING", "text").when(kind == "BOOLEAN", "boolean").when(kind != "VOID", "number")
    fields = F.coalesce(F.json_object_keys("text"), F.array().cast("array<string>"))
    return parsed.select(key.alias("index"), "r.*", fields.alias("fields"), written.alias("response_time_kind"))


def append_responses(responses: DataFrame, path: str) -> None:
    """Append; developer rows go to their own folder. Every field stays in the record, nulls too."""
    apart = responses.withColumn("developer", F.col("is_developer_validation"))
    apart.write.mode("append").partitionBy("developer").option("ignoreNullFields", "false").json(path)
