"""Reading what the engine takes in: fetched pages, whole-text files, golden cases."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GOLDEN_SCHEMA = "query string, expect array<string>, note string, answerMustContain array<string>, answerMatchAny boolean, answerMustNotContain array<string>"


def text_files(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(url, xml) of whole text files, such as sitemaps or robots.txt; the url is the file's. Missing files give no rows."""
    rows = spark.read.option("ignoreMissingFiles", True).text(paths, wholetext=True)
    return rows.select(F.col("_metadata.file_path").alias("url"), F.col("value").alias("xml"))


def golden_cases(spark: SparkSession, path: str) -> DataFrame:
    """Golden cases of a JSON array, with the names of the tables' columns."""
    rows = spark.read.schema(GOLDEN_SCHEMA).option("multiLine", True).json(path)
    return rows.select(
        "query", "expect", "note", F.col("answerMustContain").alias("answer_must_contain"), F.col("answerMatchAny").alias("answer_match_any"), F.col("answerMustNotContain").alias("answer_must_not_contain")
    )


def read_fetched(spark: SparkSession, path: str) -> DataFrame:
    """Fetched pages, each once however often its row is repeated."""
    return spark.read.parquet(path).dropDuplicates(["fetch_id"])
