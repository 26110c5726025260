"""Reading tables and requests, writing results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REQUEST = "companyName string, sourceUrl string, country string"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def jdbc(spark: SparkSession, url: str, name: str, **options: str) -> DataFrame:
    return spark.read.format("jdbc").options(url=url, dbtable=name, **options).load()


def parse_requests(raw: DataFrame, body: str = "body") -> tuple[DataFrame, DataFrame]:
    """JSON bodies to requests; bodies that are no JSON object go to the second frame.

    A field that is no string counts as missing.
    """
    trimmed = F.trim(F.col(body))
    parsed = raw.withColumn("_v", F.try_parse_json(F.when(F.startswith(trimmed, F.lit("{")), trimmed)))
    is_text = lambda k: F.startswith(F.schema_of_variant(F.try_variant_get("_v", f"$.{k}", "variant")), F.lit("STRING"))
    field = lambda k: F.when(is_text(k), F.try_variant_get("_v", f"$.{k}", "string"))
    good = parsed.where("_v IS NOT NULL")
    good = good.withColumns({"company_name": field("companyName"), "source_url": field("sourceUrl"), "country": field("country")})
    return good.drop("_v", body), parsed.where("_v IS NULL").drop("_v")


def to_response(reports: DataFrame, credits: int) -> DataFrame:
    """Each report row as a JSON response."""
    return reports.select(F.to_json(F.struct(F.struct("*").alias("report"), F.lit("demo").alias("mode"), F.lit(credits).alias("creditsCharged"))).alias("response"))


_KEPT_SPACE = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def write_csv(rows: DataFrame, path: str) -> None:
    """A header, quoted fields where needed, backslashes before quotes; a null is nothing, an empty text is quoted."""
    rows.write.options(header=True, **_KEPT_SPACE).csv(path)


def read_csv(spark: SparkSession, path: str, schema) -> DataFrame:
    """What write_csv() wrote. A field may span lines, so a file is one task: write files of the size of a task."""
    return spark.read.schema(schema).options(header=True, multiLine=True, **_KEPT_SPACE).csv(path)
