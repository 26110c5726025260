"""Insert, update and delete as functions from relations to relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_defaults(rows: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """Columns that rows lack get their default; a given null stays."""
    have = {c.lower() for c in rows.columns}
    return rows.withColumns({c: v for c, v in defaults.items() if c.lower() not in have})


def touch(rows: DataFrame, changed: Column, as_of: Column, column: str = "updated_at") -> DataFrame:
    return rows.withColumn(column, F.when(changed, as_of).otherwise(F.col(column)))


def insert_if_absent(existing: DataFrame, new: DataFrame, key: str, order: list[str]) -> DataFrame:
    """existing and those new rows whose key it lacks; of new rows with one key the first by order."""
    first = F.min_by(F.struct(*(c for c in new.columns)), F.struct(*order)).alias("row")
    once = new.groupBy(F.col(key).alias("_key")).agg(first).select("row.*")
    return existing.unionByName(once.join(existing.select(key), key, "left_anti").select(*existing.columns))


def profiles_of_users(users: DataFrame) -> DataFrame:
    """(id, full_name, avatar_url) from the users' JSON metadata."""
    at = lambda k: F.get_json_object("raw_user_meta_data", f"$.{k}")
    return users.select("id", F.coalesce(at("full_name"), at("name")).alias("full_name"), at("avatar_url").alias("avatar_url"))


def cascade_delete(child: DataFrame, deleted: DataFrame, child_key: str, key: str) -> DataFrame:
    gone = deleted.select(F.col(key).alias(child_key)).distinct()
    return child.join(gone, child_key, "left_anti")


def set_null_delete(child: DataFrame, deleted: DataFrame, child_key: str, key: str) -> DataFrame:
    gone = deleted.select(F.col(key).alias("_gone")).distinct()
    joined = child.join(gone, child[child_key] == gone["_gone"], "left")
    return joined.withColumn(child_key, F.when(F.col("_gone").isNull(), F.col(child_key))).drop("_gone")


def restricted(child: DataFrame, deleted: DataFrame, child_key: str, key: str) -> DataFrame:
    """Keys of deleted that a child still names: the delete must be refused for them."""
    used = child.select(F.col(child_key).alias(key)).distinct()
    return deleted.select(key).distinct().join(used, key, "left_semi")


def advance(jobs: DataFrame, rules: dict[str, str], when: Column) -> DataFrame:
    """Job states moved on in batch: where `when` holds, a status in rules becomes its successor."""
    to = F.create_map(*(F.lit(x) for pair in rules.items() for x in pair))
    return jobs.withColumn("status", F.when(when, F.coalesce(to[F.col("status")], F.col("status"))).otherwise(F.col("status")))
