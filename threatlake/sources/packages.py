"""Package candidates from registry metadata, and the first tier's selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

METADATA = (
    "name string, `dist-tags` map<string,string>, time map<string,string>, versions map<string, struct<scripts: map<string,string>, dist: struct<tarball: string>>>, "
    "author struct<name: string>, maintainers array<struct<name: string>>, description string, homepage string, repository struct<url: string>"
)
# Scripts that run at installation.
INSTALL_SCRIPTS = ["preinstall", "install", "postinstall"]


def published(text: Column) -> Column:
    """A time given as ISO text or as seconds since 1970."""
    return F.coalesce(F.try_to_timestamp(text), F.timestamp_seconds(text.try_cast("double")))


def candidates(metadata: DataFrame) -> DataFrame:
    """Candidate rows from (json, downloads_weekly): the latest version's facts."""
    m = metadata.select(F.from_json("json", METADATA).alias("m"), "downloads_weekly")
    version = F.element_at("m.dist-tags", "latest")
    latest = m.withColumn("version", version).withColumn("v", F.element_at("m.versions", F.col("version")))
    scripts = F.coalesce(F.map_keys("v.scripts"), F.array().cast("array<string>"))
    return latest.select(
        F.col("m.name").alias("name"), "version", F.col("v.dist.tarball").alias("tarball_url"), published(F.element_at("m.time", F.col("version"))).alias("published_at"),
        F.coalesce("m.author.name", F.get("m.maintainers", 0)["name"]).alias("author"), "downloads_weekly", scripts.alias("scripts"), F.arrays_overlap(scripts, F.array(*map(F.lit, INSTALL_SCRIPTS))).alias("has_install_scripts"),
        F.col("m.description").alias("description"), F.col("m.homepage").alias("homepage"), F.col("m.repository.url").alias("repository"),
    )


def rejection(cutoff: Column, downloads: int) -> Column:
    """Why a candidate is not of the first tier: the first reason that holds, or null."""
    return (
        F.when(F.col("name").startswith("@"), "scoped").when(~F.col("has_install_scripts"), "no_scripts").when(F.col("published_at").isNull() | (F.col("published_at") < cutoff), "too_old")
        .when(F.col("downloads_weekly") >= downloads, "too_popular")
    )


def first_of_name(rows: DataFrame, order: str) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy("name").orderBy(order))).where("_n = 1").drop("_n")


def tier1(rows: DataFrame, cutoff: Column, downloads: int = 1000, order: str = "seq", most: int | None = None) -> DataFrame:
    """First-tier candidates, one per name; ``most`` ends the selection early."""
    kept = first_of_name(rows, order).where(rejection(cutoff, downloads).isNull())
    return kept.orderBy(order).limit(most) if most is not None else kept


def rejections(rows: DataFrame, cutoff: Column, downloads: int = 1000, order: str = "seq") -> DataFrame:
    counted = first_of_name(rows, order).groupBy(F.coalesce(rejection(cutoff, downloads), F.lit("selected")).alias("reason"))
    return counted.agg(F.count(F.lit(1)).alias("n"))
