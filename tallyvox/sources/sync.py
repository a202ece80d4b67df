"""The sync job: review files and catalogs in, enriched reviews, catalog, directories and a manifest out."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import products
from . import uploads
from .csv_files import read_csv_files
from .exports import source_signature

TABLES = ["reviews", "catalog", "base_models", "products"]


def listed(spark: SparkSession, folders: list[str]) -> DataFrame:
    """relative_path, name, size and mtime of all files below the folders; file contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folders)
    return files.select(F.col("path").alias("relative_path"), F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))


def last_manifest(spark: SparkSession, out_dir: str) -> dict | None:
    """The newest row of the manifest below out_dir, if there is one."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{out_dir}/manifest")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    found = spark.read.parquet(f"{out_dir}/manifest").orderBy(F.desc("synced_at")).first()
    return found.asDict() if found else None


def sync_reviews(spark: SparkSession, review_folder: str, catalog_folder: str, out_dir: str, force: bool = False) -> dict:
    """Read CSV files of reviews and catalogs, enrich, write the tables below out_dir, add a manifest row and return it with skipped.

    Where the files are those of the last manifest (same paths, sizes and times) and force is off, nothing is read or
    written. Tables are written anew into a folder of this run, which the manifest names, so a run that fails leaves the
    last tables as they are.
    """
    signature = source_signature(listed(spark, [review_folder, catalog_folder])).first()["signature"]
    last = last_manifest(spark, out_dir)
    if last and last["signature"] == signature and not force:
        return {**last, "skipped": True}
    catalog = products.combine_catalogs(products.load_sku_catalog(read_csv_files(spark, catalog_folder)))
    reviews = uploads.normalize_reviews(uploads.read_review_csv(spark, review_folder).drop("_ord"), include_tags=True)
    run = f"{out_dir}/{signature}-{spark.sql('SELECT uuid()').first()[0][:8]}"
    catalog.write.parquet(f"{run}/catalog")
    products.enrich_with_catalog(reviews, spark.read.parquet(f"{run}/catalog")).write.parquet(f"{run}/reviews")
    enriched = spark.read.parquet(f"{run}/reviews")
    products.base_model_directory(enriched).write.parquet(f"{run}/base_models")
    products.product_directory(enriched).write.parquet(f"{run}/products")
    facts = products.import_manifest(enriched).select("*", F.lit(signature).alias("signature"), F.lit(run).alias("run"), F.lit(json.dumps([review_folder, catalog_folder])).alias("sources"), F.current_timestamp().alias("synced_at"))
    facts.write.mode("append").parquet(f"{out_dir}/manifest")
    return {**last_manifest(spark, out_dir), "skipped": False}


def read_synced(spark: SparkSession, out_dir: str, name: str) -> DataFrame:
    """A table of the last run: reviews, catalog, base_models or products."""
    if name not in TABLES:
        raise ValueError(f"no table {name}; there are {', '.join(TABLES)}")
    last = last_manifest(spark, out_dir)
    if last is None:
        raise ValueError(f"nothing has been synced to {out_dir}")
    return spark.read.parquet(f"{last['run']}/{name}")
