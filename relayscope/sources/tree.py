"""Walking a checkout: which files are documentation or code, and why others are left out."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Folders that are never read, and where a checkout has translated documentation.
SKIPPED = (".git", ".github", "__pycache__", "node_modules", "site")
TRANSLATED = r"^docs/(?!en/)[a-z]{2}(-[a-z]+)?/"


def classified(path: Column) -> Column:
    """docs, code, or the reason why a path (from the checkout's top) is left out: translated, skipped or unsupported."""
    folders = "|".join(f.replace(".", r"\.") for f in SKIPPED)
    return (
        F.when(F.rlike(path, F.lit(rf"(^|/)({folders})/")), "skipped")
        .when(F.rlike(path, F.lit(TRANSLATED)), "translated")
        .when(F.endswith(path, F.lit(".md")), "docs")
        .when(F.endswith(path, F.lit(".py")), "code")
        .otherwise("unsupported")
    )


def files_of(spark: SparkSession, folder: str) -> DataFrame:
    """path (from ``folder``), content, kind of all files of a checkout."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    top = spark._jvm.org.apache.hadoop.fs.Path(folder)
    top = top.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(top).toUri().getPath().rstrip("/") + "/"
    below = F.regexp_replace(F.regexp_replace("path", "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", ""), "^" + re.escape(top), "")
    rows = files.select(below.alias("path"), "content")
    return rows.withColumn("kind", classified(F.col("path")))


def checkout(spark: SparkSession, folder: str) -> DataFrame:
    """path, content, kind of the files that are to be read."""
    rows = files_of(spark, folder).where(F.col("kind").isin("docs", "code"))
    return rows.select("path", F.decode("content", "UTF-8").alias("content"), "kind")


def walk_counts(spark: SparkSession, folder: str) -> DataFrame:
    """kind, n: files that are read, and those that aren't by their reason; no content is read."""
    return files_of(spark, folder).groupBy("kind").agg(F.count("*").alias("n"))
