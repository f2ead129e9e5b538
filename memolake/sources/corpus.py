"""Model tables: from files of notes and logs, and from the test tables that stand in for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, name, source, kind, title, description, body, size, path, sha) of ``documents``."""
    d = table(spark, sf_dir, "documents")
    name = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"))
    return d.select(
        "doc_id", name.alias("name"), "source", F.col("lang").alias("kind"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"),
        F.lit("").alias("description"), F.col("text").alias("body"), F.length("text").cast("long").alias("size"), F.concat_ws("/", "source", name).alias("path"), F.sha1("text").alias("sha"),
    )


def benchmark_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), "text")


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").where("role = 'user'")
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("qid"), "text")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, chunk_no, vec, label) of ``embeddings``: four chunks to a document."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.floor(F.col("vec_id") / 4).alias("doc_id"), (F.col("vec_id") % 4).cast("int").alias("chunk_no"), F.col("embedding").cast("array<double>").alias("vec"), "label", "vec_id")


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src_id, dst_name): targets of links in pages, without anchors, distinct."""
    hrefs = F.regexp_extract_all("html", F.lit(r'href="([^"#?]+)'), F.lit(1))
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("src_id"), F.explode(F.array_distinct(hrefs)).alias("dst_name"))


def scan_files(spark: SparkSession, sources: list[dict]) -> DataFrame:
    """Files of configured sources: name, path, include (globs), exclude (substrings), max_depth. The first source that
    claims a path has it; hidden and vendor folders are skipped."""
    found = None
    for priority, s in enumerate(sources):
        for pattern in s.get("include", ["*.md"]):
            d = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(s["path"])
            inner = F.regexp_replace("path", "^file:/*", "/")
            rel = F.expr(f"substring(regexp_replace(path, '^file:/*', '/'), {len(s['path'].rstrip('/')) + 2})")
            d = d.select(F.lit(priority).alias("priority"), F.lit(s["name"]).alias("source"), inner.alias("path"), rel.alias("rel"), F.col("modificationTime").alias("mtime"), F.col("length").alias("size"), F.decode("content", "UTF-8").alias("raw"))
            d = d.where(~F.col("rel").rlike(r"(^|/)(\.|node_modules/|vendor/|__pycache__/)"))
            for x in s.get("exclude", []):
                d = d.where(~F.col("rel").contains(x))
            if "max_depth" in s:
                d = d.where(F.size(F.split("rel", "/")) <= s["max_depth"])
            found = d if found is None else found.unionByName(d)
    first = Window.partitionBy("path").orderBy("priority")
    return found.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r", "priority")


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines under a schema; a line that can't be read has itself in ``_corrupt_record``."""
    return spark.read.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
