"""Mixing sources to target weights by systematic sampling (operator 7).

Every source has a target in words. A document of a source is expected ``target / source size`` times, so the
prefix sum of expected copies at the n-th document is ``n * rate``; one offset is added per source and a copy is
emitted for each integer that a document's step crosses. Documents are laid out by size first, so that the words
taken follow the target as closely as the copies do.

No source is ever in one task: a source is cut into cells (size band x hash bucket), the cells are counted with
map-side partial sums, the running count of cells gives each cell its start, and only within a cell are rows ranked.
The list of sources (one narrow row each) is the only thing that is ordered as a whole.

Defined results: null text has size 0; a null source is a source, last in order; documents of size 0 take 0 words;
repeated rows are separate documents; an empty table gives no rows; other columns, whatever their names, don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memolake.llm.common import WORD, int_hash, table

SEED = "mix-1"
MAX_EPOCHS = 3
WEIGHTS = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, max_epochs: int = MAX_EPOCHS, weights: int = WEIGHTS) -> DataFrame:
    """(_key, _source, _size) rows summed to one row per source, with its target.

    Sources in code-point order weigh 1, 2, .., ``weights``, repeating. With caps c = max_epochs * size, the common
    level after filling the sources of smallest c / weight is (total - caps so far) / (weights left); it rises until
    the first source that stays under its cap and falls after, so the fixed point of resharing is its maximum.
    """
    one = Window.partitionBy(F.lit(0))
    s = sizes.groupBy("_key").agg(F.first("_source").alias("_source"), F.sum("_size").alias("_source_size"))
    s = s.withColumn("_w", ((F.row_number().over(one.orderBy(F.col("_source").asc_nulls_last())) - 1) % weights + 1).cast("long"))
    s = s.withColumn("_cap", F.col("_source_size") * max_epochs)
    by_ratio = one.orderBy(F.col("_cap") / F.col("_w"), F.col("_source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = one.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("_source_size").over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0))).cast("double") / F.sum("_w").over(after)
    s = s.withColumn("_level", level)
    s = s.withColumn("_level", F.max("_level").over(everything))
    return s.select("_key", "_source_size", F.least(F.col("_cap").cast("double"), F.col("_level") * F.col("_w")).alias("_target"))


def mixed(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: str = SEED, max_epochs: int = MAX_EPOCHS, keep: list[str] | None = None) -> DataFrame:
    """All rows of docs in the struct ``row``, with ``size``, ``source_size``, ``target`` and ``copies`` beside it.
    keep: the columns of docs that row has (all): only those go through the shuffle."""
    row = F.struct(*[F.col(f"`{c}`") for c in (docs.columns if keep is None else keep)])
    key = F.when(F.col(source).isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col(source).cast("string")))
    rows = docs.select(row.alias("row"), key.alias("_key"), F.col(source).alias("_source"), F.col(doc_id).alias("_id"), word_count(F.col(text)).alias("_size"))
    # A band holds sizes with the same number of binary digits and the same four leading ones.
    digits = F.length(F.bin("_size"))
    rows = (
        rows.withColumn("_digits", digits)
        .withColumn("_lead", F.expr("shiftright(_size, greatest(_digits - 4, 0))"))
        .withColumn("_bucket", int_hash(F.coalesce(F.col("_id").cast("string"), F.lit("")), 2))
    )
    cell = ["_key", "_digits", "_lead", "_bucket"]
    cells = rows.groupBy(*cell).agg(F.count(F.lit(1)).alias("_n"), F.sum("_size").alias("_size"), F.first("_source").alias("_source"))
    before = Window.partitionBy("_key").orderBy("_digits", "_lead", "_bucket").rowsBetween(Window.unboundedPreceding, -1)
    cells = (
        cells.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .join(source_targets(cells.select("_key", "_source", "_size"), max_epochs), "_key")
        .select(*cell, "_start", "_source_size", "_target")
    )
    ranked = rows.join(cells, cell).withColumn("_rank", F.col("_start") + F.row_number().over(Window.partitionBy(*cell).orderBy("_size", "_id")))
    rate = F.when(F.col("_source_size") > 0, F.col("_target") / F.col("_source_size")).otherwise(F.lit(0.0))
    offset = int_hash(F.concat(F.lit(seed), F.col("_key"))) / F.lit(4294967296.0)
    crossed = F.floor(F.col("_rank") * rate + offset) - F.floor((F.col("_rank") - 1) * rate + offset)
    return ranked.select(
        "row", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"),
        F.least(crossed, F.lit(max_epochs)).cast("long").alias("copies"),
    )


def mix(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, each as often as the mix takes it, in the columns of docs."""
    out = mixed(docs, **options).where("copies > 0")
    return out.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_copy")).select("row.*")


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixed(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), keep=["doc_id"])
    return out.select(F.col("row.doc_id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def mix_sql(documents: str = "documents") -> str:
    """DuckDB SQL for the mix: one row for each row of ``documents`` with its number of copies."""
    return f"""
    SELECT d.*, floor(rn * rate + u)::BIGINT - floor((rn - 1) * rate + u)::BIGINT AS copies FROM (
      SELECT r.*, t.source_size, t.target,
        row_number() OVER (PARTITION BY r.k ORDER BY digits, lead_bits, bucket, size, doc_id) AS rn,
        CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
        ('0x' || substr(md5('{SEED}' || r.k), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
      FROM (
        SELECT *, length(bin(size)) AS digits, size >> greatest(length(bin(size)) - 4, 0) AS lead_bits,
          ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 2))::BIGINT AS bucket FROM (
          SELECT *, CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END AS k,
            coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM {documents})) r
      JOIN (
        SELECT k, source_size, least((3 * source_size)::DOUBLE, max(level) OVER () * w) AS target FROM (
          SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (ORDER BY (3 * source_size)::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
              / (sum(w) OVER (ORDER BY (3 * source_size)::DOUBLE / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM (
            SELECT k, source, source_size, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT AS w FROM (
              SELECT CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END AS k, source,
                sum(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0))::BIGINT AS source_size FROM {documents} GROUP BY ALL)))) t
      ON r.k = t.k) d"""


OP7_SQL = f"SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken FROM ({mix_sql()})"
