"""Sharding by proportional stratified interleaving.

Rows are shuffled by a seeded hash within each source; row r of n in its source gets the fractional rank
(r - 1/2) / n. All rows sorted by fractional rank, then cut into shards of equal counts (one apart at most), give every
shard the mixture of the whole. A sort in one task is never needed: ranks are counted in two levels. The hash range (for
a source) and the range of fractional ranks (for the whole) are cut into BUCKETS; the counts of buckets give each
bucket's first rank, and a window in the bucket gives the rest. A source with a third of all rows is spread over all
buckets. Texts are reduced to size and CRC in the scan and never shuffled.

Law `rows`. The shuffle's hash is of id, text (its CRC) and seed, so that rows without an id, or with the same one, are
spread like others. Defined results: a null text has no bytes (size 16, CRC 0); null sources are a stratum of their own,
and so is the empty source; null or repeated ids and repeated rows each take a slot of their own (equal rows in either order); an empty table gives no
rows; other columns don't matter. A group of equal texts isn't held together: it may be larger than a shard.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SHARDS, OVERHEAD, SEED, BUCKETS = 40, 16, 20250101, 4096


def interleave(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED) -> DataFrame:
    """(id, source, size, text_crc32, shard, slot): every row of docs once."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.concat(F.lit("="), F.col(source_col)), F.lit("")).alias("stratum"),
        (F.octet_length(text).cast("long") + OVERHEAD).alias("size"), F.crc32(text).alias("crc"),
        F.xxhash64(F.col(id_col), F.crc32(text), F.lit(seed)).alias("h"),
    ).withColumn("b", F.floor((F.col("h").cast("double") / 2.0**64 + 0.5) * BUCKETS).cast("int"))
    first = Window.partitionBy("stratum").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("stratum", "b").agg(F.count("*").alias("c")).select("stratum", "b", F.coalesce(F.sum("c").over(first), F.lit(0)).alias("before"), F.sum("c").over(Window.partitionBy("stratum")).alias("n"))
    ranked = rows.withColumn("rn", F.row_number().over(Window.partitionBy("stratum", "b").orderBy("h", "id", "crc", "size"))).join(counts, ["stratum", "b"])
    f = (F.col("before") + F.col("rn") - 0.5) / F.col("n")
    placed = ranked.select("id", "stratum", "size", "crc", "h", f.alias("f"), F.floor(f * BUCKETS).cast("int").alias("fb"))
    over = Window.orderBy("fb").rowsBetween(Window.unboundedPreceding, -1)
    # BUCKETS rows at most meet in this window without a key
    counts2 = placed.groupBy("fb").agg(F.count("*").alias("c")).select("fb", F.coalesce(F.sum("c").over(over), F.lit(0)).alias("before"), F.sum("c").over(Window.partitionBy()).alias("n"))
    within = Window.partitionBy("fb").orderBy("f", F.xxhash64("stratum", F.lit(seed)), "stratum", "h", "id", "crc", "size")
    at = F.col("before") + F.col("rn") - 1
    cut = placed.withColumn("rn", F.row_number().over(within)).join(F.broadcast(counts2), "fb").withColumn("at", at).withColumn("shard", F.expr(f"(at * {shards}) div n"))
    start = F.expr(f"(shard * n + {shards - 1}) div {shards}")
    return cut.select("id", F.when(F.col("stratum") != "", F.expr("substr(stratum, 2)")).alias("source"), "size", F.col("crc").alias("text_crc32"), F.col("shard").cast("int").alias("shard"), (F.col("at") - start).cast("long").alias("slot"))


def op9_interleave(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return interleave(docs).select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")
