"""Sharding by extendible hashing: a directory of hash prefixes whose oversized buckets alone split on.

Every row gets a 60-bit hash of its id.  The directory starts with one bucket, of no bits.
A bucket above the byte limit splits on the next bit, its halves split on where they are
still too large, and so on: a shard is the shortest prefix whose rows fit.

The splits need only sums: one pass adds up bytes by prefixes of as many bits as an even
spread needs, and sums of these give all shorter prefixes.  Prefixes that are still too
large get STEP more bits in another pass over their rows alone, until all fit.

Rows with equal ids have equal hashes.  A bucket of one id that is above the limit goes on
splitting in a directory of its own, by the bits of a hash of the text and, for equal texts,
of the row's number.  So every shard fits its limit but for single rows above it, which are
shards of their own marked `oversized`.

Only DataFrame functions run on the executors; the driver sees sums over the table.

Defined results: a null text has 0 bytes, a null id hashes as the empty string.  An
empty table gives an empty result.  Only id and text are read; columns of other names
are not touched.  A text of any length is one row of one shard.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._tables import discard, read, spool

LIMIT = 1 << 20  # bytes of text in a shard
BITS = 60
STEP = 8


def _hashed(docs: DataFrame) -> DataFrame:
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    text = F.coalesce("text", F.lit(""))
    # 30 bits of the text, then 30 of the row: only what shares an id is ever told apart by these
    rest = F.shiftleft(F.pmod(F.xxhash64(text), F.lit(1 << 30)), 30) + F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 30))
    return docs.select("doc_id", F.conv(F.substring(key, 1, 15), 16, 10).cast("long").alias("h"), F.octet_length(text).cast("long").alias("n_bytes"), rest.alias("rest"))


def prefix(h: str, depth: str) -> str:
    """SQL: the first bits of a hash; depth 0 is the whole directory."""
    return f"shiftright({h}, cast({BITS} - {depth} as int))"


def _leaves(cells: DataFrame, low: int, high: int, limit: int) -> DataFrame:
    """For each cell (a prefix of `high` bits in its tree, with its sums): the depth at which it fits, or null."""
    levels = cells.select("tree", "cell", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("depth"), "n_bytes", "n_hashes")
    levels = levels.withColumn("p", F.expr(f"shiftright(cell, {high} - depth)"))
    sums = levels.groupBy("tree", "depth", "p").agg(F.sum("n_bytes").alias("n_bytes"), F.sum("n_hashes").alias("n_hashes"))
    fits = sums.filter((F.col("n_bytes") <= limit) | (F.col("n_hashes") <= 1) | (F.col("depth") == BITS))
    first = levels.select("tree", "cell", "depth", "p").join(fits.select("tree", "depth", "p", F.lit(True).alias("fits")), ["tree", "depth", "p"], "left")
    return first.groupBy("tree", "cell").agg(F.min(F.when(F.col("fits"), F.col("depth"))).alias("depth"))


def shard_directory(rows: DataFrame, limit: int, first: int) -> DataFrame:
    """(tree, high, cell, depth) from (tree, h, n_bytes): the depth of the shard of each cell, a prefix of `high` bits of h."""
    out, low, high = None, 0, first
    rows = spool(rows.groupBy("tree", "h").agg(F.sum("n_bytes").alias("n_bytes")), "hashes")
    while True:
        cells = spool(rows.groupBy("tree", F.expr(prefix("h", str(high))).alias("cell")).agg(F.sum("n_bytes").alias("n_bytes"), F.count("*").alias("n_hashes")), "cells")
        leaves = spool(_leaves(cells, low, high, limit), "leaves")
        found = leaves.filter("depth is not null").select("tree", F.lit(high).alias("high"), "cell", "depth")
        out = found if out is None else out.unionByName(found)
        rest = leaves.filter("depth is null").select("tree", "cell")
        discard(cells)
        if rest.isEmpty():
            return out
        rows, last = spool(rows.withColumn("cell", F.expr(prefix("h", str(high)))).join(rest, ["tree", "cell"]).select("tree", "h", "n_bytes"), "hashes"), rows
        discard(last)
        low, high = high + 1, min(high + STEP, BITS)


def _placed(rows: DataFrame, directory: DataFrame, h: str, tree: str, name: str) -> DataFrame:
    """rows with `name`, the bits of their shard: each row looks its prefix up at every width that the directory was built with."""
    widths = sorted(r[0] for r in directory.select("high").distinct().collect())  # one for each pass
    if not widths:
        return rows.withColumn(name, F.lit("")).limit(0)
    looked = rows.withColumn("_look", F.explode(F.array(*[F.struct(F.lit(w).alias("high"), F.expr(prefix(h, str(w))).alias("cell")) for w in widths])) if len(widths) > 1 else F.struct(F.lit(widths[0]).alias("high"), F.expr(prefix(h, str(widths[0]))).alias("cell")))
    entry = directory.select(F.col("tree").alias("_tree"), F.col("high").alias("_high"), F.col("cell").alias("_cell"), F.col("depth").alias("_depth"))
    here = (F.col(tree) == F.col("_tree")) & (F.col("_look.high") == F.col("_high")) & (F.col("_look.cell") == F.col("_cell"))
    bits = f"case when _depth = 0 then '' else lpad(bin({prefix(h, '_depth')}), cast(_depth as int), '0') end"
    return looked.join(entry, here).withColumn(name, F.expr(bits)).drop("_look", "_tree", "_high", "_cell", "_depth")


def extendible_shards(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """For each row of docs: doc_id, n_bytes, depth, shard (its prefix in bits, then those within its id), shard_bytes and oversized."""
    hashed = spool(_hashed(docs), "rows")
    total = hashed.agg(F.sum("n_bytes")).first()[0] or 0
    first = max(1, min(BITS, math.ceil(math.log2(max(1, total / limit))) + 2))
    directory = spool(shard_directory(hashed.select(F.lit(0).cast("long").alias("tree"), "h", "n_bytes"), limit, first), "directory")
    placed = _placed(hashed.withColumn("_zero", F.lit(0).cast("long")), directory, "h", "_zero", "bits").drop("_zero")
    sizes = placed.groupBy("bits").agg(F.sum("n_bytes").alias("_bytes"), F.count("*").alias("_rows"))
    large = spool(sizes.filter((F.col("_bytes") > limit) & (F.col("_rows") > 1)).select(F.col("bits").alias("_bits")), "large")  # buckets of one id
    if large.isEmpty():
        placed = placed.withColumn("page", F.lit(""))
    else:
        inside = placed.join(large, F.col("bits") == F.col("_bits"), "left_semi").withColumn("tree", F.col("h"))
        pages = spool(shard_directory(inside.select("tree", F.col("rest").alias("h"), "n_bytes"), limit, STEP), "pages")
        outside = placed.join(large, F.col("bits") == F.col("_bits"), "left_anti").withColumn("page", F.lit(""))
        placed = outside.unionByName(_placed(inside, pages, "rest", "tree", "page").drop("tree"))
    placed = placed.withColumn("shard", F.when(F.col("page") == "", F.col("bits")).otherwise(F.concat_ws(".", "bits", "page"))).drop("rest", "h")
    of = placed.groupBy("shard").agg(F.sum("n_bytes").alias("shard_bytes")).withColumnRenamed("shard", "_shard")
    out = placed.join(of, F.col("shard") == F.col("_shard"))
    return out.select("doc_id", "n_bytes", F.length("bits").cast("int").alias("depth"), "shard", "shard_bytes", (F.col("shard_bytes") > limit).alias("oversized"))


def write_shards(docs: DataFrame, path: str, limit: int = LIMIT) -> None:
    """Writes docs as one folder of Parquet for each shard.

    Every row is written once.  A shard is chosen by id, text and row, so rows that share an id go where the n-th row of
    that id and size goes; null ids are one id.
    """
    size = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    nth = F.row_number().over(Window.partitionBy("_id", "_size").orderBy("_tie"))
    place = extendible_shards(docs.select("doc_id", "text"), limit).select(F.col("doc_id").alias("_id"), F.col("n_bytes").cast("long").alias("_size"), F.concat(F.lit("s"), "shard").alias("shard"))
    place = place.withColumn("_tie", F.col("shard")).withColumn("_nth", nth).drop("_tie")
    rows = docs.drop("shard").withColumns({"_id": F.col("doc_id"), "_size": size, "_tie": F.xxhash64("text")}).withColumn("_nth", nth).drop("_tie")
    same = rows["_id"].eqNullSafe(place["_id"]) & (rows["_size"] == place["_size"]) & (rows["_nth"] == place["_nth"])
    rows.join(place, same).drop("_id", "_size", "_nth").repartition("shard").write.partitionBy("shard").parquet(path)


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extendible_shards(read(spark, sf_dir, "documents").select("doc_id", "text"))


SQL = f"""
WITH hashed AS (
    SELECT doc_id, ('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT AS h, strlen(coalesce(text, ''))::BIGINT AS n_bytes FROM documents),
levels AS (SELECT doc_id, h, n_bytes, d AS depth, h >> ({BITS} - d) AS p FROM hashed, range(0, 41) t(d)),
sums AS (SELECT depth, p, sum(n_bytes) AS shard_bytes, count(*) AS n FROM levels GROUP BY depth, p),
leaf AS (SELECT l.doc_id, l.h, l.n_bytes, min(l.depth) AS depth FROM levels l JOIN sums s USING (depth, p)
         WHERE s.shard_bytes <= {LIMIT} OR s.n = 1 GROUP BY l.doc_id, l.h, l.n_bytes)
SELECT doc_id, leaf.n_bytes, leaf.depth::INT AS depth,
    CASE WHEN leaf.depth = 0 THEN '' ELSE lpad(bin(h >> ({BITS} - leaf.depth)), leaf.depth::INT, '0') END AS shard,
    s.shard_bytes::BIGINT AS shard_bytes, s.shard_bytes > {LIMIT} AS oversized
FROM leaf JOIN sums s ON s.depth = leaf.depth AND s.p = h >> ({BITS} - leaf.depth)
"""
