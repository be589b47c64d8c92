"""Sharding by a two-pass external shuffle, in DataFrame functions only.

Pass one scatters every row, text and all, into memory-sized buckets by a seeded hash of its content;
pass two shuffles each bucket (Spark's ``shuffle`` is a seeded Fisher-Yates over the array) and deals
the buckets' rows, end to end, round the shards, which are written as one folder each. A bucket is the
partition of its own number, so the generator that shuffles it depends on the seed and that number
alone: the same rows and seed give the same shards however the files and partitions are cut. The law is
``rows``: shard counts differ by one at most.
"""

from __future__ import annotations

import uuid
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.llm.common import cut, shared_dir, shuffles_freed, table, unused
from tessella.runtime import gone_at_end

SHARDS = 40
SEED = 20_011
BUCKET_ROWS = 65_536
BUCKET_BYTES = 64 << 20
LEAST_BUCKETS = 64
FILE_BYTES = 256 << 20  # of texts in one written file
#: Bytes of a row besides the columns it carries.
ROW_BYTES = 64
#: Shuffled texts compress badly by the default, and three copies of them are on disk at the most.
CODEC = "zstd"
LAW = "rows"


def bucket_count(rows: int, size: int, bucket_rows: int = BUCKET_ROWS, bucket_bytes: int = BUCKET_BYTES, least: int = LEAST_BUCKETS) -> int:
    """Buckets enough that each holds about ``bucket_rows`` rows and ``bucket_bytes`` bytes at most."""
    return max(least, -(-rows // bucket_rows), -(-size // bucket_bytes))


def shuffle_into_shards(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, payload: tuple[str, ...] = (), bucket_rows: int = BUCKET_ROWS, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, size, text_crc32, the ``payload`` columns, shard and slot (gapless from 0 in each shard).

    Texts go through both passes with or without ``payload``: size (the text's UTF-8 bytes plus 16) and
    text_crc32 are those of the shuffled rows; null text counts as empty. The seed and the rows decide the
    result; rows that are equal in all that is carried are interchangeable. Copies with ids of their own
    spread over all buckets; rows whose id and text repeat too often for a bucket are spread by their
    position instead (only then does the cut of the input matter). An empty table gives no rows; extra
    columns are ignored unless named in ``payload``, where no name may be that of a result.
    A bucket is the only thing held in one task; its size is bounded by the two bucket limits, the
    second by the bytes of all that its rows carry.
    """
    carried = ("text", *(c for c in payload if c != "text"))
    key = F.xxhash64(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit("")))
    rows = docs.select(key.alias("_key"), "doc_id", *[F.col(f"`{c}`").alias(f"_p_{c}") for c in carried])
    held = rows.columns
    bytes_of = sum((F.coalesce(F.octet_length(F.col(f"`_p_{c}`").cast("string")), F.lit(0)).cast("bigint") for c in carried), F.lit(ROW_BYTES))
    n, size = rows.agg(F.count("*"), F.coalesce(F.sum(bytes_of), F.lit(0))).first()
    buckets = bucket_count(n, size, bucket_rows, bucket_bytes)
    often = cut(rows.groupBy("_key").agg(F.count("*").alias("_n")).where(F.col("_n") > max(1, bucket_rows // 4)), "shard-often")
    if not often.isEmpty():
        rows = rows.join(often, "_key", "left")
        salt = F.when(F.col("_n").isNotNull(), F.monotonically_increasing_id()).otherwise(0)
    else:
        salt = F.lit(0)
    scattered = rows.select(*[F.col(f"`{c}`") for c in held], F.pmod(F.xxhash64(F.lit(seed), F.col("_key"), salt), F.lit(buckets)).cast("int").alias("bucket"))
    dealt = scattered.repartitionById(buckets, F.col("bucket")).groupBy("bucket").agg(F.sort_array(F.collect_list(F.struct(*[F.col(f"`{c}`") for c in held]))).alias("rows"))
    shuffled = dealt.select("bucket", F.shuffle("rows", F.lit(seed)).alias("rows"))
    with shuffles_freed(docs.sparkSession):
        placed = cut(shuffled.select("bucket", F.posexplode("rows").alias("pos", "row")).select("bucket", "pos", "row.*").drop("_key"), "shard-buckets", compression=CODEC)
    counts = placed.groupBy("bucket").agg(F.count("*").alias("n"))
    starts = counts.select("bucket", (F.sum("n").over(Window.orderBy("bucket")) - F.col("n")).alias("start"))
    at = F.col("start") + F.col("pos")
    return placed.join(F.broadcast(starts), "bucket").select(
        "doc_id",
        *_digests(F.col("_p_text")),
        *[F.col(f"`_p_{c}`").alias(c) for c in payload],
        F.pmod(at, F.lit(shards)).cast("int").alias("shard"),
        F.floor(at / shards).cast("bigint").alias("slot"),
    )


def _digests(text: Column) -> list[Column]:
    body = F.coalesce(text, F.lit(""))
    return [(F.octet_length(body) + 16).cast("bigint").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32")]


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED, file_bytes: int = FILE_BYTES) -> None:
    """Writes whole documents, one folder for each shard, as files of about ``file_bytes``, each a range of slots in order.

    Columns of ``docs`` that are named as the results (size, text_crc32, shard, slot) are kept with ``_`` after the name.
    """
    results = {"size", "text_crc32", "shard", "slot"}
    for c in docs.columns:
        if c.lower() in results:
            docs = docs.withColumnRenamed(c, unused(docs, f"{c}_"))
    placed = shuffle_into_shards(docs, shards, seed, payload=tuple(c for c in docs.columns if c != "doc_id"))
    size, most = placed.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.max("slot") + 1, F.lit(1))).first()
    files = min(max(1, -(-size // (shards * file_bytes))), most)
    file = F.col("shard") * F.lit(files) + F.floor(F.col("slot") * F.lit(files) / F.lit(most)).cast("int")
    with shuffles_freed(docs.sparkSession):
        placed.repartitionById(shards * files, file).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path, compression=CODEC)


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its shard and slot, under the law ``rows``, as the written shards have them."""
    docs = table(spark, sf_dir, "documents")
    path = f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}"
    gone_at_end(spark, path)
    write_shards(docs, path)
    kept = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in ("doc_id", "text"))
    written = spark.read.schema(f"{kept}, slot bigint, shard int").parquet(path)
    return written.select("doc_id", *_digests(F.col("text")), F.lit(LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
