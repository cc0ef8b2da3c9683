"""Rendezvous sharding: every record picks the shard that scores highest for it.

For a record key and a shard of weight ``w`` the first 52 bits of
``md5(key:shard)`` give a number ``u`` in (0, 1), the score is ``-w / ln(u)``,
and the highest score wins (ties: the least shard). The winner depends on the
key and the shards alone, so equal keys share a shard whatever the
partitioning or the rest of the table. A further shard only adds a score: a
record moves if the new shard beats its old one, and only into the new one; a
removed shard gives up its own records and no others. A shard gets records in
proportion to its weight. Every shard is scored by native functions, one pass
and no shuffle; the cost per record grows with the number of shards.

``slots`` number the records of a shard from 0 by a range layout
(``ranks.places``), so a shard of any size is spread over tasks.

Defined results. A null key counts as empty text and has a shard like any
other. Repeated rows, ties: records of one key share the shard and get slots
of their own, in order of size and text checksum; fully equal rows are
interchangeable. Null text: size 8, checksum of no bytes (0); empty text the
same. Long texts: only size and checksum are computed, natively. An empty
table gives none. Further columns stay in ``assign``; columns called like a
result give way. Recovery: the layout of the slots starts from a written
table.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import clear_of, prepare
from .ranks import Scratch, places

SHARDS = 24
BITS = 52


def _score(key: Column, shard: Column, weight: Column) -> Column:
    digest = F.md5(F.concat_ws(":", key, shard.cast("string")).cast("binary"))
    u = (F.conv(F.substring(digest, 1, BITS // 4), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << BITS))
    return -weight / F.log(u)


def winner(key: Column, shards: Mapping[int, float]) -> Column:
    """The shard (struct ``score``, ``least`` = minus its number) that the key
    picks among ``shards`` (number -> weight above 0)."""
    if not shards or any(w <= 0 for w in shards.values()):
        raise ValueError("shards need weights above 0")
    key = F.coalesce(key.cast("string"), F.lit(""))
    table = F.array(*[F.struct(F.lit(int(s)).alias("s"), F.lit(float(w)).alias("w")) for s, w in sorted(shards.items())])
    return F.array_max(F.transform(table, lambda x: F.struct(
        _score(key, x["s"], x["w"]).alias("score"), (-x["s"]).alias("least"))))


def assign(df: DataFrame, key: str, shards: Mapping[int, float], out: str = "shard",
           grown: Mapping[int, float] | None = None, grown_out: str = "grown_shard") -> DataFrame:
    """``df`` with the shard of every row; ``grown`` gives further shards, and
    ``grown_out`` the row's shard once they have joined the others."""
    df = clear_of(df, out, *([grown_out] if grown else []))
    best = df.withColumn("_best", winner(F.col(f"`{key}`"), shards))
    shard = (-F.col("_best.least")).cast("int")
    if not grown:
        return best.withColumn(out, shard).drop("_best")
    best = best.withColumn("_more", winner(F.col(f"`{key}`"), grown))
    # the old shards' scores are as they were: only the new ones can beat them
    return (best.withColumn(out, shard)
            .withColumn(grown_out, (-F.greatest("_best", "_more")["least"]).cast("int")).drop("_best", "_more"))


def slots(df: DataFrame, order: list[Column], scratch: Scratch, shard: str = "shard", out: str = "slot") -> DataFrame:
    """``df`` with its places in each shard, gapless from 0, by ``order``."""
    return places(df, [shard], order, scratch, "slots", out)


def shard_documents(docs: DataFrame, shards: Mapping[int, float], grown: Mapping[int, float] | None = None) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot, grown_shard`` of all documents."""
    prepare(docs.sparkSession)
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select("doc_id", (F.octet_length(raw) + 8).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    rows = assign(rows, "doc_id", shards, grown=grown)
    order = [F.col("doc_id").asc_nulls_first(), F.col("size").asc(), F.col("text_crc32").asc()]
    return slots(rows, order, Scratch(docs.sparkSession, "shards"))


def op12_sharding(spark, sf_dir: str) -> DataFrame:
    equal = {s: 1.0 for s in range(SHARDS)}
    out = shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), equal, {SHARDS: 1.0})
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


#: crc32 byte by byte over a list of byte values, with its table built in SQL
CRC32_SQL = """
table_ AS (
  SELECT list(list_reduce(list_prepend(i::UBIGINT, range(8)::UBIGINT[]),
                          lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END)
              ORDER BY i) AS t
  FROM range(256) r(i))"""


def crc32_sql(text: str) -> str:
    """DuckDB expression: unsigned crc32 of the UTF-8 bytes of ``text``; ``t`` is
    a column with the list of ``CRC32_SQL``."""
    return (f"xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(regexp_extract_all(hex(encode({text})), '..'), "
            "lambda h: ('0x' || h)::UBIGINT)), lambda c, b: xor(c >> 8, "
            "t[(xor(c, b) & 255)::BIGINT + 1])), 4294967295::UBIGINT)::BIGINT")


SQL = f"""
WITH {CRC32_SQL},
docs AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 8 AS size, {crc32_sql("coalesce(text, '')")} AS text_crc32
  FROM (SELECT *, (SELECT t FROM table_) AS t FROM documents)),
scores AS (
  SELECT doc_id, size, text_crc32, s, -1.0::DOUBLE / ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || s), 1, 13))::BIGINT::DOUBLE + 0.5)
         / 4503599627370496.0::DOUBLE) AS score, n
  FROM (SELECT *, row_number() OVER () AS n FROM docs), range({SHARDS + 1}) r(s)),
best AS (
  SELECT n, any_value(doc_id) AS doc_id, any_value(size) AS size, any_value(text_crc32) AS text_crc32,
         max_by(s, (score, -s)) FILTER (WHERE s < {SHARDS}) AS shard, max_by(s, (score, -s)) AS grown
  FROM scores GROUP BY n)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'key' AS law, shard::INTEGER AS shard,
       row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, size, text_crc32) - 1 AS slot,
       grown::INTEGER AS grown_shard
FROM best
"""
