"""Sharding by proportional stratified interleaving.

Rows are ranked within their source in a seeded random order. A row of rank r among n has the fractional rank (r + 1/2) / n; in the order of
these, any stretch has each source in its share of the whole. Cutting that order into equal counts makes shards that all match the mixture.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline.llm.shared import cut, table
from tideline.llm.strata import handed_out, ranked, with_key


def assigned(docs: DataFrame, shards: int = 24, seed: int = 20, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, size, text_crc32, shard, slot) for every row: counts of shards are at most one apart, slots run from 0 within a shard.

    size: UTF-8 bytes of the text plus 8. A null text has no bytes (checksum 0), a null source is one source, a null id has its own place in the
    order. Equal ids are ordered by checksum and size. Fewer rows than shards leave some shards empty; an empty table gives an empty result.
    Other columns are ignored. No text is shuffled.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), (F.octet_length(text) + 8).cast("long").alias("size_bytes"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = cut(with_key(rows, seed), "rows")
    total = rows.count()
    placed = ranked(rows, total, ["doc_id", "text_crc32", "size_bytes"])
    part = (F.col("rank") + 0.5) / F.col("stratum_rows")
    groups = max(64, total // 100_000)  # fractional ranks are even over 0 to 1, and so are groups of them
    placed = cut(placed.withColumn("part", part).withColumn("g", F.floor(F.col("part") * groups).cast("int")), "placed")
    counts = placed.groupBy("g").agg(F.count("*").alias("n"))
    starts = counts.select("g", (F.sum("n").over(Window.orderBy("g")) - F.col("n")).alias("start"))  # `groups` rows
    rn = F.row_number().over(Window.partitionBy("g").orderBy("part", "stratum", "key", "doc_id", "text_crc32", "size_bytes"))
    at = placed.withColumn("rn", rn).join(starts, "g").withColumn("at", F.col("start") + F.col("rn") - 1)
    shard = F.expr(f"at * {shards}L div {max(total, 1)}L")
    return at.withColumn("shard", shard).select("doc_id", "source", F.col("size_bytes").alias("size"), "text_crc32", F.col("shard").cast("int").alias("shard"), (F.col("at") - F.expr(f"(shard * {max(total, 1)}L + {shards - 1}L) div {shards}L")).alias("slot"))


def sharded(docs: DataFrame, shards: int = 24, seed: int = 20) -> DataFrame:
    """`docs` with shard and slot. Columns of these names are replaced. Rows that repeat an id and a text share out their places."""
    docs = docs.select(*[c for c in docs.columns if c not in ("shard", "slot")])
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    key = lambda crc, size: F.concat_ws(":", name, crc.cast("string"), size.cast("string"))
    text = F.coalesce(F.col("text"), F.lit(""))
    places = cut(assigned(docs, shards, seed).select(key(F.col("text_crc32"), F.col("size")).alias("key"), F.expr(f"slot div 65536 * {shards} + shard").alias("lead"), F.col("slot").alias("at"), "shard", "slot"), "places")
    return handed_out(docs, key(F.crc32(text.cast("binary")), F.octet_length(text) + 8), places).select("row.*", "shard", "slot")


def dealt(docs: DataFrame, place: str, shards: int = 24, source_col: str = "source", slots: int = 64) -> DataFrame:
    """`docs` with shard and slot by the places 0, 1, .. of a given order in column `place`, which goes.

    Each stretch of `slots` places a shard is interleaved as assigned() does it with the whole: rows have fractional ranks within their source, by place, and the order of these is cut into equal counts. So all shards have the
    sources of a stretch in its proportions, and follow the given order from stretch to stretch. Counts of shards are at most one apart, slots run from 0 within a shard. Columns named shard and slot are replaced. Sources
    and places alone are ranked, and then rows shuffled once."""
    at = docs.select(*[c for c in docs.columns if c not in ("shard", "slot")])
    rows = docs.select(F.col(place).alias("at"), F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("")).alias("stratum"), F.expr(f"`{place}` div {shards * slots}").alias("stretch"))
    own, whole = Window.partitionBy("stretch", "stratum"), Window.partitionBy("stretch")  # a stretch's rows at most
    rows = rows.repartition("stretch").withColumn("part", (F.row_number().over(own.orderBy("at")) - 0.5) / F.count("*").over(own))
    rows = rows.withColumn("nth", F.row_number().over(whole.orderBy("part", "stratum", "at")) - 1).withColumn("n", F.count("*").over(whole))
    rows = rows.withColumn("piece", F.expr(f"nth * {shards}L div n"))
    slot = F.col("stretch") * slots + F.col("nth") - F.expr(f"(piece * n + {shards - 1}L) div {shards}L")
    found = rows.select(F.col("at").alias(place), F.struct(F.col("piece").cast("int").alias("shard"), slot.cast("long").alias("slot")).alias("dealt"))
    both = at.select(F.col(place), F.struct(*[c for c in at.columns if c != place]).alias("row")).join(found.hint("merge"), place)
    return both.select("row.*", "dealt.shard", "dealt.slot")


def op10_stratified_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """24 shards of all documents, stratified by source."""
    out = assigned(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")


CRC = """
  select doc_id, source, octet_length(encode(coalesce(text, ''))) + 8 as size,
    xor(list_reduce(list_prepend(4294967295::bigint, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda b: ('0x' || b)::bigint)),
      lambda c, b: xor((c >> 8), crc_table[xor(c & 255, b) + 1])), 4294967295::bigint) as text_crc32
  from documents cross join crc_rule"""
ORACLE_OP10 = f"""
with crc_rule as (
  select list_transform(range(256), lambda i: list_reduce([i::bigint] || range(8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384::bigint) else c >> 1 end)) as crc_table),
r as ({CRC}),
k as (select *, coalesce('=' || source, '') as stratum, md5('20:' || coalesce(doc_id::varchar, '')) as key from r),
ranks as (select *, (row_number() over (partition by stratum order by key, doc_id, text_crc32, size) - 0.5::double) / count(*) over (partition by stratum) as part from k),
placed as (select *, row_number() over (order by part, stratum, key, doc_id, text_crc32, size) - 1 as place, count(*) over () as total from ranks),
s as (select *, place * 24 // total as shard from placed)
select doc_id, size, text_crc32, 'rows' as law, shard::int as shard, place - (shard * total + 23) // 24 as slot, null::int as grown_shard, source from s
"""
