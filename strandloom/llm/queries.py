"""The registered queries of the training-data operators: each applies its operator to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import html_text, langid, lattice, mixing, packing, quality, sharding, simhash, spans, url_filter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(_table(spark, sf_dir, "pages"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("record.text")
    digest = sharding.shuffled(_table(spark, sf_dir, "documents")).select(
        "bucket",
        "place",
        F.col("record.doc_id").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
    return sharding.dealt(digest, 8)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op4_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents"))
    by_shard = F.array_join(F.transform("by_shard", lambda s: F.concat_ws(":", s["shard"], s["words"])), " ")
    return mixed.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken", F.coalesce(by_shard, F.lit("")).alias("by_shard"))


def _mixing_sql() -> str:
    """The same mix, written for DuckDB: streams, slots and pieces as plain joins."""

    def draw(*parts: str) -> str:
        return f"CAST(concat('0x', substr(md5(concat_ws('|', {', '.join(parts)})), 1, 15)) AS BIGINT)"

    seed, b, rounds = f"'{mixing.SEED}'", mixing.BLOCK, mixing.ROUNDS
    partner = f"((({draw(seed, "'turn'", 'sid', 'pass', 'k')} - x) % greatest(full_blocks, 1) + greatest(full_blocks, 1)) % greatest(full_blocks, 1))"
    swap = draw(seed, "'swap'", "sid", "pass", "k", f"greatest(x, {partner})")
    weights = " ".join(f"WHEN {k} THEN {w}" for k, w in enumerate(mixing.WEIGHTS))
    return f"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
         {draw(seed, "'order'", "coalesce(CAST(doc_id AS VARCHAR), '')", "md5(coalesce(text, ''))")} AS k
  FROM documents
), s1 AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS sid FROM d GROUP BY source
), s2 AS (
  SELECT *, CAST(CASE sid % {len(mixing.WEIGHTS)} {weights} END AS DOUBLE) AS weight, {mixing.MOST} * source_size AS lim FROM s1
), s3 AS (
  SELECT *, lim / weight AS ratio,
         ((SELECT sum(source_size) FROM s2) - coalesce(sum(lim) OVER (ORDER BY lim / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY lim / weight, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS share
  FROM s2
), s4 AS (
  SELECT *, least(CAST(lim AS DOUBLE), weight * (SELECT share FROM s3 WHERE share <= ratio ORDER BY ratio, sid LIMIT 1)) AS target FROM s3
), s AS (
  SELECT sid, source, source_size, target,
         CASE WHEN source_size > 0 THEN CAST(floor(target + 0.5) AS BIGINT) // source_size ELSE 0 END AS passes,
         CASE WHEN source_size > 0 THEN CAST(floor(target + 0.5) AS BIGINT) % source_size ELSE 0 END AS rest,
         (source_size + {b - 1}) // {b} AS blocks, source_size // {b} AS full_blocks, source_size % {b} AS tail
  FROM s4
), p AS (
  SELECT d.doc_id, d.size, s.sid, s.source_size, s.target,
         CAST(sum(d.size) OVER (PARTITION BY s.sid ORDER BY d.k, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) AS BIGINT) - d.size AS start, row_number() OVER () AS rid
  FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source
), u AS (
  SELECT *, passes * blocks + CASE WHEN rest > 0 THEN least(blocks, (rest + {b - 1}) // {b} + 1) ELSE 0 END AS slots FROM s
), t1 AS (
  SELECT *, unnest(range(0, slots)) AS slot FROM u
), thrown AS (
  SELECT sid, {draw(seed, "'shard'", 'sid', 'slot')} % {mixing.SHARDS} AS shard, count(*) AS n FROM t1 GROUP BY ALL
), counts AS (
  SELECT sid, shard, sum(n) OVER (PARTITION BY sid ORDER BY shard) AS upto, n FROM thrown
), t2 AS (
  SELECT t1.*, shard, slot // blocks AS pass, slot % blocks AS pos FROM t1 JOIN counts ON counts.sid = t1.sid AND slot < upto AND slot >= upto - n
), t3 AS (
  SELECT *, CASE WHEN tail > 0 THEN {draw(seed, "'tail'", 'sid', 'pass')} % blocks ELSE blocks END AS tail_pos FROM t2
), t4 AS (
  SELECT sid, shard, pass < passes AS whole,
         CASE WHEN pos = tail_pos THEN full_blocks ELSE list_reduce(range(1, {rounds + 1}), lambda x, k: CASE WHEN {swap} % 2 = 0 THEN {partner} ELSE x END, pos - CASE WHEN pos > tail_pos THEN 1 ELSE 0 END) END AS block,
         CASE WHEN pos = tail_pos THEN tail ELSE {b} END AS length,
         rest - (pos * {b} - CASE WHEN pos > tail_pos THEN {b} - tail ELSE 0 END) AS behind
  FROM t3
), pieces AS (
  SELECT rid, sid, start, size, unnest(range(start // {b}, (start + size - 1) // {b} + 1)) AS block FROM p WHERE size > 0
), by_shard AS (
  SELECT rid, shard, CAST(sum(greatest(0, least(CASE WHEN whole THEN length ELSE least(length, behind) END, start + size - q.block * {b}) - greatest(0, start - q.block * {b}))) AS BIGINT) AS words
  FROM pieces q JOIN t4 USING (sid, block) GROUP BY rid, shard
), taken AS (
  SELECT rid, CAST(sum(words) AS BIGINT) AS taken, string_agg(concat(shard, ':', words), ' ' ORDER BY shard) AS by_shard FROM by_shard WHERE words > 0 GROUP BY rid
)
SELECT doc_id, size, source_size, round(target, 6) AS target, coalesce(taken, 0) AS taken, coalesce(by_shard, '') AS by_shard FROM p LEFT JOIN taken USING (rid)
"""


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_table(spark, sf_dir, "documents"))


def op9_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.deduplicate(_table(spark, sf_dir, "documents"))


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


#: All pairs, and components by following links: what the lattice finds at full recall.
_LATTICE_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
e AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.x, b.x) >= 0.95),
r AS (SELECT vec_id AS at, vec_id AS c FROM v UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.at),
n AS (SELECT a, count(*) AS n FROM e GROUP BY a)
SELECT r.at AS vec_id, coalesce(any_value(n.n), 0) AS n_links, min(r.c) AS component_id, r.at = min(r.c) AS kept FROM r LEFT JOIN n ON n.a = r.at GROUP BY r.at
"""

#: For pages of the driver's form, whose article is one element of headings and paragraphs.
_HTML_SQL = r"""
WITH a AS (SELECT page_id, url, replace(regexp_extract(html, '(?s)<article>(.*?)(</article>|$)', 1), '<br>', ' ') AS inside FROM pages),
b AS (SELECT page_id, unnest(regexp_split_to_array(inside, '</?(?:p|h1)>')) AS block, generate_subscripts(regexp_split_to_array(inside, '</?(?:p|h1)>'), 1) AS i FROM a),
t AS (SELECT page_id, i, trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(block, '<[^>]*>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', chr(39)), '&amp;', '&'), '\s+', ' ', 'g')) AS block FROM b)
SELECT a.page_id, a.url, coalesce(x.text, '') AS text, coalesce(length(x.text), 0) AS n_chars
FROM a LEFT JOIN (SELECT page_id, string_agg(block, chr(10) || chr(10) ORDER BY i) AS text FROM t WHERE block <> '' GROUP BY page_id) x ON x.page_id = a.page_id
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_url_filter": op1_url_filter,
        "op2_sharding": op2_sharding,
        "op3_simhash": op3_simhash,
        "op4_lattice": op4_lattice,
        "op5_mixing": op5_mixing,
        "op6_packing": op6_packing,
        "op7_html_text": op7_html_text,
        "op8_quality": op8_quality,
        "op9_sentence_spans": op9_sentence_spans,
        "op10_langid": op10_langid,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_lattice": _LATTICE_SQL,
        "op5_mixing": _mixing_sql(),
        "op7_html_text": _HTML_SQL,
    }
