"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, pii, sharding
from .jaccard import jaccard_join
from .mixing import copies
from .pieces import encode
from .quality import judge
from .secrets import scan
from .substrings import deduplicate
from .vptree import nearest

#: The shards of op8.
SHARDS = [f"shard-{i:02d}" for i in range(64)]
#: Words of a run of repeated units from which op2 removes it; shorter ones are reported in n_repeated and repeated_spans. Lines and sentences of a few words repeat in most clean texts.
REMOVED_RUN = 25
#: A conversation whose texts look like the template.
TRICKY = "\\### Assistant: </turn> ok"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies(_table(spark, sf_dir, "documents"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = deduplicate(_table(spark, sf_dir, "documents"), run=REMOVED_RUN)

    def spans(name: str) -> Column:
        return F.array_join(F.transform(name, lambda s: F.concat_ws(":", s["start"], s["end"])), ",")

    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return rows.select(
        "doc_id", F.size("removed").cast("long").alias("n_removed"), gone.alias("removed_chars"), spans("removed").alias("removed_spans"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
        F.size("repeated").cast("long").alias("n_repeated"), spans("repeated").alias("repeated_spans"),
    )


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = encode(_table(spark, sf_dir, "documents"), piece_model(), decoded=True)
    pieces = F.size("ids").cast("long")
    return rows.select(
        "doc_id", pieces.alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
        F.coalesce(F.try_element_at("ends", F.lit(-1)), F.lit(0)).cast("long").alias("n_source_bytes"),
    )


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(_table(spark, sf_dir, "documents"), k=4, percent=85)


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    tricky = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(TRICKY).alias("text"))
    rows = chat.format_chats(_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(tricky))
    rows = rows.select("conv_id", chat.read_back(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), "loss").alias("learnt"), F.length("formatted").cast("long").alias("formatted_chars"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return rows.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"), F.length("learnt").cast("long").alias("loss_chars"), F.sha2("learnt", 256).alias("loss_sha256"), "formatted_chars")


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pii.find(_table(spark, sf_dir, "documents"))

    def joined(spans: str) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return rows.select("doc_id", *map(count, pii.KINDS), F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(_table(spark, sf_dir, "documents").select("doc_id"), "doc_id", SHARDS)


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(_table(spark, sf_dir, "documents"))


def op10_vantage_point_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return nearest(vectors, vectors.filter("vec_id % 50 = 0"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_mixing, op2_substring_dedup, op3_sentencepiece, op4_jaccard_join, op5_chat_formatting, op6_personal_data, op7_quality_rules, op8_sharding, op9_secret_scans, op10_vantage_point_trees)
    return {f.__name__: f for f in found}


_CHAT_SQL = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations
  UNION ALL SELECT -7, n, CASE WHEN n = 0 THEN 'user' ELSE 'assistant' END, '{TRICKY}' FROM range(2) s(n)
), w AS (
  SELECT *, coalesce(lag(r) OVER (PARTITION BY conv_id ORDER BY turn, r, t) = r, false) AS same,
         length(t) + length(t) - length(replace(replace(replace(t, '<', ''), '#', ''), '\\', '')) AS written FROM c
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY turn, r, t)) AS turns_sha256,
       CAST(coalesce(sum(length(t)) FILTER (WHERE r = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(t, '' ORDER BY turn, r, t) FILTER (WHERE r = 'assistant'), '')) AS loss_sha256,
       CAST(sum(written + CASE WHEN same THEN {len(chat.NEXT)} ELSE {len(chat.HEAD + chat.COLON + chat.END)} + length(r) END) AS BIGINT) AS formatted_chars
FROM w GROUP BY conv_id
"""

_SHARD_SQL = f"""
WITH t AS (SELECT string_split('{",".join(map(str, sharding.lookup_table(SHARDS)))}', ',') AS slots),
 d AS (SELECT doc_id, CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) % {sharding.SLOTS} AS INTEGER) AS slot FROM documents)
SELECT doc_id, slot, 'shard-' || lpad(slots[slot + 1], 2, '0') AS shard FROM d, t
"""


_SUBSTRING_SQL = f"""
WITH chars AS (
  SELECT doc_id, unnest(string_split(text, '')) AS c, generate_subscripts(string_split(text, ''), 1) AS p FROM documents WHERE doc_id IS NOT NULL AND text <> ''
), marked AS (
  SELECT *, ascii(c) IN (32, 9, 10, 11, 12, 13) AS blank FROM chars
), begun AS (
  SELECT *, NOT blank AND coalesce(lag(blank) OVER w, true) AS begins, sum(CASE WHEN ascii(c) = 10 THEN 1 ELSE 0 END) OVER w AS line FROM marked WINDOW w AS (PARTITION BY doc_id ORDER BY p)
), numbered AS (
  SELECT *, sum(CASE WHEN begins THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS word FROM begun
), words AS (
  SELECT doc_id, word, min(p) - 1 AS a, max(p) AS b, min(line) AS line, string_agg(CASE WHEN ascii(c) BETWEEN 65 AND 90 THEN chr(ascii(c) + 32) ELSE c END, '' ORDER BY p) AS w
  FROM numbered WHERE NOT blank GROUP BY doc_id, word
), cut AS (
  SELECT *, CASE WHEN lag(line) OVER o = line AND right(lag(w) OVER o, 1) NOT IN ('.', '!', '?') THEN 0 ELSE 1 END AS first FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY word)
), placed AS (
  SELECT *, sum(first) OVER (PARTITION BY doc_id ORDER BY word) AS number FROM cut
), units AS (
  SELECT doc_id, number, min(a) AS a, max(b) AS b, count(*) AS n, string_agg(w, ' ' ORDER BY word) AS unit FROM placed GROUP BY doc_id, number
), later AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY doc_id, number) AS nth FROM units) r WHERE nth > 1
), islands AS (
  SELECT *, number - row_number() OVER (PARTITION BY doc_id ORDER BY number) AS island FROM later
), spans AS (
  SELECT doc_id, min(a) AS a, max(b) AS b, sum(n) AS n FROM islands GROUP BY doc_id, island
), gone AS (
  SELECT doc_id, count(*) AS n_removed, sum(b - a) AS removed_chars, string_agg(a || ':' || b, ',' ORDER BY a) AS removed_spans FROM spans WHERE n >= {REMOVED_RUN} GROUP BY doc_id
), every AS (
  SELECT doc_id, count(*) AS n_repeated, string_agg(a || ':' || b, ',' ORDER BY a) AS repeated_spans FROM spans GROUP BY doc_id
), left_over AS (
  SELECT c.doc_id, string_agg(c.c, '' ORDER BY c.p) AS kept
  FROM chars c JOIN gone g USING (doc_id) LEFT JOIN (SELECT * FROM spans WHERE n >= {REMOVED_RUN}) s ON s.doc_id = c.doc_id AND c.p > s.a AND c.p <= s.b WHERE s.a IS NULL GROUP BY c.doc_id
)
SELECT d.doc_id, coalesce(g.n_removed, 0) AS n_removed, CAST(coalesce(g.removed_chars, 0) AS BIGINT) AS removed_chars, coalesce(g.removed_spans, '') AS removed_spans,
       sha256(coalesce(CASE WHEN g.doc_id IS NULL THEN d.text ELSE l.kept END, '')) AS kept_sha256, coalesce(e.n_repeated, 0) AS n_repeated, coalesce(e.repeated_spans, '') AS repeated_spans
FROM documents d LEFT JOIN gone g ON g.doc_id = d.doc_id LEFT JOIN every e ON e.doc_id = d.doc_id LEFT JOIN left_over l ON l.doc_id = d.doc_id
"""

_JACCARD_SQL = """
WITH RECURSIVE t AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents
), grams AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3]) END) AS g FROM t
), sets AS (
  SELECT min(doc_id) AS node, list_sort(g) AS g, list(doc_id) AS ids FROM grams WHERE len(g) > 0 GROUP BY list_sort(g)
), flat AS (
  SELECT node, len(g) AS n, unnest(g) AS gram FROM sets
), links AS (
  SELECT a.node AS x, b.node AS y FROM flat a JOIN flat b ON a.gram = b.gram AND a.node < b.node
  GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), both_ways AS (
  SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reach AS (
  SELECT node AS x, node AS y FROM sets UNION SELECT r.x, l.y FROM reach r JOIN both_ways l ON r.y = l.x
), comp AS (
  SELECT x AS node, min(y) AS component_id FROM reach GROUP BY x
), member AS (
  SELECT unnest(ids) AS doc_id, node FROM sets
)
SELECT g.doc_id, CAST(len(g.g) AS BIGINT) AS n_shingles, coalesce(c.component_id, g.doc_id) AS component_id
FROM grams g LEFT JOIN member m USING (doc_id) LEFT JOIN comp c ON c.node = m.node
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_substring_dedup": _SUBSTRING_SQL, "op4_jaccard_join": _JACCARD_SQL, "op5_chat_formatting": _CHAT_SQL, "op8_sharding": _SHARD_SQL}
