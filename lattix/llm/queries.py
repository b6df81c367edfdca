"""The queries ``opN_<name>`` and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattix.llm import chat, decontam, fingerprint, langid, linededup, mixing, quality, sharding, simhash, toxicity
from lattix.llm.common import held_out

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of each document."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, ["doc_id"]).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


@query
def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of each document."""
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(docs), ["doc_id"]).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@query
def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of documents whose SimHash fingerprints link at 2 or fewer differing bits."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight shards of nearly equal bytes."""
    placed = sharding.shard(table(spark, sf_dir, "documents"), 8)
    text = F.coalesce("text", F.lit(""))
    return placed.select("doc_id", sharding.text_bytes(F.col("text")).alias("size"), F.crc32(text).alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op5_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed one-permutation MinHash of each document and of its edited text."""
    return fingerprint.fingerprint(table(spark, sf_dir, "documents"))


@query
def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without the later occurrences of repeated three-line windows."""
    return linededup.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "text")


@query
def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents taken into a mixture of half of all tokens, once for each epoch."""
    mixed = mixing.mix(table(spark, sf_dir, "documents"), mixing.corpus_levels(), mixing.CORPUS_WEIGHTS, (1, 2), 2, seed=7)
    return mixed.select("doc_id", "epoch", "leaf.*", "n_tokens")


@query
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of each document."""
    docs = table(spark, sf_dir, "documents")
    machine = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, machine, ["doc_id"]).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


@query
def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document that lie in a window of a benchmark item."""
    found = decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return decontam.digest(found).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@query
def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation from the perspective of each participant."""
    found = chat.perspectives(table(spark, sf_dir, "conversations"))
    mask = F.array_join(F.transform("mask", lambda m: F.concat_ws("-", m["start"].cast("string"), m["end"].cast("string"))), ",")
    return found.select("conv_id", "perspective", "n_turns", "text", mask.alias("mask"))


ORACLES["op6_line_dedup"] = """
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
w AS (
  SELECT doc_id, s - 1 AS pos, l[s:s + 2] AS win FROM (SELECT doc_id, l, unnest(range(1, len(l) - 1)) AS s FROM d WHERE len(l) >= 3)
), ranked AS (
  SELECT doc_id, pos, row_number() OVER (PARTITION BY win ORDER BY doc_id, pos) AS r FROM w
), covered AS (
  SELECT DISTINCT doc_id, unnest(range(pos, pos + 3)) AS pos FROM ranked WHERE r > 1
), lines AS (
  SELECT doc_id, l[s] AS line, s - 1 AS pos FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS s FROM d)
), kept AS (
  SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY lines.pos) FILTER (covered.pos IS NULL), '') AS text, count(covered.pos) AS n_removed
  FROM lines LEFT JOIN covered USING (doc_id, pos) GROUP BY doc_id
)
SELECT d.doc_id, CAST(CASE WHEN d.text IS NULL THEN 0 ELSE len(d.l) END AS BIGINT) AS n_lines, coalesce(kept.n_removed, 0) AS n_removed, CASE WHEN d.text IS NULL THEN NULL ELSE kept.text END AS text
FROM d LEFT JOIN kept USING (doc_id)
"""


def _fill(child: str, up: str, family: str) -> str:
    """SQL of one level of the budget tree: ``child`` is the level's column, ``family`` its ancestors."""
    part = f"PARTITION BY {family + ', ' if family else ''}weight > 0"
    whole = f"PARTITION BY {family}" if family else ""
    path = f"{family + ', ' if family else ''}{child}"
    return f"""
{child}_ranked AS (
  SELECT *, coalesce(sum(cap) OVER ({part} ORDER BY cap / weight, cap, weight, {child} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS taken,
    sum(weight) OVER ({part} ORDER BY cap / weight, cap, weight, {child} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS heavy FROM {child}_nodes
), {child}_full AS (SELECT *, weight > 0 AND cap * heavy <= weight * (given - taken) AS is_full FROM {child}_ranked),
{child}_shared AS (
  SELECT *, sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER ({whole}) AS spent, sum(CASE WHEN NOT is_full AND weight > 0 THEN weight ELSE 0 END) OVER ({whole}) AS open FROM {child}_full
), {child}_given AS (
  SELECT {path}, CAST(CASE WHEN is_full THEN cap WHEN weight = 0 THEN 0 ELSE weight * (given - spent) // open END AS BIGINT) AS given FROM {child}_shared
)"""


def _weight(level: str) -> str:
    known = "".join(f" WHEN '{k}' THEN {w}" for k, w in mixing.CORPUS_WEIGHTS.get(level, {}).items())
    return f"CASE {level}{known} ELSE 1 END" if known else "1"


ORACLES["op7_mixing"] = f"""
WITH base AS (
  SELECT doc_id, 'domain' || CAST(coalesce(TRY_CAST(regexp_extract(source, '([0-9]+)$', 1) AS INTEGER), 0) % 3 AS VARCHAR) AS domain,
    coalesce(lang, 'unknown') AS lang, coalesce(source, 'unknown') AS source,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_tokens FROM documents
), leaves AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS n_tokens, CAST(2 * sum(n_tokens) AS BIGINT) AS cap FROM base GROUP BY ALL),
root AS (SELECT CAST(least(sum(n_tokens) * 1 // 2, sum(cap)) AS BIGINT) AS given FROM leaves),
domain_nodes AS (SELECT domain, CAST(sum(cap) AS BIGINT) AS cap, {_weight("domain")} AS weight, any_value(given) AS given FROM leaves, root GROUP BY domain),
{_fill("domain", "", "")},
lang_nodes AS (SELECT domain, lang, CAST(sum(cap) AS BIGINT) AS cap, {_weight("lang")} AS weight, any_value(given) AS given FROM leaves JOIN domain_given USING (domain) GROUP BY domain, lang),
{_fill("lang", "domain", "domain")},
source_nodes AS (SELECT domain, lang, source, CAST(sum(cap) AS BIGINT) AS cap, {_weight("source")} AS weight, any_value(given) AS given FROM leaves JOIN lang_given USING (domain, lang) GROUP BY domain, lang, source),
{_fill("source", "lang", "domain, lang")},
plan AS (
  SELECT domain, lang, source, CASE WHEN n_tokens > 0 THEN given // n_tokens ELSE 0 END AS epochs, CASE WHEN n_tokens > 0 THEN given % n_tokens ELSE 0 END AS rest
  FROM leaves JOIN source_given USING (domain, lang, source)
), ordered AS (
  SELECT base.*, epochs, rest, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('7:' || CAST(epochs AS VARCHAR) || ':' || CAST(doc_id AS VARCHAR))) AS upto
  FROM base JOIN plan USING (domain, lang, source)
), times AS (SELECT *, epochs + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END AS n FROM ordered)
SELECT doc_id, CAST(unnest(range(0, n)) AS INTEGER) AS epoch, domain, lang, source, n_tokens FROM times WHERE n > 0
"""

ORACLES["op10_chat"] = """
WITH said AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations),
speakers AS (SELECT DISTINCT conv_id, role AS perspective FROM said WHERE role <> 'system'),
parts AS (
  SELECT conv_id, perspective, turn, role, text, role = perspective AS own,
    CASE WHEN role = 'system' THEN '<|system|>' || chr(10) WHEN role = perspective THEN '<|assistant|>' || chr(10) ELSE '<|user name=' || replace(role, '<|', '< |') || '|>' || chr(10) END AS head,
    replace(text, '<|', '< |') || '<|end|>' || chr(10) AS body
  FROM said JOIN speakers USING (conv_id)
), placed AS (
  SELECT *, coalesce(sum(length(head) + length(body)) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS at_char FROM parts
)
SELECT conv_id, perspective, count(*) AS n_turns, string_agg(head || body, '' ORDER BY turn NULLS FIRST, role, text) AS text,
  coalesce(string_agg(CAST(CAST(at_char + length(head) AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(at_char + length(head) + length(body) AS BIGINT) AS VARCHAR), ',' ORDER BY turn NULLS FIRST, role, text) FILTER (own), '') AS mask
FROM placed GROUP BY conv_id, perspective
"""

ORACLES["op9_decontaminate"] = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), i AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL
), starts AS (
  SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS s FROM i WHERE len(w) > 0
), windows AS (
  SELECT DISTINCT item, len(w[s:s + 12]) AS size, array_to_string(w[s:s + 12], ' ') AS win FROM starts
), places AS (
  SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS s FROM d
), hits AS (
  SELECT p.doc_id, p.s, x.size, x.item
  FROM (SELECT doc_id, s, size, array_to_string(w[s:s + size - 1], ' ') AS win FROM places, (SELECT DISTINCT size FROM windows) WHERE s + size - 1 <= len(w)) p
  JOIN windows x ON x.win = p.win AND x.size = p.size
), words_hit AS (
  SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + size)) AS pos FROM hits) GROUP BY doc_id
), items_hit AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN words_hit USING (doc_id) LEFT JOIN items_hit USING (doc_id)
"""
