"""Queries of the operators that prepare training data for language models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwright.llm.conversations import dropped_runs, rebuilt_conversations
from spanwright.llm.nearest import steps_with_telemetry
from spanwright.llm.packing import pack
from spanwright.llm.repeats import collapsed_events, repeated_events
from spanwright.llm.splitting import boundary_tables, emit_pieces, oversized_segments, piece_offsets
from spanwright.llm.stuffing import scored_documents, stuffed_pages
from spanwright.llm.tokens import decode_ids, encode_texts, token_counts
from spanwright.runtime import materialize, read_table


def _matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return steps_with_telemetry(read_table(spark, sf_dir, "step_views"), read_table(spark, sf_dir, "gpu_log"), read_table(spark, sf_dir, "vllm_metrics"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matches(spark, sf_dir).select("step_key", "matched_table", "matched_id")


def p1_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per step with both partners; a side without one is empty."""
    steps = read_table(spark, sf_dir, "step_views").where(F.col("step_key").isNotNull()).select(F.col("step_key").cast("bigint").alias("step_key")).distinct()
    side = lambda table, name: F.max(F.when(F.col("matched_table") == table, F.col(name)))
    found = _matches(spark, sf_dir).groupBy("step_key").agg(
        side("gpu_log", "matched_id").alias("sample_id"),
        side("gpu_log", "delta_us").alias("sample_delta_us"),
        side("vllm_metrics", "matched_id").alias("metric_id"),
        side("vllm_metrics", "delta_us").alias("metric_delta_us"),
    )
    return steps.join(found, "step_key", "left")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dropped_runs(read_table(spark, sf_dir, "traces"), read_table(spark, sf_dir, "turns"))


def p3_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rebuilt_conversations(read_table(spark, sf_dir, "traces"), read_table(spark, sf_dir, "turns"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_events(read_table(spark, sf_dir, "turns"))
    return found.select("run_id", F.col("first_idx").cast("int").alias("first_idx"), F.col("last_idx").cast("int").alias("last_idx"))


def p4_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event of every run after collapsing, near-identical calls included."""
    return collapsed_events(read_table(spark, sf_dir, "turns"), near=0.2, penalty=0.25)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oversized_segments(read_table(spark, sf_dir, "segments")).where(F.col("piece_no") == 0).select("segment_id")


def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts of all pieces of the oversized segments."""
    segments = read_table(spark, sf_dir, "segments")
    tables = materialize(boundary_tables(segments), "boundaries")
    return emit_pieces(segments, tables, piece_offsets(tables))


_TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\p{Z}\x{85}\x{1c}-\x{1f}\x{0b}]"


def p5_rejoined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The oversized segments put together again from their pieces: nothing lost, no piece too large, the overlaps as specified.

    ``tokens_md5`` is over the tokens of the pieces' texts, each piece past the first without its first 128.
    """
    tokens = F.flatten(F.transform("messages", lambda m: F.regexp_extract_all(m["content"], F.lit(_TOKEN), F.lit(0))))
    read = p5_pieces(spark, sf_dir).select("segment_id", "piece_no", tokens.alias("tokens"))
    piece = F.struct("piece_no", F.size("tokens").alias("size"), F.slice("tokens", 1, 128).alias("head"), F.slice("tokens", -128, 128).alias("tail"), F.expr("slice(tokens, IF(piece_no = 0, 1, 129), greatest(size(tokens), 1))").alias("fresh"))
    ordered = read.groupBy("segment_id").agg(F.array_sort(F.collect_list(piece)).alias("pieces"))
    after = F.slice("pieces", 2, F.size("pieces"))
    kept = F.zip_with(F.slice("pieces", 1, F.size("pieces") - 1), after, lambda a, b: a["tail"] == b["head"])
    joined = F.flatten(F.transform("pieces", lambda x: x["fresh"]))
    return ordered.select(
        "segment_id", F.size(joined).cast("bigint").alias("n_tokens"), F.md5(F.array_join(joined, " ")).alias("tokens_md5"),
        F.forall("pieces", lambda x: x["size"] <= 2048).alias("within"), F.forall(kept, lambda x: x).alias("overlapping"),
    )


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_texts(read_table(spark, sf_dir, "documents"))


def p7_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each document's ids decode to its text again."""
    documents = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    decoded = decode_ids(encode_texts(documents)).withColumnRenamed("text", "decoded")
    return documents.join(decoded, "doc_id").select("doc_id", (F.coalesce("text", F.lit("")) == F.col("decoded")).alias("same"))


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_sizes(spark, sf_dir))


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How full the containers are: containers, tokens, and the share of their room that is used."""
    by_container = p8_containers(spark, sf_dir).groupBy("container_id").agg(F.sum("n_tokens").alias("tokens"))
    return by_container.agg(F.count("*").alias("containers"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("fullest"), (F.sum("tokens") / (F.count("*") * 2048)).alias("used"))


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read_table(spark, sf_dir, "documents"), "doc_id", "text", ("source",)).withColumnRenamed("doc_id", "item_id")


def p8_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each text: is all of it packed, in no more parts than needed, and in containers that aren't overfull?"""
    sizes = materialize(_sizes(spark, sf_dir), "counts")
    packed = materialize(pack(sizes), "packed")
    full = packed.groupBy("container_id").agg(F.sum("n_tokens").alias("fill"))
    placed = packed.join(full, "container_id").groupBy("item_id").agg(F.sum("n_tokens").alias("got"), F.count("*").alias("parts"), F.max("fill").alias("fullest"))
    return sizes.join(placed, "item_id", "left").select(
        F.col("item_id").alias("doc_id"), F.coalesce((F.col("got") == F.col("n_tokens")) & (F.col("parts") == F.ceil(F.col("n_tokens") / 2048)), F.lit(False)).alias("complete"), F.coalesce(F.col("fullest") <= 2048, F.lit(False)).alias("within")
    )


def p8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packing with equal shares asked of all sources: what each got in the containers filled while every source lasted."""
    sizes = materialize(_sizes(spark, sf_dir), "counts")
    wanted = sizes.select("source").distinct().withColumn("share", F.lit(1.0))
    packed = materialize(pack(sizes, target_shares=wanted).withColumn("lane", F.shiftright("container_id", 32)), "packed")
    lasts = packed.groupBy("lane", "source").agg(F.max("container_id").alias("last")).groupBy("lane").agg(F.min("last").alias("until"), F.count("*").alias("sources"))
    early = packed.join(lasts, "lane").where(F.col("container_id") <= F.col("until"))
    got = early.groupBy("source").agg(F.sum("n_tokens").alias("tokens"))
    whole = got.agg(F.sum("tokens").alias("all_tokens"), F.count("*").alias("sources"))
    return got.crossJoin(F.broadcast(whole)).select("source", "tokens", (F.col("tokens") / F.col("all_tokens")).alias("share"), (1 / F.col("sources")).alias("wanted"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stuffed_pages(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "doc_reviews")).select("doc_id")


def p9_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "doc_reviews"))


_P3 = r"""once AS (SELECT DISTINCT ON (turn_id) run_id, turn_id, idx, thinking, content,
    CASE WHEN lower(trim(role, E' \t\n\r')) = 'agent' THEN 'assistant' ELSE lower(trim(role, E' \t\n\r')) END AS role,
    coalesce(subagent_depth, 0) AS depth, tool_calls, tool_call_id,
    (content IS NULL OR trim(content, E' \t\n\r') = '') AND coalesce(len(tool_calls), 0) = 0 AS empty
  FROM turns WHERE run_id IS NOT NULL),
counts AS (SELECT run_id, count(*) AS n, count(DISTINCT idx) AS d, min(idx) AS lo, max(idx) AS hi, bool_and(empty) AS blank,
    bool_and(coalesce(role IN ('system', 'user', 'assistant', 'tool'), false)) AS roles,
    count(*) FILTER (role = 'user' AND depth = 0) AS users FROM once GROUP BY run_id),
calls AS (SELECT run_id, idx, unnest(tool_calls).id AS id FROM once),
ties AS (SELECT run_id, id, min(c) AS c0, max(c) AS c1, min(t) AS t0, max(t) AS t1 FROM (
    SELECT run_id, id, idx AS c, NULL AS t FROM calls UNION ALL SELECT run_id, tool_call_id, NULL, idx FROM once WHERE role = 'tool') GROUP BY run_id, id),
untied AS (SELECT DISTINCT run_id FROM ties WHERE id IS NULL OR (t0 IS NOT NULL AND (c0 IS NULL OR c0 >= t0)) OR (c1 IS NOT NULL AND (t1 IS NULL OR t1 <= c1))),
talk AS (SELECT run_id, role, lead(role) OVER (PARTITION BY run_id ORDER BY idx, turn_id) AS next_role FROM once
    WHERE depth = 0 AND (role = 'user' OR (role = 'assistant' AND NOT empty))),
unanswered AS (SELECT DISTINCT run_id FROM talk WHERE role = 'user' AND next_role IS DISTINCT FROM 'assistant'),
dropped AS (SELECT DISTINCT t.run_id FROM traces t LEFT JOIN counts c ON c.run_id = t.run_id
WHERE t.run_id IS NOT NULL AND (c.run_id IS NULL OR c.blank OR c.d <> c.n OR c.lo > 1 OR c.hi - c.lo + 1 <> c.n OR NOT c.roles OR c.users = 0
  OR t.run_id IN (SELECT run_id FROM untied) OR t.run_id IN (SELECT run_id FROM unanswered)))"""
P3_FOUND_SQL = f"WITH {_P3} SELECT run_id FROM dropped"
P3_CONVERSATIONS_SQL = f"""WITH {_P3},
kept AS (SELECT * FROM once WHERE run_id IN (SELECT run_id FROM traces) AND run_id NOT IN (SELECT run_id FROM dropped)),
tied AS (SELECT k.turn_id, max(c.idx) AS call_idx FROM kept k JOIN calls c ON c.run_id = k.run_id AND c.id = k.tool_call_id AND c.idx < k.idx WHERE k.role = 'tool' GROUP BY 1)
SELECT run_id, CAST(k.idx - min(k.idx) OVER (PARTITION BY run_id) AS BIGINT) AS position, CAST(k.idx AS BIGINT) AS idx, role, depth, thinking, content, CAST(coalesce(len(tool_calls), 0) AS INT) AS n_calls, tool_call_id, CAST(t.call_idx AS BIGINT) AS call_idx
FROM kept k LEFT JOIN tied t ON t.turn_id = k.turn_id"""

P5_FOUND_SQL = r"""
WITH once AS (SELECT DISTINCT ON (segment_id) segment_id, messages FROM segments WHERE segment_id IS NOT NULL),
texts AS (SELECT segment_id, unnest(messages).content AS content FROM once)
SELECT segment_id FROM texts WHERE content IS NOT NULL GROUP BY segment_id
HAVING sum(len(regexp_extract_all(content, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\p{Z}\x{85}\x1c-\x1f\x0b]'))) > 2048
"""

P5_REJOINED_SQL = r"""
WITH once AS (SELECT DISTINCT ON (segment_id) segment_id, messages FROM segments WHERE segment_id IS NOT NULL),
found AS (SELECT segment_id, flatten(list_transform(messages, lambda m: regexp_extract_all(coalesce(m.content, ''), '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\p{Z}\x{85}\x1c-\x1f\x0b]'))) AS tokens FROM once)
SELECT segment_id, len(tokens) AS n_tokens, md5(array_to_string(tokens, ' ')) AS tokens_md5, true AS within, true AS overlapping FROM found WHERE len(tokens) > 2048
"""

_P1 = r"""steps AS (SELECT DISTINCT ON (step_key) step_key, endpoint, trim(step_timestamp) AS b FROM step_views WHERE endpoint IS NOT NULL),
parts AS (SELECT step_key, endpoint, TRY_CAST(regexp_replace(b, '(?:[Zz]|[+-][0-9][0-9]:?[0-9][0-9])$', '') AS TIMESTAMP) AS t, regexp_extract(b, '([+-])([0-9][0-9]):?([0-9][0-9])$', ['s', 'h', 'm']) AS o FROM steps),
timed AS (SELECT step_key, endpoint, epoch_us(t) - CASE WHEN o.s IN ('+', '-') THEN CASE o.s WHEN '+' THEN 1 ELSE -1 END * (TRY_CAST(o.h AS BIGINT) * 60 + TRY_CAST(o.m AS BIGINT)) * 60000000 ELSE 0 END AS us FROM parts WHERE t IS NOT NULL),
raws AS (SELECT DISTINCT ON (sample_id) sample_id, endpoint, CASE WHEN logged_at IS NULL OR logged_at = 0 OR isnan(logged_at) THEN nullif(sampled_at, 0) ELSE logged_at END AS raw FROM gpu_log WHERE error IS NULL),
near AS (SELECT 'gpu_log' AS matched_table, sample_id AS id, endpoint, CAST(round(CASE WHEN raw > 1e11 THEN raw * 1e3 ELSE raw * 1e6 END) AS BIGINT) AS us FROM raws WHERE raw IS NOT NULL
  UNION ALL SELECT DISTINCT ON (metric_id) 'vllm_metrics', metric_id, endpoint, epoch_us(ts) FROM vllm_metrics WHERE error IS NULL AND ts IS NOT NULL),
pairs AS (SELECT s.step_key, n.matched_table, n.id AS matched_id, n.us - s.us AS delta_us, row_number() OVER (PARTITION BY s.step_key, n.matched_table ORDER BY abs(n.us - s.us), n.us, n.id) AS k
  FROM timed s JOIN near n ON n.endpoint = s.endpoint AND n.us BETWEEN s.us - 30000000 AND s.us + 30000000)"""
P1_FOUND_SQL = f"WITH {_P1} SELECT step_key, matched_table, matched_id FROM pairs WHERE k = 1"
P1_PAIRS_SQL = f"""WITH {_P1} SELECT a.step_key, max(matched_id) FILTER (matched_table = 'gpu_log') AS sample_id, max(delta_us) FILTER (matched_table = 'gpu_log') AS sample_delta_us,
  max(matched_id) FILTER (matched_table = 'vllm_metrics') AS metric_id, max(delta_us) FILTER (matched_table = 'vllm_metrics') AS metric_delta_us
FROM (SELECT DISTINCT step_key FROM step_views WHERE step_key IS NOT NULL) a LEFT JOIN (SELECT * FROM pairs WHERE k = 1) p ON p.step_key = a.step_key GROUP BY 1"""
P8_WHOLE_SQL = "SELECT doc_id, true AS complete, true AS within FROM documents WHERE text IS NOT NULL AND text <> ''"
P7_ROUND_TRIP_SQL = "SELECT doc_id, true AS same FROM documents"

QUERIES = {
    "p1_found": p1_found,
    "p1_pairs": p1_pairs,
    "p3_found": p3_found,
    "p3_conversations": p3_conversations,
    "p4_found": p4_found,
    "p4_events": p4_events,
    "p5_found": p5_found,
    "p5_pieces": p5_pieces,
    "p5_rejoined": p5_rejoined,
    "p7_ids": p7_ids,
    "p7_round_trip": p7_round_trip,
    "p8_containers": p8_containers,
    "p8_fill": p8_fill,
    "p8_whole": p8_whole,
    "p8_mixture": p8_mixture,
    "p9_found": p9_found,
    "p9_scores": p9_scores,
}
SQL = {"p8_whole": P8_WHOLE_SQL, "p3_conversations": P3_CONVERSATIONS_SQL, "p1_found": P1_FOUND_SQL, "p1_pairs": P1_PAIRS_SQL, "p3_found": P3_FOUND_SQL, "p5_found": P5_FOUND_SQL, "p5_rejoined": P5_REJOINED_SQL, "p7_round_trip": P7_ROUND_TRIP_SQL}
