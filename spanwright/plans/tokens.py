"""Queries of the token family: two streams cut from the documents, vocabularies, divergences."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanwright.functions.stats import entropy
from spanwright.operators import align as A
from spanwright.plans.views import oracle, rounded, view


def _chunks(text, size):
    """A text in chunks of so many characters."""
    return F.coalesce(*(F.when(size == k, F.regexp_extract_all(text, F.lit(f"(?s).{{1,{k}}}"), F.lit(0))) for k in (1, 2, 3)))


def _tokens(spark, sf_dir):
    """Each document's whole text as student tokens of 1 to 3 characters and teacher tokens of 2 or 3."""
    docs = view(spark, sf_dir, "documents").where(F.length("text") > 0).select(F.col("doc_id").alias("ex_id"), "text")
    sides = F.array(F.struct(F.lit("student").alias("side"), (1 + F.col("ex_id") % 3).alias("size")), F.struct(F.lit("teacher").alias("side"), (2 + F.col("ex_id") % 2).alias("size")))
    flat = docs.select("ex_id", "text", F.explode(sides).alias("s")).select("ex_id", F.col("s.side").alias("side"), F.posexplode(_chunks(F.col("text"), F.col("s.size"))).alias("idx", "piece"))
    lp = F.when(F.col("side") == "student", -(1 + F.col("idx") % 7) / 10.0).otherwise(-(1 + F.col("idx") % 5) / 10.0)
    return flat.select("ex_id", "side", "idx", F.col("piece").cast("binary").alias("token"), lp.alias("logprob"), (F.col("piece") == F.lit("e ")).alias("is_special"))


def _vocab(spark, sf_dir):
    part = view(spark, sf_dir, "part")
    student = part.select(F.lit("student").alias("side"), F.col("p_partkey").alias("token_id"), F.concat_ws("-", "p_brand", F.col("p_size").cast("string")).cast("binary").alias("bytes"), (F.col("p_partkey") % 97 == 0).alias("is_special"))
    teacher = part.select(F.lit("teacher").alias("side"), (F.col("p_partkey") + 1_000_000).alias("token_id"), F.concat_ws("-", "p_brand", (F.col("p_partkey") % 60).cast("string")).cast("binary").alias("bytes"), (F.col("p_partkey") % 89 == 0).alias("is_special"))
    return student.unionByName(teacher)


def _candidates(spark, sf_dir):
    """Lines of an order as the candidates at a position, with log probabilities of both models."""
    lines = view(spark, sf_dir, "lineitem")
    sums = lines.groupBy("l_orderkey").agg(F.sum("l_quantity").alias("q"), F.sum("l_extendedprice").alias("p"))
    joined = lines.join(sums, "l_orderkey")
    return joined.select(F.col("l_orderkey").alias("position"), "l_linenumber", F.log(F.col("l_quantity") / (F.col("q") + 1)).alias("t_lp"), F.log(F.col("l_extendedprice") / (F.col("p") * 1.05)).alias("s_lp"), (F.col("l_linenumber") % 5 != 3).alias("mapped"))


def q_f04_byte_offsets(spark, sf_dir):
    return A.byte_ends(_tokens(spark, sf_dir)).groupBy("ex_id", "side").agg(F.count("*").alias("n"), F.max("byte_end").alias("bytes"), F.sum("byte_end").alias("sum_of_ends"), F.max("occurrence").alias("most"))


def q_d13_alignment(spark, sf_dir):
    spans = A.aligned_spans(_tokens(spark, sf_dir))
    return spans.groupBy("ex_id").agg(F.count("*").alias("spans"), F.sum(F.col("s_end") - F.col("s_start")).alias("student"), F.sum(F.col("t_end") - F.col("t_start")).alias("teacher"), F.max("byte_end").alias("bytes"), F.max(F.col("byte_end") - F.col("byte_start")).alias("widest"))


def q_e20_granularity_report(spark, sf_dir):
    report = A.alignment_report(_tokens(spark, sf_dir))
    kinds = report.join(view(spark, sf_dir, "documents").select(F.col("doc_id").alias("ex_id"), F.coalesce("kind", F.lit("unknown")).alias("kind")), "ex_id")
    return rounded(kinds.rollup("kind").agg(F.count("*").alias("n"), F.avg("granularity").alias("mean_granularity"), F.min("granularity").alias("least"), (F.sum("one_to_one") / F.sum("n_spans")).alias("one_to_one"), F.count("fault").alias("faults")))


def q_c25_span_kinds(spark, sf_dir):
    return A.span_kinds(_tokens(spark, sf_dir)).groupBy("kind").agg(F.count("*").alias("n"), F.sum(F.col("byte_end") - F.col("byte_start")).alias("bytes"))


def q_d16_span_sums(spark, sf_dir):
    sums = A.span_sums(_tokens(spark, sf_dir))
    return rounded(sums.groupBy("ex_id").agg(F.count("*").alias("spans"), F.sum("s_sum").alias("student"), F.sum("t_sum").alias("teacher"), F.sum((F.col("s_sum") - F.col("t_sum")) * F.col("s_sum")).alias("loss")), 6)


def q_d14_exact_map(spark, sf_dir):
    return A.exact_map(_vocab(spark, sf_dir))


def q_e26_fingerprint(spark, sf_dir):
    return A.fingerprint(_vocab(spark, sf_dir), "token_id", F.col("bytes"), "side")


def q_c26_content_type(spark, sf_dir):
    words = view(spark, sf_dir, "documents").where(F.col("text").isNotNull()).select(F.explode(F.split("text", " ")).alias("w"))
    return words.groupBy(A.content_type(F.col("w").cast("binary")).alias("kind")).agg(F.count("*").alias("n"))


def q_m10_coarse_kl(spark, sf_dir):
    return rounded(A.coarse_reverse_kl(_candidates(spark, sf_dir), coverage=0.6131), 8)


def q_m09_topk_kl(spark, sf_dir):
    return rounded(A.topk_reverse_kl(_candidates(spark, sf_dir)), 6)


def q_m08_surrogate(spark, sf_dir):
    rows = _candidates(spark, sf_dir).select(F.col("position").alias("ex_id"), "s_lp", "t_lp", F.col("mapped").alias("supervised"))
    return rounded(A.surrogate(rows), 6)


def q_m14_entropy(spark, sf_dir):
    lists = _candidates(spark, sf_dir).groupBy("position").agg(F.collect_list("t_lp").alias("lps"))
    return rounded(lists.select("position", entropy(F.col("lps")).alias("entropy")), 6)


def q_e15_step_stats(spark, sf_dir):
    """Share of analytic, surrogate and dropped spans, and the masked tokens, over all examples."""
    kinds = A.span_kinds(_tokens(spark, sf_dir))
    dropped = F.col("kind").startswith("DROP")
    return rounded(kinds.agg(F.count("*").alias("spans"), F.avg((F.col("kind") == "A").cast("double")).alias("share_a"), F.avg((F.col("kind") == "B").cast("double")).alias("share_b"), F.sum(F.when(dropped, F.col("s_end") - F.col("s_start")).otherwise(0)).alias("masked_tokens"), F.sum(F.when(~dropped, F.col("byte_end") - F.col("byte_start")).otherwise(0)).alias("bytes_aligned")))


def q_j04_sft_mask(spark, sf_dir):
    """Lines of an order as prompt, their numbers as action."""
    lists = view(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_linenumber")).alias("ids"))
    prompt, action = F.slice("ids", 1, 2), F.slice("ids", 3, 10)
    labels = A.masked_labels(prompt.cast("array<int>"), action.cast("array<int>"), 5)
    return lists.select("l_orderkey", F.array_join(labels.cast("array<string>"), ",").alias("labels"))


def q_j06_padding(spark, sf_dir):
    """Batches of 16 orders padded to their longest member."""
    from pyspark.sql import Window

    lists = view(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.col("l_linenumber").cast("int"))).alias("ids"))
    width = F.max(F.size("ids")).over(Window.partitionBy(F.floor(F.col("l_orderkey") / 16)))
    return lists.withColumn("width", width).select("l_orderkey", F.array_join(A.padded(F.col("ids"), F.col("width"), -100).cast("array<string>"), ",").alias("ids"))


def q_f11_topk_rows(spark, sf_dir):
    """The sampled candidate first, then the likeliest others, three in all."""
    from pyspark.sql import Window

    order = Window.partitionBy("position").orderBy(F.desc(F.col("l_linenumber") == 1), F.desc("t_lp"), "l_linenumber")
    ranked = _candidates(spark, sf_dir).withColumn("k", F.row_number().over(order)).where("k <= 3")
    return ranked.select("position", "k", "l_linenumber")


_TOK = """docs AS (SELECT doc_id AS ex_id, text, 1 + doc_id % 3 AS ss, 2 + doc_id % 2 AS ts FROM documents WHERE length(text) > 0),
chars AS (SELECT ex_id, ss, ts, unnest(string_split(text, '')) AS c, unnest(range(0, length(text))) AS i FROM docs),
tok AS (SELECT ex_id, 'student' AS side, CAST(i // ss AS INT) AS idx, sum(strlen(c)) AS len, string_agg(c, '' ORDER BY i) AS piece FROM chars GROUP BY 1, 3
  UNION ALL SELECT ex_id, 'teacher', CAST(i // ts AS INT), sum(strlen(c)), string_agg(c, '' ORDER BY i) FROM chars GROUP BY 1, 3),
ends AS (SELECT *, CASE side WHEN 'student' THEN -(1 + idx % 7) / 10.0 ELSE -(1 + idx % 5) / 10.0 END AS lp, sum(len) OVER (PARTITION BY ex_id, side ORDER BY idx) AS byte_end FROM tok)"""
_SPANS = _TOK + """,
met AS (SELECT s.ex_id, s.byte_end, s.idx AS s_last, t.idx AS t_last FROM ends s JOIN ends t ON t.ex_id = s.ex_id AND t.byte_end = s.byte_end WHERE s.side = 'student' AND t.side = 'teacher'),
spans AS (SELECT ex_id, row_number() OVER w - 1 AS span_no, coalesce(lag(s_last) OVER w, -1) + 1 AS s_start, s_last + 1 AS s_end, coalesce(lag(t_last) OVER w, -1) + 1 AS t_start, t_last + 1 AS t_end, coalesce(lag(byte_end) OVER w, 0) AS byte_start, byte_end FROM met WINDOW w AS (PARTITION BY ex_id ORDER BY s_last))"""
_KINDS = _SPANS + """,
owner AS (SELECT e.ex_id, e.side, s.span_no, bool_or(e.piece = 'e ') AS sp FROM ends e JOIN spans s ON s.ex_id = e.ex_id AND ((e.side = 'student' AND e.idx >= s.s_start AND e.idx < s.s_end) OR (e.side = 'teacher' AND e.idx >= s.t_start AND e.idx < s.t_end)) WHERE e.piece = 'e ' GROUP BY 1, 2, 3),
kinds AS (SELECT s.*, CASE WHEN byte_end = byte_start THEN 'DROP_empty' WHEN a.sp THEN 'DROP_student_special' WHEN b.sp THEN 'DROP_teacher_special' WHEN s_end - s_start = 1 AND t_end - t_start = 1 THEN 'A' ELSE 'B' END AS kind
  FROM spans s LEFT JOIN owner a ON a.ex_id = s.ex_id AND a.span_no = s.span_no AND a.side = 'student' LEFT JOIN owner b ON b.ex_id = s.ex_id AND b.span_no = s.span_no AND b.side = 'teacher')"""
_VOC = """voc AS (SELECT 'student' AS side, p_partkey AS token_id, concat(p_brand, '-', p_size) AS b, p_partkey % 97 = 0 AS sp FROM part UNION ALL SELECT 'teacher', p_partkey + 1000000, concat(p_brand, '-', p_partkey % 60), p_partkey % 89 = 0 FROM part)"""
_CAND = """sums AS (SELECT l_orderkey, sum(l_quantity) AS q, sum(l_extendedprice) AS p FROM lineitem GROUP BY 1),
cand AS (SELECT l.l_orderkey AS position, l_linenumber, ln(l_quantity / (q + 1)) AS t, ln(l_extendedprice / (p * 1.05)) AS s, l_linenumber % 5 <> 3 AS m FROM lineitem l JOIN sums USING (l_orderkey))"""

QUERIES = {name: f for name, f in dict(globals()).items() if name.startswith("q_")}
SQL = {
    "q_f04_byte_offsets": f"WITH {_TOK} SELECT ex_id, side, count(*) AS n, CAST(max(byte_end) AS BIGINT) AS bytes, CAST(sum(byte_end) AS BIGINT) AS sum_of_ends, 1 AS most FROM ends GROUP BY 1, 2",
    "q_d13_alignment": f"WITH {_SPANS} SELECT ex_id, count(*) AS spans, CAST(sum(s_end - s_start) AS BIGINT) AS student, CAST(sum(t_end - t_start) AS BIGINT) AS teacher, CAST(max(byte_end) AS BIGINT) AS bytes, CAST(max(byte_end - byte_start) AS BIGINT) AS widest FROM spans GROUP BY 1",
    "q_e20_granularity_report": f"WITH {_SPANS}, tot AS (SELECT ex_id, count(*) FILTER (side = 'student') AS n FROM ends GROUP BY 1), r AS (SELECT t.ex_id, t.n, count(s.span_no) AS k, count(*) FILTER (s_end - s_start = 1 AND t_end - t_start = 1) AS one, max(s_end - s_start) AS longest FROM tot t LEFT JOIN spans s ON s.ex_id = t.ex_id GROUP BY 1, 2), j AS (SELECT r.*, coalesce(d.kind, 'unknown') AS kind FROM r JOIN documents d ON d.doc_id = r.ex_id) SELECT kind, count(*) AS n, round(avg(k / n), 9) AS mean_granularity, round(min(k / n), 9) AS least, round(sum(one) / sum(k), 9) AS one_to_one, count(*) FILTER (longest > 8) AS faults FROM j GROUP BY ROLLUP (kind)",
    "q_c25_span_kinds": f"WITH {_KINDS} SELECT kind, count(*) AS n, CAST(sum(byte_end - byte_start) AS BIGINT) AS bytes FROM kinds GROUP BY 1",
    "q_d16_span_sums": f"WITH {_SPANS}, run AS (SELECT ex_id, side, byte_end, sum(lp) OVER (PARTITION BY ex_id, side ORDER BY idx) AS total FROM ends), m AS (SELECT s.ex_id, s.byte_end, s.total AS a, t.total AS b FROM run s JOIN run t ON t.ex_id = s.ex_id AND t.byte_end = s.byte_end WHERE s.side = 'student' AND t.side = 'teacher'), d AS (SELECT ex_id, a - coalesce(lag(a) OVER w, 0) AS s, b - coalesce(lag(b) OVER w, 0) AS t FROM m WINDOW w AS (PARTITION BY ex_id ORDER BY byte_end)) SELECT ex_id, count(*) AS spans, round(CAST(sum(s) AS DOUBLE), 6) AS student, round(CAST(sum(t) AS DOUBLE), 6) AS teacher, round(CAST(sum((s - t) * s) AS DOUBLE), 6) AS loss FROM d GROUP BY 1",
    "q_c26_content_type": r"""WITH w AS (SELECT unnest(string_split(text, ' ')) AS w FROM documents WHERE text IS NOT NULL), b AS (SELECT w, regexp_replace(w, '^[\t\n\x0b\f\r \x{85}\p{Z}]+|[\t\n\x0b\f\r \x{85}\p{Z}]+$', '', 'g') AS t FROM w)
SELECT CASE WHEN w = '' THEN 'empty' WHEN t = '' THEN 'whitespace' WHEN regexp_matches(t, '^[\p{Nd}.\-+eE]+$') AND regexp_matches(t, '\p{Nd}') THEN 'numeric' WHEN regexp_matches(t, '^[\p{L}\p{N}_/.\-$@:]+$') AND regexp_matches(t, '\p{L}') THEN 'identifier' ELSE 'other' END AS kind, count(*) AS n FROM b GROUP BY 1""",
    "q_d14_exact_map": f"WITH {_VOC} SELECT max(token_id) FILTER (side = 'teacher') AS teacher_id, max(token_id) FILTER (side = 'student') AS student_id FROM voc WHERE NOT sp GROUP BY b HAVING count(*) FILTER (side = 'student') = 1 AND count(*) FILTER (side = 'teacher') = 1",
    "q_e26_fingerprint": f"WITH {_VOC} SELECT side, sha256(string_agg(concat(token_id, ':', lower(hex(b))), chr(10) ORDER BY token_id)) AS sha256 FROM voc GROUP BY 1",
    "q_m10_coarse_kl": f"WITH {_CAND}, g AS (SELECT position, sum(exp(t)) AS listed, coalesce(sum(exp(t)) FILTER (m), 0) AS tm, coalesce(sum(exp(s)) FILTER (m), 0) AS sm, coalesce(sum(exp(s) * (s - t)) FILTER (m), 0) AS k, count(*) FILTER (m) AS n FROM cand GROUP BY 1), o AS (SELECT *, tm / listed AS cov, ln(greatest(1 - tm, 1e-3)) AS ot, CASE WHEN sm >= 1 THEN ln(1e-3) ELSE ln(1 - sm) END AS os FROM g) SELECT position, round(cov, 8) AS coverage, round(CASE WHEN n > 0 AND cov >= 0.6131 THEN k + exp(os) * (os - ot) END, 8) AS kl, CASE WHEN n > 0 AND cov >= 0.6131 THEN 1 - tm < -1e-3 END AS clamped FROM o",
    "q_m09_topk_kl": f"WITH {_CAND}, z AS (SELECT position, ln(sum(exp(s))) AS zs, ln(sum(exp(t))) AS zt FROM cand GROUP BY 1) SELECT c.position, round(sum(exp(s - zs) * ((s - zs) - (t - zt))), 6) AS kl FROM cand c JOIN z ON z.position = c.position GROUP BY 1",
    "q_m08_surrogate": f"WITH {_CAND} SELECT position AS ex_id, round(coalesce(avg((s - t) * s) FILTER (m), 0), 6) AS loss, round(coalesce(avg(s - t) FILTER (m), 0), 6) AS mean_log_ratio, count(*) FILTER (m) AS n_tokens FROM cand GROUP BY 1",
    "q_m14_entropy": f"WITH {_CAND} SELECT position, round(-sum(exp(t) * t), 6) AS entropy FROM cand GROUP BY 1",
    "q_e15_step_stats": f"WITH {_KINDS} SELECT count(*) AS spans, round(avg(CAST(kind = 'A' AS INT)), 9) AS share_a, round(avg(CAST(kind = 'B' AS INT)), 9) AS share_b, CAST(sum(CASE WHEN starts_with(kind, 'DROP') THEN s_end - s_start ELSE 0 END) AS BIGINT) AS masked_tokens, CAST(sum(CASE WHEN starts_with(kind, 'DROP') THEN 0 ELSE byte_end - byte_start END) AS BIGINT) AS bytes_aligned FROM kinds",
    "q_j04_sft_mask": "WITH g AS (SELECT l_orderkey, list_sort(list(l_linenumber)) AS ids FROM lineitem GROUP BY 1) SELECT l_orderkey, CASE WHEN len(ids) > 2 THEN array_to_string(list_concat([-100, -100], ids[3:5]), ',') END AS labels FROM g",
    "q_j06_padding": "WITH g AS (SELECT l_orderkey, list_sort(list(l_linenumber)) AS ids FROM lineitem GROUP BY 1), w AS (SELECT *, max(len(ids)) OVER (PARTITION BY l_orderkey // 16) AS width FROM g) SELECT l_orderkey, array_to_string(list_concat(ids, list_transform(range(0, width - len(ids)), lambda i: -100)), ',') AS ids FROM w",
    "q_f11_topk_rows": f"WITH {_CAND}, r AS (SELECT position, CAST(row_number() OVER (PARTITION BY position ORDER BY l_linenumber = 1 DESC, t DESC, l_linenumber) AS INT) AS k, l_linenumber FROM cand) SELECT * FROM r WHERE k <= 3",
}
SQL = {name: oracle(text) for name, text in SQL.items()}
