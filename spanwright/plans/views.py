"""Relations derived from the driver's tables, as one SQL text that Spark and the oracle both run.

``{name}`` stands for a table or another view.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwright.runtime import read_table

VIEWS: dict[str, str] = {
    # the entry of the largest ordinal holds; a missing outcome follows from the status
    "v_runs": """
SELECT run_id, task, model, coalesce(outcome, CASE WHEN status = 'success' THEN 'win' ELSE 'loss' END) AS outcome, ordinal
FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY ordinal DESC) AS rn FROM {traces}) WHERE rn = 1""",
    "v_capabilities": """
SELECT * FROM (VALUES ('c0', 0), ('c1', 1), ('c2', 2), ('c3', 3), ('c4', 4), ('c5', 5)) AS t(capability_id, ordinal)""",
    "v_labels": """
SELECT run_id, capability_id, CASE WHEN h < '5' THEN 'NA' WHEN capability_id = 'c0' THEN CASE WHEN outcome = 'loss' THEN 'LACKING' ELSE 'PRESENT' END
  WHEN h < 'b' THEN 'PRESENT' ELSE 'LACKING' END AS label
FROM (SELECT run_id, outcome, capability_id, substr(md5(concat(run_id, ':', capability_id)), 1, 1) AS h FROM {v_runs} CROSS JOIN {v_capabilities}) WHERE h <> '0'""",
    "v_truth": """
SELECT run_id, capability_id, CASE WHEN h < '4' THEN 'NA' WHEN h < 'a' THEN 'PRESENT' ELSE 'LACKING' END AS truth
FROM (SELECT run_id, capability_id, substr(md5(concat(run_id, ':', capability_id)), 1, 1) AS h FROM {v_runs} CROSS JOIN {v_capabilities})""",
    # every 40 events of a user are the rollouts of a task by two models: eight first, then 32 more where none passed
    "v_attempts": """
SELECT user_id, concat('task-', part, '-', user_id) AS task, model, rn - 40 * part AS rollout_index, CASE WHEN rn - 40 * part <= 8 THEN 'stage1' ELSE 'stage2' END AS stratum, value AS elapsed_sec,
  CASE event_type WHEN 'error' THEN NULL ELSE (CASE event_type WHEN 'click' THEN 0 WHEN 'purchase' THEN 1 WHEN 'signup' THEN 2 ELSE 3 END)
    < CASE model WHEN 'student' THEN user_id % 5 ELSE CAST(floor(user_id / 5) AS BIGINT) % 5 END END AS passed
FROM (SELECT *, CAST(floor((rn - 1) / 40) AS BIGINT) AS part FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM {events}))
CROSS JOIN (SELECT * FROM (VALUES ('student'), ('teacher')) AS m(model))""",
    "v_rollouts": """
SELECT a.* FROM {v_attempts} a LEFT JOIN (
  SELECT model AS m, task AS t FROM {v_attempts} WHERE stratum = 'stage1' AND passed IS NOT NULL GROUP BY model, task
  HAVING sum(CASE WHEN passed THEN 1 ELSE 0 END) = 0) z ON a.model = z.m AND a.task = z.t
WHERE a.stratum = 'stage1' OR z.t IS NOT NULL""",
    "v_task_caps": """
SELECT DISTINCT task, concat('c', user_id % 6) AS capability FROM {v_attempts}""",
    # documents as pull requests and commits: what they say is their text, how they stand a digest of their id
    "v_pulls": """
SELECT number, split_part(text, chr(10), 1) AS title, concat(text, chr(10), CASE WHEN substr(m, 1, 1) < '2' THEN '' WHEN substr(m, 1, 1) < '7' THEN 'Fixes #31' WHEN substr(m, 1, 1) < '9' THEN '<!-- closes #5 --> nothing'
    WHEN substr(m, 1, 1) < 'c' THEN 'Resolves https://github.com/Acme/Widget/issues/77' WHEN substr(m, 1, 1) < 'e' THEN 'closes https://github.com/other/repo/issues/7' ELSE 'fixed [#12](x), see #3' END) AS body,
  substr(m, 2, 1) = '0' AS is_draft, CASE WHEN substr(m, 3, 1) <> '0' THEN '2024-01-01' END AS merged_at, substr(m, 4, 1) = '0' AS no_files, CASE WHEN substr(m, 5, 1) < '4' THEN 0 WHEN substr(m, 5, 1) < 'd' THEN 2 END AS n_fail_to_pass,
  CASE WHEN substr(m, 6, 1) = '0' THEN 0 WHEN substr(m, 6, 1) = '1' THEN 2 ELSE 1 END AS n_parents, CASE WHEN substr(m, 7, 1) = '0' THEN 'Renovate Bot' ELSE 'Dev' END AS author_name, text, m
FROM (SELECT doc_id AS number, text, md5(concat('pull ', doc_id)) AS m FROM {documents} WHERE text IS NOT NULL)""",
    # every file holds the whole text, as a test with its functions named so
    "v_patch_files": """
SELECT number, k, path, CASE WHEN path LIKE '%test%' THEN replace(text, 'def ', 'def test_') ELSE text END AS content
FROM (SELECT number, k, text, CASE WHEN substr(m, 10 + k, 1) < '4' THEN 'tests/test_core.py' WHEN substr(m, 10 + k, 1) < '6' THEN 'pkg/core_test.go' WHEN substr(m, 10 + k, 1) < '7' THEN 'docs/test/a.md'
    WHEN substr(m, 10 + k, 1) < '9' THEN '.github/workflows/ci.yml' WHEN substr(m, 10 + k, 1) < 'b' THEN 'src/trim_rows.py' WHEN substr(m, 10 + k, 1) < 'd' THEN 'src/view.ts' ELSE concat('lib/part', k, '.py') END AS path
  FROM {v_pulls} CROSS JOIN (SELECT * FROM (VALUES (0), (1), (2), (3)) AS t(k)) WHERE NOT no_files AND (k = 0 OR substr(m, 20 + k, 1) < 'a'))""",
    "v_tasks": """
SELECT task, CASE WHEN substr(m, 1, 1) = '0' THEN NULL WHEN substr(m, 1, 1) = '1' THEN 'not = = toml' WHEN substr(m, 1, 1) = '2' THEN concat('name = "x"', chr(10), '[metadata]', chr(10), 'repo2env = "bad"')
    ELSE concat('[metadata.repo2env.', CASE WHEN substr(m, 2, 1) < '8' THEN 'pr' ELSE 'commit' END, '_runtime]', chr(10), 'base_commit = "', substr(base, 1, CASE WHEN substr(m, 3, 1) = '0' THEN 12 ELSE 40 END), '"', chr(10), 'fail_to_pass = [', ids, ']') END AS task_toml,
  concat('FROM base', chr(10), 'RUN git reset --hard ', CASE WHEN substr(m, 4, 1) < '3' THEN 'HEAD' ELSE base END, chr(10), 'RUN git remote remove origin && git branch -D x && git tag -d y && git reflog expire', CASE WHEN substr(m, 5, 1) < '4' THEN '' ELSE ' && git gc --prune=now' END,
    chr(10), 'RUN git clean ', CASE WHEN substr(m, 6, 1) < '3' THEN '-fdx' WHEN substr(m, 6, 1) < '6' THEN '--exclude=x -fd' ELSE '-fd' END, chr(10), CASE WHEN substr(m, 7, 1) < '8' THEN 'RUN apt-get install -y tmux' ELSE '# tmux is not installed' END, chr(10), '# ', replace(text, chr(10), concat(chr(10), '# '))) AS dockerfile,
  concat('set -e', chr(10), CASE WHEN substr(m, 8, 1) < '3' THEN 'pytest' ELSE concat('git apply - <<EOF', chr(10), '+++ b/tests/test_core.py', chr(10), '+', replace(replace(text, 'def ', 'def test_'), chr(10), concat(chr(10), '+')), chr(10), 'EOF') END) AS test_sh,
  CASE WHEN substr(m, 9, 1) < '3' THEN ' ' WHEN substr(m, 9, 1) < '6' THEN concat('+++ b/tests/test_core.py', chr(10), '+x') ELSE concat('+++ b/src/a.py', chr(10), '+x') END AS oracle,
  CASE WHEN substr(m, 10, 1) < '3' THEN 'oops' WHEN substr(m, 10, 1) < '6' THEN '["other"]' ELSE concat('[', ids, ']') END AS f2p_json
FROM (SELECT doc_id AS task, text, md5(concat('task ', doc_id)) AS m, concat(md5(concat('base ', doc_id)), '01234567') AS base,
    CASE WHEN substr(md5(concat('ids ', doc_id)), 1, 1) < '3' THEN '' WHEN substr(md5(concat('ids ', doc_id)), 1, 1) < '9' THEN '"tests/test_core.py::test_load_rows"' WHEN substr(md5(concat('ids ', doc_id)), 1, 1) < 'c' THEN '"TestTrim/sub", "mod::trim_spans"'
      ELSE '"tests/other.py::test_trim_turns[1]"' END AS ids FROM {documents} WHERE text IS NOT NULL)""",
    "v_turns": """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY turn_id ORDER BY ingested_at) AS rn FROM {turns}) WHERE rn = 1""",
}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "serve_endpoints", "gpu_log", "vllm_metrics", "step_views", "traces", "turns", "segments", "doc_reviews")


def _needs(text: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"{([a-z]\w*)}", text)))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table or a view over the tables of ``sf_dir``."""
    if name in TABLES:
        return read_table(spark, sf_dir, name)
    text = VIEWS[name]
    return spark.sql(text, **{n: view(spark, sf_dir, n) for n in _needs(text)})


def oracle(query: str) -> str:
    """The SQL of a query with the views that it names as common table expressions."""
    order: list[str] = []

    def add(text: str) -> None:
        for n in _needs(text):
            if n in VIEWS and n not in order:
                add(VIEWS[n])
                order.append(n)

    add(query)
    plain = lambda text: re.sub(r"{([a-z]\w*)}", r"\1", text)
    body = plain(query).strip()
    if not order:
        return body
    ctes = ",\n".join(f"{n} AS ({plain(VIEWS[n]).strip()})" for n in order)
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes},\n{body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


def rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    """Doubles rounded, so that the order in which they were summed doesn't show."""
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))
