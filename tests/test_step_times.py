"""Steps keep their time in every rendering of their timestamp."""

import pandas as pd
import pytest

from spanwright.plans import telemetry

AT = 1_572_912_000_000_000  # 2019-11-05 00:00:00 UTC
STAMPS = ["2019-11-05T00:00:00Z", "2019-11-05T02:01:00.000+02:00", " 2019-11-05 00:02:00 ", "2019-11-04T17:03:00-0700", "pending"]


@pytest.fixture(scope="module")
def tables(tmp_path_factory):
    path = tmp_path_factory.mktemp("steps")
    steps = pd.DataFrame({"step_key": range(len(STAMPS)), "trial_id": 1, "step_id": range(len(STAMPS)), "endpoint": "e", "step_timestamp": STAMPS})
    steps = pd.concat([steps, pd.DataFrame({"step_key": [9], "trial_id": [2], "step_id": [0], "endpoint": ["f"], "step_timestamp": ["2019-11-05T00:00:00"]})])
    steps = steps.assign(source="agent", message="m", prompt_tokens=1, completion_tokens=2, ingested_at=pd.Timestamp("2019-11-06").as_unit("us"))
    steps.to_parquet(path / "step_views.parquet", index=False)
    # one sample between the times of the second and third step, none at the second endpoint
    gpu = pd.DataFrame({"sample_id": [5], "endpoint": ["e"], "logged_at": [AT / 1e6 + 100], "sampled_at": [AT / 1e6 + 100], "gpu_util_pct": [1.0], "mem_used_mib": [1.0], "power_w": [1.0], "error": pd.Series([None], dtype="string")})
    gpu.to_parquet(path / "gpu_log.parquet", index=False)
    return str(path)


def test_deltas_read_every_rendering(spark, tables):
    rows = telemetry.q_f01_step_delta(spark, tables).where("trial_id = 1").orderBy("step_id").collect()
    assert [r.delta_sec for r in rows] == [None, 60.0, 60.0, 60.0, None]


def test_only_unreadable_steps_lack_a_time(spark, tables):
    assert telemetry.q_e31_capture_audit(spark, tables).first().no_time == 1


def test_windows_span_every_step(spark, tables):
    assert [r.point_id for r in telemetry.q_d17_samples_in_window(spark, tables).collect()] == [5]
    assert [(r.window_id, r.entity) for r in telemetry.q_d17_uncovered_trials(spark, tables).collect()] == [(2, "f")]
