"""The condensed rendering keeps the turns and characters that the operator keeps by default."""

import hashlib

import pandas as pd

from spanwright.plans import trajectories


def test_thirty_turns_at_either_end(spark, tmp_path):
    runs = {"short": 60, "long": 65}
    turns = [{"turn_id": len(r) * 1000 + i, "run_id": r, "idx": i, "role": "user", "thinking": None, "content": f"{i} " + "x" * 450, "tool_calls": None, "tool_call_id": None, "subagent_depth": 0} for r, n in runs.items() for i in range(n)]
    frame = pd.DataFrame(turns).astype({"thinking": "string", "tool_call_id": "string", "tool_calls": "string"})
    frame.assign(ingested_at=pd.Timestamp("2019-11-06").as_unit("us")).to_parquet(tmp_path / "turns.parquet", index=False)
    line = lambda i: f"[{i}] user: " + (f"{i} " + "x" * 450)[:400] + "..."
    short = "\n".join(line(i) for i in range(60))
    long = "\n".join([*(line(i) for i in range(30)), "... [5 turns omitted] ...", *(line(i) for i in range(35, 65))])
    rows = trajectories.q_f17_condensed(spark, str(tmp_path)).collect()
    assert {r.run_id: (r.n_turns, r.md5) for r in rows} == {k: (runs[k], hashlib.md5(t.encode()).hexdigest()) for k, t in (("short", short), ("long", long))}
