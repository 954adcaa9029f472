"""Every supplier is a root, walked as deep as the operator goes."""

import pandas as pd

from spanwright.plans import records

N, DEPTH = 40, 5


def walk(root):
    level, found = [(root,)], [(root,)]
    for _ in range(DEPTH):
        level = [(*p, d) for p in level for d in (p[-1] * 7 % N + 1, (p[-1] * 3 + 5) % N + 1) if d not in p]
        found += level
    return root, len(found), len({p[-1] for p in found}), max(len(p) for p in found) - 1


def test_all_roots_to_full_depth(spark, tmp_path):
    pd.DataFrame({"s_suppkey": range(1, N + 1)}).to_parquet(tmp_path / "supplier.parquet", index=False)
    rows = records.q_a06_subagents(spark, str(tmp_path)).collect()
    assert sorted((r.root, r.visits, r.files, r.depth) for r in rows) == [walk(r) for r in range(1, N + 1)]
