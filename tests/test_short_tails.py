"""Short texts are cut like all others, down to nothing or a split character."""

import pandas as pd

from spanwright.plans import records


def test_short_texts_give_a_row(spark, tmp_path):
    texts = {0: "", 1: "é", 2: "日", 3: "ab", 6: "日本語", 13: "a" * 20, 20: None}
    pd.DataFrame({"doc_id": list(texts), "text": list(texts.values())}).to_parquet(tmp_path / "documents.parquet", index=False)
    rows = records.q_j07_utf8_tail(spark, str(tmp_path)).collect()
    expected = {k: len(t.encode()[: max(len(t.encode()) - k % 7, 0)].decode(errors="ignore")) for k, t in texts.items() if t is not None}
    assert {r.doc_id: r.n for r in rows} == expected
