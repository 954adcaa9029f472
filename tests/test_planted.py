from spanwright.plans.records import q_e17_planted_ceiling


def test_published_ceilings(spark):
    """The ceiling column of the published sweep."""
    found = {r.config: r for r in q_e17_planted_ceiling(spark, "").collect()}
    recovered = {k for k, r in found.items() if r.recovered}
    assert recovered == {"6w/6l@1.0", "6w/6l@0.6", "12w/12l@1.0", "12w/12l@0.6", "12w/12l@0.3"}
    assert len(found) == 9 and all(r.verdict != "recovered" for k, r in found.items() if k not in recovered)
