from recordloom.llm import jaccard, licenses, neighbours, substrings

BUILT = (substrings.op6_substrings, neighbours.op3_neighbours, jaccard.op2_jaccard, licenses.op5_licenses)


def test_settings_stay_and_order_is_free(spark, small):
    """Queries that are built in one order give the same rows when they run in another, and no setting of the session changes."""
    settings = lambda: {r.key: r.value for r in spark.sql("SET").collect()}
    before = settings()
    built = [f(spark, small) for f in BUILT]
    late = [sorted(map(tuple, df.collect())) for df in reversed(built)][::-1]
    assert settings() == before
    assert late == [sorted(map(tuple, f(spark, small).collect())) for f in BUILT]
