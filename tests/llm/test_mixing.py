"""Mixing to targets that are scarce or given."""

from planestack.llm import mixing


def test_a_scarce_value_meets_its_target(spark):
    docs = [(i, "a", "en", "w " * 10) for i in range(400)] + [(1000 + i, "b", "es", "w " * 10) for i in range(4)]
    rows = mixing.decided(spark.createDataFrame(docs, "doc_id long, source string, lang string, text string")).cache()
    got = {(r.marginal, r.value): r for r in mixing.shares(rows).collect()}
    b = got["source", "b"]
    assert rows.filter("source = 'b' AND p < 0.999999").isEmpty() and rows.filter("p > 1.000001").isEmpty()
    assert abs(b.input - 4 / 404) < 1e-4 and abs(b.target - 4**0.7 / (4**0.7 + 400**0.7)) < 1e-4
    assert abs(b.expected - b.target) < 1e-3


def test_reached_shares(spark):
    for r in mixing.op4_shares(spark, "/root/testdata/sf0.1").collect():
        assert abs(r.expected - r.target) < 1e-3


def test_given_targets_are_met(spark):
    docs = [(i, "a" if i % 4 else "b", "en" if i % 5 < 3 else "es", ("w " if i % 3 else "x@y ") * 10) for i in range(2400)] + [(9000, None, "en", None), (9001, "a", "en", " "), (9002, "c", "en", "w w")]
    df = spark.createDataFrame(docs, "doc_id long, source string, lang string, text string")
    wanted = {("source", "a"): 0.5, ("source", "b"): 0.5, ("lang", "en"): 0.7, ("lang", "es"): 0.3}
    targets = spark.createDataFrame([(m, v, s * 3) for (m, v), s in wanted.items()], "marginal string, value string, share double")
    rows = mixing.decided(df, 0.8, targets, 1e-6).cache()
    assert rows.count() == len(docs) and rows.filter("p > 1.0000001").isEmpty()
    tokens = lambda where: rows.filter(where).selectExpr("sum(tokens * p)").first()[0]
    for (marginal, value), share in wanted.items():
        assert abs(tokens(f"{marginal} = '{value}'") / tokens("true") - share) < 1e-4
    # The marginal that isn't named keeps its shares.
    assert abs(tokens("topic = 'contact'") / tokens("true") - 1 / 3) < 1e-3
    assert {r.doc_id for r in rows.filter("kept AND tokens = 0").collect()} == {9000, 9001}
    assert rows.filter("doc_id = 9002").first().p == 0.0  # its source isn't named
    kept = mixing.mix(df, 0.8, targets, 1e-6)
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {r.doc_id for r in rows.filter("kept").collect()}


def test_the_sample_holds_the_kept_share_and_meets_the_targets(spark):
    """0.8 of the tokens, though a value has too few of them to meet its target in one pass: its documents repeat."""
    docs = [(i, "a", "en", "w " * 10) for i in range(400)] + [(1000 + i, "b", "es", "w " * 10) for i in range(4)] + [(2000, "a", "en", None)]
    df = spark.createDataFrame(docs, "doc_id long, source string, lang string, text string")
    rows = mixing.decided(df).cache()
    told = rows.filter("tokens > 0").selectExpr("sum(tokens * expected) / sum(tokens)", "sum(tokens * copies) / sum(tokens)").first()
    assert abs(told[0] - 0.8) < 1e-9 and abs(told[1] - 0.8) < 0.08
    b = rows.filter("source = 'b'").collect()
    assert len(b) == 4 and all(r.expected > 2 and r.copies in (int(r.expected), int(r.expected) + 1) and r.kept for r in b)
    assert rows.filter("kept <> (copies > 0)").isEmpty() and rows.filter("doc_id = 2000").first().copies == 1
    want = {r.doc_id: r.copies for r in rows.filter("kept").collect()}
    assert {r.doc_id: r["count"] for r in mixing.mix(df, repeat=True).groupBy("doc_id").count().collect()} == want
    assert sorted(r.doc_id for r in mixing.mix(df).collect()) == sorted(want)


def test_kept_tokens_of_the_query(spark):
    rows = mixing.op4_mixing(spark, "/root/testdata/sf0.1").selectExpr("sum(tokens * copies) / sum(tokens)", "count(*)").first()
    assert abs(rows[0] - mixing.KEEP) < 0.01 and rows[1] == 10_000
