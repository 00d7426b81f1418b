"""Queries over all of their rows, where ids go beyond those of the smallest tables."""

from planestack.plans import registry


def saved(spark, tmp_path, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_fill_missing_reaches_the_largest_id(spark, tmp_path):
    sf = saved(spark, tmp_path, "events", [(199, "view"), (250, "view"), (250, "view"), (260, "error")], "user_id long, event_type string")
    got = {r.i: r.n for r in registry.queries()["fill_missing"](spark, sf).collect()}
    assert len(got) == 261 and {i: n for i, n in got.items() if n} == {199: 1, 250: 2}


def test_background_reaches_every_instance(spark, tmp_path):
    rows = [(1, 7, "purchase"), (2, 7, "error"), (3, 7, "error"), (5, 7, "purchase"), (6, 8, "purchase"), (10, 9, "error"), (11, 7, "view")]
    sf = saved(spark, tmp_path, "events", rows, "event_id long, user_id long, event_type string")
    got = {(r.user_id, r.event_id, r.role) for r in registry.queries()["background_to_all_instances"](spark, sf).collect()}
    assert got == {(7, 1, "point"), (7, 5, "point"), (7, 2, "background"), (7, 3, "background")}


def test_set_operations_take_all_documents(spark, tmp_path):
    saved(spark, tmp_path, "documents", [(i,) for i in (1, 2, 3, 4)], "doc_id long")
    sf = saved(spark, tmp_path, "labels", [(i,) for i in (2, 3, 9)], "doc_id long")
    got = {(r.op, r.doc_id) for r in registry.queries()["set_ops_all"](spark, sf).collect()}
    assert got == {("union", i) for i in (1, 2, 3, 4, 9)} | {("intersect", i) for i in (2, 3)} | {("except", i) for i in (1, 4)}
