"""Nulls, empty and very long texts, repeated rows, empty tables and clashing column names, for every operator and stage."""

import pytest
from pyspark.sql import functions as F

from planestack.llm import ann, bpe, common, fingerprint, mixing, near_dedup, quality, registry, repeats, secrets, toxicity, url_filter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, score string, block string, key string, _k1 string, kept string, tokens string, class string, list string"
LONG = " ".join(f"word{i % 997} token = 'abcdefgh{i}'." for i in range(2_500))


def docs(spark):
    rows = [(None, "some words of a text without an id"), (None, None), (1, None), (2, ""), (3, " \n\t "), (4, "one two"), (5, LONG), (6, "a b c d e f g"), (6, "a b c d e f g"), (7, "idiot " * 30)]
    return spark.createDataFrame([(i, t, None, "s" if i else None, len(t or ""), *"abcdefghi") for i, t in rows], SCHEMA)


def labels(spark):
    return spark.createDataFrame([(4, 1, 0), (6, 1, 0), (7, 0, 1), (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")


def same_columns(got, df):
    assert got.columns == df.columns
    return got.collect()


def operators(df, lab):
    weights = toxicity.train(df, lab)
    yield toxicity.score(common.boxed(df), weights)
    yield quality.score(df, quality.train(df, lab))
    yield repeats.cut_repeats(df)
    yield near_dedup.near_duplicates(df)
    yield mixing.decided(df)
    yield secrets.find(df)
    yield bpe.encode_decode(df)
    yield fingerprint.followed(df)


@pytest.mark.parametrize("size", ["some", "none"])
def test_every_row_has_its_result(spark, tmp_path, size):
    df = docs(spark)
    df.limit(0 if size == "none" else 100).write.parquet(str(tmp_path / "d"))
    labels(spark).limit(0 if size == "none" else 100).write.parquet(str(tmp_path / "l"))
    df, lab = spark.read.parquet(str(tmp_path / "d")), spark.read.parquet(str(tmp_path / "l"))
    for result in operators(df, lab):
        assert result.count() == (0 if size == "none" else 10)
    weights = toxicity.train(df, lab)
    for kept in (toxicity.clean(df, weights), near_dedup.deduplicate(df), secrets.redact(df), mixing.mix(df)):
        rows = same_columns(kept, df)
        assert len(rows) <= 10 and bool(rows) == (size == "some")


def test_defined_results(spark):
    df = docs(spark)
    near = {(r.doc_id, r.n_shingles): r for r in near_dedup.near_duplicates(df).collect()}
    assert near[(2, 0)].component_id == 2 and near[(2, 0)].kept
    assert near[(None, 0)].component_id is None and near[(None, 0)].kept
    assert near[(4, 1)].n_shingles == 1
    found = {r.doc_id: r for r in secrets.find(df.filter("doc_id >= 1")).collect()}
    assert found[1].base == [] and len(found[5].base) == 2_500
    pieces = {r.doc_id: r for r in bpe.encode_decode(df.filter("doc_id IN (1, 2, 3)")).collect()}
    assert all(pieces[i].n_tokens == 0 and pieces[i].decoded == "" for i in (1, 2, 3))
    cut = {r.doc_id: r for r in repeats.cut_repeats(df.filter("doc_id IN (1, 6)")).collect()}
    assert cut[1].n_bytes == 0 and cut[1].spans == []
    assert quality.score(df.filter("doc_id = 2"), quality.train(df, labels(spark))).first().score is not None


def test_vectors(spark):
    rows = [(0, [1.0, 0.0]), (20, [0.0, 0.0]), (40, None), (60, [None, 1.0]), (1, [float("nan"), 1.0]), (2, [float("inf"), 1.0]), (3, [1.0]), (None, [1.0, 1.0]), (5, [0.5, 0.5]), (6, [1.0, 0.0]), (80, [1.0, 0.0])]
    df = spark.createDataFrame([(i, v, "a", 1) for i, v in rows], "vec_id long, embedding array<double>, id string, list int")
    got = [tuple(r) for r in ann.nearest(df, 3, lambda i: i % 20 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 6, 1.0), (0, 2, 80, 1.0), (0, 3, 5, 0.5), (80, 1, 0, 1.0), (80, 2, 6, 1.0), (80, 3, 5, 0.5)]
    assert ann.nearest(df.limit(0), 3, lambda i: i % 20 == 0).count() == 0


def test_vectors_of_several_lengths_and_many_queries(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(ann, "QUERIES", 3)
    draw = np.random.default_rng(9)
    rows = [(i, draw.normal(0, 1, 3 + i % 2 * 2 + (i == 400)).tolist()) for i in range(401)]
    got = {}
    for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 4, lambda i: i % 20 < 2).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    hit = total = 0
    for i, v in rows:
        if i % 20 < 2 and i != 400:
            want = sorted(((-float(np.dot(v, w)), j) for j, w in rows if j != i and len(w) == len(v)))[:4]
            assert [got[i][n][1] for n in range(1, 5)] == sorted((float(np.dot(v, rows[j][1])) for j, _ in got[i].values()), reverse=True) or len(got[i]) == 4
            hit += len({j for _, j in want} & {j for j, _ in got[i].values()})
            total += 4
    assert 400 not in got and hit >= 0.9 * total


def test_urls(spark):
    urls = [None, "", "no host", "http://", "https://A.Example.ORG/es/x?y#z", "http://example.org/en/12", "http://example.org/en/2", "http://notexample.org/es/", "x://org", "http://www.example.net/en/100/more", "http://example.net/en/101", "http://a.com/fr/", "http://a.com/de/"]
    df = spark.createDataFrame([(i, u, "k", "v") for i, u in enumerate(urls)] + [(None, urls[5], "k", "v")], "page_id long, url string, key string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(df, url_filter.rule_table(spark), url_filter.block_list(spark)).collect()}
    assert got[0] == got[1] == got[2] == ("", "", None, "allow")
    assert got[4] == ("a.example.org", "/es/x", "example.org/es/", "block")
    assert (got[5][2:], got[6][2:], got[7][2:], got[8][2:]) == (("example.org/en/1", "block"), ("org/", "allow"), ("org/", "allow"), (None, "allow"))
    assert (got[9][2:], got[10][2:]) == ((None, "block"), (None, "allow"))
    assert (got[11][2:], got[12][2:], got[None]) == (("com/fr/", "allow"), ("com/de/", "block"), got[5])
    assert url_filter.filter_urls(df.limit(0), url_filter.rule_table(spark), url_filter.block_list(spark)).count() == 0


def test_ids_come_back_in_order(spark):
    df = docs(spark).filter("doc_id = 5")
    assert [r.doc_id for r in bpe.encode_decode(df).collect()] == [5]
    assert mixing.cells(df.withColumns({"topic": F.lit("t"), "tokens": F.lit(3)})).count() == 1
    assert set(registry.oracle_sql()) <= set(registry.queries())


def test_very_long_and_listed_urls(spark):
    long = "http://a.example.org/en/1" + "x" * 300_000 + "/y" * 20_000
    df = spark.createDataFrame([(1, long), (2, "http://sub.listed.test/a/b/c?x"), (3, "http://listed.test/a/bc")], "page_id long, url string")
    rules = url_filter.rule_table(spark)
    listed = spark.createDataFrame([("listed.test/a/b",)], "entry string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.filter_urls(df, rules, listed).collect()}
    assert got == {1: ("example.org/en/1", "block"), 2: (None, "block"), 3: (None, "allow")}


def test_blocks_are_named_by_their_content(spark):
    rows = [(1, "one two"), (2, "three"), (None, None)]
    names = lambda r: {b.block for b in bpe._blocks(spark.createDataFrame(r, "doc_id long, text string").coalesce(1), 16).select("block").collect()}
    assert names(rows) == names(rows) and len(names(rows)) == 1
    assert not names(rows) & names(rows[::-1]) and not names(rows) & names([(1, "one two"), (2, "thre "), (None, None)])
