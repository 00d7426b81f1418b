"""The Merkle manifest against a plain tree, and against its SQL."""

import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from planestack.llm import common, manifest
from tests.compare import assert_same, tables

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, path string, idx int, grp string, h string"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def tree(leaves, fanout):
    """(root, one list of (left, right) for each leaf)."""
    paths, nodes, over = [[] for _ in leaves], leaves, [[i] for i in range(len(leaves))]
    while len(nodes) > 1:
        fresh, held = [], []
        for at in range(0, len(nodes), fanout):
            run = nodes[at : at + fanout]
            for k in range(len(run)):
                for leaf in over[at + k]:
                    paths[leaf].append(("".join(run[:k]), "".join(run[k + 1 :])))
            fresh.append(sha("".join(run)))
            held.append([leaf for own in over[at : at + fanout] for leaf in own])
        nodes, over = fresh, held
    return nodes[0], paths


def brute(rows, fanout=16):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda i, t, la, s, n: sha("".join(map(field, (i, s, la, n, t))))
    lower = lambda t: t if t is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    groups = defaultdict(list)
    for i, t, la, s, n in rows:
        struck = i is not None and zlib.crc32(str(i).encode()) % 5 == 0
        groups[s].append(((i is not None, i or 0), leaf(i, t, la, s, n), i, leaf(i, lower(t), la, s, n) if struck else None))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    below = {s: tree([r[1] for r in sorted(groups[s], key=lambda r: r[:2])], fanout) for s in order}
    root, above = tree([below[s][0] for s in order], fanout)
    out = []
    for s, top in zip(order, above, strict=True):
        for (_, h, i, tampered), path in zip(sorted(groups[s], key=lambda r: r[:2]), below[s][1], strict=True):
            path, fold = path + top, tampered or h
            for left, right in path:
                fold = sha(left + fold + right)
            out.append((i, h, below[s][0], root, sha("".join(a + b for a, b in path)), fold, fold == root))
    return sorted(map(str, out))


def told(rows, fanout):
    rows = manifest.prove(rows, fanout).withColumn("folded", manifest.folded(F.coalesce("tampered", "leaf"), F.col("path")))
    got = rows.select("doc_id", "leaf", "subroot", "root", F.sha2(manifest.siblings(F.col("path")).cast("binary"), 256), "folded", F.col("folded") == F.col("root"))
    return sorted(str(tuple(r)) for r in got.collect())


def made():
    rows = [(i, f"Text {i} WITH É Letters", "en", "a", i) for i in range(70)]
    rows += [(i, f"b {i}", None, "b", None) for i in range(5)] + [(1000, "alone", "de", "ü", 5), (1001, None, None, None, None), (None, "X", "en", None, 1), (None, "X", "en", None, 1)]
    rows += [(2000 + k // 2, "Again" * (k % 3), "fr", "", 1) for k in range(17)] + [(3000 + k, "", "en", f"s{k:02}", 0) for k in range(20)]
    return [*rows, (4000, "Long " * 400_000, "en", "a", 2_000_000)]


@pytest.mark.parametrize("fanout", [2, 3, 16])
def test_against_a_plain_tree(spark, fanout):
    rows = made()
    df = spark.createDataFrame([(*r, "p", 1, "g", "h") for r in rows], SCHEMA).repartition(5)
    assert told(df, fanout) == brute(rows, fanout)


def test_one_group_one_row_and_none(spark):
    for rows in ([(7, "T", "en", "s", 1)], [(i, "T", "en", "s", 1) for i in range(40)], [(i, "T", "en", f"s{i}", 1) for i in range(3)]):
        df = spark.createDataFrame([(*r, "p", 1, "g", "h") for r in rows], SCHEMA)
        assert told(df, 16) == brute(rows)
    assert manifest.prove(df.limit(0)).collect() == []


def test_tampering_shows(spark):
    rows = manifest.op13_manifest(spark, "/root/testdata/sf0.001").collect()
    struck = {r.doc_id for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5 == 0}
    assert {r.doc_id for r in rows if not r.verified} <= struck and any(not r.verified for r in rows)


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", None])
def test_sql(spark, tmp_path, sf):
    if sf is None:
        sf = str(tmp_path)
        spark.createDataFrame([(*r, "p", 1, "g", "h") for r in made()[:-1]], SCHEMA).coalesce(1).write.parquet(f"{sf}/documents.parquet")
    df = common.documents(spark, sf)
    assert len(df.columns) >= 5
    assert_same(manifest.op13_manifest(spark, sf), manifest.OP13_SQL, tables(sf))
