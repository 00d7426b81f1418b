"""Near-duplicates in awkward tables: ids on several texts, dense families, small blocks."""

import numpy as np
import pytest

from planestack.llm import near_dedup
from tests.llm import brute


def family(draw, n, words, least, most, common=None):
    """n copies of a text of so many words, each with least to most words changed (into its own words, or some of `common`)."""
    base, out = [f"v{i}" for i in range(words)], []
    for i in range(n):
        own = list(base)
        for at in draw.choice(words, int(draw.integers(least, most + 1)), replace=False):
            own[at] = f"c{draw.integers(common)}" if common else f"w{i}x{at}"
        out.append(" ".join(own))
    return out


def components(spark, texts):
    got = near_dedup.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), 4).collect()
    return {r.doc_id: (r.n_shingles, r.component_id) for r in got}


def test_one_id_on_two_texts(spark):
    one, two = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    alone = " ".join(f"c{i}" for i in range(40))
    rows = [(1, one), (5, one), (5, two), (9, two), (11, alone), (12, alone + " d"), (12, ""), (13, ""), (14, None), (14, alone)]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()
    assert len(got) == len(rows)
    assert {(r.doc_id, r.component_id) for r in got} == {(1, 1), (5, 1), (9, 1), (11, 11), (12, 11), (13, 13), (14, 11)}


@pytest.mark.parametrize("common", [None, 3])
def test_families_near_the_bound(spark, common):
    draw = np.random.default_rng(5)
    texts = dict(enumerate(family(draw, 150, 260, 3, 26, common)))
    assert components(spark, texts) == brute.near(texts)


def test_near_copies_with_few_to_many_edits(spark):
    draw = np.random.default_rng(5)
    base, texts = [f"v{i}" for i in range(260)], {}
    for i in range(60):
        words = list(base)
        for at in draw.choice(len(words), 3 + i // 6, replace=False):
            words[at] = f"w{i}x{at}"
        texts[i] = " ".join(words)
    assert components(spark, texts) == brute.near(texts)


def test_longer_bands(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    monkeypatch.setattr(near_dedup, "LONGER", [(8, 88), (12, 240)])
    draw = np.random.default_rng(6)
    texts = dict(enumerate(family(draw, 60, 120, 2, 12, 3) + family(draw, 40, 90, 1, 9)))
    assert components(spark, texts) == brute.near(texts)
