"""The pipeline's stage of near copies against the Jaccard similarity of all pairs."""

import random

import pytest

import corpus_pipeline
from storyflow.llm import simhash

from .test_operators import ODD, documents, rows


def shingles(text):
    ws = (text or "").encode().lower().split()
    return frozenset(b" ".join(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))) if ws else frozenset()


def brute_kept(docs):
    sets = [shingles(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            if x == y or 5 * len(x & y) >= 4 * len(x | y):
                root[find(i)] = find(j)
    groups = {}
    for i, (d, _) in enumerate(docs):
        groups.setdefault(find(i), []).append(d)
    return sorted(((min(g, key=lambda d: (d is None, d or 0)),) for g in groups.values()), key=repr)


def made():
    rnd = random.Random(3)
    word = lambda: f"w{rnd.randrange(3000)}"
    passage = [word() for _ in range(40)]
    base = [[word() for _ in range(rnd.choice([12, 60, 150]))] + (passage if i % 2 else []) for i in range(12)]
    docs = [*ODD, *[(100 + i, " ".join(b)) for i, b in enumerate(base)]]
    for i in range(150):
        ws = list(rnd.choice(base))
        for _ in range(rnd.randrange(5)):
            ws[rnd.randrange(len(ws))] = word()
        docs.append((200 + i, " ".join(ws)))
    return docs


def test_stage_drops_texts_alike_to_four_fifths(spark, sf):
    ws = [f"w{i}" for i in range(150)]
    docs = [(1, " ".join(ws)), (2, " ".join(["x", *ws[1:40], "y", *ws[41:]])), (3, " ".join(f"v{i}" for i in range(150)))]
    assert rows(corpus_pipeline.one_of_near_copies(spark, documents(spark, docs), sf), "doc_id") == [(1,), (3,)]


@pytest.mark.parametrize("crowd", [64, 3])
def test_no_pair_is_lost_or_added(spark, crowd):
    docs = made()
    assert rows(simhash.keep_first(documents(spark, docs), shingle=5, similarity=(4, 5), crowd=crowd), "doc_id") == brute_kept(docs)
    assert simhash.keep_first(documents(spark, docs).limit(0), shingle=5, similarity=(4, 5)).count() == 0


@pytest.mark.parametrize("common", [0, 5])
def test_common_shingles_change_the_order_alone(spark, monkeypatch, common):
    """However few shingles are known to be common, the rows kept are those of brute force."""
    from storyflow.llm import near_copies

    monkeypatch.setattr(near_copies, "COMMON", common)
    docs = made()
    assert rows(simhash.keep_first(documents(spark, docs), shingle=5, similarity=(4, 5), crowd=3), "doc_id") == brute_kept(docs)
