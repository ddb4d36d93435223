from __future__ import annotations

import random
import re

import pytest

from verispark.llm import ngram_join
from verispark.llm.components import connected


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if len(w) < 5:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute(docs):
    sets = [(i, shingles(t)) for i, t in docs]
    parent = {i: i for i, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if s and t and 100 * len(s & t) >= 80 * len(s | t):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return {(i, len(s), root(i)) for i, s in sets}


def corpus(words, seed):
    """Copies, near copies around the limit, shared passages, short texts and a chain of links."""
    rng = random.Random(seed)
    passage = words(30)
    docs = []
    for _ in range(6):
        base = words(rng.choice([6, 20, 60, 150]))
        for _ in range(rng.choice([1, 3, 12])):
            text = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 25))):
                text[rng.randrange(len(text))] = "changed%d" % rng.randrange(1000)
            docs.append(" ".join(text))
    docs += [" ".join(words(rng.randint(0, 9)) + passage + words(rng.randint(0, 200))) for _ in range(12)]
    docs += ["", None, "One", "one", "two words", "Two  WORDS\n", "a b c d", "a b c d e", "A\tb\x0bc d e", "é É x y z w"]
    chain = words(60)
    docs += [" ".join(chain[k : k + 50]) for k in range(10)]
    return list(enumerate(docs))


@pytest.mark.parametrize("max_cost", [64, 3])
def test_matches_brute_force(spark, rows, words, max_cost):
    docs = corpus(words, max_cost)
    got = ngram_join.near_duplicates(rows("doc_id long, text string", *docs, extra=True), max_cost=max_cost)
    assert {tuple(r) for r in got.collect()} == brute(docs)


def test_a_large_group_needs_no_pairs_of_all(spark, rows, words):
    rng = random.Random(1)
    base = words(80)
    docs = []
    for i in range(150):
        text = list(base)
        for _ in range(rng.randint(0, 3)):
            text[rng.randrange(80)] = f"w{rng.randrange(10**6)}"
        docs.append((i, " ".join(text)))
    docs += [(200 + i, " ".join(base)) for i in range(50)]
    got = ngram_join.near_duplicates(rows("doc_id long, text string", *docs), max_cost=8)
    assert {tuple(r) for r in got.collect()} == brute(docs)


def test_defined_results(spark, rows):
    long = " ".join(f"w{i}" for i in range(60_000))
    got = ngram_join.near_duplicates(rows("doc_id long, text string", (None, "a b"), (3, "a b"), (3, "c d"), (5, "c d"), (1, long), (9, long), (7, None)))
    found = sorted((tuple(r) for r in got.collect()), key=lambda r: (r[0] is None, r))
    assert found == [(1, 59_996, 1), (3, 1, 3), (3, 1, 3), (5, 1, 3), (7, 0, 7), (9, 59_996, 1), (None, 1, None)]
    assert ngram_join.near_duplicates(rows("doc_id long, text string")).count() == 0


def test_an_id_with_two_texts_has_the_links_of_both(rows, words):
    a, b = words(60), words(60)

    def near(text, k):
        return " ".join([*text[:k], "changed", *text[k + 1 :]])

    plain = [(10, " ".join(a)), (10, " ".join(b)), (20, near(a, 3)), (30, near(b, 50)), (40, near(a, 20)), (50, " ".join(words(60)))]
    crowd = [(100 + i, near(b, i)) for i in range(40)]  # costly: through leaders and blocks
    for docs in (plain, plain[::-1], [*plain, *crowd]):
        for max_cost in (64, 4):
            got = {r["doc_id"]: r["component_id"] for r in ngram_join.near_duplicates(rows("doc_id long, text string", *docs), max_cost=max_cost).collect()}
            assert got == {i: 50 if i == 50 else 10 for i, _ in docs}


def test_one_of_each_keeps_columns(spark, rows):
    docs = rows("doc_id long, text string, lang string", (1, "a b c", "x"), (2, "a b c", "y"), (4, "d", "z"), (4, "d", "z"), (None, "a b c", "n"), extra=True)
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or -1, r.lang) for r in kept.collect()) == [(-1, "n"), (1, "x"), (4, "z")]


def test_connected(rows):
    edges = rows("a long, b long", *[(i + 1, i) for i in range(40)], (100, 101), (101, 102), (50, 50))
    got = {r["doc"]: r["comp"] for r in connected(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in (100, 101, 102)}


def test_connected_goes_on_from_earlier_classes(rows):
    rng = random.Random(9)
    parts = [[(rng.randrange(200), rng.randrange(200)) for _ in range(n)] for n in (60, 40, 1, 80)]
    parts.insert(2, parts[0][:20])  # edges inside of known classes
    parts.insert(3, [])
    classes, seen = None, []
    for part in parts:
        classes = connected(rows("a long, b long", *part), classes)
        seen += [e for e in part if e[0] != e[1]]
        want = {v: v for e in seen for v in e}
        while True:
            step = dict(want)
            for a, b in seen:
                step[a] = step[b] = min(step[a], step[b])
            if step == want:
                break
            want = step
        assert sorted(map(tuple, classes.select("doc", "comp").collect())) == sorted(want.items())
