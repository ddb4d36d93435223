from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from verispark.llm import collocations
from verispark.llm.textbytes import slices

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counted(docs, max_words=4):
    counts, words = {}, Counter()
    for _, text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOW)):
            w = re.findall("[^\x20\x09]+", piece)
            words[lang] += len(w)
            for n in range(1, max_words + 1):
                counts.setdefault(lang, Counter()).update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    return counts, words


def brute(docs, least, contained=80, top=2000, max_words=4):
    counts, words = counted(docs, max_words)
    out = set()
    for lang, all_ in counts.items():
        f = {p: c for p, c in all_.items() if c >= least}
        rows = []
        for p, a in f.items():
            if len(p) == 1:
                continue
            if any(len(q) > len(p) and 100 * c >= contained * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, c in f.items()):
                continue
            score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        rows.sort()
        out |= {(lang, r + 1, p.decode(), -a, x, y, words[lang], -s) for r, (s, a, p, x, y) in enumerate(rows[:top])}
    return out


def found(df):
    return {tuple(r)[:8] for r in df.collect()}


def corpus():
    rng = random.Random(2)
    pool = ["to", "be", "not", "ÉTÉ", "żółw", "a", "B", "Or", "x" * 90, "x" * 89 + "y", "…", "don't", "-"]
    gaps = [" ", "  ", "\t", " \t ", ". ", ",", "\n", "\r\n", "; ", "\x0b", "\xa0"]
    docs = []
    for i in range(120):
        text = "".join(rng.choice(pool) + rng.choice(gaps[:3] if rng.random() < 0.8 else gaps) for _ in range(rng.randint(0, 90)))
        docs.append((i, text + ("to be or not to be " * 3 if i % 3 == 0 else ""), ("en", "pl", None, "und")[i % 4]))
    return [*docs, (500, None, "en"), (501, "", "en"), (None, "to be or not to be", "en"), (3, "to be or not to be", "en"), (502, "rare words here", "xx")]


def test_matches_brute_force(rows):
    docs = corpus()
    table = rows("doc_id long, text string, lang string", *docs, extra=True)
    got = collocations.collocations(table.repartition(4), least=8)
    assert found(got) == brute(docs, 8)
    assert {r["rank"] for r in got.collect() if r["lang"] == "en"} == set(range(1, sum(r["lang"] == "en" for r in got.collect()) + 1))
    assert found(collocations.collocations(table, least=8, top=3, max_words=3)) == brute(docs, 8, top=3, max_words=3)


def test_pointers_lead_to_the_phrase(rows):
    docs = corpus()
    texts = {i: " ".join(re.findall("[^\x20\x09]+", (t or "").translate(LOW))) for i, t, _ in docs if i != 3}
    for r in collocations.collocations(rows("doc_id long, text string, lang string", *docs), least=8).collect():
        assert r["first_doc"] == 3 or r["phrase"] in texts[r["first_doc"]]


def test_colliding_fingerprints_are_counted_apart(rows):
    """With eight bits of each fingerprint nearly all phrases share theirs with others; counts by text still hold."""
    docs = corpus()
    table = rows("doc_id long, text string, lang string", *docs)
    for mask in (0xFF << 56, 0xF0000F, 0):
        got, words = collocations.phrase_counts(table, least=8, mask=mask)
        want, _ = counted(docs)
        assert {(r["lang"], r["phrase"]): r["f"] for r in got.collect()} == {(lang, " ".join(p)): c for lang, all_ in want.items() for p, c in all_.items() if c >= 8}
        assert sum(r["n"] for r in words.collect()) == sum(c for all_ in want.values() for p, c in all_.items() if len(p) == 1)


def test_digests_tell_words_apart():
    """Equal fingerprints of different words never have equal digests: places and bytes count."""
    words = ["ab", "ba", "aab", "aba", "baa", "b", "a", "bb", "abab", "baba", "y" * 99 + "z", "z" + "y" * 99]
    texts = next(slices(pa.array([" ".join(words)])))
    cut = collocations.cut_words(texts, np.zeros(1, np.uint64))
    assert len(set(collocations.word_digests(cut).tolist())) == len(words)
    two = collocations.run_digests(cut, collocations.word_digests(cut), cut.places(2), 2)
    assert len(set(two.tolist())) == len(words) - 1


def test_empty_tables_and_exact_scores(rows):
    schema = "doc_id long, text string, lang string"
    assert collocations.collocations(rows(schema)).count() == 0
    assert collocations.collocations(rows(schema, (1, None, None), (2, "", "en"))).count() == 0
    one = collocations.collocations(rows(schema, *[(i, "New York New York", "en") for i in range(30)])).collect()
    assert sorted((r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"], r["first_doc"]) for r in one) == [
        ("new york", 60, 60, 60, 120, 1_000_000, 0), ("new york new york", 30, 60, 60, 120, 500_000, 0)]
