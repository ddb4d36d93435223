"""Language ID, quality classifier, packing, decontamination, token counts and the pipeline."""

from __future__ import annotations

import random
import zlib
from array import array
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from verispark.llm import decontam, langid, ngram_join, packing, quality, token_counts
from verispark.llm.queries import QUERIES
from verispark.llm.sampling import class_sample
from verispark.llm.tables import release
from verispark.llm.wordids import WordIds
from verispark.operators.ordered import without_ids

from .conftest import RANKS, TOKENIZER

DOCS = "doc_id long, text string, lang string"


@pytest.fixture(scope="module")
def documents(sf):
    return pd.read_parquet(f"{sf}/documents.parquet")


def test_language_held_out(spark, sf, documents):
    got = QUERIES["op6_language_id"](spark, sf).toPandas()
    assert len(got) == len(documents)
    assert (got.held_out == got.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 3 == 1)).all()
    both = got.merge(documents, on="doc_id")
    held = both[both.held_out & both.lang.notna()]
    assert (held.lang_pred == held.lang).mean() > 0.95 and got.score.between(0, 1).all()


def test_language_defined_results(rows):
    texts = {"de": "der die das und ich nicht ein Haus", "en": "the and of a house with them", "fr": "le la les et une maison avec"}
    train = [(i, texts[lang] + f" {i}", lang) for i in range(90) for lang in [("de", "en", "fr")[i % 3]]]
    odd = [(1000, None, "de"), (1001, "", "en"), (1002, "12 34 !?", "fr"), (None, "the house", "en"), (1003, "a", None), (1004, "the and of " * 50_000, None), (1005, "the", "en"), (1005, "the", "en")]
    got = langid.language_id(rows(DOCS, *train, *odd, extra=True))
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    found = defaultdict(list)
    for r in got.collect():
        found[r.doc_id].append((r.lang_pred, r.score))
    assert all(found[i] == [("und", 0.0)] for i in (1000, 1001, 1002))
    assert len(found[1005]) == 2 and found[1004][0][0] == "en" and found[None][0][0] == "en"
    assert langid.language_id(rows(DOCS)).count() == 0
    assert [r.lang_pred for r in langid.language_id(rows(DOCS, (1, "abc", None))).collect()] == ["und"]
    assert {r.lang_pred for r in langid.language_id(rows(DOCS, *[(i, "abc", "en") for i in range(9)])).collect()} == {"en"}


def test_a_hundred_languages_are_all_learned(rows):
    """Each language has its own words; none is cut, and their families keep the number of machines low."""
    rng = np.random.default_rng(9)
    words = {f"x{k:02d}": ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6)) for _ in range(12)] for k in range(100)}
    docs = [(i, " ".join(rng.choice(words[f"x{i % 100:02d}"], 12)), f"x{i % 100:02d}") for i in range(2400)]
    got = langid.language_id(rows(DOCS, *docs)).collect()
    assert len({r.lang_pred for r in got}) == 100
    assert np.mean([r.lang_pred == f"x{r.doc_id % 100:02d}" for r in got if r.held_out]) > 0.9
    x = rng.normal(size=(100, langid.BINS)).astype(np.float32)
    of = langid.families(np.array(sorted(words), object), x)
    assert len(set(of.values())) == 10 and langid.families(np.array(["en", "xx", "yy"], object), x[:3])["xx"] == "only xx"


def test_samples_are_bounded_per_class(rows):
    table = rows("doc_id long, text string, lang string", *[(5, f"t{i}", "en") for i in range(300)], *[(i, "t", "fr") for i in range(300)], (1, "t", None))
    got = Counter(r.lang for r in class_sample(table, "doc_id", "lang", 20).collect())
    assert set(got) <= {"en", "fr"} and got["en"] <= 40 and 5 <= got["fr"] <= 40


def test_family_comes_first():
    rng = np.random.default_rng(1)
    langs = np.array(["en", "de", "fr", "es"] * 30, object)
    x = rng.normal(0, 0.01, (120, langid.BINS)).astype(np.float32)
    for k, lang in enumerate(["en", "de", "fr", "es"]):
        x[langs == lang, k] += 1
    model = langid.Hierarchy(x, langs)
    assert model.top.names == ["germanic", "romance"] and model.within["romance"].names == ["es", "fr"]
    names, score = model.predict(x)
    assert (names == langs).all() and ((score > 0) & (score <= 1)).all()


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"  # the smallest table has too few labels to learn from
    got = QUERIES["op9_quality_classifier"](spark, sf).toPandas()
    assert len(got) == len(pd.read_parquet(f"{sf}/documents.parquet")) and ((got.score >= 0.3) == (got.predicted == 1)).all()
    held = got[got.held_out].merge(pd.read_parquet(f"{sf}/labels.parquet"), on="doc_id")
    rank, good = held.score.rank(), held.quality == 1
    auc = (rank[good].sum() - good.sum() * (good.sum() + 1) / 2) / max(1, good.sum() * (~good).sum())
    assert auc > 0.9, auc


def test_quality_gradients_and_cover():
    net = quality.ByteNet(seed=9)
    rng = np.random.default_rng(0)
    net.tables[:] = rng.normal(0, 0.3, net.tables.shape)
    net.size_w[:] = (0.1, -0.2)
    data = rng.integers(0, 256, 1500).astype(np.uint8)

    def loss():
        p = net.score(data)
        return -np.log(p)

    grads = net.gradients(data, 1.0)
    for p, g in zip(net.parameters, grads):
        at = np.unravel_index(int(np.abs(g).argmax()), g.shape)
        old, step = float(p[at]), 1e-2
        p[at] = old + step
        up = loss()
        p[at] = old - step
        down = loss()
        p[at] = old
        assert (up - down) / (2 * step) == pytest.approx(float(g[at]), rel=0.08, abs=2e-3)
    # Every byte is in some chunk: a strong sign anywhere moves the maximum.
    net.tables[:] = 0
    net.tables[0, 7] = 5
    for at in (0, 2, 700, 1498):
        text = np.zeros(1500, np.uint8)
        text[at] = 7
        assert net.pooled(text)[0].max() == 5


def test_quality_defined_results(rows):
    docs = rows(DOCS, *[(i, "good words here " * 9 if i % 2 else "### $$$ " * 9, "x") for i in range(60)], (None, None, None), (70, "", None), (71, "good words " * 40_000, None), (72, "a", None), (72, "a", None), extra=True)
    labels = rows("doc_id long, quality int, score int", *[(i, i % 2, 0) for i in range(60)], (None, 1, 0), (70, None, 0), (3, 0, 0))
    got = quality.quality_scores(docs, labels)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    found = [(r.doc_id, r.score, r.predicted) for r in got.collect()]
    assert len(found) == 65 and all(0 <= s <= 1 for _, s, _ in found)
    assert all(p == i % 2 for i, _, p in found if i is not None and i < 60)
    empty = quality.quality_scores(docs, rows("doc_id long, quality int"))
    assert {r.score for r in empty.collect()} == {0.5}
    assert quality.quality_scores(rows(DOCS), labels).count() == 0


def test_word_ids_equal_the_library():
    mine, exact = WordIds(TOKENIZER, cache_bytes=10_000), Tokenizer.from_file(TOKENIZER)
    exact.encode_special_tokens = True
    rng = random.Random(3)
    signs = "abcdefghij ABCÉÀßœ 0123456789.,-'_!|#$%²½éΣİ日🙂\n\t́\x1c\x85\xa0​"
    texts = ["", " ", "don't stop_it", "x" * 500, "<|endoftext|>", "ΣΑΣ a_ _b -_-", *["".join(rng.choice(signs) for _ in range(60)) for _ in range(400)]]
    for text in texts:
        assert mine.encode(text) == array("I", exact.encode(text, add_special_tokens=False).ids).tobytes(), repr(text)


def check_packing(got, texts, capacity):
    exact = Tokenizer.from_file(TOKENIZER)
    exact.encode_special_tokens = True
    want = {i: [*exact.encode(t or "", add_special_tokens=False).ids, 0] for i, t in texts.items()}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        ids = want[r.doc_id][r.start : r.start + r.length]
        assert len(ids) == r.length and zlib.crc32(array("I", ids).tobytes()) == r.ids_crc32
        by_doc[r.doc_id].append((r.piece, r.start, r.length))
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for i, ids in want.items():
        assert sorted(by_doc[i]) == [(k, at, min(capacity, len(ids) - at)) for k, at in enumerate(range(0, len(ids), capacity))]
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence), sum(map(len, want.values()))


def test_packing(spark, sf, documents):
    got = QUERIES["op7_best_fit_packing"](spark, sf).collect()
    n, total = check_packing(got, dict(zip(documents.doc_id, documents.text)), 2048)
    assert n <= -(-total // 2048) + 2


def test_packing_defined_results(rows):
    texts = {1: None, 2: "", 3: "w " * 5000, 4: "a b c", 5: "\n"}
    got = packing.best_fit_packing(rows("doc_id long, text string, length int, piece int", *[(i, t, 0, 0) for i, t in texts.items()]), TOKENIZER, capacity=16)
    n, total = check_packing(got.collect(), texts, 16)
    assert n == -(-total // 16)
    twice = packing.best_fit_packing(rows("doc_id long, text string", (4, "a"), (4, "a"), (None, "b")), TOKENIZER, with_ids=True).collect()
    assert sorted(r.offset for r in twice) == [0, 2, 4] and all(len(r.ids) == 2 and r.ids[-1] == 0 for r in twice)
    assert packing.best_fit_packing(rows("doc_id long, text string"), TOKENIZER).count() == 0


def best_fit_decreasing(counts, capacity):
    rooms = []
    for x in sorted((x for x, n in counts.items() for _ in range(n)), reverse=True):
        fitting = [k for k, room in enumerate(rooms) if room >= x]
        if fitting:
            rooms[min(fitting, key=lambda k: rooms[k])] -= x
        else:
            rooms.append(capacity - x)
    return len(rooms)


def test_plan_fills_gaps_exactly():
    rng = random.Random(2)
    for _ in range(60):
        capacity = rng.randint(1, 40)
        counts = {rng.randint(1, capacity): rng.randint(1, 30) for _ in range(rng.randint(1, 12))}
        plan = packing.make_plan(counts, capacity)
        used = defaultdict(int)
        for pattern, times in plan:
            assert sum(pattern) <= capacity and times > 0
            for x in pattern:
                used[x] += times
        assert dict(used) == counts
        assert sum(t for _, t in plan) <= best_fit_decreasing(counts, capacity) + 1
    assert packing.make_plan({7: 2, 1: 2, 2: 4}, 10) == [([7, 2, 1], 2), ([2, 2], 1)]


QUESTION = "Anna Kowalska: yesterday Peter bought 12 apples and 30 pears for 12 dollars each then walked 5 km home with all of them"


def find(rows, items, *texts, **kw):
    docs = rows("doc_id long, text string", *enumerate(texts), **kw)
    got = decontam.contaminated(docs, rows("item_id long, text string", *enumerate(items))).collect()
    return sorted((r.doc_id, r.item_id, r.changed_slots) for r in got)


def test_decontamination(rows):
    other = QUESTION.replace("Peter", "Maria").replace("12", "45").replace("30", "7").replace("km", "miles")
    torn = QUESTION.replace("12", "45", 1).replace("30", "7")  # the same number became two
    noise = "unrelated words about the sea and the wind in a small town "
    got = find(
        rows, [QUESTION, "short", None, "", "one two three four five"], "so " + QUESTION.upper() + "!! " + noise, noise * 20 + other + noise, noise, None, "",
        noise + " ".join(QUESTION.split()[:9]), (noise * 20_000) + QUESTION, "one, two THREE four five", "one two three four six", extra=True)
    assert got == [(0, 0, 0), (1, 0, 5), (6, 0, 0), (7, 4, 0)]
    clean = decontam.contaminated(rows("doc_id long, text string", (0, QUESTION), (1, other), (2, torn)), rows("item_id long, text string", (0, QUESTION))).collect()
    share = {r.doc_id: r.coverage for r in clean}
    assert share[0] >= share[1] > share.get(2, 0)
    assert find(rows, []) == [] and find(rows, [], QUESTION) == [] and find(rows, [QUESTION]) == []


def test_decontamination_word_for_word(rows):
    """Items of numbers, units and names: too few literal words for a template window."""
    numbers = "Compute 12 + 34 * 56 - 78 / 9"
    short = "What is 7x8?"
    long = "Add 14 kg 27 kg 33 kg 48 kg 51 kg and then 66 kg 72 kg 85 kg 93 kg to find the sum of it all"
    names = "Then Anna Berg Carl Dahl Emil Falk met Gina Holm Ivan Juhl Kari Lund there"
    noise = "unrelated words about the sea and the wind in a small town. "
    items = [numbers, short, long, names]
    assert find(rows, items, *[noise + item + " " + noise for item in items]) == [(0, 0, 0), (1, 1, 0), (2, 2, 0), (3, 3, 0)]
    # Other numbers in an item of hardly anything else make another text.
    assert find(rows, [numbers, short], noise + "Compute 98 + 76 * 54 - 32 / 1", noise + "What is 9x4?") == []
    got = decontam.contaminated(rows("doc_id long, text string", (0, noise + long)), rows("item_id long, text string", (0, long))).collect()
    assert [(r.coverage, r.changed_slots) for r in got] == [(1.0, 0)]


def test_decontamination_of_other_case(rows):
    """Copies whose words count as names on one side and as literals on the other."""
    names = "when Anna met the old Mister Berg near Oslo they saw Carl Dahl leave for Rome with Emil and his friend Gina from Bonn"
    short = "Where does the river end"
    noise = "unrelated words about the sea and the wind in a small town "
    got = find(rows, [names, short], noise + names.lower() + " " + noise, noise + names.upper() + " " + noise, noise + short + " " + noise, noise + short.upper())
    assert got == [(0, 0, 0), (1, 0, 0), (2, 1, 0), (3, 1, 0)]


def test_decontamination_of_planted_items(spark, sf, documents):
    items = pd.read_parquet(f"{sf}/benchmark.parquet")
    plain = {i: " ".join("".join(c if c.isalnum() else " " for c in t.lower()).split()) for i, t in zip(documents.doc_id, documents.text)}
    want = {(i, j) for j, t in zip(items.item_id, items.text) for key in [" ".join("".join(c if c.isalnum() else " " for c in t.lower()).split())] for i, text in plain.items() if key in text}
    got = {(r.doc_id, r.item_id) for r in QUERIES["op8_decontamination"](spark, sf).collect()}
    assert got == want and want


def test_token_counts_under_edits():
    enc = token_counts.load_encoding(RANKS, public_tokenizers.PATTERN)
    rng = random.Random(3)
    parts = ["a", "b", "the", " ", "  ", "\n", "'s", "1", "22", ".", "é", "日", "\x1c", "\xa0", " x", " y"]

    def text(n):
        return "".join(rng.choice(parts) for _ in range(n))

    for _ in range(500):
        now = text(rng.randint(0, 80))
        tree = token_counts.TokenTree(now, enc, rng.choice([1, 4, 16]))
        for _ in range(rng.randint(1, 8)):
            at, drop, put = rng.randint(0, len(now) + 3), rng.randint(0, rng.choice([0, 2, 60])), text(rng.randint(0, 6))
            now = now[: min(at, len(now))] + put + now[at + drop :]
            tree.edit(at, drop, put)
            assert "".join(tree.texts) == now and tree.count == len(enc.encode_ordinary(now)), repr(now)
    long = token_counts.TokenTree("some words here and there " * 20_000, enc)
    long.edit(250_000, 3, "new text")
    assert long.encoded < 1000 and long.count == len(enc.encode_ordinary("".join(long.texts)))


def test_token_count_query(spark, sf, documents):
    enc = token_counts.load_encoding(RANKS, public_tokenizers.PATTERN)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    edits = {r.doc_id: r.edits for r in docs.select("doc_id", token_counts.scrub_edits(F.col("text"), F.col("doc_id")).alias("edits")).collect()}
    texts = dict(zip(documents.doc_id, documents.text))
    for r in QUERIES["op10_token_counts"](spark, sf).collect():
        now = texts[r.doc_id] or ""
        assert r.tokens_before == len(enc.encode_ordinary(now))
        for at, drop, put in edits[r.doc_id] or []:
            at = min(max(at, 0), len(now))
            now = now[:at] + put + now[at + drop :]
        assert (r.tokens_after, r.chars_after) == (len(enc.encode_ordinary(now)), len(now))


def test_token_counts_defined_results(rows):
    docs = rows("doc_id long, text string, n int", (1, None, 0), (2, "", 0), (3, "a b c", 0), (3, "a b c", 0), (None, "x", 0))
    edits = rows("doc_id long, edit_no int, at int, drop int, put string", (3, 2, 0, 1, None), (3, 1, -5, 0, "zz "), (2, 1, 9, 9, "hi"), (None, 1, None, None, "y"), (99, 1, 0, 0, "no"))
    got = token_counts.edited_token_counts(token_counts.with_edits(docs, edits), RANKS, public_tokenizers.PATTERN)
    assert sorted(((r.doc_id or 0), r.n_edits, r.chars_after) for r in got.collect()) == [(0, 1, 2), (1, 0, 0), (2, 1, 2), (3, 2, 7), (3, 2, 7)]


def test_without_ids(rows):
    docs = rows("doc_id long, text string", *[(i, "t") for i in range(50)], (None, "t"), (7, "u"), extra=True)
    got = without_ids(docs, rows("x long", (7,), (7,), (3,), (None,), (99,)))
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect() if r.doc_id is not None) == [i for i in range(50) if i not in (3, 7)]
    assert got.filter("doc_id IS NULL").count() == 1


CLASH = "lang_pred string, score double, predicted int, _letters boolean, _judged int, _class string, _no int, _place int"
CLASH_VALUES = ("p", 0.5, 0, False, 1, "c", 2, 3)


def test_pipeline_stages_keep_columns_of_any_name(spark, sf, rows):
    docs = [(i, ("the and of a house" if i % 2 else "der die das und ich") + f" {i}", ("de", "en")[i % 2]) for i in range(60)]
    odd = [(100, None, "en"), (101, "", "en"), (102, "12 34", "de"), (None, "the house of", None), (103, "the house", "en"), (103, "the house", "en")]
    table = spark.createDataFrame([(*d, *CLASH_VALUES) for d in [*docs, *odd]], f"{DOCS}, {CLASH}")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, table, sf)
        assert got.columns == table.columns, name
        assert {tuple(r)[3:] for r in got.collect()} <= {CLASH_VALUES}, name
        assert stage(spark, table.limit(0), sf).count() == 0, name
    left = Counter(r.doc_id for r in corpus_pipeline.language(spark, table, sf).collect())
    assert left == Counter([*range(60), None, 103, 103])


def test_language_stage_decides_by_the_model_and_keeps_all_without_one(spark, sf, rows):
    docs = [(i, ("the and of a house and the", "der die das und ich")[i % 2] + f" {i}", ("en", "de")[i % 2]) for i in range(300)]
    far = [(1000, "QZXJ#QZXJ#QZXJ#QZXJ", None)]
    known = rows(DOCS, *docs)
    model = langid.train(known.filter("doc_id % 3 <> 1"))
    least = langid.least_score(model, known.filter("doc_id % 3 = 1"))
    assert 0 < least < 1 and langid.least_score(model, known.limit(0)) == 0
    judged = {r.doc_id: r.j.score for r in rows(DOCS, *docs, *far).select("doc_id", langid.judged(F.col("text"), model).alias("j")).collect()}
    left = {r.doc_id for r in corpus_pipeline.language(spark, rows(DOCS, *docs, *far), sf).collect()}
    assert left >= {i for i in range(300)} and (1000 in left) == (judged[1000] >= least)
    none = rows(DOCS, *[(i, f"text {i}", None) for i in range(100)], (200, "12", None))
    assert corpus_pipeline.language(spark, none, sf).count() == 100


def test_words_held_are_bounded_in_bytes_and_go_with_the_task():
    held = WordIds(TOKENIZER, cache_bytes=20_000)
    for i in range(2000):
        held.encode(f"word{i} again")
        assert sum(4 * len(w) + len(b) for w, b in held.known.items()) <= held.known.held <= 20_000
    held.known.forget()
    assert not held.known and held.known.held == 0


def test_pipeline(spark, sf, documents):
    docs, at = {}, spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        at = stage(spark, at, sf)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert at.columns == list(documents.columns)
            at = spark.createDataFrame(at.toPandas(), at.schema)
            docs[name] = set(at.toPandas().doc_id)
    kept = docs["language_id"]
    assert kept == set(documents[documents.text.str.contains(r"[^\W\d_]", regex=True, na=False)].doc_id)
    labels = pd.read_parquet(f"{sf}/labels.parquet").set_index("doc_id").quality
    good = set(labels[labels == 1].index) & kept
    assert len(good & docs["quality_classifier"]) >= 0.9 * len(good)
    left = spark.createDataFrame(documents[documents.doc_id.isin(docs["quality_classifier"])][["doc_id", "text"]])
    classes = ngram_join.near_duplicates(left).toPandas()
    assert docs["ngram_jaccard_join"] == set(classes[classes.doc_id == classes.component_id].doc_id)
    held = decontam.contaminated(left, spark.read.parquet(f"{sf}/benchmark.parquet")).toPandas()
    assert docs["decontamination"] == docs["ngram_jaccard_join"] - set(held.doc_id)
    last = at.toPandas()
    assert set(last.doc_id) == docs["decontamination"]
    assert last.groupby("sequence_id").length.sum().max() <= 2048
    whole = corpus_pipeline.run(spark, sf).toPandas()
    assert sorted(zip(whole.doc_id, whole.piece, whole.ids_crc32)) == sorted(zip(last.doc_id, last.piece, last.ids_crc32))
    assert release(spark) > 0 and release(spark) == 0
