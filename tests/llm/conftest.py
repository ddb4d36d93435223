from __future__ import annotations

import random

import public_tokenizers
import pytest

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")

# Columns an input may also have; names that the operators use themselves.
EXTRA = "token int, df string, n int, doc int, score string, label int, _key string, hash int, prefix int, cell int, rank int"
EXTRA_VALUES = (1, "x", 2, 3, "s", 4, "k", 5, 6, 7, 8)


@pytest.fixture(scope="session")
def rows(spark):
    """A table with a schema from tuples; `extra` adds columns with clashing names."""

    def make(schema, *values, extra=False):
        if extra:
            return spark.createDataFrame([(*v, *EXTRA_VALUES) for v in values], f"{schema}, {EXTRA}")
        return spark.createDataFrame(list(values), schema)

    return make


@pytest.fixture()
def words():
    rng = random.Random(4)
    pool = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    return lambda n, r=rng: [r.choice(pool) for _ in range(n)]
