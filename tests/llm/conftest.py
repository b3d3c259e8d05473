from __future__ import annotations

import random

import pytest

from dayzero.llm.common import ready


@pytest.fixture(scope="session")
def docs(spark):
    """A documents table of (doc_id, text, lang, source) rows with further columns whose names operators use inside."""
    ready(spark)
    clashing = ["row", "size", "key", "id", "kept", "gid", "n_tokens", "toxic", "gone_id", "l_id", "n_chars"]

    def build(rows):
        schema = "doc_id long, text string, lang string, source string, " + ", ".join(f"{c} string" for c in clashing)
        return spark.createDataFrame([(*row, *clashing) for row in rows], schema)

    return build


@pytest.fixture
def prose():
    """A maker of texts from a small vocabulary."""
    pick = random.Random(7)
    vocabulary = ["alpha", "beta", "Gamma", "delta,", "épsilon", "zeta.", "eta", "Theta", "iota", "kappa", "of", "the"]

    def build(n, words=None):
        return " ".join(pick.choice(words or vocabulary) for _ in range(n))

    return build
