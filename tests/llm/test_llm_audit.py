"""The filter audit against a plain walk through all orders."""

from collections import Counter
from itertools import permutations

import pytest

from dayzero.llm import filter_audit
from dayzero.llm.common import WORD

NAMES = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def plain(rows, labels):
    """rows (doc_id, text, lang); labels (doc_id, quality, toxic)."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    docs = []
    for i, text, lang in rows:
        text = text or ""
        words = WORD.findall(text)
        fails = "A" * (len(words) < 200) + "B" * (100 * len(set(words)) < 50 * len(words))
        fails += "C" * (100 * sum("A" <= c <= "Z" for c in text) > 3 * len(text)) + "D" * any(c in "#$%&*|" for c in text)
        same = [j for j, other, _ in rows if (other or "") == text and j is not None and i is not None and j < i]
        docs.append((lang or "", fails + "E" * bool(same), i in good, i in toxic))
    out, shapley = {}, Counter()
    for part in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == part]
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, f in enumerate(order, 1):
                here = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                shapley[part, f] += len(here)
                redundant = sum(f in d[1] for d in own) - len(here)
                alone = sum(d[1] == f for d in own)
                out[part, order, step] = [len(left), len(here), redundant, alone, sum(d[2] for d in here), sum(d[3] for d in here)]
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def found(df):
    rows = df.collect()
    out = {(r["part"], r["filter_order"], r["step"]): tuple(r[n] for n in NAMES) for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.fixture
def labelled(spark):
    def build(*rows):
        return spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, quality int, toxic int, n string, part string")

    return build


def test_traps(docs, prose, labelled):
    many = " ".join(f"w{i}" for i in range(250))
    texts = [
        (1, None, "en"), (2, "", "de"), (3, "Short & LOUD", "en"), (4, many, "en"), (4, many, "en"), (5, many, "fr"), (6, many, None),
        (None, many, "en"), (None, None, None), (7, prose(400), ""), (8, "same word " * 300, "en"), (9, "same word " * 300, "de"),
        (10, many + " $", "fr"), (11, "ÄÖÜ" * 300, "fr"), (12, "A" * 31 + "b" * 969, "fr"), (13, "A" * 30 + "é" * 970, "fr"),
        (14, " ".join(["a b\x0bc\x0cd\x1ce"] * 60), "fr"), (3, "Another short text of one id", "de"), (0, "Short & LOUD", "de"),
    ]
    labels = [(1, 1, 0), (1, 0, 1), (3, 1, None), (4, 1, 1), (5, 0, 1), (9, 1, 0), (9, 1, 0), (None, 1, 1), (99, 1, 1)]
    table = docs([(i, t, lang, "s") for i, t, lang in texts])
    assert found(filter_audit.audit_filters(table, labelled(*labels))) == plain(texts, labels)


def test_hot_text_and_many_tasks(spark, docs, labelled, prose, monkeypatch):
    monkeypatch.setattr(filter_audit, "PARTS_HELD", 1)
    monkeypatch.setattr(filter_audit, "MEETING_POINTS", 2)
    texts = [(i, "copied text" if i % 3 == 0 else prose(i % 7) + "%" * (i % 5 == 0), "abc"[i % 3]) for i in range(300)]
    labels = [(i, i % 2, i % 11 == 0) for i in range(0, 300, 2)]
    table = docs([(i, t, lang, "s") for i, t, lang in texts]).repartition(7)
    labels = [(i, q, int(t)) for i, q, t in labels]
    assert found(filter_audit.audit_filters(table, labelled(*labels))) == plain(texts, labels)


def test_counts_do_not_overflow(spark):
    """Sums beyond 32 bits stay in their fields."""
    n = 5_000_000_000_000
    rows = [("x", 31, True, False, n)] * 5 + [("x", 0, False, False, n), ("x", 1, False, True, 3)]
    counts = spark.createDataFrame(rows, "part string, mask int, good boolean, toxic boolean, n long")
    got = found(filter_audit.order_audit(counts))
    assert got["x", "ABCDE", 1] == (n, 5 * n + 3, 0, 3, 5 * n, 3, 5 * n * 24 + 3 * 120)
    assert got["x", "BACDE", 1] == (n + 3, 5 * n, 0, 0, 5 * n, 0, 5 * n * 24)
    assert got["x", "BACDE", 2] == (n, 3, 5 * n, 3, 0, 3, 5 * n * 24 + 3 * 120)


def test_long_texts_are_cut_between_words(monkeypatch):
    monkeypatch.setattr(filter_audit, "LONG_TEXT", 11)
    text = ("some words of different lengths " * 9).encode()
    assert [w for part in filter_audit._words(text) for w in part] == text.split()
    assert [w for part in filter_audit._words(b"x" * 100) for w in part] == [b"x" * 100]


def test_no_documents(docs, labelled):
    assert filter_audit.audit_filters(docs([(1, "x", "en", "s")]).limit(0), labelled((1, 1, 1))).count() == 0
    assert filter_audit.audit_filters(docs([(1, "x", "en", "s")]), labelled((1, 1, 1)).limit(0)).count() == 600
