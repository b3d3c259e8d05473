import random
import re

import pytest

from dayzero.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_targets(sizes, weights=(5, 2, 1), most=3):
    """Deal all words by weight, cut what is above its cap, deal the excess again, until nothing is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode("utf-32-be")))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = total - sum(most * sizes[s] for s in capped)
        free = [s for s in names if s not in capped]
        targets = {s: most * sizes[s] for s in capped}
        targets |= {s: rest * weight[s] / sum(weight[f] for f in free) for s in free}
        over = [s for s in free if targets[s] > most * sizes[s]]
        if not over:
            return targets
        capped |= set(over)


@pytest.fixture
def corpus(prose):
    pick = random.Random(9)
    sources = [None, "a", "B", "é", "z", "😀", "\uffff", "tiny"]
    data = [(i, prose(pick.randint(0, 60)), "en", pick.choice(sources[:7] + ["B"] * 4)) for i in range(900)]
    data += [(1000, "just one", "en", "tiny"), (1001, None, "en", "a"), (1002, "", "en", "nothing"), (1003, None, "en", "nothing")]
    return data + [(7, "same " * 9, "en", "a")] * 3 + [(None, "no id", "en", "a")]


@pytest.mark.parametrize("range_rows", [1000, 40])
def test_mix(docs, corpus, monkeypatch, range_rows):
    monkeypatch.setattr(mixing, "RANGE_ROWS", range_rows)
    table = docs(corpus).repartition(5)
    out = mixing.mix(table, ["doc_id", "size", "source"]).collect()
    assert len(out) == len(corpus)
    sizes = {}
    for _, text, _, source in corpus:
        sizes[source] = sizes.get(source, 0) + len(WORD.findall(text or ""))
    targets = plain_targets(sizes)
    assert sum(targets.values()) == pytest.approx(sum(sizes.values()))
    for source, size in sizes.items():
        rows = [r for r in out if r.row.source == source]
        assert {r.source_size for r in rows} == {size}
        assert {round(r.target, 6) for r in rows} == {round(targets[source], 6)}
        assert all(r.taken == r.copies * r.size and 0 <= r.copies <= 3 for r in rows)
        taken = sum(r.taken for r in rows)
        assert taken <= targets[source] + 1e-6
        # Short by less than any document that could still be taken.
        left = [r.size for r in rows if r.size and r.copies < 3 and r.copies == min(x.copies for x in rows if x.size)]
        assert not left or targets[source] - taken < min(left)
        # Whole epochs come first, so documents' copies differ by one at most.
        assert len({r.copies for r in rows if r.size}) <= 2
    again = mixing.mix(table.repartition(3), ["doc_id", "size", "source"]).collect()
    assert sorted(map(str, again)) == sorted(map(str, out))


def test_the_last_words_go_to_small_documents(docs, prose):
    """A long document at the end of the budget leaves room that only few, or equal, small ones can fill."""
    pick = random.Random(3)
    rows = [(i, prose(pick.choice([700, 800, 900])), "en", "long") for i in range(40)]
    rows += [(100 + i, prose(3), "en", "long") for i in range(30)] + [(200 + i, prose(90), "en", "other") for i in range(50)]
    rows += [(150, prose(3), "en", "long")] * 4
    for weights in ((1.0, 3.0), (1.0, 9.0), (2.0, 3.0)):
        out = mixing.mix(docs(rows), ["doc_id", "source"], weights=weights).collect()
        for source in ("long", "other"):
            own = [r for r in out if r.row.source == source]
            base = min(r.copies for r in own)
            short = own[0].target - sum(r.taken for r in own)
            left = [r.size for r in own if r.copies == base < 3]
            assert short >= -1e-6 and (not left or short < min(left))


def test_better_documents_come_first(docs):
    rows = [(i, ("fine word " * 20) if i % 2 else ("### word " * 20), "en", s) for i in range(1000) for s in ("a", "b")]
    out = mixing.mix(docs(rows), ["doc_id"], weights=(1.0, 4.0)).collect()
    taken = [r.row.doc_id % 2 for r in out if r.copies == min(1, r.copies) and r.copies and r.target < r.source_size]
    assert len(taken) > 300 and sum(taken) > 0.6 * len(taken)


def test_empty_tables(docs):
    assert mixing.mix(docs([]), ["doc_id"]).collect() == []
    out = mixing.mix(docs([(1, None, "en", None), (2, " ", "en", "a")]), ["doc_id"]).collect()
    assert [(r.size, r.source_size, r.target, r.taken) for r in out] == [(0, 0, 0.0, 0)] * 2
