import random
import re

import numpy as np
import pytest

from dayzero.llm import near_text, near_vectors
from dayzero.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def grouped(nodes, links):
    """The smallest node that each can reach."""
    top = {n: n for n in nodes}

    def find(n):
        while top[n] != n:
            n = top[n]
        return n

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        top[b] = a
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize(
    "links",
    [
        [],
        [(1, 1)],
        [(i, i + 1) for i in range(300)],
        [(0, i) for i in range(1, 500)] + [(500, i) for i in range(501, 900)] + [(-5, 899)],
        [(random.Random(1).randint(0, 400), random.Random(i).randint(0, 400)) for i in range(350)],
        [(2 * i, 2 * i + 1) for i in range(50)] * 2 + [(2**62, -(2**62))],
    ],
)
def test_components(spark, links):
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    nodes = {n for a, b in links if a != b for n in (a, b)}
    assert got == grouped(nodes, [(a, b) for a, b in links if a != b])


def shingles(text, width):
    words = [w.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for w in WORD.findall(text or "")]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


def edited(pick, words, n):
    words = list(words)
    for _ in range(n):
        words[pick.randrange(len(words))] = f"new{pick.randint(0, 999)}"
    return words


@pytest.fixture
def texts(prose):
    pick = random.Random(11)
    vocabulary = [f"w{i}" for i in range(3000)] + ["Of", "THE"]
    base = [prose(pick.randint(3, 150), vocabulary) for _ in range(150)]
    near = [" ".join(edited(pick, b.split(), pick.randint(1, 6))) for b in base for _ in range(2)]
    # One large group whose members differ more and more from each other, so that links form chains.
    trunk = prose(120, vocabulary).split()
    chain = []
    for _ in range(150):
        trunk = edited(pick, trunk, 1)
        chain.append(" ".join(edited(pick, trunk, pick.randint(0, 3))))
    odd = [None, "", " \n", "a", "a", "A", "a b", "a  B\n", "b a", "É x y", "é x y", "x y z w", "same words here " * 3000]
    return base + near + chain + odd + [base[0]] * 60 + ["head " + base[5], base[5].upper()]


@pytest.mark.parametrize("width, percent, small", [(3, 85, False), (3, 85, True), (5, 80, True)])
def test_near_texts(docs, texts, monkeypatch, width, percent, small):
    if small:
        monkeypatch.setattr(near_text, "BUCKET_ROWS", 20)
        monkeypatch.setattr(near_text, "BLOCK_TEXTS", 15)
        monkeypatch.setattr(near_text, "STAR_TEXTS", 4)
    order = list(range(len(texts)))
    random.Random(3).shuffle(order)
    sets = {i: shingles(t, width) for i, t in zip(order, texts, strict=True)}
    links = []
    for i, a in sets.items():
        for j, b in sets.items():
            common = len(a & b)
            if i < j and common and 100 * common >= percent * (len(a) + len(b) - common):
                links.append((i, j))
    expected = grouped(sets, links)
    table = docs([(i, t, "en", "s") for i, t in zip(order, texts, strict=True)]).repartition(7)
    got = near_text.near_duplicates(table, width, percent).collect()
    assert len(got) == len(texts)
    for r in got:
        assert r.n_shingles == len(sets[r.doc_id])
        assert (r.component_id, r.kept) == (expected[r.doc_id], expected[r.doc_id] == r.doc_id), r
    assert len(set(expected.values())) < len(texts) - 120


def test_rows_without_or_with_equal_ids(docs):
    rows = [(5, "a b c d e f", "en", "s"), (5, "q r s t u v", "en", "s"), (9, "Q r s t u v", "en", "s"), (3, "a b c d e f", "en", "s")]
    table = docs([*rows, (None, "a b c d e f", "en", "s"), (7, None, "en", "s"), (7, None, "en", "s")])
    got = sorted(map(tuple, near_text.near_duplicates(table, 3, 85).collect()), key=str)
    assert got == sorted(
        [(5, 4, 3, False), (5, 4, 3, False), (9, 4, 3, False), (3, 4, 3, True), (None, 4, None, True), (7, 0, 7, True), (7, 0, 7, True)],
        key=str,
    )
    assert near_text.near_duplicates(table.where("false"), 3, 85).collect() == []


def test_one_text_stands_for_repeated_rows(spark, docs, prose, monkeypatch):
    """Rows that repeat an id and its text never meet in one task, however many there are."""
    pick = random.Random(4)
    text = prose(60, [f"w{i}" for i in range(500)])
    near = [" ".join(edited(pick, text.split(), 1)) for _ in range(5)]
    rows = [(4, text)] * 2000 + [(10 + i, t) for i, t in enumerate(near)] + [(10, near[1])] * 300 + [(20, text)] * 500
    table = docs([(i, t, "en", "s") for i, t in rows]).repartition(6)
    sizes = spark.sparkContext.accumulator(0)
    star, confirm, gathered = near_text._star, near_text._confirm, near_text.family_texts
    monkeypatch.setattr(near_text, "_star", lambda *a: lambda df: (sizes.add(len(df)), star(*a)(df))[1])
    monkeypatch.setattr(near_text, "_confirm", lambda *a: lambda df: (sizes.add(len(df)), confirm(*a)(df))[1])
    held = []
    monkeypatch.setattr(near_text, "family_texts", lambda *a: held.append(gathered(*a)) or held[0])
    got = near_text.near_duplicates(table, 3, 85).collect()
    assert len(got) == len(rows) and {r.component_id for r in got} == {4}
    assert sum(r.kept for r in got) == 2000
    assert held[0].count() == 6  # sets, each with the text of its smallest id
    assert sizes.value <= 3 * held[0].count()


def test_families_held_by_a_star_are_not_compared_again(spark, docs, prose, monkeypatch):
    text = prose(100, [f"w{i}" for i in range(900)]).split()
    texts = [" ".join([*text[:i], "other", *text[i + 1 :]]) for i in range(60)]
    compared = []
    blocks = near_text.block_links
    monkeypatch.setattr(near_text, "block_links", lambda t, f, *a: compared.append(f.count()) or blocks(t, f, *a))
    got = near_text.near_duplicates(docs([(i, t, "en", "s") for i, t in enumerate(texts)]), 3, 85).collect()
    assert {r.component_id for r in got} == {0} and compared == [0]


def test_buckets_of_equal_ids_do_not_cancel(docs, prose):
    """Two ids with two sets each: their hashes by id would add up to nothing."""
    pick = random.Random(6)
    base = prose(80, [f"w{i}" for i in range(700)]).split()
    texts = [" ".join(edited(pick, base, 1)) for _ in range(5)]
    rows = [(1, texts[0]), (1, texts[1]), (2, texts[2]), (2, texts[3]), (9, texts[4])]
    got = near_text.near_duplicates(docs([(i, t, "en", "s") for i, t in rows]), 3, 85).collect()
    assert {r.component_id for r in got} == {1}


def test_pigeonhole_keys():
    """Every pair within the distance shares a key."""
    pick = random.Random(2)
    for similarity in (0.8, 0.85, 0.95):
        distance = near_text.search_distance(similarity)
        keys = near_text.chunk_keys(distance)
        for _ in range(300):
            wrong = set(pick.sample(range(near_text.SYMBOLS), distance))
            assert any(not wrong & set(key) for key in keys)


def test_signatures_estimate_similarity():
    a = near_text.shingle_set(" ".join(f"a{i}" for i in range(2000)), 1)
    b = near_text.shingle_set(" ".join(f"a{i}" for i in range(200, 2200)), 1)
    sides = [near_text.signature(s).view(np.uint16) for s in (a, b)]
    assert abs((sides[0] == sides[1]).mean() - 1800 / 2200) < 0.15
    assert len(near_text.shingle_set("word " * 100_000, 3)) == 1


def plain_links(rows, threshold=0.95):
    width = max((len(v) for _, v in rows if v is not None), default=1)
    units = []
    for _, v in rows:
        good = v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)
        x = np.zeros(width)
        if good:
            x[: len(v)] = v
            x = x / np.abs(x).max()
        units.append(x / np.linalg.norm(x) if good else x)
    return np.array(units) @ np.array(units).T >= threshold


@pytest.mark.parametrize("kind, small", [("float", False), ("double", True)])
def test_near_vectors(spark, monkeypatch, kind, small):
    if small:
        monkeypatch.setattr(near_vectors, "BLOCK_HOMES", 30)
        monkeypatch.setattr(near_vectors, "BLOCK_VISITORS", 50)
        monkeypatch.setattr(near_vectors, "PIECE", 16)
    pick = np.random.default_rng(5)
    centres = pick.normal(size=(150, 11))
    around = [c + 0.06 * pick.normal(size=11) for c in centres[:40] for _ in range(6)] + [centres[0] + 0.08 * pick.normal(size=11) for _ in range(200)]
    vectors = [v.astype(np.float32).tolist() for v in [*centres, *around]]
    vectors += [vectors[3]] * 40 + [[2 * x for x in vectors[4]], [-x for x in vectors[4]]]
    vectors += [None, [], [0.0] * 11, [float("nan"), 1.0], [float("inf")] * 3, [None, 1.0], [1.0], [5.0, 0.0], [1e30] * 11, [1e-30] * 11]
    order = pick.permutation(len(vectors)).tolist()
    rows = [(i, vectors[i]) for i in order]
    table = spark.createDataFrame(
        [(*r, "l", "v", "x") for r in rows], f"vec_id long, embedding array<{kind}>, label string, vector string, id string"
    )
    got = {r.vec_id: r for r in near_vectors.near_vectors(table.repartition(5)).collect()}
    linked = plain_links(rows)
    np.fill_diagonal(linked, False)
    found = sum(r.n_links for r in got.values())
    assert len(got) == len(rows) and found <= linked.sum() and found >= 0.99 * linked.sum()
    expected = grouped(order, [(order[a], order[b]) for a, b in zip(*np.nonzero(linked), strict=True)])
    wrong = [i for i, r in got.items() if r.component_id != expected[i]]
    assert len(wrong) <= 0.01 * len(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())
    for i in range(len(vectors) - 10, len(vectors) - 4):
        assert (got[i].n_links, got[i].component_id) == (0, i)


def test_few_vectors(spark):
    def run(rows):
        table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
        return sorted(map(tuple, near_vectors.near_vectors(table).collect()), key=str)

    assert run([]) == []
    assert run([(1, None), (None, [1.0])]) == [(1, 0, 1, True), (None, 0, None, True)]
    assert run([(4, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.01])]) == [(2, 0, 2, True), (3, 1, 3, True), (4, 1, 3, False)]
    assert run([(4, [1.0]), (4, [1.0]), (4, [-1.0])]) == [(4, 0, 4, True), (4, 1, 4, True), (4, 1, 4, True)]


def test_visits_are_the_nearest_cells():
    pick = np.random.default_rng(1)
    units = near_vectors._unit(pick.normal(size=(400, 8)))
    grid = near_vectors.fit_grid(units, 8, 0.95, 0.99)
    a, b = grid.sides(units[:50])
    sums = (a[:, :, None] + b[:, None, :]).reshape(50, -1)
    for n in (1, 5, 20, 64, 100):
        visits = grid.visits(units[:50], n)
        assert visits.shape == (50, min(n, 64))
        np.testing.assert_allclose(np.take_along_axis(sums, visits, 1), np.sort(sums, axis=1)[:, : visits.shape[1]], atol=1e-12)


def test_visited_cells_follow_the_whole_sample():
    rng = np.random.default_rng(5)
    tight = rng.normal(size=(1, 32)) + 0.02 * rng.normal(size=(4000, 32))
    wide = rng.normal(size=(4000, 32))
    for units in (np.concatenate([tight, wide]), np.concatenate([wide, tight])):
        units /= np.linalg.norm(units, axis=1, keepdims=True)
        # From the first 2,000 rows alone it is 30 and 16.
        assert near_vectors.fit_grid(units, 32, 0.95, 0.998).n_visits >= 25
