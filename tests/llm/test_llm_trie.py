"""The trie of conversations against a plain one."""

import hashlib
import random
import zlib

import pytest

from dayzero.llm import prefix_trie
from dayzero.llm.common import WORD, ready

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(rows):
    """rows (conv_id, turn, role, text)."""
    turns = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()
            turns.setdefault(conv, []).append((turn is not None, turn, role, digest, text))
    turns = {c: [(t[2], t[4]) for t in sorted(own, key=lambda t: (t[0], t[1] or 0, t[2], t[3]))] for c, own in turns.items()}
    built = {}
    for conv, own in turns.items():
        h = zlib.crc32(str(conv).encode()) % 4
        rest = abs(conv) % 20 * (-1 if conv < 0 else 1)
        built[conv] = tuple(turns.get(conv - rest, [])[:h] + own[h:])
    members = {}
    for conv, path in built.items():
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(conv)
    out = []
    for node, convs in members.items():
        subtree = [n for n in members if n[: len(node)] == node]
        inner = {n[:-1] for n in members if n}
        ends = sorted(c for c in convs if built[c] == node)
        out.append(
            (
                min(convs),
                len(node),
                min(members[node[:-1]]) if node else None,
                len(convs),
                sum(len(n) == len(node) + 1 for n in subtree),
                sum(n not in inner for n in subtree),
                sum((len(members[n]) - 1) * len(WORD.findall(n[-1][1])) for n in subtree if n),
                hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
            )
        )
    return sorted(out, key=repr)


def found(spark, rows, **settings):
    ready(spark)
    schema = "conv_id long, turn long, role string, text string, pos string, span string, key string, ids string"
    table = spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], schema).repartition(3)
    return sorted((tuple(r) for r in prefix_trie.prefix_trie(table, **settings).select(COLUMNS).collect()), key=repr)


def conversations(n, seed, longest=6, texts=3):
    pick = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(pick.randint(0, longest)):
            rows.append((conv, turn, pick.choice(["user", "system", None]), "word " * pick.randrange(texts)))
    pick.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", range(2))
def test_one_shard(spark, seed):
    rows = conversations(70, seed)
    assert found(spark, rows) == plain(rows)


@pytest.mark.parametrize("seed", range(2))
def test_many_shards_and_levels(spark, seed, monkeypatch):
    monkeypatch.setattr(prefix_trie, "FEW_CELLS", 20)
    rows = conversations(90, 10 + seed, longest=5, texts=2)
    assert found(spark, rows, cells=40) == plain(rows)


@pytest.mark.parametrize("cells", [1 << 20, 30])
def test_slabs(spark, cells, monkeypatch):
    """Conversations of up to 14 turns in slabs of 2, 3 and 4: common beginnings go over several slabs."""
    monkeypatch.setattr(prefix_trie, "FEW_CELLS", 30)
    pick = random.Random(3)
    rows = []
    for conv in range(40):
        kind = pick.randrange(3)
        for turn in range(pick.randint(0, 14)):
            rows.append((conv, turn, "user", f"text {kind} {turn}" if pick.random() < 0.97 else "another"))
    assert found(spark, rows, widths=(2, 3, 4), cells=cells) == plain(rows)


def test_hot_conversation_of_many_copies(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "FEW_CELLS", 50)
    rows = [(c, t, "user", f"t{t}") for c in range(150) for t in range(3)] + [(c, 0, "user", f"x{c}") for c in range(150, 200)]
    assert found(spark, rows, cells=100) == plain(rows)


def test_one_conversation_of_very_many_turns(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "SPAN_BITS", 3)
    rows = [(7, t * 3, "user", f"t{t % 5} w") for t in range(300)] + [(0, t, "user", "a b") for t in range(20)]
    rows += [(8, t, "user", f"t{t % 5} w") for t in range(300)] + [(9, None, "x", "same")] * 30
    assert found(spark, rows, widths=(4, 8, 32)) == plain(rows)


def test_nulls_ties_and_absent_bases(spark):
    rows = [
        (None, 0, "user", "lost"), (21, None, None, None), (21, 0, "user", "a"), (21, 0, "user", "b"), (21, 0, "assistant", "c"),
        (21, 0, "user", "a"), (33, 1, "user", "only"), (47, 0, "user", "x"), (47, 1, "user", "y"), (-3, 0, "user", "neg"),
        (-3, 1, "user", "neg 2"), (0, 5, "system", "hello there"), (0, None, "system", "null first"), (5, 0, "u", "z" * 100_000),
        (6, 0, "us", "erx"), (6, 1, "user", "x"), (26, 0, "user", "x"),
    ]
    assert found(spark, rows) == plain(rows)


def test_turnless(spark):
    """A conversation whose own turns are all replaced and whose base is absent ends at the root."""
    gone = next(c for c in range(41, 60) if zlib.crc32(str(c).encode()) % 4 == 3)
    rows = [(gone, 0, "user", "x"), (gone, 1, "user", "y")]
    assert found(spark, rows) == plain(rows)
    assert found(spark, [*rows, (100, 0, "user", "z")]) == plain([*rows, (100, 0, "user", "z")])


def test_empty(spark):
    assert found(spark, []) == [] and found(spark, [(None, 1, "user", "x")]) == []
