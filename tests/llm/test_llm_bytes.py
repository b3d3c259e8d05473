"""Byte-level encoding against the library it stands for."""

import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from dayzero.llm import byte_bpe, letters

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
PARTS = [
    *"abcdeghinorstABZ  '.,!?-019", " ", " the", "ing", "'s", "'LL", "aaaa", "\n", "\r\n", "\t ", "é", "é", "ß", "Σ", "日本語",
    "한국", "😀", "́", "½²", "Ⅷ", "\x00", "\xad", "ɏɐ", "<|endoftext|>", "\x85", "\xa0", " ", "　", "\x1c", "՘",
    "\U00016ea0", "x" * 40,
]


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})


@pytest.fixture(scope="module")
def coder():
    return byte_bpe.TextCoder(RANKS, PATTERN)


def ids_of(coder, text):
    return [i for ids, _ in coder.encode(text) for i in ids]


def test_odd_texts(coder, library):
    pick = random.Random(4)
    texts = ["".join(pick.choice(PARTS) for _ in range(pick.randint(0, 90))) for _ in range(4000)]
    for text in [*texts, "", " ", "a" * 3000, "ab" * 500 + "a", "the " * 5000, "!" * 300]:
        ids = ids_of(coder, text)
        assert ids == library.encode_ordinary(text)
        assert coder.bpe.decode(ids) == text.encode()


def test_every_character(coder, library):
    """Between letters, digits, spaces and itself: so also where the library's tables lack a character."""
    for c in letters.all_characters()[::7]:
        text = f"a{c}b1{c}2 {c} {c}{c}"
        assert ids_of(coder, text) == library.encode_ordinary(text), hex(ord(c))


def test_joined_tokens(coder, library):
    """Texts made of whole tokens need other tokens than these, which is where longest matches mislead."""
    pick, tokens = random.Random(2), list(coder.bpe.ids)
    for _ in range(5000):
        text = b"".join(pick.choice(tokens) for _ in range(pick.randint(2, 6))).decode(errors="ignore")
        assert ids_of(coder, text) == library.encode_ordinary(text)


def test_small_ranks_that_need_backtracking():
    """Of random small vocabularies, pieces equal the merges carried out one by one."""
    pick, turned_back = random.Random(9), 0
    for _ in range(60):
        ranks = {bytes([b]): b for b in range(256)}
        tokens = [b"a", b"b", b"c"]
        while len(tokens) < 30:
            joined = pick.choice(tokens) + pick.choice(tokens)
            if joined not in ranks:
                ranks[joined] = 253 + len(tokens)
                tokens.append(joined)
        bpe = byte_bpe.ByteBpe(ranks)
        own = tiktoken.Encoding("own", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})
        for _ in range(200):
            piece = bytes(pick.choice(b"abc") for _ in range(pick.randint(1, 40)))
            expected = own.encode_ordinary(piece.decode())
            assert bpe.encode_piece(piece) == expected
            longest, at = [], 0
            while at < len(piece):
                at += next(n for n in range(len(piece) - at, 0, -1) if piece[at : at + n] in ranks)
                longest.append(at)
            turned_back += len(longest) != len(expected)
    assert turned_back > 100


def test_steps_grow_with_the_bytes(coder, monkeypatch):
    asked = 0
    fits = coder.bpe.fits

    def counted(before, token):
        nonlocal asked
        asked += 1
        return fits(before, token)

    monkeypatch.setattr(coder.bpe, "fits", counted)
    per_size = []
    for n in (20_000, 80_000):
        asked = 0
        assert coder.bpe.decode(coder.bpe.encode_piece(b"xaab" * n)) == b"xaab" * n
        per_size.append(asked / n)
    assert per_size[1] < 1.1 * per_size[0]


def test_long_texts_go_step_by_step(coder, library, monkeypatch):
    monkeypatch.setattr(letters, "LONG_TEXT", 100)
    monkeypatch.setattr(letters, "STEP_PIECES", 7)
    monkeypatch.setattr(byte_bpe, "REMEMBERED", 20)
    pick = random.Random(8)
    for _ in range(200):
        text = "".join(pick.choice(PARTS) for _ in range(150))
        assert ids_of(coder, text) == library.encode_ordinary(text)


def test_patterns_with_other_classes_raise():
    for pattern in (r"\w+", r"[\S]", r"\p{Lu}"):
        with pytest.raises(ValueError):
            letters.compiled(pattern, letters.tiktoken_classes())
    with pytest.raises(ValueError):
        byte_bpe.ByteBpe({b"a": 0})


def test_documents(docs, library, monkeypatch):
    monkeypatch.setattr(letters, "LONG_TEXT", 1000)
    texts = [None, "", "Same text, 2 rows", "Same text, 2 rows", "word " * 30_000, "x" * 50_000, " é 日本 's"]
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)] + [(None, "no id", None, None)]
    coded = byte_bpe.encode_documents(docs(rows), RANKS, PATTERN, carried=["doc_id", "n_tokens"], with_ids=True)
    got = coded.select("row.doc_id", "row.n_tokens", coded["n_tokens"].alias("n"), "ids", "ids_sha256", "decoded_sha256").collect()
    assert len(got) == len(rows)
    by_id = {r[0]: r for r in rows}
    for doc_id, carried, n, ids, ids_sha, decoded_sha in got:
        text = by_id[doc_id][1] or ""
        expected = library.encode_ordinary(text)
        assert (carried, n, ids) == ("n_tokens", len(expected), expected)
        assert ids_sha == hashlib.sha256(" ".join(map(str, expected)).encode()).hexdigest()
        assert decoded_sha == hashlib.sha256(text.encode()).hexdigest()
    assert byte_bpe.encode_documents(docs(rows).limit(0), RANKS, PATTERN, carried=["doc_id"]).count() == 0
