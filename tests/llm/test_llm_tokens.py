import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from dayzero.llm import bpe, context_coder, id_files, token_counts

PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
WORDS = public_tokenizers.path("word_bpe_49k.json")

SPACES = [chr(c) for c in (0x85, 0xA0, 0x1680, 0x2000, 0x200A, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0x1C, 0x1F, 0x180E, 0x200B)]
PARTS = [
    *"abcdeghinorstABZ  '.,!?-019", " ", " the", "ing", "'s", "'LL", "aaaa", "\n", "\r\n", "\t ", "é", "e\u0301", "ß", "ü", "Σ",
    "σς", "İı", "日本語", "한국", "😀", "\u0301", "½²", "Ⅷ", "\x00", "\xad", "×÷", "ɏɐ", "▁", "</s>", "<unk>", "<0x0A>",
    "<|endoftext|>", "<|startoftext|>", "x" * 40, *SPACES,
]


def odd_texts(n, seed=3):
    pick = random.Random(seed)
    texts = ["".join(pick.choice(PARTS) for _ in range(pick.randint(0, 90))) for _ in range(n)]
    return texts + ["", " ", "a" * 3000, "ab" * 500 + "a", "the " * 5000, "!" * 300, "<|endoftext|>" * 3]


@pytest.mark.parametrize("chunk, overlap", [(24, 1), (60, 5), (200, 40)])
def test_spliced_chunks_equal_whole_encoding(chunk, overlap):
    model, proven = token_counts._load(PIECES)
    assert proven
    for text in odd_texts(600):
        parts = token_counts.encode_long(model, text, chunk, overlap)
        assert [i for part in parts for i in part] == model.encode(text)


def test_overlap_is_widened_to_the_end():
    model, _ = token_counts._load(PIECES)
    text = "日" * 2000 + "a" * 2000
    assert list(token_counts.encode_long(model, text, 100, 10)) == [model.encode(text)]


def test_without_proof_a_text_is_encoded_whole():
    model, _ = token_counts._load(PIECES)
    assert list(token_counts.encode_long(model, "a b " * 100, 50, 10, proven=False)) == [model.encode("a b " * 100)]


def test_token_counts(docs, rows):
    texts = [None, "", "a b " * 30_000, "x" * 50_000, *odd_texts(100), "same", "same"]
    table = docs([(i, t, "en", "s") for i, t in enumerate(texts)] + [(None, "a", None, None)])
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    expected = []
    for i, t in [*enumerate(texts), (None, "a")]:
        n = len(model.encode(t or ""))
        expected.append((i, len((t or "").encode()), n, n > 4096))
    got = rows(token_counts.count_tokens(table, PIECES))
    assert sorted(got, key=str) == sorted(expected, key=str)
    assert rows(token_counts.count_tokens(table.where("false"), PIECES)) == []


def test_trie_encodes_and_decodes_like_the_library(docs, rows):
    library = Tokenizer.from_file(WORDS)
    texts = odd_texts(1500)
    table = docs([(i, t, "en", "s") for i, t in enumerate([*texts, None, texts[0]])])
    got = rows(bpe.encode_documents(table, WORDS, ["doc_id"], with_ids=True))
    assert len(got) == len(texts) + 2
    for row, n, ids_sha, decoded_sha, ids in got:
        text = ([*texts, None, texts[0]][row.doc_id]) or ""
        coded = library.encode(text, add_special_tokens=False)
        decoded = library.decode(coded.ids, skip_special_tokens=False)
        assert (n, ids) == (len(coded.ids), coded.ids), text
        assert ids_sha == hashlib.sha256(" ".join(map(str, coded.ids)).encode()).hexdigest()
        assert decoded_sha == hashlib.sha256(decoded.encode()).hexdigest()
        assert bpe.encoder(WORDS).decode(ids) == decoded
    assert rows(bpe.encode_documents(table.where("false"), WORDS, ["doc_id"])) == []


def test_every_character_as_in_the_library():
    """Also those that only one of the interpreter's and the library's tables know as letters."""
    from dayzero.llm.letters import all_characters

    texts = [f"A{c}b 1{c}2 {c} {c}{c}" for c in all_characters()[::3]]
    library, own = Tokenizer.from_file(WORDS), bpe.Encoder(WORDS)
    expected = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [list(ids) for ids, _ in own.encode(texts)] == expected
    library, own = Tokenizer.from_file(BYTES), id_files.WordEncoder(BYTES)
    expected = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(ids, "<u4").tolist() for ids in own.encode(texts)] == expected


@pytest.mark.parametrize("library", ["tokenizers", "tiktoken"])
def test_letter_classes_take_little_memory(library):
    """Every worker asks for them as it starts, so what this takes for a moment counts once per core."""
    import subprocess
    import sys
    from pathlib import Path

    code = (
        "import resource, tokenizers, tiktoken; from dayzero.llm import letters\n"
        "peak = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024\n"
        f"start = peak(); found = letters.{library}_classes(); print(peak() - start, *map(len, found.values()))"
    )
    root = Path(id_files.__file__).resolve().parents[2]
    said = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, check=True).stdout
    grown, *sizes = map(int, said.split())
    assert grown < 110 and min(sizes) > 20, said


def test_encoder_forgets_words_and_pairs(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 200)
    library, own = Tokenizer.from_file(WORDS), bpe.Encoder(WORDS)
    texts = odd_texts(400, seed=11)
    for i in range(0, len(texts), 10):
        part = texts[i : i + 10]
        for text, (ids, written) in zip(part, own.encode(part), strict=True):
            expected = library.encode(text, add_special_tokens=False).ids
            assert (list(ids), written) == (expected, " ".join(map(str, expected))), text
    list(own.encode(texts))
    assert min(len(own.known), len(own.merges._apart)) > 200
    list(own.encode(["zq"]))
    assert max(len(own.known), len(own.merges._apart)) < 50


def test_files_that_ask_for_something_else_are_refused(tmp_path):
    import json

    changes = {
        "normalizer": {"type": "NFKC"},
        "pre_tokenizer": {"type": "Whitespace"},
        "decoder": {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True},
    }
    spec = json.load(open(WORDS, encoding="utf-8"))
    for name, value in changes.items():
        path = tmp_path / f"{name}.json"
        path.write_text(json.dumps(spec | {name: value}))
        with pytest.raises(ValueError, match=name):
            bpe.Merges(str(path))
    spec = json.load(open(BYTES, encoding="utf-8"))
    for name, value in changes.items():
        if name != "decoder":
            path = tmp_path / f"bytes-{name}.json"
            path.write_text(json.dumps(spec | {name: value}))
            with pytest.raises(ValueError):
                id_files.WordEncoder(str(path))


def test_trie_on_random_merges(tmp_path):
    """Small vocabularies with dense merges, where many pairs of tokens interfere."""
    import json

    pick = random.Random(5)
    spec = json.load(open(WORDS, encoding="utf-8"))
    for trial in range(15):
        symbols = ["a", "b", "c", "a</w>", "b</w>", "c</w>"]
        tokens, merges = list(symbols), []
        while len(merges) < 40:
            left = pick.choice([t for t in tokens if not t.endswith("</w>")])
            right = pick.choice(tokens)
            if left + right not in tokens and len(left + right) < 14:
                tokens.append(left + right)
                merges.append([left, right])
        spec["model"] |= {"vocab": {t: i for i, t in enumerate(tokens)}, "merges": merges}
        spec["added_tokens"] = []
        path = tmp_path / f"{trial}.json"
        path.write_text(json.dumps(spec))
        library, own = Tokenizer.from_file(str(path)), bpe.Merges(str(path))
        words = {"".join(pick.choice("aabc") for _ in range(pick.randint(1, 12))) for _ in range(300)}
        for word, got in own.encode_words(words).items():
            assert got == library.encode(word, add_special_tokens=False).tokens, (merges, word)


@pytest.mark.parametrize("nibbles", [4, 5, 8])
def test_blocks_come_back(nibbles):
    pick = np.random.default_rng(nibbles)
    most = min(1 << 4 * nibbles, 1 << 31) - 1
    blocks = [pick.integers(0, most, n) for n in (0, 1, 2, 7, 2048, 500)]
    blocks += [np.zeros(2048, int), np.arange(2048) % 5, np.full(300, most), np.repeat(pick.integers(0, most, 50), 40)]
    coded = context_coder.write_blocks(blocks, nibbles)
    assert all(np.array_equal(a, b) for a, b in zip(blocks, context_coder.read_blocks(coded), strict=True))
    # Each block is reset: it can be read by itself and gives the same bytes alone.
    for block, own in zip(blocks, coded, strict=True):
        assert context_coder.write_blocks([block], nibbles) == [own]
        assert np.array_equal(context_coder.read_blocks([own])[0], block)
    assert len(coded[6]) < 200 and len(coded[7]) < 300


def test_blocks_take_little_time():
    """Writing and reading against sorting, on skewed ids: 13 to 14 times as long, and 28 to 38 before."""
    import time

    pick = np.random.default_rng(4)
    ids = np.minimum(pick.zipf(1.2, (600, context_coder.BLOCK_IDS)), 50_000)

    def seconds(run):
        start = time.process_time()
        run()
        return time.process_time() - start

    sorting = min(seconds(lambda: np.argsort(ids.reshape(-1), kind="stable")) for _ in range(3))
    coding = min(seconds(lambda: context_coder.read_blocks(context_coder.write_blocks(list(ids), 4))) for _ in range(3))
    assert coding < 20 * sorting, (coding, sorting)


def test_lists_of_blocks():
    """Few and many ids, close and far apart, used once and often; a block longer than the others is stored as it is."""
    pick = np.random.default_rng(6)
    far = np.array([0, 1, 1 << 20, (1 << 31) - 1])
    blocks = [far, np.repeat(far, 500), far[:1], np.arange(2048), np.arange(2048) * 30_000, pick.permutation(2048)]
    blocks += [np.minimum(pick.zipf(1.2, 2048), 50_000) for _ in range(300)]
    blocks.append(np.zeros(context_coder.BLOCK_IDS + 1, int))
    coded = context_coder.write_blocks(blocks, 8)
    assert all(np.array_equal(a, b) for a, b in zip(blocks, context_coder.read_blocks(coded), strict=True))
    assert len(coded[-1]) > 4 * context_coder.BLOCK_IDS > len(coded[6])
    # Skewed ids take less than they did in nibbles, 2,247 bytes a block.
    assert sum(map(len, coded[6:-1])) < 2_240 * 300


def test_damaged_lists_are_noticed():
    coded = context_coder.write_blocks([np.arange(1000) % 37], 4)[0]
    for place in range(context_coder.HEADER.size, len(coded)):
        damaged = bytearray(coded)
        damaged[place] ^= 1
        with pytest.raises(ValueError, match="checksum"):
            context_coder.read_blocks([bytes(damaged)])


def test_damage_is_noticed():
    block = np.arange(1000) % 37
    coded = bytearray(context_coder.write_blocks([block], 4)[0])
    coded[-5] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        context_coder.read_blocks([bytes(coded)])


def test_word_cache_encodes_like_the_library():
    library, own = Tokenizer.from_file(BYTES), id_files.WordEncoder(BYTES)
    texts = odd_texts(3000, seed=8)
    for text, ids in zip(texts, own.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_word_encoder_asks_once_and_forgets(monkeypatch):
    """New words of a batch go to the library in one call, and its ids come in the order of the words."""
    library, own = Tokenizer.from_file(BYTES), id_files.WordEncoder(BYTES)
    texts = odd_texts(400, seed=13)
    asked = []
    learn = own.learn
    monkeypatch.setattr(own, "learn", lambda words: (asked.append(words), learn(words)))
    monkeypatch.setattr(id_files, "REMEMBERED", 300)
    for i in [*range(0, len(texts), 10), 0]:
        part = [*texts[i : i + 10], None, ""]
        for text, ids in zip(part, own.encode(part), strict=True):
            assert ids.tolist() == library.encode(text or "", add_special_tokens=False).ids, text
    assert max(asked, key=len) and all(len(set(words)) == len(words) for words in asked)
    own.forget()
    assert own.encode(["zq zq"])[0].tolist() == library.encode("zq zq", add_special_tokens=False).ids
    assert len(own.known) < 10
    assert [ids.tolist() for ids in own.encode([])] == []


@pytest.mark.parametrize("chunk", [1000, id_files.CHUNK_IDS])
def test_id_files(docs, rows, monkeypatch, chunk):
    monkeypatch.setattr(id_files, "CHUNK_IDS", chunk)
    texts = [None, "", "x" * 20_000, *odd_texts(300), "same", "same"]
    order = list(range(len(texts)))
    random.Random(2).shuffle(order)
    table = docs([(3 * i - 50, texts[i], "en", "s") for i in order]).repartition(5)
    library = Tokenizer.from_file(BYTES)
    expected, start = [], 0
    for i, text in enumerate(texts):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        expected.append((3 * i - 50, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(rows(id_files.store_ids(table, BYTES, 2))) == expected
    assert rows(id_files.store_ids(table.where("false"), BYTES, 2)) == []


def test_equal_and_missing_ids_of_documents(docs, rows):
    table = docs([(1, "b", "en", "s"), (1, "b", "en", "s"), (None, "a", "en", "s"), (0, "c d", "en", "s")])
    got = rows(id_files.store_ids(table, BYTES, 2))
    assert sorted((i, s) for i, s, _, _ in got if i is not None) == [(0, 2), (1, 5), (1, 7)]
    assert [(s, n) for i, s, n, _ in got if i is None] == [(0, 2)]
