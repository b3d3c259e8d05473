"""Byte-pair encoding of words by a trie, and decoding.

The distinct words of a batch are put into a trie of symbols. The last token of a prefix's encoding is found from its
ancestors: a token t that ends the prefix is its last token exactly if the prefix without t ends with a token s such
that the merges leave the pair (s, t) apart (and t is a token that its own string is merged to). A walk through the trie finds the last token of each prefix once, however
many words share it; a word's encoding is read by stepping back from token to token.

Texts are cut as the tokenizer file says: special strings are taken out first, the rest is normalised (NFC, white space
to one space, lower case) and split into words by the file's pattern, with letters and digits as the library's
tables have them; words become symbols of bytes, the last one marked as the end of a word. Decoding goes from the ids to
their strings and joins these by spaces, as the file names no decoder. A file that asks for anything else is refused.

Null text counts as empty; an empty text has no ids. Repeated rows are encoded one by one; an empty table gives an empty
result. Input columns are carried in one struct, so they may have any names.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayzero.llm.letters import Splitter, tokenizers_classes

#: Words, and pairs of tokens, that a worker remembers before it starts anew.
REMEMBERED = 500_000
#: What the tokenizer file has to say: the normaliser and the splitter that this module carries out.
NORMALIZER = {
    "type": "Sequence",
    "normalizers": [
        {"type": "NFC"},
        {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "},
        {"type": "Lowercase"},
    ],
}
BYTES_ONLY = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
#: From here on characters may differ between this interpreter's Unicode tables and the library's.
NOT_LATIN = re.compile(r"[^\x00-\u024f]")
ENDLESS = 1 << 60


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where printable, else the next one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


def read_spec(path: str) -> dict:
    """A tokenizer file; ValueError if it asks for something else than is carried out here."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, before = spec["model"], spec["pre_tokenizer"] or {}
    parts = before.get("pretokenizers") or [{}]
    split = {k: v for k, v in parts[0].items() if k != "pattern"}
    as_here = {
        "model": model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix")),
        "byte_fallback": not model.get("byte_fallback") and not model.get("ignore_merges"),
        "normalizer": spec["normalizer"] == NORMALIZER,
        "pre_tokenizer": split == {"type": "Split", "behavior": "Removed", "invert": True} and parts[1:] == [BYTES_ONLY],
        "decoder": spec["decoder"] is None,
        "added_tokens": not any(t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")),
    }
    other = [name for name, same in as_here.items() if not same]
    if other:
        raise ValueError(f"{path} asks for another {', '.join(other)} than this encoder carries out")
    return spec


class Merges:
    """Vocabulary and merges of a tokenizer file."""

    def __init__(self, path: str):
        spec = read_spec(path)
        self.pattern: str = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.end: str = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s for s, i in self.ids.items()} | {i: s for s, i in self.special.items()}
        self.rank: dict[tuple[str, str], int] = {}
        self.parts: dict[str, tuple[str, str]] = {}
        for i, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            self.rank[a, b] = i
            self.parts.setdefault(a + b, (a, b))
        self.made = {s: self.rank[p] for s, p in self.parts.items()}
        #: Symbols in a token: its characters, of which the end mark is none of its own.
        self.length = {s: len(s) - len(self.end) * (bool(self.end) and s.endswith(self.end)) for s in self.ids}
        self.longest = max(self.length.values())
        self.bytes = byte_symbols()
        self._apart: dict[tuple[str, str], bool] = {}
        # A token whose own string is merged otherwise occurs in no encoding.
        self.usable = {s for s in self.ids if s not in self.parts}
        for (a, b), i in self.rank.items():
            if self.made[a + b] == i and a in self.usable and b in self.usable and not self._cross(a, b, i):
                self.usable.add(a + b)

    def _edge(self, token: str, side: int, used: int) -> list[tuple[str, int, int]]:
        """The pieces at one end of a token, from whole to symbol: when each is made and when it is used up."""
        pieces = []
        while True:
            made = self.made.get(token, -1)
            pieces.append((token, made, used))
            if token not in self.parts:
                return pieces
            token, used = self.parts[token][side], made

    def _cross(self, left: str, right: str, used: int) -> bool:
        """Does a merge reach across two neighbouring tokens before they are used up themselves?

        One does if some piece at the end of left and some piece at the start of right exist at one time and merge
        before either is used up. Equal merges happen from left to right, so at equal rank left's own merge comes
        first and right's comes second.
        """
        return any(
            (rank := self.rank.get((a, b))) is not None
            and rank < a_used
            and rank <= b_used
            and a_made < b_used
            and b_made < a_used
            for a, a_made, a_used in self._edge(left, 1, used)
            for b, b_made, b_used in self._edge(right, 0, used)
        )

    def apart(self, left: str, right: str) -> bool:
        """Do the merges leave these two tokens side by side?"""
        known = self._apart.get((left, right))
        if known is None:
            known = self._apart[left, right] = not self._cross(left, right, ENDLESS)
        return known

    def symbols(self, word: str) -> list[str]:
        out = [self.bytes[b] for b in word.encode()]
        if out:
            out[-1] += self.end
        return out

    def encode_words(self, words: Iterable[str]) -> dict[str, list[str]]:
        """The tokens of each word, from one walk through the trie of all of them."""
        symbols, parents, children, ends = [""], [-1], [{}], {}
        for word in words:
            node = 0
            for s in self.symbols(word):
                child = children[node].get(s)
                if child is None:
                    child = children[node][s] = len(symbols)
                    symbols.append(s)
                    parents.append(node)
                    children.append({})
                node = child
            ends[word] = node
        last: list[str | None] = [None] * len(symbols)
        back = [0] * len(symbols)
        usable, apart, known, steps = self.usable, self.apart, self._apart, range(self.longest)
        # A node comes after its parent, so the order of making is a walk in which ancestors' states are known.
        for node in range(1, len(symbols)):
            at, token = node, ""
            for _ in steps:
                token = symbols[at] + token
                at = parents[at]
                if not at:
                    if token in usable:
                        last[node] = token
                    break
                if token in usable and (before := last[at]) is not None:
                    free = known.get((before, token))
                    if apart(before, token) if free is None else free:
                        last[node], back[node] = token, at
                        break
        out = {}
        for word, node in ends.items():
            tokens = []
            while node:
                tokens.append(last[node])
                node = back[node]
            out[word] = tokens[::-1]
        return out


class Encoder:
    """Texts to ids and back, with the words of a batch encoded together."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.merges = Merges(path)
        self.split = Splitter(self.merges.pattern, tokenizers_classes())
        self.library_normal = Tokenizer.from_file(path).normalizer.normalize_str
        #: Of each word the ids as 32-bit numbers; as strings they are written by decimals.
        self.known: dict[str, bytes] = {}
        self.decimals = list(map(str, range(max(self.merges.strings) + 1)))
        specials = sorted(self.merges.special, key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, specials)) + ")") if specials else None
        for s in specials:
            self.known[s] = self.entry([self.merges.special[s]])
        self.fixed = dict(self.known)

    def normal(self, text: str) -> str:
        """As the library normalises; texts of older letters in a faster way.

        These are composed already, and white space may stay as it is, since it is in no word.
        """
        return self.library_normal(text) if NOT_LATIN.search(text) else text.lower()

    def words(self, text: str) -> list[str]:
        if self.special is None or not any(s in text for s in self.fixed):
            return self.split.findall(self.normal(text))
        out = []
        for i, part in enumerate(self.special.split(text)):
            out += [part] if i % 2 else self.split.findall(self.normal(part))
        return out

    def learn(self, words: set[str]) -> None:
        if len(self.known) > REMEMBERED:
            self.known = dict(self.fixed)
        if len(self.merges._apart) > REMEMBERED:
            self.merges._apart.clear()
        ids = self.merges.ids
        for word, tokens in self.merges.encode_words(w for w in words if w not in self.known).items():
            self.known[word] = self.entry([ids[t] for t in tokens])

    @staticmethod
    def entry(ids: list[int]) -> bytes:
        return array("i", ids).tobytes()

    def encode(self, texts: list[str | None]) -> Iterator[tuple[array, str]]:
        """The ids of each text, as numbers and as a string."""
        cut = [self.words(t or "") for t in texts]
        self.learn(set().union(*cut))
        known = self.known
        for words in cut:
            ids = array("i")
            ids.frombytes(b"".join(map(known.__getitem__, words)))
            yield ids, " ".join(map(self.decimals.__getitem__, ids))

    def decode(self, ids: Iterable[int]) -> str:
        return " ".join(map(self.merges.strings.__getitem__, ids))


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


#: Texts that are cut into words and encoded together.
TOGETHER = 256


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def encode_documents(
    docs: DataFrame, path: str, carried: list[str], text_col: str = "text", with_ids: bool = False
) -> DataFrame:
    """row (struct of the carried columns), n_tokens, ids_sha256, decoded_sha256; with_ids adds the ids.

    ids_sha256 is of the decimal ids joined by one space, decoded_sha256 of the decoded text.
    """
    read = docs.select(F.struct(*[F.col(c) for c in carried]).alias("row"), F.col(text_col).alias("text"))
    row_type = read.schema["row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in batches:
            for i in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(i, TOGETHER)
                done = list(coder.encode(part.column(1).to_pylist()))
                columns = {
                    "row": part.column(0),
                    "n_tokens": pa.array([len(ids) for ids, _ in done], pa.int64()),
                    "ids_sha256": pa.array([_sha(written) for _, written in done], pa.string()),
                    "decoded_sha256": pa.array([_sha(coder.decode(ids)) for ids, _ in done], pa.string()),
                }
                if with_ids:
                    columns["ids"] = pa.array([np.frombuffer(ids, np.int32) for ids, _ in done], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_pydict(columns)

    schema = f"row {row_type}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return read.mapInArrow(run, schema + (", ids array<int>" if with_ids else ""))
