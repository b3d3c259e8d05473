"""Byte-level byte-pair encoding by backtracking from longest matches, and decoding.

A text is cut by the pattern into pieces. The bytes of a piece are written as Latin-1 characters, one each, and one pass
of an Aho-Corasick automaton over them gives the longest token that starts at each byte. The encoding is then grown from
the left: the longest token that fits behind the last one is taken; where none fits, the last token is given up for the
next shorter one that starts at the same byte. A token fits if merging the bytes of both tokens leaves the two side by
side; this is found out once per pair and remembered. Sequences in which all neighbours fit are exactly those that the
merges give, and a prefix has one such sequence only, so a place that once led nowhere is never tried again and the steps
grow in proportion to the bytes.

Decoding goes from the ids alone to their bytes. Null text counts as empty; an empty text has no ids. Repeated rows are
encoded one by one; an empty table gives an empty result. Input columns are carried in one struct, so they may have any
names. Long texts are encoded step by step, so a task holds a bounded number of their pieces at a time.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayzero.llm.letters import Splitter, tiktoken_classes

#: Pieces and pairs of tokens that a worker remembers before it starts anew.
REMEMBERED = 500_000
#: Longer pieces are not remembered.
LONG_PIECE = 64
NONE = -1
UNRANKED = 1 << 60


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and their ranks of a file with one token in base64 and its rank a line."""
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


class ByteBpe:
    """Encodes pieces by ranks: of all neighbours whose joined bytes have a rank, those of the lowest merge first."""

    def __init__(self, ranks: dict[bytes, int]):
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"the ranks lack {len(missing)} of the 256 single bytes")
        self.ids = ranks
        self.bytes = {i: token for token, i in ranks.items()}
        self.size = {i: len(token) for token, i in ranks.items()}
        #: The longest token that a token begins with, other than itself.
        self.shorter: dict[int, int] = {}
        self.matcher = ahocorasick.Automaton()
        for token, i in ranks.items():
            starts = (ranks.get(token[:n]) for n in range(len(token) - 1, 0, -1))
            self.shorter[i] = next((s for s in starts if s is not None), NONE)
            self.matcher.add_word(token.decode("latin-1"), i)
        self.matcher.make_automaton()
        self.fitting: dict[tuple[int, int], bool] = {}

    def merged(self, text: bytes) -> list[bytes]:
        """The merges carried out one by one; for the few bytes of two tokens."""
        parts = [text[i : i + 1] for i in range(len(text))]
        ranks = [self.rank(a, b) for a, b in zip(parts, parts[1:])]
        while ranks and (lowest := min(ranks)) != UNRANKED:
            at = ranks.index(lowest)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del ranks[at]
            if at:
                ranks[at - 1] = self.rank(parts[at - 1], parts[at])
            if at < len(ranks):
                ranks[at] = self.rank(parts[at], parts[at + 1])
        return parts

    def rank(self, left: bytes, right: bytes) -> int:
        return self.ids.get(left + right, UNRANKED)

    def fits(self, before: int, token: int) -> bool:
        """Do the merges leave token behind before, or, at the start of a piece, leave it whole?"""
        known = self.fitting.get((before, token))
        if known is None:
            if len(self.fitting) > REMEMBERED:
                self.fitting.clear()
            pair = [self.bytes[i] for i in (before, token) if i != NONE]
            known = self.fitting[before, token] = self.merged(b"".join(pair)) == pair
        return known

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ids.get(piece)
        if whole is not None:
            return [whole]
        size, shorter, n = self.size, self.shorter, len(piece)
        longest = [NONE] * (n + 1)
        for end, token in self.matcher.iter(piece.decode("latin-1")):
            longest[end - size[token] + 1] = token  # a later match that starts here is longer
        path: list[int] = []
        dead = bytearray(n + 1)
        at, token = 0, longest[0]
        while at < n:
            before = path[-1] if path else NONE
            while token != NONE and (dead[at + size[token]] or not self.fits(before, token)):
                token = shorter[token]
            if token != NONE:
                path.append(token)
                at += size[token]
                token = longest[at]
            else:
                dead[at] = 1
                token = path.pop()
                at -= size[token]
                token = shorter[token]
        return path

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


class TextCoder:
    """Texts to ids, piece by piece, with the ids of pieces seen before remembered."""

    def __init__(self, path: str, pattern: str):
        self.bpe = ByteBpe(read_ranks(path))
        self.split = Splitter(pattern, tiktoken_classes())
        #: Of each piece the ids, as 32-bit numbers and as a string.
        self.known: dict[str, tuple[bytes, str]] = {}

    def learn(self, pieces: set[str]) -> dict[str, tuple[bytes, str]]:
        """Encode pieces that are new; returns those too long to remember."""
        if len(self.known) > REMEMBERED:
            self.known = {}
        long = {}
        for piece in pieces.difference(self.known):
            ids = self.bpe.encode_piece(piece.encode())
            kept = self.known if len(piece) <= LONG_PIECE else long
            kept[piece] = array("i", ids).tobytes(), " ".join(map(str, ids))
        return long

    def encode(self, text: str) -> Iterator[tuple[array, str]]:
        """The ids of a text as numbers and as a string, those of a long one in several steps."""
        for pieces in self.split.pieces(text):
            long = self.learn(set(pieces))
            if long:
                found = [long.get(p) or self.known[p] for p in pieces]
            else:
                found = list(map(self.known.__getitem__, pieces))
            ids = array("i")
            ids.frombytes(b"".join([f[0] for f in found]))
            yield ids, " ".join([f[1] for f in found])


@lru_cache(maxsize=2)
def text_coder(path: str, pattern: str) -> TextCoder:
    return TextCoder(path, pattern)


def encode_documents(
    docs: DataFrame, path: str, pattern: str, carried: list[str], text_col: str = "text", with_ids: bool = False
) -> DataFrame:
    """row (struct of the carried columns), n_tokens, ids_sha256, decoded_sha256; with_ids adds the ids.

    ids_sha256 is of the decimal ids joined by one space, decoded_sha256 of the bytes that the ids decode to.
    """
    read = docs.select(F.struct(*[F.col(c) for c in carried]).alias("row"), F.col(text_col).alias("text"))
    row_type = read.schema["row"].dataType.simpleString()

    def digests(coder: TextCoder, text: str) -> tuple[int, str, str, array | None]:
        n, ids_sha, decoded_sha, kept = 0, hashlib.sha256(), hashlib.sha256(), array("i") if with_ids else None
        for ids, written in coder.encode(text):
            if n and written:
                ids_sha.update(b" ")
            n += len(ids)
            ids_sha.update(written.encode())
            decoded_sha.update(coder.bpe.decode(ids))
            if with_ids:
                kept.extend(ids)
        return n, ids_sha.hexdigest(), decoded_sha.hexdigest(), kept

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = text_coder(path, pattern)
        for batch in batches:
            done = [digests(coder, text.as_py() or "") for text in batch.column(1)]
            columns = {
                "row": batch.column(0),
                "n_tokens": pa.array([d[0] for d in done], pa.int64()),
                "ids_sha256": pa.array([d[1] for d in done], pa.string()),
                "decoded_sha256": pa.array([d[2] for d in done], pa.string()),
            }
            if with_ids:
                columns["ids"] = pa.array([d[3] for d in done], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict(columns)

    schema = f"row {row_type}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return read.mapInArrow(run, schema + (", ids array<int>" if with_ids else ""))
