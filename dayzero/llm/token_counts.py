"""Token counts of whole texts by overlapping chunks that are spliced at proven boundaries.

A text longer than a chunk is encoded in chunks that overlap. Two neighbours are joined at a position of their overlap
where both have a token boundary and where no piece of the vocabulary can reach across, so the tokens before it do not
depend on what follows and those after it do not depend on what precedes. Where the overlap holds no such position it
is doubled, at worst up to the end of the text.

The proof is made on the vocabulary: a space after another character starts a piece, because no
piece has the sign that stands for a space behind another character. A vocabulary with such a piece has no proven position, and
its texts are encoded in one go.

Null text counts as empty, and an empty text has no tokens. Repeated rows are counted one by one; an empty table gives
an empty result. Only the id and text columns are read, so other columns may have any names.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GAP = "▁".encode()
CHUNK_BYTES = 32_768
OVERLAP_BYTES = 256
#: Texts that are handed to the encoder together, so that their ids need little memory.
TOGETHER = 64


@lru_cache(maxsize=4)
def _load(path: str):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    gap_starts_piece = all("▁" not in model.id_to_piece(i).lstrip("▁") for i in range(model.get_piece_size()))
    return model, gap_starts_piece


def _encode(model, data: bytes, start: int, end: int) -> tuple[list[int], list[int]]:
    """Ids of a part of a UTF-8 text, and the byte of the text at which each begins."""
    pieces = model.encode(data[start:end].decode(), return_type="proto").pieces
    return [p.id for p in pieces], [p.begin + start for p in pieces]


def _whole(data: bytes, at: int) -> int:
    """The first character boundary at or after a byte."""
    at = min(at, len(data))
    while at < len(data) and data[at] & 0xC0 == 0x80:
        at += 1
    return at


def common_boundary(data: bytes, left: list[int], right: list[int], start: int, end: int) -> tuple[int, int] | None:
    """Tokens of the left chunk to keep and of the right one to drop, at the first proven boundary of [start, end).

    left and right hold the bytes at which the chunks' tokens begin.
    """
    at = data.find(b" ", start + 1, end)
    while at >= 0:
        if data[at - 1] != 0x20 and data[at - 3 : at] != GAP:
            i, j = bisect_left(left, at), bisect_left(right, at)
            if i < len(left) and left[i] == at and j < len(right) and right[j] == at:
                return i, j
        at = data.find(b" ", at + 1, end)
    return None


def encode_long(model, text: str, chunk: int = CHUNK_BYTES, overlap: int = OVERLAP_BYTES, proven: bool = True) -> Iterator[list[int]]:
    """The ids of model.encode(text), in parts that follow each other."""
    data = text.encode()
    if not proven or len(data) <= chunk:
        yield model.encode(text)
        return
    start, end, drop = 0, _whole(data, chunk), 0
    ids, begins = _encode(model, data, start, end)
    while end < len(data):
        right_start = _whole(data, max(end - overlap, start + 1))
        width, cut = overlap, None
        while cut is None:
            right_end = _whole(data, end + chunk)
            right_ids, right_begins = _encode(model, data, right_start, right_end)
            cut = common_boundary(data, begins, right_begins, right_start, end)
            if cut is None:
                if end == len(data):
                    yield ids[drop:]
                    return
                width *= 2
                end = _whole(data, right_start + width)
                ids, begins = _encode(model, data, start, end)
        yield ids[drop : cut[0]]
        start, end, drop, ids, begins = right_start, right_end, cut[1], right_ids, right_begins
    yield ids[drop:]


def count_tokens(
    docs: DataFrame,
    model_path: str,
    limit: int = 4096,
    id_col: str = "doc_id",
    text_col: str = "text",
    chunk: int = CHUNK_BYTES,
    overlap: int = OVERLAP_BYTES,
) -> DataFrame:
    """id, n_bytes, n_tokens and over_limit of every row. model_path must be readable on the executors."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, proven = _load(model_path)
        for batch in batches:
            n_bytes, n_tokens = [], []
            for i in range(0, batch.num_rows, TOGETHER):
                texts = [t or "" for t in batch.column(1).slice(i, TOGETHER).to_pylist()]
                sizes = [len(t.encode()) for t in texts]
                short = iter(model.encode([t for t, n in zip(texts, sizes, strict=True) if n <= chunk], num_threads=1))
                n_bytes += sizes
                n_tokens += [
                    len(next(short)) if n <= chunk else sum(map(len, encode_long(model, t, chunk, overlap, proven)))
                    for t, n in zip(texts, sizes, strict=True)
                ]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(n_bytes, pa.int64()),
                    pa.array(n_tokens, pa.int64()),
                    pa.array([n > limit for n in n_tokens], pa.bool_()),
                ],
                names=[id_col, "n_bytes", "n_tokens", "over_limit"],
            )

    read = docs.select(F.col(id_col), F.col(text_col))
    return read.mapInArrow(count, f"`{id_col}` {id_type}, n_bytes long, n_tokens long, over_limit boolean")
