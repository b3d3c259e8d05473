"""Token ids of documents in coded files, and reading them back.

Documents are sorted by id into shards, one per task. A task encodes its texts, ends each document with an end id, and
packs whole documents into chunks of about CHUNK_IDS ids. A chunk holds an index (id and number of ids of each document)
and the ids in blocks of the context-mixing range coder, each with its checksum, so any chunk is read by itself. The
files are Parquet with one row per chunk (shard, chunk, n_ids, payload), which keeps them readable in any store.

Reading decodes the chunks, wherever they come to lie, and adds up the ids of earlier chunks and shards from the files'
numbers alone.

Texts are encoded by the tokenizers library, word by word as its file cuts them: the ids of each different word are asked
from it once per worker and kept for the next text. Special strings inside texts are handled as the library's default.

Null text counts as empty and gets the end id alone. Rows that share an id follow each other in an order that depends on
their texts. A null id comes first. An empty table gives files without rows and an empty result. Only the id and text
columns are read, so other columns may have any names. Ids of documents are whole numbers.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice, pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dayzero.llm.common import shared_folder
from dayzero.llm.context_coder import BLOCK_IDS, LANES, nibbles_for, read_blocks, write_blocks
from dayzero.llm.letters import Splitter, tokenizers_classes

CHUNK_IDS = 512 * BLOCK_IDS
MAGIC = b"IDS1"
HEAD = struct.Struct("<4sIII")  # magic, documents, blocks, bytes of the index
#: Words whose ids a worker remembers before it starts anew, and how many ids these may have on average.
REMEMBERED, IDS_PER_WORD = 1_000_000, 8
#: How the library cuts texts before it looks for bytes, if its file asks for it. Letters and digits are asked for first,
#: as most pieces begin with them or with a space; contractions must only come before other symbols.
PATTERN = r" ?\p{L}+| ?\p{N}+|'(?:s|t|re|ve|m|ll|d)| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CUT_BYTES = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}


class _Numbers(dict):
    """Words and the order in which they were first asked for."""

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        return number


class WordEncoder:
    """ids of texts by a byte-level tokenizer file, as unsigned 32-bit numbers.

    Words are numbered as they come. The ids of all numbers lie one after the other in one array, so those of a batch of
    texts are taken from it at once.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        cut = {k: v for k, v in (spec["pre_tokenizer"] or {}).items() if k != "trim_offsets"}
        if spec["normalizer"] is not None or cut != CUT_BYTES:
            raise ValueError(f"{path} normalises or cuts texts in another way than this encoder")
        if any(t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError(f"{path} has added tokens that take in what is around them")
        self.split = Splitter(PATTERN, tokenizers_classes())
        self.library = Tokenizer.from_file(path)
        added = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        self.largest = max(self.library.get_vocab_size(with_added_tokens=True), *added.values(), 1)
        self.fixed = added
        ordered = sorted(added, key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, ordered)) + ")") if ordered else None
        self.forget()

    def forget(self) -> None:
        self.known = _Numbers((s, n) for n, s in enumerate(self.fixed))
        self.ids = np.array(list(self.fixed.values()), "<u4")
        #: Where the ids of each number begin; the last is where those of the next one will.
        self.starts = np.arange(len(self.ids) + 1)

    def learn(self, words: list[str]) -> None:
        """Ask the library for the ids of the words that follow those already asked for."""
        # As one sequence of words that are each cut and encoded by themselves; that is faster than one call for each.
        coded = self.library.encode(words, is_pretokenized=True, add_special_tokens=False)
        sizes = np.bincount(np.array(coded.word_ids, np.int64), minlength=len(words))
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(sizes)])
        self.ids = np.concatenate([self.ids, np.array(coded.ids, "<u4")])

    def words(self, text: str) -> list[str]:
        cut = self.split.findall
        if self.special is None or not any(s in text for s in self.fixed):
            return cut(text)
        out = []
        for i, part in enumerate(self.special.split(text)):
            out += [part] if i % 2 else cut(part)
        return out

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        if len(self.known) > REMEMBERED or len(self.ids) > REMEMBERED * IDS_PER_WORD:
            self.forget()
        before, number = len(self.known), self.known.__getitem__
        # Text by text, so that the words of one are gone before the next is cut.
        cut = [np.fromiter(map(number, self.words(t or "")), np.int64) for t in texts]
        if len(self.known) > before:
            self.learn(list(islice(reversed(self.known), len(self.known) - before))[::-1])
        numbers = np.concatenate([np.empty(0, np.int64), *cut])
        starts = self.starts.take(numbers)
        sizes = self.starts.take(numbers + 1) - starts
        ends = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.ids.take(np.repeat(starts - ends[:-1], sizes) + np.arange(ends[-1]))
        text_ends = ends[np.cumsum([0, *map(len, cut)])].tolist()
        return [ids[a:b] for a, b in pairwise(text_ends)]


@lru_cache(maxsize=2)
def _encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def pack(docs: list[tuple[int | None, np.ndarray]], blocks: list[bytes]) -> bytes:
    """A chunk: its documents' ids and lengths with the end id, then its blocks."""
    numbers = np.array([0 if i is None else i for i, _ in docs], "<i8")
    known = np.array([i is not None for i, _ in docs], np.uint8)
    lengths = np.array([len(ids) + 1 for _, ids in docs], "<u4")
    sizes = np.array([len(b) for b in blocks], "<u4")
    index = zlib.compress(numbers.tobytes() + known.tobytes() + lengths.tobytes() + sizes.tobytes(), 6)
    head = HEAD.pack(MAGIC, len(docs), len(blocks), len(index))
    return b"".join([head, index, zlib.crc32(head + index).to_bytes(4, "little"), *blocks])


def unpack(chunk: bytes) -> tuple[list[int | None], np.ndarray, list[bytes]]:
    """Documents' ids, their lengths, and the blocks."""
    magic, n_docs, n_blocks, n_index = HEAD.unpack_from(chunk)
    at = HEAD.size + n_index
    if magic != MAGIC or zlib.crc32(chunk[:at]) != int.from_bytes(chunk[at : at + 4], "little"):
        raise ValueError("the index of a chunk is damaged: its checksum does not hold")
    index = zlib.decompress(chunk[HEAD.size : at])
    numbers = np.frombuffer(index, "<i8", n_docs)
    known = np.frombuffer(index, np.uint8, n_docs, 8 * n_docs)
    lengths = np.frombuffer(index, "<u4", n_docs, 9 * n_docs)
    ends = at + 4 + np.cumsum(np.frombuffer(index, "<u4", n_blocks, 13 * n_docs), dtype=np.int64)
    starts = np.concatenate([[at + 4], ends[:-1]]) if n_blocks else ends
    ids = [int(i) if k else None for i, k in zip(numbers, known, strict=True)]
    return ids, lengths, [chunk[s:e] for s, e in zip(starts, ends, strict=True)]


def write_files(
    docs: DataFrame, tokenizer_path: str, end_id: int, path: str, id_col: str = "doc_id", text_col: str = "text"
) -> None:
    """Encode all documents in ascending order of their ids and write the files to a new folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer_path)
        end = np.array([end_id], "<u4")
        nibbles = nibbles_for(max(encoder.largest, end_id))
        shard = TaskContext.get().partitionId()
        chunks: list[list[tuple[int | None, np.ndarray]]] = [[]]
        held = in_chunk = first = 0

        def coded() -> pa.RecordBatch:
            nonlocal first
            cut, counts = [], []
            for chunk in chunks:
                ids = np.concatenate([part for _, ids in chunk for part in (ids, end)])
                parts = [ids[i : i + BLOCK_IDS] for i in range(0, len(ids), BLOCK_IDS)]
                cut += parts
                counts.append(len(parts))
            blocks = iter(write_blocks(cut, nibbles))
            rows = {
                "shard": pa.array([shard] * len(chunks), pa.int32()),
                "chunk": pa.array(range(first, first + len(chunks)), pa.int64()),
                "n_ids": pa.array([sum(len(ids) + 1 for _, ids in c) for c in chunks], pa.int64()),
                "payload": pa.array([pack(c, [next(blocks) for _ in range(n)]) for c, n in zip(chunks, counts, strict=True)]),
            }
            first += len(chunks)
            return pa.RecordBatch.from_pydict(rows)

        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                texts = encoder.encode(part.column(1).to_pylist())
                for doc_id, ids in zip(part.column(0).to_pylist(), texts, strict=True):
                    if in_chunk >= CHUNK_IDS:
                        chunks.append([])
                        held, in_chunk = held + in_chunk, 0
                        if held >= LANES * BLOCK_IDS:
                            chunks.pop()
                            yield coded()
                            chunks, held = [[]], 0
                    chunks[-1].append((doc_id, ids))
                    in_chunk += len(ids) + 1
        if chunks[-1]:
            yield coded()

    read = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    tie = F.xxhash64("text")
    ordered = read.repartitionByRange("id", tie).sortWithinPartitions("id", tie)
    ordered.mapInArrow(run, "shard int, chunk long, n_ids long, payload binary").write.parquet(path)


def read_files(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """id, start, n_tokens and ids_crc32 of every document in the files of a folder."""
    files = spark.read.schema("shard int, chunk long, n_ids long, payload binary").parquet(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            waiting, n_blocks = [], 0
            for i in range(batch.num_rows):
                waiting.append((batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), *unpack(batch.column(2)[i].as_py())))
                n_blocks += len(waiting[-1][4])
                if n_blocks >= LANES or i == batch.num_rows - 1:
                    yield decoded(waiting)
                    waiting, n_blocks = [], 0

    def decoded(chunks: list) -> pa.RecordBatch:
        blocks = iter(read_blocks([b for c in chunks for b in c[4]]))
        columns: list[list] = [[], [], [], [], [], []]
        for shard, chunk, doc_ids, lengths, coded in chunks:
            ids = np.concatenate([*[next(blocks) for _ in coded], np.empty(0, np.uint32)]).astype("<u4")
            ends = np.cumsum(lengths, dtype=np.int64)
            for doc_id, start, end in zip(doc_ids, ends - lengths, ends, strict=True):
                row = (shard, chunk, doc_id, int(start), int(end - start), zlib.crc32(ids[start:end]))
                for column, value in zip(columns, row, strict=True):
                    column.append(value)
        names = ["shard", "chunk", "id", "at", "n_tokens", "ids_crc32"]
        kinds = [pa.int32(), *[pa.int64()] * 5]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    docs = files.select("shard", "chunk", "payload").mapInArrow(
        run, "shard int, chunk long, id long, at long, n_tokens long, ids_crc32 long"
    )
    # The numbers of the files alone: one row per chunk, and one per shard where all of them meet.
    sizes = files.select("shard", "chunk", "n_ids")
    within = F.sum("n_ids").over(Window.partitionBy("shard").orderBy("chunk")) - F.col("n_ids")
    shards = sizes.groupBy("shard").agg(F.sum("n_ids").alias("ids"))
    shards = shards.select(
        F.col("shard").alias("s_shard"), (F.sum("ids").over(Window.orderBy("shard")) - F.col("ids")).alias("before")
    )
    chunks = sizes.withColumn("within", within).join(shards, F.col("shard") == F.col("s_shard"))
    chunks = chunks.select(F.col("shard").alias("c_shard"), F.col("chunk").alias("c_chunk"), (F.col("before") + F.col("within")).alias("before"))
    placed = docs.join(chunks, (F.col("shard") == F.col("c_shard")) & (F.col("chunk") == F.col("c_chunk")))
    return placed.select(F.col("id").alias(id_col), (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def store_ids(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write all documents' ids to a new folder in the shared one and read them back."""
    path = f"{shared_folder(docs.sparkSession)}/ids-{uuid.uuid4().hex}"
    write_files(docs, tokenizer_path, end_id, path, id_col, text_col)
    return read_files(docs.sparkSession, path, id_col)
