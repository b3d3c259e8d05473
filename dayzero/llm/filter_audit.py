"""What each filter of a chain removes, in every order of the filters.

A document fails a set of filters, its mask. What happens to it in any order follows from the mask alone: the first
filter of the order that it fails removes it. So every mask stands for one wide integer with a field per order and step
(600 fields for five filters) that holds a 1 where the document is removed. Tasks add these integers up per part of the
table, once for all documents, once for the good and once for the toxic ones; sums are added in two steps and their
fields are read at the end. A field has 64 bits, so counts up to 2**63 cannot reach the next one. The other figures
follow from these and from the number of documents per mask.

The fifth filter, E, needs the smallest id of each text. Rows are first counted per id and text, then folded per text,
part, mask and labels before they meet at the text's digest, so a text of a third of all rows is a few rows by then.

Null text counts as empty, null part as the empty string. Rows without an id are never copies and make none; they have no
labels. Repeated rows each count; all rows of a text's smallest id are originals. A document is good or toxic if any of its
labels says so. An empty table gives an empty result. Only the named columns are read, so others may have any names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from itertools import permutations
from math import factorial

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dayzero.llm.common import written

FILTERS = "ABCDE"
#: Fixed limits of the filters.
FEW_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT = 200, 50, 3
SYMBOLS, CAPITALS = b"#$%&*|", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
INSIDE_CHARACTERS = bytes(range(0x80, 0xC0))
FIELD_BITS = 64
FIELD = (1 << FIELD_BITS) - 1
#: Texts beyond this many bytes are cut into words step by step.
LONG_TEXT = 1 << 22
#: Parts whose sums a task holds at a time.
PARTS_HELD = 500
#: Groups of tasks whose sums are added up before those of a part meet.
MEETING_POINTS = 256


def _words(text: bytes) -> Iterator[list[bytes]]:
    """Words of a text in lists of a bounded size; bytes.split() parts at 0x20 and 0x09 to 0x0D, as is wanted."""
    at = 0
    while len(text) - at > LONG_TEXT:
        end = at + LONG_TEXT
        while end < len(text) and not text[end : end + 1].isspace():
            end += 1
        yield text[at:end].split()
        at = end
    yield text[at:].split() if at else text.split()


def text_mask(text: bytes) -> int:
    """Bits 0 to 3: does the text fail A, B, C, D?"""
    n, distinct = 0, set()
    for words in _words(text):
        n += len(words)
        distinct.update(words)
    characters = len(text.translate(None, INSIDE_CHARACTERS))
    capitals = len(text) - len(text.translate(None, CAPITALS))
    return (
        (n < FEW_WORDS)
        | (100 * len(distinct) < DISTINCT_PERCENT * n) << 1
        | (100 * capitals > CAPITAL_PERCENT * characters) << 2
        | (len(text.translate(None, SYMBOLS)) < len(text)) << 3
    )


def text_masks(docs: DataFrame, id_col: str = "doc_id", part_col: str = "lang", text_col: str = "text") -> DataFrame:
    """id, part, mask of the filters that see a text alone, and a 128-bit digest of the text, for every row."""
    read = docs.select(
        F.col(id_col).cast("long").alias("id"),
        F.coalesce(F.col(part_col), F.lit("")).alias("part"),
        F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            masks, digests = [], []
            for text in batch.column(2):
                own = text.as_py()
                masks.append(text_mask(own))
                digests.append(hashlib.blake2b(own, digest_size=16).digest())
            columns = [batch.column(0), batch.column(1), pa.array(masks, pa.int32()), pa.array(digests, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "part", "mask", "digest"])

    return read.mapInArrow(run, "id long, part string, mask int, digest binary")


def mask_counts(masked: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """part, mask, good, toxic, n: rows are many, one per text at least, and add up to the documents.

    ``masked`` has the rows of text_masks; the mask returned has the bit of E as well.
    """
    flags = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("l_id"))
    flags = flags.agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"),
        F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"),
    )
    # From a stored table, so that adaptive execution can split an id with very many rows.
    flags = written(flags.where("good OR toxic"), "labels")
    rows = masked.groupBy("id", "digest", "part", "mask").agg(F.count("*").alias("n"))
    rows = rows.join(flags, F.col("id") == F.col("l_id"), "left")
    rows = rows.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    texts = rows.groupBy("digest", "part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"),
        F.min(F.when(F.col("id").isNotNull(), F.struct("id", "n"))).alias("first"),
        F.coalesce(F.sum(F.when(F.col("id").isNull(), F.col("n"))), F.lit(0)).alias("n_without_id"),
    )
    # At most one row per part and labels meets at a digest here. Rows of one id may have different parts.
    smallest = F.min("first.id").over(Window.partitionBy("digest"))
    own = F.when(F.col("first.id") == smallest, F.col("first.n")).otherwise(F.lit(0))
    texts = texts.withColumn("originals", F.col("n_without_id") + F.coalesce(own, F.lit(0)))
    copies = F.struct((F.col("mask") + F.lit(1 << 4)).alias("mask"), (F.col("n") - F.col("originals")).alias("n"))
    both = F.explode(F.array(F.struct("mask", F.col("originals").alias("n")), copies)).alias("own")
    return texts.select("part", "good", "toxic", both).select("part", "own.mask", "good", "toxic", "own.n").where("n > 0")


def outcomes(filters: str) -> list[int]:
    """For each mask the wide integer with a 1 in the field of every order and step that removes its documents."""
    wide = []
    for mask in range(1 << len(filters)):
        own = 0
        for nth, order in enumerate(permutations(range(len(filters)))):
            step = next((s for s, f in enumerate(order) if mask >> f & 1), None)
            if step is not None:
                own |= 1 << FIELD_BITS * (nth * len(filters) + step)
        wide.append(own)
    return wide


def fields(wide: int, n: int) -> list[int]:
    """The first n fields of a wide integer."""
    read = wide.to_bytes(n * FIELD_BITS // 8, "little")
    width = FIELD_BITS // 8
    return [int.from_bytes(read[i : i + width], "little") for i in range(0, len(read), width)]


class Sums:
    """Wide sums of one part: removals of all, good and toxic documents, and documents per mask."""

    NAMES = ("removed", "good", "toxic", "masks")

    def __init__(self, wide: Sequence[int] = (0, 0, 0, 0)):
        self.wide = list(wide)

    def add(self, other: Sequence[int]) -> None:
        self.wide = [a + b for a, b in zip(self.wide, other, strict=True)]

    @staticmethod
    def packed(wide: int) -> bytes:
        return wide.to_bytes((wide.bit_length() + 7) // 8 or 1, "little")

    def row(self) -> dict[str, bytes]:
        return {name: self.packed(w) for name, w in zip(self.NAMES, self.wide, strict=True)}

    @classmethod
    def of_rows(cls, rows: pd.DataFrame) -> Sums:
        out = cls()
        for row in rows[list(cls.NAMES)].itertuples(index=False):
            out.add([int.from_bytes(w, "little") for w in row])
        return out


def part_rows(part: str, sums: Sums, filters: str) -> pd.DataFrame:
    """All orders and steps of a part."""
    k = len(filters)
    n = factorial(k) * k
    removed, good, toxic = (fields(w, n) for w in sums.wide[:3])
    per_mask = fields(sums.wide[3], 1 << k)
    fails = [sum(c for m, c in enumerate(per_mask) if m >> f & 1) for f in range(k)]
    alone = [per_mask[1 << f] for f in range(k)]
    orders = list(permutations(range(k)))
    shapley = [0] * k
    for at, count in enumerate(removed):
        shapley[orders[at // k][at % k]] += count
    out = []
    for nth, order in enumerate(orders):
        kept = sum(per_mask)
        name = "".join(filters[f] for f in order)
        for step, f in enumerate(order):
            at = nth * k + step
            kept -= removed[at]
            lost = (good[at], toxic[at], shapley[f])
            out.append((part, name, step + 1, kept, removed[at], fails[f] - removed[at], alone[f], *lost))
    names = "part filter_order step kept removed redundant unique_fails good_lost toxic_lost shapley"
    return pd.DataFrame(out, columns=names.split())


RESULT = (
    "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
    "good_lost long, toxic_lost long, shapley long"
)


def order_audit(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """Per part, order of the filters and step what is kept, removed, redundant and lost.

    ``counts`` has part, mask, good, toxic and n, in any number of rows; bit i of a mask says that filter i fails.
    """
    packed = "part string, " + ", ".join(f"{name} binary" for name in Sums.NAMES)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide, held = outcomes(filters), {}
        task = TaskContext.get().partitionId() % MEETING_POINTS

        def sent() -> pa.RecordBatch:
            rows = [{"part": part, "point": task, **sums.row()} for part, sums in held.items()]
            return pa.RecordBatch.from_pylist(rows, schema=schema)

        schema = pa.schema([("part", pa.string()), ("point", pa.int32()), *[(n, pa.binary()) for n in Sums.NAMES]])
        for batch in batches:
            for row in batch.to_pylist():
                own = wide[row["mask"]] * row["n"]
                count = row["n"] << FIELD_BITS * row["mask"]
                held.setdefault(row["part"], Sums()).add((own, own * row["good"], own * row["toxic"], count))
                if len(held) >= PARTS_HELD:
                    yield sent()
                    held.clear()
        if held:
            yield sent()

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([{"part": rows["part"].iloc[0], **Sums.of_rows(rows).row()}])

    def unpack(rows: pd.DataFrame) -> pd.DataFrame:
        return part_rows(rows["part"].iloc[0], Sums.of_rows(rows), filters)

    counts = counts.select("part", "mask", "good", "toxic", "n")
    sums = counts.mapInArrow(add_up, packed.replace("part string", "part string, point int"))
    return sums.groupBy("part", "point").applyInPandas(meet, packed).groupBy("part").applyInPandas(unpack, RESULT)


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of filters A to E over all documents, by language."""
    return order_audit(mask_counts(text_masks(docs), labels))


AUDIT_SQL = r"""
WITH texts AS (
    SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
           regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
           min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first_id
    FROM documents
), flags AS (
    SELECT doc_id AS l_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), judged AS (
    SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
           concat(CASE WHEN len(w) < 200 THEN 'A' ELSE '' END,
                  CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END,
                  CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t) THEN 'C' ELSE '' END,
                  CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END,
                  CASE WHEN doc_id > first_id THEN 'E' ELSE '' END) AS failed
    FROM texts LEFT JOIN flags ON doc_id = l_id
), masks AS (
    SELECT part, failed, count(*) AS n, count(*) FILTER (good) AS n_good, count(*) FILTER (toxic) AS n_toxic
    FROM judged GROUP BY part, failed
), letters(l) AS (
    VALUES ('A'), ('B'), ('C'), ('D'), ('E')
), orders AS (
    SELECT concat(a.l, b.l, c.l, d.l, e.l) AS filter_order
    FROM letters a JOIN letters b ON b.l <> a.l JOIN letters c ON c.l NOT IN (a.l, b.l)
    JOIN letters d ON d.l NOT IN (a.l, b.l, c.l) JOIN letters e ON e.l NOT IN (a.l, b.l, c.l, d.l)
), steps AS (
    SELECT filter_order, s.step::INTEGER AS step, substr(filter_order, s.step, 1) AS own,
           substr(filter_order, 1, s.step - 1) AS earlier
    FROM orders, (SELECT unnest(range(1, 6)) AS step) s
), met AS (
    SELECT part, filter_order, step, own, n, n_good, n_toxic, failed,
           contains(failed, own) AS fails,
           len(failed) > len(translate(failed, earlier, '')) AS gone
    FROM masks, steps
), counted AS (
    SELECT part, filter_order, step, own,
           coalesce(sum(n) FILTER (NOT gone AND NOT fails), 0)::BIGINT AS kept,
           coalesce(sum(n) FILTER (NOT gone AND fails), 0)::BIGINT AS removed,
           coalesce(sum(n) FILTER (gone AND fails), 0)::BIGINT AS redundant,
           coalesce(sum(n) FILTER (failed = own), 0)::BIGINT AS unique_fails,
           coalesce(sum(n_good) FILTER (NOT gone AND fails), 0)::BIGINT AS good_lost,
           coalesce(sum(n_toxic) FILTER (NOT gone AND fails), 0)::BIGINT AS toxic_lost
    FROM met GROUP BY part, filter_order, step, own
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM counted
"""
