"""Near-duplicate texts by b-bit MinHash and a multi-index Hamming join, confirmed on whole shingle sets.

Each text becomes the set of its distinct word shingles, and the set a signature of SYMBOLS numbers of 16 bits, each from
the smallest shingle under one hash function. Two sets of similarity s differ in a binomial number of symbols; the largest
distance that pairs at the threshold exceed once in 1 / MISSED is the signature distance to search. The signature is cut
into so many chunks that, by the pigeonhole principle, every pair within that distance has a chunk with at most one
error. Each chunk is looked up with each of its positions left out, which finds all pairs with at most one error there.

Texts with equal sets are one class from the start. Buckets with the same members are looked at once. Inside a bucket the
signatures are compared, and the links of at most the distance go on as a spanning forest, so no bucket emits its pairs.

The families that these links form are confirmed on their whole sets, as 64-bit hashes of all shingles. First every text
is compared with the smallest one that its signature is near to, which sends each text about once; mostly that holds a
family together. Of the other families all texts are compared, block against block where a family is large, and only a
spanning forest of the confirmed links leaves a block. One text stands for each id and set, however many rows repeat it.
Stars, blocks and buckets are bounded per task; a bucket beyond BUCKET_ROWS is cut into blocks that meet pair by pair.

Null or empty texts, and texts without words, have empty sets, link with nothing and are kept. A text with fewer words
than a shingle has one shingle of all its words. Rows that share an id are one document, linked to whatever one of them
links to. Rows without an id link with nothing, have no component and are kept. An empty table gives an empty result. Only
the id and text columns are read, so other columns may have any names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dayzero.llm.common import written
from dayzero.llm.components import components

SYMBOLS = 64
SYMBOL_BITS = 16
PER_LONG = 64 // SYMBOL_BITS
LONGS = [f"s{i}" for i in range(SYMBOLS // PER_LONG)]
#: Share of pairs at the threshold whose signatures may lie beyond the searched distance.
MISSED = 1e-4
#: Errors allowed in a chunk.
ERRORS = 1
#: Shingles hashed at one time.
PIECE = 1 << 15
BUCKET_ROWS = 20_000
#: Texts that are compared with the middle of their star in one task.
STAR_TEXTS = 256
BLOCK_TEXTS = 384
BLOCK_SHINGLES = 200_000
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A one-to-one scramble of 64-bit numbers (splitmix64)."""
    x = (x + np.uint64(salt)) * GOLDEN
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles. bytes.lower and split know ASCII only, as wanted."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    if len(words) < width:
        width = len(words)
    out = mixed(hashes[: len(words) - width + 1], width)
    for i in range(1, width):
        out = mixed(out ^ hashes[i : len(words) - width + 1 + i], i)
    return np.unique(out)


@lru_cache(maxsize=1)
def _functions() -> tuple[np.ndarray, np.ndarray]:
    numbers = mixed(np.arange(1, 2 * SYMBOLS + 1, dtype=np.uint64), 77)
    return numbers[:SYMBOLS, None], numbers[SYMBOLS:, None] | np.uint64(1)


def signature(shingles: np.ndarray) -> np.ndarray:
    """SYMBOLS numbers of SYMBOL_BITS bits, packed into longs."""
    salt, factor = _functions()
    least = np.full(SYMBOLS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), PIECE):
        least = np.minimum(least, ((shingles[None, i : i + PIECE] ^ salt) * factor).min(axis=1))
    symbols = mixed(least) >> np.uint64(64 - SYMBOL_BITS)
    return np.ascontiguousarray(symbols.astype(np.uint16)).view(np.int64)


def search_distance(similarity: float, missed: float = MISSED) -> int:
    """The least distance that signatures of sets of this similarity exceed with at most this chance."""
    p = (1 - similarity) * (1 - 2.0**-SYMBOL_BITS)
    beyond, d = 1.0, -1
    while beyond > missed:
        d += 1
        beyond -= math.comb(SYMBOLS, d) * p**d * (1 - p) ** (SYMBOLS - d)
    return d


def chunk_keys(distance: int, errors: int = ERRORS) -> list[list[int]]:
    """Positions that make up each key: a chunk's positions without each choice of `errors` of them."""
    n_chunks = distance // (errors + 1) + 1
    bounds = [round(i * SYMBOLS / n_chunks) for i in range(n_chunks + 1)]
    keys = []
    for low, high in zip(bounds, bounds[1:], strict=False):
        chunk = range(low, high)
        out = min(errors, len(chunk) - 1)
        keys += [[p for p in chunk if p not in left_out] for left_out in combinations(chunk, out)]
    return keys


def _key_columns(keys: list[list[int]]) -> list[Column]:
    ones = (1 << SYMBOL_BITS) - 1
    columns = []
    for number, positions in enumerate(keys):
        masks: dict[int, int] = {}
        for p in positions:
            masks[p // PER_LONG] = masks.get(p // PER_LONG, 0) | ones << SYMBOL_BITS * (p % PER_LONG)
        signed = {i: m - (1 << 64) if m >> 63 else m for i, m in masks.items()}
        columns.append(F.xxhash64(F.lit(number), *[F.col(LONGS[i]).bitwiseAND(F.lit(m)) for i, m in signed.items()]))
    return columns


def _signed(docs: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """id, tie (a hash of the text), n_shingles, two fingerprints of the set and the signature of every row."""
    id_type = docs.schema[id_col].dataType.simpleString()
    fields = ["n_shingles", "fp1", "fp2", *LONGS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = np.zeros((batch.num_rows, len(fields)), np.int64)
            for row, text in enumerate(batch.column(1)):
                found = shingle_set(text.as_py(), width)
                if len(found):
                    sums = [mixed(found, salt).sum(dtype=np.uint64) for salt in (11, 13)]
                    numbers[row, :3] = [len(found), *np.array(sums, np.uint64).view(np.int64)]
                    numbers[row, 3:] = signature(found)
            columns = [pa.array(np.ascontiguousarray(numbers[:, i])) for i in range(len(fields))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *columns], names=["id", "tie", *fields])

    read = _tied(docs, id_col, text_col)
    return read.mapInArrow(run, ", ".join([f"id {id_type}", "tie long", *[f"{f} long" for f in fields]]))


def _tied(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("tie"))


def forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Links of a spanning forest of a symmetric boolean matrix."""
    todo = np.ones(len(linked), bool)
    out = []
    for root in range(len(linked)):
        if not todo[root]:
            continue
        todo[root] = False
        front = [root]
        while front:
            at = front.pop()
            new = np.flatnonzero(linked[at] & todo)
            todo[new] = False
            out += [(at, int(n)) for n in new]
            front += new.tolist()
    return out


def _near(symbols: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Spanning forest of the rows whose signatures differ in at most `distance` symbols, searched breadth first."""
    left = np.arange(1, len(symbols))
    out, front = [], [0]
    while len(left):
        if not front:
            front, left = [int(left[0])], left[1:]
            continue
        at = front.pop()
        near = (symbols[left] != symbols[at]).sum(axis=1) <= distance
        out += [(at, int(n)) for n in left[near]]
        front += left[near].tolist()
        left = left[~near]
    return out


def _bucket_links(rows: DataFrame, distance: int) -> DataFrame:
    """Spanning links (a, b) of each bucket; rows (bucket, id, signature) come sorted by bucket in each partition."""

    def links(ids: np.ndarray, symbols: np.ndarray, starts: np.ndarray) -> pa.RecordBatch:
        a, b = [], []
        sizes = np.diff(starts)
        twos = starts[:-1][sizes == 2]
        if len(twos):
            near = (symbols[twos] != symbols[twos + 1]).sum(axis=1) <= distance
            a.append(ids[twos[near]])
            b.append(ids[twos[near] + 1])
        for start, size in zip(starts[:-1][sizes > 2], sizes[sizes > 2], strict=True):
            found = np.array(_near(symbols[start : start + size], distance), np.int64).reshape(-1, 2) + start
            a.append(ids[found[:, 0]])
            b.append(ids[found[:, 1]])
        one = np.concatenate(a) if a else np.empty(0, np.int64)
        two = np.concatenate(b) if b else np.empty(0, np.int64)
        pairs = np.unique(np.stack([np.minimum(one, two), np.maximum(one, two)], axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns)]
            table = np.stack(columns, axis=1)
            table = table if held is None else np.concatenate([held, table])
            # The last bucket may go on in the next batch.
            changes = np.flatnonzero((table[1:, :2] != table[:-1, :2]).any(axis=1)) + 1
            if len(changes):
                starts = np.concatenate([[0], changes])
                done = table[: changes[-1]]
                yield links(done[:, 2], np.ascontiguousarray(done[:, 3:]).view(np.uint16), starts)
                held = table[changes[-1] :]
            else:
                held = table
        if held is not None:
            yield links(held[:, 2], np.ascontiguousarray(held[:, 3:]).view(np.uint16), np.array([0, len(held)]))

    return rows.mapInArrow(run, "a long, b long")


def _block_pairs(block: Column, n_blocks: Column) -> Column:
    """Codes of the pairs of blocks that a row of one block takes part in."""
    return F.transform(
        F.sequence(F.lit(0), n_blocks - 1),
        lambda other: F.least(block, other) * n_blocks + F.greatest(block, other),
    )


def candidate_links(classes: DataFrame, distance: int) -> DataFrame:
    """Links (a, b) that connect all classes with signatures of at most the distance."""
    keys = _key_columns(chunk_keys(distance))
    # Classes differ in their sets, so no two of them cancel each other here, whatever their ids are.
    marks = [F.xxhash64("fp1", "fp2", F.lit(i)).alias(f"m{i}") for i in (1, 2)]
    buckets = classes.select("id", *marks, F.explode(F.array(*keys)).alias("key"))
    shared = (
        buckets.groupBy("key")
        .agg(F.count("*").alias("n"), F.bit_xor("m1").alias("h1"), F.bit_xor("m2").alias("h2"))
        .where("n > 1")
    )
    # Buckets with the same members: one of them will do.
    chosen = written(shared.groupBy("n", "h1", "h2").agg(F.min("key").alias("k_key")).select("k_key", "n"), "near-buckets")
    n_blocks = F.ceil(F.col("n") / BUCKET_ROWS).cast("long")
    rows = (
        buckets.join(chosen, F.col("key") == F.col("k_key"))
        .withColumn("n_blocks", n_blocks)
        .withColumn("part", F.explode(_block_pairs(F.pmod(F.xxhash64("id"), F.col("n_blocks")), F.col("n_blocks"))))
        .select("key", "part", F.col("id").alias("b_id"))
    )
    rows = rows.join(classes.select("id", *LONGS), F.col("b_id") == F.col("id")).select("key", "part", "id", *LONGS)
    return _bucket_links(rows.repartition("key", "part").sortWithinPartitions("key", "part", "id"), distance)


def _confirm(width: int, percent: int):
    """Spanning forest of the confirmed links among the texts of one pair of blocks."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        ids = rows["id"].to_numpy()
        sets = [shingle_set(t, width) for t in rows["text"]]
        sizes = np.array([len(s) for s in sets])
        owner = np.repeat(np.arange(len(sets)), sizes)
        _, column, held = np.unique(np.concatenate([*sets, np.empty(0, np.uint64)]), return_inverse=True, return_counts=True)
        wanted = held[column] > 1
        owner, column = owner[wanted], column[wanted]
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        column = np.cumsum(np.concatenate([[0], column[1:] != column[:-1]])) if len(column) else column
        common = np.zeros((len(sets), len(sets)), np.float32)
        step = max(256, (1 << 22) // max(1, len(sets)))
        for low in range(0, int(column[-1]) + 1 if len(column) else 0, step):
            i, j = np.searchsorted(column, [low, low + step])
            held_by = np.zeros((len(sets), step), np.float32)
            held_by[owner[i:j], column[i:j] - low] = 1
            common += held_by @ held_by.T
        common = common.astype(np.int64)
        union = sizes[:, None] + sizes[None, :] - common
        found = forest((100 * common >= percent * union) & (union > 0))
        return pd.DataFrame({"a": [ids[i] for i, _ in found], "b": [ids[j] for _, j in found]}, columns=["a", "b"])

    return run


def _star(width: int, percent: int):
    """Links of the texts of one part of a star to the text, or texts, in its middle; one set at a time."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        middle = rows["id"].to_numpy() == rows["star"].to_numpy()
        centres = [shingle_set(t, width) for t in rows["text"][middle]]
        found = []
        for own, text in zip(rows["id"][~middle], rows["text"][~middle], strict=True):
            mine = shingle_set(text, width)
            for centre in centres:
                common = len(np.intersect1d(mine, centre, assume_unique=True))
                if common and 100 * common >= percent * (len(mine) + len(centre) - common):
                    found.append(own)
                    break
        return pd.DataFrame({"a": [rows["star"].iloc[0]] * len(found), "b": found}, columns=["a", "b"])

    return run


def family_texts(docs: DataFrame, classes: DataFrame, repeats: DataFrame, families: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id and text, one for each class in a family, written. A text that an id has in many rows is taken once."""
    placed = classes.join(families.select(F.col("id").alias("f_id")), F.col("id") == F.col("f_id"))
    placed = placed.join(repeats, (F.col("id") == F.col("r_id")) & (F.col("tie") == F.col("r_tie")), "left")
    placed = placed.select(F.col("id").alias("p_id"), F.col("tie").alias("p_tie"), F.col("r_id").isNotNull().alias("repeated"))
    placed = written(placed, "near-placed")
    texts = _tied(docs, id_col, text_col)
    same = (F.col("id") == F.col("p_id")) & (F.col("tie") == F.col("p_tie"))
    # The texts in families grow with the table, so their list is not to be broadcast at any size.
    once = texts.join(placed.where("not repeated").hint("merge"), same).select("id", "text")
    if repeats.isEmpty():
        return written(once, "near-texts")
    many = texts.join(placed.where("repeated"), same)
    # The key is negated so that the aggregate has an exchange of its own: each task sends a repeated text once.
    many = many.groupBy((-F.col("id")).alias("n_id"), "tie").agg(F.any_value("text").alias("text"))
    return written(once.unionByName(many.select((-F.col("n_id")).alias("id"), "text")), "near-texts")


def star_links(texts: DataFrame, candidates: DataFrame, width: int, percent: int) -> DataFrame:
    """Confirmed links (a, b) of every class to the smallest class that its signature is near to.

    Every text is sent once, and one that very many look at once more for each STAR_TEXTS of them.
    """
    stars = candidates.select(F.greatest("a", "b").alias("own"), F.least("a", "b").alias("star")).where("own <> star")
    stars = written(stars.groupBy("own").agg(F.min("star").alias("star")), "near-stars")
    sizes = stars.groupBy("star").agg(F.ceil(F.count("*") / STAR_TEXTS).cast("long").alias("parts"))
    sizes = written(sizes.select(F.col("star").alias("s_star"), "parts"), "near-stars")
    own = stars.join(sizes, F.col("star") == F.col("s_star")).select(
        "own", "star", F.pmod(F.xxhash64("own"), F.col("parts")).alias("part")
    )
    centre = sizes.select(
        F.col("s_star").alias("own"),
        F.col("s_star").alias("star"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"),
    )
    rows = texts.join(own.unionByName(centre).hint("merge"), F.col("id") == F.col("own"))
    return rows.select("star", "part", "id", "text").groupBy("star", "part").applyInPandas(
        _star(width, percent), "a long, b long"
    )


def block_links(texts: DataFrame, families: DataFrame, width: int, percent: int) -> DataFrame:
    """Confirmed links (a, b) among all texts of each family (id, n_shingles, family)."""
    sizes = families.groupBy("family").agg(F.count("*").alias("texts"), F.sum("n_shingles").alias("shingles"))
    n_blocks = F.greatest(F.ceil(F.col("texts") / BLOCK_TEXTS), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("long")
    sizes = sizes.select((-F.col("family")).alias("f_key"), F.least(n_blocks, F.col("texts")).alias("n_blocks"))
    placed = written(
        families.withColumn("f_key", -F.col("family"))
        .join(sizes, "f_key")
        .select(F.col("id").alias("p_id"), "family", "n_blocks", F.pmod(F.xxhash64("id"), F.col("n_blocks")).alias("block")),
        "near-families",
    )
    rows = texts.join(placed.hint("merge"), F.col("id") == F.col("p_id"))
    rows = rows.withColumn("part", F.explode(_block_pairs(F.col("block"), F.col("n_blocks"))))
    return rows.select("family", "part", "id", "text").groupBy("family", "part").applyInPandas(
        _confirm(width, percent), "a long, b long"
    )


def confirmed_links(texts: DataFrame, candidates: DataFrame, families: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) that connect what the similar whole sets of each family (id, n_shingles, family) connect.

    Stars are confirmed first. Families that these hold together need no more; only in the others all texts are compared.
    """
    links = written(star_links(texts, candidates, width, percent), "near-links")
    joined = components(links).select(F.col("node").alias("j_id"), F.col("component").alias("joined"))
    known = families.join(joined, F.col("id") == F.col("j_id"), "left")
    open_ones = known.groupBy("family").agg(F.min(F.coalesce("joined", "id")).alias("low"), F.max(F.coalesce("joined", "id")).alias("high"))
    open_ones = open_ones.where("low <> high").select((-F.col("family")).alias("o_key"))
    left = families.withColumn("o_key", -F.col("family")).join(open_ones, "o_key", "left_semi").drop("o_key")
    return links.unionByName(block_links(texts, written(left, "near-families"), width, percent))


def near_duplicates(
    docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """id, n_shingles, component_id and kept of every row; documents link at a similarity of percent / 100 or more.

    Ids are whole numbers.
    """
    signed = written(_signed(docs, width, id_col, text_col), "near-signatures")
    classes = (
        signed.where("n_shingles > 0 and id is not null")
        .groupBy("fp1", "fp2", "n_shingles")
        .agg(F.min(F.struct(F.col("id").cast("long").alias("id"), "tie")).alias("least"), *[F.max(c).alias(c) for c in LONGS])
    )
    classes = written(classes.select("fp1", "fp2", "n_shingles", "least.id", "least.tie", *LONGS), "near-classes")
    repeats = signed.where("n_shingles > 0").groupBy(F.col("id").cast("long").alias("r_id"), F.col("tie").alias("r_tie"))
    repeats = written(repeats.agg(F.count("*").alias("n")).where("n > 1").select("r_id", "r_tie"), "near-repeats")
    candidates = written(candidate_links(classes, search_distance(percent / 100)).distinct(), "near-candidates")
    families = components(candidates)
    families = families.select(F.col("node").alias("f_id"), F.col("component").alias("family"))
    sized = classes.groupBy("id").agg(F.sum("n_shingles").alias("n_shingles"))
    families = families.join(sized, F.col("f_id") == F.col("id")).select("id", "n_shingles", "family")
    families = written(families, "near-families")
    texts = family_texts(docs, classes, repeats, families, id_col, text_col)
    links = confirmed_links(texts, candidates, families, width, percent)
    members = written(
        signed.select("id", "n_shingles", "fp1", "fp2")
        .join(
            classes.select(F.col("fp1").alias("c1"), F.col("fp2").alias("c2"), F.col("n_shingles").alias("cn"), F.col("id").alias("least")),
            (F.col("fp1") == F.col("c1")) & (F.col("fp2") == F.col("c2")) & (F.col("n_shingles") == F.col("cn")),
            "left",
        )
        .select("id", "n_shingles", "least"),
        "near-members",
    )
    # Rows that share an id but not a set tie their sets together.
    tied = members.where("id is not null").groupBy("id").agg(F.min("least").alias("a"), F.max("least").alias("b")).where("a <> b")
    grouped = components(links.unionByName(tied.select("a", "b")))
    grouped = grouped.select(F.col("node").alias("g_id"), F.col("component").alias("g_component"))
    joined = members.join(grouped, F.col("least") == F.col("g_id"), "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("g_component", "least", F.col("id").cast("long")))
    return joined.select(
        F.col("id").alias(id_col),
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"),
    )
