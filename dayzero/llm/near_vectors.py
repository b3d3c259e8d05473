"""Near-duplicate vectors by an inverted multi-index.

The halves of the vectors get a codebook each, and the pairs of codewords form a grid of cells. A vector's home is the cell
of its nearest codewords. Each vector visits the cells nearest to it in the order of the sum of its distances to their
codewords, as many as are needed for the target recall, and is compared with the vectors that have their home there. That
number is measured when the codebooks are fitted: pairs exactly at the threshold are made from sampled vectors, and a pair
counts as found if one of the two visits the other's home. Closer pairs are found more often.

A cell (r, s) in the order of the two halves' distances can be among the first n only if r * s <= n, since all cells
before it in both orders come earlier; so a visit sorts about n log n sums, not the grid.

Vectors are dealt out by the first half's codeword, with a list of the second's, so a vector is sent to the few codewords
that it visits and not to each cell. Large codewords are cut into blocks that meet each other pair by pair. Each pair of
linked vectors is counted for both when it is seen from the one that visits, unless the other visits back and counts it by
itself; a block sends counts and a spanning forest of its links, never its pairs. Equal vectors are one class from the
start.

Vectors that are null or zero, or hold null or non-finite components, link with nothing and are kept. A vector shorter
than the longest one counts as filled up with zeros. Rows that share an id are one node of the components; n_links counts
rows. Rows without an id have no links and no component and are kept. An empty table gives an empty result. Only the id and
vector columns are read, so other columns may have any names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dayzero.llm.common import written
from dayzero.llm.components import components

#: Vectors that the codebooks are fitted to, and pairs that the visits are measured on.
SAMPLE, PAIRS = 16_384, 2_000
RECALL = 0.998
ROWS_PER_CELL = 16
MAX_WORDS = 512
ROUNDS = 12
BLOCK_HOMES, BLOCK_VISITORS = 4_096, 16_384
#: Vectors compared with a cell at one time.
PIECE = 1_024


def _unit(rows: np.ndarray) -> np.ndarray:
    rows = rows.astype(np.float64)
    # Scaled first, so that neither large nor small components overflow or vanish.
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _distances(rows: np.ndarray, words: np.ndarray) -> np.ndarray:
    return (rows * rows).sum(1)[:, None] - 2 * rows @ words.T + (words * words).sum(1)[None, :]


class Grid:
    """Two codebooks and the number of cells that a vector visits."""

    def __init__(self, first: np.ndarray, second: np.ndarray, visits: int):
        self.first, self.second, self.n_visits = first, second, visits

    def sides(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        half = self.first.shape[1]
        return _distances(units[:, :half], self.first), _distances(units[:, half:], self.second)

    def visits(self, units: np.ndarray, n: int | None = None) -> np.ndarray:
        """Codes of the nearest n cells of each vector, the nearest first; a code is first * words + second."""
        n = min(n or self.n_visits, len(self.first) * len(self.second))
        a, b = self.sides(units)
        by_a, by_b = np.argsort(a, axis=1, kind="stable"), np.argsort(b, axis=1, kind="stable")
        r, s = zip(
            *[(i, j) for i in range(a.shape[1]) for j in range(min(b.shape[1], n // (i + 1)))], strict=True
        )
        i, j = by_a[:, r], by_b[:, s]
        sums = np.take_along_axis(a, i, 1) + np.take_along_axis(b, j, 1)
        order = np.argsort(sums, axis=1, kind="stable")[:, :n]
        codes = i * len(self.second) + j
        return np.take_along_axis(codes, order, 1).astype(np.int32)


def _codebook(rows: np.ndarray, n_words: int) -> np.ndarray:
    """Plain k-means from evenly spread starting rows."""
    words = rows[np.linspace(0, len(rows) - 1, n_words).astype(int)].copy()
    for _ in range(ROUNDS):
        nearest = _distances(rows, words).argmin(axis=1)
        sums = np.zeros_like(words)
        np.add.at(sums, nearest, rows)
        counts = np.bincount(nearest, minlength=n_words)
        words[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return words


def fit_grid(units: np.ndarray, n_words: int, threshold: float, recall: float) -> Grid:
    half = units.shape[1] // 2
    n_words = min(n_words, len(units))
    grid = Grid(_codebook(units[:, :half], n_words), _codebook(units[:, half:], n_words), 1)
    one = units[np.linspace(0, len(units) - 1, PAIRS).astype(int)]
    noise = np.random.default_rng(3).normal(size=one.shape)
    noise -= (noise * one).sum(1, keepdims=True) * one
    noise /= np.maximum(np.sqrt((noise * noise).sum(1, keepdims=True)), 1e-12)
    two = threshold * one + math.sqrt(1 - threshold * threshold) * noise

    def place(rows: np.ndarray, homes: np.ndarray) -> np.ndarray:
        """How many cells lie nearer to each row than the given one."""
        a, b = grid.sides(rows)
        at = np.arange(len(rows))
        own = a[at, homes // n_words] + b[at, homes % n_words]
        b = np.sort(b, axis=1)
        return sum((b < (own - a[:, i])[:, None]).sum(axis=1) for i in range(n_words))

    found = np.minimum(place(one, grid.visits(two, 1)[:, 0]), place(two, grid.visits(one, 1)[:, 0]))
    grid.n_visits = int(np.quantile(found, recall, method="higher")) + 1
    return grid


def _read(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, type, int]:
    """id, vector (bytes; null if it links with nothing) and a fingerprint of every row; type and length of the bytes."""
    kind = vectors.schema[vector_col].dataType.elementType.simpleString()
    dtype = np.float32 if kind == "float" else np.float64
    own = F.col(vector_col).cast("array<float>" if kind == "float" else "array<double>")
    longest = vectors.agg(F.max(F.size(vector_col))).first()[0] or 0
    width = max(2, longest + longest % 2)
    id_type = vectors.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[bytes | None] = []
            for value in batch.column(1):
                row = np.zeros(width, dtype)
                values = value.values
                good = values is not None and values.null_count == 0
                if good:
                    row[: len(values)] = values.to_numpy(zero_copy_only=False)
                    good = bool(np.isfinite(row).all() and row.any())
                out.append(row.tobytes() if good else None)
            prints = [xxhash.xxh3_128_intdigest(v) if v else 0 for v in out]
            halves = np.array([[p >> 64, p & (1 << 64) - 1] for p in prints], np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(out, pa.binary()),
                    pa.array(np.ascontiguousarray(halves[:, 0])),
                    pa.array(np.ascontiguousarray(halves[:, 1])),
                ],
                names=["id", "vector", "fp1", "fp2"],
            )

    rows = vectors.select(F.col(id_col).alias("id"), own.alias("own")).mapInArrow(
        run, f"id {id_type}, vector binary, fp1 long, fp2 long"
    )
    return rows, dtype, width


def _matrix(values, dtype, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(values), dtype).reshape(-1, width)


def _fit(classes: DataFrame, n: int, dtype, width: int, threshold: float, recall: float) -> Grid:
    words = 2 ** round(math.log2(max(1.0, math.sqrt(n / ROWS_PER_CELL))))
    words = min(MAX_WORDS, words)
    share = int(min(1.0, SAMPLE / n) * (1 << 30))

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        grid = fit_grid(_unit(_matrix(rows.sort_values("id")["vector"], dtype, width)), words, threshold, recall)
        return pd.DataFrame(
            {"first": [grid.first.tobytes()], "second": [grid.second.tobytes()], "visits": [grid.n_visits]}
        )

    sample = classes.where(F.pmod(F.xxhash64("id", F.lit(9)), F.lit(1 << 30)) < share).select("id", "vector")
    if sample.isEmpty():
        sample = classes.select("id", "vector").orderBy("id").limit(1)
    fitted = sample.groupBy().applyInPandas(fit, "first binary, second binary, visits int").first()
    half = width // 2
    books = [np.frombuffer(fitted[side]).reshape(-1, half) for side in ("first", "second")]
    return Grid(*books, fitted["visits"])


def _with_cells(classes: DataFrame, grid: Grid, dtype, width: int) -> DataFrame:
    """classes with the codes of the cells that each visits, its home first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            units = _unit(_matrix(batch.column(2).to_pylist(), dtype, width))
            cells = np.concatenate([grid.visits(units[i : i + PIECE]) for i in range(0, len(units), PIECE)])
            offsets = pa.array(np.arange(len(cells) + 1, dtype=np.int32) * cells.shape[1])
            visits = pa.ListArray.from_arrays(offsets, pa.array(cells.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*batch.columns, visits], names=["id", "n", "vector", "visits"])

    return classes.select("id", "n", "vector").mapInArrow(run, "id long, n long, vector binary, visits array<int>")


def bipartite_forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """(row, column) links that connect what a boolean matrix connects."""
    rows_left, columns_left = linked.any(axis=1), linked.any(axis=0)
    out = []
    for start in np.flatnonzero(rows_left):
        if not rows_left[start]:
            continue
        rows_left[start] = False
        front = [(True, int(start))]
        while front:
            is_row, at = front.pop()
            left = columns_left if is_row else rows_left
            new = np.flatnonzero((linked[at] if is_row else linked[:, at]) & left)
            left[new] = False
            out += [(at, int(k)) if is_row else (int(k), at) for k in new]
            front += [(not is_row, int(k)) for k in new]
    return out


def _compare(dtype, width: int, threshold: float):
    """Counts (a, null, n_links) and spanning links (a, b, null) of one block of homes and one of visitors."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        homes, visitors = rows[rows["is_home"]], rows[~rows["is_home"]]
        out_a, out_b, out_n = [], [], []
        if len(homes) and len(visitors):
            h_ids, v_ids = homes["id"].to_numpy(), visitors["id"].to_numpy()
            h_n, v_n = homes["n"].to_numpy(), visitors["n"].to_numpy()
            h_units = _unit(_matrix(homes["vector"], dtype, width))
            v_units = _unit(_matrix(visitors["vector"], dtype, width))
            h_visits, h_home = np.stack(homes["cells"].to_numpy()), homes["home"].to_numpy()
            v_home, lists = visitors["home"].to_numpy(), visitors["cells"].to_numpy()
            v_at = np.repeat(np.arange(len(visitors)), [len(x) for x in lists])
            v_cell = np.concatenate(lists)
            order = np.argsort(v_cell, kind="stable")
            v_at, v_cell = v_at[order], v_cell[order]
            h_links, v_links = np.zeros(len(homes), np.int64), np.zeros(len(visitors), np.int64)
            for cell in np.unique(h_home):
                own = np.flatnonzero(h_home == cell)
                low, high = np.searchsorted(v_cell, [cell, cell + 1])
                for start in range(low, high, PIECE):
                    guests = v_at[start : min(start + PIECE, high)]
                    linked = v_units[guests] @ h_units[own].T >= threshold
                    linked &= v_ids[guests][:, None] != h_ids[own][None, :]
                    i, j = np.nonzero(linked)
                    if not len(i):
                        continue
                    np.add.at(v_links, guests[i], h_n[own[j]])
                    back = (h_visits[own[j]] == v_home[guests[i]][:, None]).any(axis=1)
                    np.add.at(h_links, own[j[~back]], v_n[guests[i[~back]]])
                    for r, c in bipartite_forest(linked):
                        out_a.append(v_ids[guests[r]])
                        out_b.append(h_ids[own[c]])
                        out_n.append(None)
            for ids, links in ((h_ids, h_links), (v_ids, v_links)):
                some = links > 0
                out_a += ids[some].tolist()
                out_b += [None] * int(some.sum())
                out_n += links[some].tolist()
        return pd.DataFrame(
            {
                "a": pd.array(out_a, "Int64"),
                "b": pd.array(out_b, "Int64"),
                "n_links": pd.array(out_n, "Int64"),
            }
        )

    return run


def _links(classes: DataFrame, grid: Grid, dtype, width: int, threshold: float) -> DataFrame:
    """Counts and spanning links, as _compare gives them."""
    words = len(grid.second)
    cells = written(_with_cells(classes, grid, dtype, width), "vector-cells")

    def word(code: Column) -> Column:
        return F.floor(code / words).cast("int")

    home = F.get("visits", F.lit(0))
    homes = cells.select(
        word(home).alias("word"), "id", "n", "vector", home.alias("home"), F.col("visits").alias("cells"), F.lit(True).alias("is_home")
    )
    visitors = cells.withColumn("word", F.explode(F.array_distinct(F.transform("visits", word)))).select(
        "word",
        "id",
        "n",
        "vector",
        home.alias("home"),
        F.filter("visits", lambda c: word(c) == F.col("word")).alias("cells"),
        F.lit(False).alias("is_home"),
    )
    blocks = homes.groupBy("word").agg(F.ceil(F.count("*") / BLOCK_HOMES).alias("home_blocks")).join(
        visitors.groupBy("word").agg(F.ceil(F.count("*") / BLOCK_VISITORS).alias("visitor_blocks")), "word"
    )

    def placed(rows: DataFrame, own: str, other: str) -> DataFrame:
        # One row per codeword of the first half, at most MAX_WORDS.
        rows = rows.join(F.broadcast(blocks), "word")
        rows = rows.withColumn(f"{own}_block", F.pmod(F.xxhash64("id"), F.col(f"{own}_blocks")))
        rows = rows.withColumn(f"{other}_block", F.explode(F.sequence(F.lit(0), F.col(f"{other}_blocks") - 1)))
        numbers = [F.col(c).cast("long").alias(c) for c in ("home_block", "visitor_block")]
        return rows.select("word", *numbers, "id", "n", "vector", "home", "cells", "is_home")

    both = placed(homes, "home", "visitor").unionByName(placed(visitors, "visitor", "home"))
    return both.groupBy("word", "home_block", "visitor_block").applyInPandas(
        _compare(dtype, width, threshold), "a long, b long, n_links long"
    )


def near_vectors(
    vectors: DataFrame,
    threshold: float = 0.95,
    recall: float = RECALL,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """id, n_links, component_id and kept of every row; vectors link at a cosine of `threshold` or more.

    Ids are whole numbers.
    """
    rows, dtype, width = _read(vectors, id_col, vector_col)
    rows = written(rows, "vector-rows")
    good = rows.where("vector is not null and id is not null")
    classes = good.groupBy("fp1", "fp2").agg(F.min("id").cast("long").alias("id"), F.count("*").alias("n"), F.first("vector").alias("vector"))
    classes = written(classes, "vector-classes")
    n = classes.count()
    members = rows.select("id", "fp1", "fp2", F.col("vector").isNotNull().alias("good")).join(
        classes.select(F.col("fp1").alias("c1"), F.col("fp2").alias("c2"), F.col("id").alias("least"), "n"),
        F.col("good") & F.col("id").isNotNull() & (F.col("fp1") == F.col("c1")) & (F.col("fp2") == F.col("c2")),
        "left",
    )
    members = written(members.select("id", "least", "n", "fp1", "fp2"), "vector-members")
    if n:
        found = written(_links(classes, _fit(classes, n, dtype, width, threshold, recall), dtype, width, threshold), "vector-links")
    else:
        found = vectors.sparkSession.createDataFrame([], "a long, b long, n_links long")
    tied = members.where("least is not null").groupBy("id").agg(F.min("least").alias("a"), F.max("least").alias("b")).where("a <> b")
    grouped = components(found.where("b is not null").select("a", "b").unionByName(tied.select("a", "b")))
    counts = found.where("b is null").groupBy(F.col("a").alias("n_id")).agg(F.sum("n_links").alias("n_links"))
    joined = (
        members.join(counts, F.col("least") == F.col("n_id"), "left")
        .join(grouped.select(F.col("node").alias("g_id"), F.col("component").alias("g_component")), F.col("least") == F.col("g_id"), "left")
    )
    component = F.when(F.col("id").isNotNull(), F.coalesce("g_component", "least", F.col("id").cast("long")))
    return joined.select(
        F.col("id").alias(id_col),
        (F.coalesce("n_links", F.lit(0)) + F.coalesce(F.col("n") - 1, F.lit(0))).alias("n_links"),
        component.alias("component_id"),
        F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"),
    )
