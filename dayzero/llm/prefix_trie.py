"""The trie of the turns that conversations begin with, and what its nodes share.

Turns become 128-bit ids of their role and text. Rebuilt conversations are sorted by range into shards, hot ones split by
their ids, so that conversations with a common beginning lie side by side. A shard is one padded matrix of turn ids: a
lexsort orders its rows, masks of changed columns, OR-accumulated from left to right, mark where nodes start, and
reduceat sums every depth. Nodes inside a shard are complete. Those on the path of its first and its last row may go on
in the next shard; what the shard knows of them goes up as two rows with sums per depth, and these rows are sharded and
folded in the same way until one shard is left. A level has about a thousandth of the rows of the one below.

Conversations longer than the first of WIDTHS are cut into slabs of turns, each a matrix of its own under the digest of
the turns before. Slabs are folded from the last one on, and the sums of a slab's roots go to the rows above them, so
that no row holds more than the largest width. There are as many rounds as the longest conversation has slabs. Turns are
numbered per conversation and span of turn numbers, then moved by the number of turns in earlier spans, so a conversation
with very many turns is no single group (rows that all have one turn number are; they are sorted as a stream).

The ids of conversations that end at one node are hashed in ascending order, inside the shard where they are all there,
else from pieces that shards write; SHA-256 takes its bytes one after the other, so the pieces of one node are read as a
stream of about ten bytes a conversation by one task.

Null role and text count as empty; turns of equal number are ordered by role, then by digest; repeated rows are
turns of their own. Rows without a conv_id belong to no conversation and are left out. An empty table has no nodes, not
even a root. Only the four columns are read, so further ones may have any names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dayzero.llm.common import word_array, written

#: Turns of the slabs; the last width goes for all further ones.
WIDTHS = (64, 256, 1024, 4096, 16384)
#: Cells of a shard's matrix, and the fewest for which another shard is opened.
CELLS, FEW_CELLS = 1 << 20, 1 << 14
#: Turn numbers of a span, as a power of two.
SPAN_BITS = 10
SHARED_FROM, MOST_SHARED = 20, 4
NO_CONV = np.iinfo(np.int64).max
NO_ENDS = hashlib.sha256(b"").hexdigest()

SUMS = ("n", "least", "children", "leaves", "saved")
PATH = "key binary, conv_id long, ids array<binary>, words array<long>, ends boolean, " + ", ".join(f"{s} array<long>" for s in SUMS)
OUT = (
    "kind int, depth long, parent_conv_id long, parent_key binary, n_convs long, n_children long, n_leaves long, "
    "saved_tokens long, ends_sha256 string, payload binary, " + PATH
)
NODE, EDGE, PIECE = range(3)


# Rebuilding the conversations.


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1 on), digest and words of every turn."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        role.alias("role"),
        F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))).alias("digest"),
        F.size(word_array(text)).cast("long").alias("words"),
    )
    before_all = F.lit(-(1 << 63)).cast("long")
    turns = turns.withColumn("span", F.coalesce(F.shiftright("turn", SPAN_BITS), before_all))
    by_turn = Window.partitionBy("conv_id", "span").orderBy(F.asc_nulls_first("turn"), "role", "digest")
    turns = turns.withColumn("nth", F.row_number().over(by_turn).cast("long"))
    spans = turns.groupBy("conv_id", "span").agg(F.count("*").alias("n"))
    earlier = F.sum("n").over(Window.partitionBy("conv_id").orderBy("span")) - F.col("n")
    spans = spans.withColumn("earlier", earlier).where("earlier > 0").select("conv_id", "span", "earlier")
    placed = turns.join(spans, ["conv_id", "span"], "left")
    pos = F.col("nth") + F.coalesce("earlier", F.lit(0))
    return placed.select("conv_id", pos.alias("pos"), "digest", "words")


def rebuilt(turns: DataFrame, widths: Sequence[int] = WIDTHS) -> DataFrame:
    """conv_id, slab, total, ids, words: every conversation's turns, cut into slabs.

    A conversation has a row for each slab that it reaches, also where it ends right before the slab's first turn.
    """
    in_order = F.array_sort(F.collect_list(F.struct("pos", "digest", "words")))
    heads = turns.where((F.col("conv_id") % SHARED_FROM == 0) & (F.col("pos") < MOST_SHARED))
    heads = heads.groupBy(F.col("conv_id").alias("base_id")).agg(in_order.alias("head"))
    convs = turns.groupBy("conv_id").agg(F.count("*").alias("n")).select(
        "conv_id",
        "n",
        (F.col("conv_id") - F.col("conv_id") % SHARED_FROM).alias("base"),
        (F.crc32(F.col("conv_id").cast("string").cast("binary")) % MOST_SHARED).cast("int").alias("h"),
    )
    none = F.array().cast("array<struct<pos:bigint,digest:binary,words:bigint>>")
    convs = convs.join(heads, F.col("base") == F.col("base_id"), "left")
    head = F.slice(F.coalesce("head", none), F.lit(1), F.col("h"))
    convs = convs.select("conv_id", "n", "h", head.alias("head"))
    total = F.size("head") + F.greatest(F.col("n") - F.col("h"), F.lit(0))
    convs = written(convs.withColumn("total", total), "rebuilt")
    # Both sides are stored tables, so adaptive execution can split a conversation with very many turns.
    moved = convs.select("conv_id", "h", F.size("head").alias("n_head"), "total")
    own = turns.join(moved, "conv_id").where(F.col("pos") > F.col("h"))
    own = own.select("conv_id", "total", (F.col("pos") - F.col("h") + F.col("n_head")).alias("depth"), "digest", "words")
    given = convs.select("conv_id", "total", F.posexplode("head").alias("at", "turn"))
    given = given.select("conv_id", "total", (F.col("at") + F.lit(1).cast("long")).alias("depth"), "turn.digest", "turn.words")
    rows = own.unionByName(given).withColumn("slab", slab_of(F.col("depth") - 1, widths))
    rows = rows.groupBy("conv_id", "slab").agg(
        F.max("total").alias("total"), F.array_sort(F.collect_list(F.struct("depth", "digest", "words"))).alias("turns")
    )
    rows = rows.select("conv_id", "slab", "total", F.col("turns.digest").alias("ids"), F.col("turns.words").alias("words"))
    after = convs.select("conv_id", slab_of(F.col("total"), widths).alias("slab"), "total")
    after = after.where(F.col("total") == slab_start(F.col("slab"), widths)).withColumns(
        {"ids": F.array().cast("array<binary>"), "words": F.array().cast("array<bigint>")}
    )
    return rows.unionByName(after)


def slab_of(turn: Column, widths: Sequence[int]) -> Column:
    """The slab of a turn, counted from 0."""
    ends = list(accumulate(widths))
    slab = (turn - ends[-1]) / widths[-1]
    out = F.floor(slab).cast("int") + len(ends)
    for k, end in reversed(list(enumerate(ends))):
        out = F.when(turn < end, F.lit(k)).otherwise(out)
    return out


def slab_start(slab: Column, widths: Sequence[int]) -> Column:
    starts = [0, *accumulate(widths)]
    out = F.lit(starts[-1]) + (slab - len(widths)).cast("long") * widths[-1]
    for k, start in enumerate(starts[:-1]):
        out = F.when(slab == k, F.lit(start)).otherwise(out)
    return out


# Folding a shard.


@dataclass
class Shard:
    """Rows of one slab that lie side by side: paths of turn ids under a key, with sums for each depth of a path."""

    keys: np.ndarray
    convs: np.ndarray
    lengths: np.ndarray
    ids: list[bytes]
    words: np.ndarray
    ends: np.ndarray
    sums: dict[str, np.ndarray]

    @classmethod
    def read(cls, table: pa.Table) -> Shard:
        lists = table.column("ids").combine_chunks()
        lengths = np.asarray(pc.list_value_length(lists)).astype(np.int64)
        if table.column("n").null_count:
            return cls.of_conversations(table, lengths, lists)
        sums = {s: np.asarray(pc.list_flatten(table.column(s))).astype(np.int64) for s in SUMS}
        return cls(*cls.columns(table, lengths, lists), sums)

    @staticmethod
    def columns(table: pa.Table, lengths: np.ndarray, lists: pa.Array) -> tuple:
        return (
            np.array(table.column("key").to_pylist(), dtype=object),
            np.asarray(table.column("conv_id")).astype(np.int64),
            lengths,
            pc.list_flatten(lists).to_pylist(),
            np.asarray(pc.list_flatten(table.column("words"))).astype(np.int64),
            np.asarray(table.column("ends")).astype(bool),
        )

    @classmethod
    def of_conversations(cls, table: pa.Table, lengths: np.ndarray, lists: pa.Array) -> Shard:
        """A conversation counts one at each depth and brings the sums of the slab below to its last one."""
        out = cls(*cls.columns(table, lengths, lists), {})
        last = np.cumsum(lengths + 1) - 1
        n = int(last[-1]) + 1
        out.sums = {s: np.zeros(n, np.int64) for s in ("children", "leaves", "saved")}
        out.sums |= {"n": np.ones(n, np.int64), "least": np.repeat(out.convs, lengths + 1)}
        for s in ("children", "leaves", "saved"):
            out.sums[s][last] = np.asarray(table.column("below_" + s)).astype(np.int64)
        return out

    def matrix(self) -> np.ndarray:
        """Numbers of keys and turn ids, one row per path, padded with -1; numbers follow the order of the bytes."""
        width = int(self.lengths.max())
        halves = np.frombuffer(b"".join(self.ids), ">u8").reshape(-1, 2).astype(np.uint64)
        order = np.lexsort((halves[:, 1], halves[:, 0]))
        new = np.ones(len(order), bool)
        new[1:] = (halves[order[1:]] != halves[order[:-1]]).any(axis=1)
        numbers = np.empty(len(order), np.int32)
        numbers[order] = np.cumsum(new) - 1
        out = np.full((len(self.lengths), width + 1), -1, np.int32)
        known = {k: i for i, k in enumerate(sorted(set(self.keys)))}
        out[:, 0] = [known[k] for k in self.keys]
        out[:, 1:][np.arange(width) < self.lengths[:, None]] = numbers
        return out


class Folded:
    """A shard in order, with the nodes of every depth."""

    def __init__(self, shard: Shard, alone: bool):
        self.shard = shard
        matrix = shard.matrix()
        order = np.lexsort((shard.convs, *matrix.T[::-1]))
        matrix = matrix[order]
        self.order, self.lengths, self.convs = order, shard.lengths[order], shard.convs[order]
        self.width = matrix.shape[1] - 1
        depths = np.arange(self.width + 1)
        self.live = depths <= self.lengths[:, None]
        changed = np.ones(matrix.shape, bool)
        changed[1:] = matrix[1:] != matrix[:-1]
        #: Does another beginning start here? Once a column differs, so do all longer beginnings.
        self.new = np.logical_or.accumulate(changed, axis=1)
        self.starts = self.new & self.live
        self.run = np.cumsum(self.new, axis=0, dtype=np.int32)
        #: Cells of nodes that other shards may share.
        self.edge = np.zeros(matrix.shape, bool)
        if not alone:
            self.edge = self.live & ((self.run == 1) | (self.run == self.run[-1]))
        self.first = np.concatenate([[0], np.cumsum(shard.lengths)])
        cells = depths <= shard.lengths[:, None]
        self.cells = {}
        for name, values in shard.sums.items():
            padded = np.full(matrix.shape, NO_CONV if name == "least" else 0, np.int64)
            padded[cells] = values
            self.cells[name] = padded[order]
        words = np.zeros(matrix.shape, np.int64)
        words[:, 1:][cells[:, 1:]] = shard.words
        self.words = words[order]
        self._reduce()

    def _reduce(self) -> None:
        """Sums of every node, from the deepest on; cells of edges keep what is not theirs alone."""
        self.at: list[np.ndarray] = []
        self.found: dict[str, list[np.ndarray]] = {s: [] for s in SUMS}
        zeros = np.zeros(len(self.lengths), np.int64)
        leaves = saved = zeros
        for d in range(self.width, -1, -1):
            at = np.flatnonzero(self.new[:, d])
            deeper = d < self.width
            inside = ~self.edge[:, d + 1] if deeper else np.zeros(len(zeros), bool)
            n = np.add.reduceat(self.cells["n"][:, d], at)
            least = np.minimum.reduceat(self.cells["least"][:, d], at)
            own_children = self.cells["children"][:, d] + (self.starts[:, d + 1] & inside if deeper else 0)
            children = np.add.reduceat(own_children, at)
            leaves = self.cells["leaves"][:, d] + np.where(inside, leaves, 0)
            saved = self.cells["saved"][:, d] + np.where(inside, saved, 0)
            whole = at[self.starts[at, d] & ~self.edge[at, d]]
            which = self.run[whole, d] - 1
            leaves[whole] += children[which] == 0
            saved[whole] += (n[which] - 1) * self.words[whole, d]
            sums = (n, least, children, np.add.reduceat(leaves, at), np.add.reduceat(saved, at))
            self.at.append(at)
            for name, values in zip(SUMS, sums, strict=True):
                self.found[name].append(values)
        self.at.reverse()
        for values in self.found.values():
            values.reverse()

    def key(self, row: int) -> bytes:
        return self.shard.keys[self.order[row]]

    def path(self, row: int) -> list[bytes]:
        start = self.first[self.order[row]]
        return self.shard.ids[start : start + int(self.lengths[row])]

    def path_digests(self, row: int) -> list[bytes]:
        """Of each beginning of a row, from its key on."""
        out = [hashlib.md5(self.key(row)).digest()]
        for turn in self.path(row):
            out.append(hashlib.md5(out[-1] + turn).digest())
        return out

    def edge_digests(self) -> tuple[list[bytes], list[bytes]]:
        return self.path_digests(0), self.path_digests(-1)

    def ending(self) -> Iterator[tuple[int, np.ndarray]]:
        """First row and conversations, ascending, of the sequences at which some conversation ends."""
        ends = self.shard.ends[self.order]
        at = np.append(np.flatnonzero(self.new[:, -1]), len(ends))
        for i in np.flatnonzero(np.add.reduceat(ends, at[:-1])) if len(ends) else ():
            a, b = at[i], at[i + 1]
            yield int(a), self.convs[a:b][ends[a:b]]


def _joined(convs: np.ndarray) -> bytes:
    return ",".join(map(str, convs.tolist())).encode()


def fold(table: pa.Table, level: int, alone: bool, offset: int) -> Iterator[dict[str, list]]:
    """Rows of OUT, as columns: complete nodes, then the two edges and, from conversations, pieces of their ends."""
    folded = Folded(Shard.read(table), alone)
    digests = ([], []) if alone else folded.edge_digests()

    def edge_digest(row: int, depth: int) -> bytes:
        return digests[int(folded.run[row, depth] != 1)][depth]

    hashes, pieces = {}, []
    if level == 0:
        for row, convs in folded.ending():
            depth = int(folded.lengths[row])
            if folded.edge[row, depth]:
                pieces.append((edge_digest(row, depth), int(convs[0]), _joined(convs)))
            else:
                hashes[row] = hashlib.sha256(_joined(convs)).hexdigest()
    own_digests = {}
    least_above: np.ndarray | None = None
    for d in range(folded.width + 1):
        at = folded.at[d]
        whole = at[folded.starts[at, d] & ~folded.edge[at, d]]
        which = folded.run[whole, d] - 1
        n = len(whole)
        parents, parent_keys = [None] * n, [None] * n
        if d:
            edge_above = folded.edge[whole, d - 1]
            parents = [None if e else p for p, e in zip(least_above[folded.run[whole, d - 1] - 1].tolist(), edge_above)]
            parent_keys = [edge_digest(int(r), d - 1) if e else None for r, e in zip(whole, edge_above)]
        least_above = folded.found["least"][d]
        keys = [None] * n
        if level:
            for row in map(int, whole):
                if row not in own_digests:
                    own_digests[row] = folded.path_digests(row)
            keys = [own_digests[int(row)][d] for row in whole]
        ends_here = folded.lengths[whole] == d
        yield {
            "kind": [NODE] * n,
            "depth": [offset + d] * n,
            "parent_conv_id": parents,
            "parent_key": parent_keys,
            "n_convs": folded.found["n"][d][which],
            "n_children": folded.found["children"][d][which],
            "n_leaves": folded.found["leaves"][d][which],
            "saved_tokens": folded.found["saved"][d][which],
            "ends_sha256": [None] * n if level else [hashes.get(int(r), NO_ENDS) if e else NO_ENDS for r, e in zip(whole, ends_here)],
            "key": keys,
            "conv_id": folded.found["least"][d][which],
        }
    if alone:
        return
    edges = [0] if folded.run[-1, -1] == 1 else [0, len(folded.lengths) - 1]
    for row in edges:
        length = int(folded.lengths[row])
        runs = folded.run[row, : length + 1] - 1
        counted = (runs > 0) | (row == 0)  # what both paths share is counted by the first one
        sums = {}
        for name in SUMS:
            values = [int(folded.found[name][d][runs[d]]) for d in range(length + 1)]
            sums[name] = [[v if c else NO_CONV if name == "least" else 0 for v, c in zip(values, counted)]]
        yield {
            "kind": [EDGE],
            "key": [folded.key(row)],
            "conv_id": [int(folded.convs[row])],
            "ids": [folded.path(row)],
            "words": [folded.words[row, 1 : length + 1].tolist()],
            "ends": [False],
            **sums,
        }
    if pieces:
        keys, firsts, payloads = zip(*pieces)
        yield {"kind": [PIECE] * len(pieces), "key": list(keys), "conv_id": list(firsts), "payload": list(payloads)}


OUT_TYPES = pa.schema(
    [("kind", pa.int32()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("parent_key", pa.binary())]
    + [(c, pa.int64()) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    + [("ends_sha256", pa.string()), ("payload", pa.binary()), ("key", pa.binary()), ("conv_id", pa.int64())]
    + [("ids", pa.list_(pa.binary())), ("words", pa.list_(pa.int64())), ("ends", pa.bool_())]
    + [(s, pa.list_(pa.int64())) for s in SUMS]
)


def folded_level(rows: DataFrame, shards: int, level: int, offset: int) -> DataFrame:
    """One level of folding, written; rows have the columns of PATH, from conversations also those of the slab below."""
    alone = shards == 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        for columns in fold(pa.Table.from_batches(held), level, alone, offset):
            n = len(columns["kind"])
            if n:
                arrays = [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in OUT_TYPES]
                yield pa.RecordBatch.from_arrays(arrays, schema=OUT_TYPES)

    dealt = rows.coalesce(1) if alone else rows.repartitionByRange(shards, "key", "ids", "conv_id")
    return written(dealt.mapInArrow(run, OUT), "trie")


def hashed_pieces(pieces: DataFrame) -> DataFrame:
    """key and ends_sha256 of the nodes whose ends lie in several shards; pieces are read as a stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha = None, None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"key": pa.array([key], pa.binary()), "ends_sha256": [sha.hexdigest()]})

        for batch in batches:
            for own, payload in zip(batch.column(0), batch.column(1)):
                own = own.as_py()
                if own == key:
                    sha.update(b",")
                elif key is not None:
                    yield done()
                if own != key:
                    key, sha = own, hashlib.sha256()
                sha.update(payload.as_py())
        if key is not None:
            yield done()

    ordered = pieces.repartition("key").sortWithinPartitions("key", "conv_id").select("key", "payload")
    return ordered.mapInArrow(run, "key binary, ends_sha256 string")


RESULT = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def slab_nodes(rows: DataFrame, offset: int, cells: int) -> DataFrame:
    """The nodes of one slab, its roots included, written."""
    n_rows, width = rows.agg(F.count("*"), F.max(F.size("ids"))).first()
    most = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = n_rows * (width + 1)
    shards = max(-(-size // cells), min(most, size // min(cells, FEW_CELLS)), 1)
    tables, level = [], 0
    while True:
        tables.append(folded_level(rows, shards, level, offset))
        if shards == 1:
            break
        rows = tables[-1].where(F.col("kind") == EDGE).select([c.split()[0] for c in PATH.split(", ")])
        level += 1
        shards = max(1, min(-(-rows.count() * (width + 1) // cells), shards // 4))
    nodes = tables[0].where(F.col("kind") == NODE)
    if level == 0:
        return nodes.select(*RESULT)
    upper = tables[1]
    for table in tables[2:]:
        upper = upper.unionByName(table)
    upper = upper.where(F.col("kind") == NODE).drop("ends_sha256")
    sha = hashed_pieces(tables[0].where(F.col("kind") == PIECE)).withColumnRenamed("key", "sha_key")
    upper = upper.join(sha, F.col("key") == F.col("sha_key"), "left")
    upper = written(upper.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NO_ENDS))), "trie")
    parents = upper.select(F.col("key").alias("p_key"), F.col("conv_id").alias("p_conv"))
    columns = ["parent_key", *RESULT]
    every = nodes.select(columns).unionByName(upper.select(columns))
    # Parents at the edges of shards; adaptive execution splits the rows of one with very many children.
    asked = every.where(F.col("parent_key").isNotNull()).join(parents, F.col("parent_key") == F.col("p_key"))
    asked = asked.withColumn("parent_conv_id", F.col("p_conv")).select(*RESULT)
    return written(every.where(F.col("parent_key").isNull()).select(*RESULT).unionByName(asked), "nodes")


def prefix_trie(conversations: DataFrame, widths: Sequence[int] = WIDTHS, cells: int = CELLS) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    turns = written(numbered_turns(conversations), "turns")
    slabs = written(rebuilt(turns, widths), "slabs")
    last = slabs.agg(F.max("slab")).first()[0]
    if last is None:
        columns = (f"{c} {'string' if c == 'ends_sha256' else 'long'}" for c in RESULT)
        return slabs.sparkSession.createDataFrame([], ", ".join(columns))
    key = F.lit("").cast("binary")
    if last:
        earlier = Window.partitionBy("conv_id").orderBy("slab").rowsBetween(Window.unboundedPreceding, -1)
        own = F.md5(F.array_join(F.transform("ids", F.hex), ""))
        key = F.array_join(F.collect_list("own").over(earlier), "").cast("binary")
        key = F.when(F.col("slab") == 0, F.lit("").cast("binary")).otherwise(F.unhex(F.md5(key)))
        slabs = written(slabs.withColumn("own", own).withColumn("key", key).drop("own"), "slabs")
    else:
        slabs = slabs.withColumn("key", key)
    starts = list(accumulate([0, *widths]))
    starts += [starts[-1] + widths[-1] * k for k in range(1, last + 1)]
    below = result = None
    for slab in range(last, -1, -1):
        rows = slabs.where(F.col("slab") == slab)
        rows = rows.withColumn("ends", F.col("total") == F.size("ids") + F.lit(starts[slab]))
        sums = ["below_children", "below_leaves", "below_saved"]
        if below is not None:
            rows = rows.join(below, F.col("conv_id") == F.col("b_conv"), "left")
            rows = rows.withColumns({s: F.coalesce(s, F.lit(0)) for s in sums})
        else:
            rows = rows.withColumns({s: F.lit(0).cast("long") for s in sums})
        rows = rows.select("key", "conv_id", "ids", "words", "ends", *[F.lit(None).cast("array<long>").alias(s) for s in SUMS], *sums)
        nodes = slab_nodes(written(rows, "rows"), starts[slab], cells)
        if slab:
            roots = nodes.where((F.col("depth") == starts[slab]) & (F.col("n_children") > 0))
            below = roots.select(
                F.col("conv_id").alias("b_conv"),
                F.col("n_children").alias("below_children"),
                F.col("n_leaves").alias("below_leaves"),
                F.col("saved_tokens").alias("below_saved"),
            )
            nodes = nodes.where(F.col("depth") > starts[slab])
        result = nodes if result is None else result.unionByName(nodes)
    return result


TRIE_SQL = r"""
WITH turns AS (
    SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS t,
           row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, r, md5(concat(length(r), ':', r, t))) AS pos
    FROM conversations WHERE conv_id IS NOT NULL
), crcs AS (
    SELECT conv_id,
           xor(4294967295, list_reduce(
               list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
               lambda crc, byte: list_reduce(
                   list_prepend(xor(crc, byte), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
                   lambda x, ignored: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END))) AS crc
    FROM (SELECT DISTINCT conv_id FROM turns)
), convs AS (
    SELECT conv_id, conv_id - conv_id % 20 AS base, crc % 4 AS h FROM crcs
), rebuilt AS (
    SELECT c.conv_id, 0 AS part, pos, r, t FROM convs c JOIN turns u ON u.conv_id = c.base AND u.pos <= c.h
    UNION ALL
    SELECT c.conv_id, 1 AS part, pos, r, t FROM convs c JOIN turns u ON u.conv_id = c.conv_id AND u.pos > c.h
), deep AS (
    SELECT conv_id, row_number() OVER own AS depth, t, list(sha256(concat(length(r), ':', r, t))) OVER own AS path
    FROM rebuilt WINDOW own AS (PARTITION BY conv_id ORDER BY part, pos)
), reached AS (
    SELECT conv_id, 0 AS depth, '' AS node, 0 AS words FROM convs
    UNION ALL
    SELECT conv_id, depth, sha256(array_to_string(path, ' ')), len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) FROM deep
), lengths AS (
    SELECT conv_id, max(depth) AS total FROM reached GROUP BY conv_id
), nodes AS (
    SELECT node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, min(words) AS words,
           sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (depth = total), '')) AS ends_sha256
    FROM reached JOIN lengths USING (conv_id) GROUP BY node, depth
), linked AS (
    SELECT n.*, p.conv_id AS parent_conv_id, p.node AS parent
    FROM nodes n LEFT JOIN reached m ON m.conv_id = n.conv_id AND m.depth = n.depth - 1
    LEFT JOIN nodes p ON p.node = m.node AND p.depth = m.depth
), children AS (
    SELECT parent, count(*) AS n_children FROM linked WHERE parent IS NOT NULL GROUP BY parent
), counted AS (
    SELECT l.*, coalesce(c.n_children, 0) AS n_children FROM linked l LEFT JOIN children c ON c.parent = l.node
), subtrees AS (
    SELECT a.node, count(*) FILTER (n.n_children = 0) AS n_leaves, sum((n.n_convs - 1) * n.words)::BIGINT AS saved_tokens
    FROM counted n JOIN reached a ON a.conv_id = n.conv_id AND a.depth <= n.depth GROUP BY a.node
)
SELECT conv_id, depth::BIGINT AS depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256
FROM counted JOIN subtrees USING (node)
"""
