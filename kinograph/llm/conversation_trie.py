"""Prefix trie of conversations from the LCP array of their sorted order.

Every turn becomes a mark of 16 bytes (SHA-256 of role and text) and its number of words, so that texts are read
once and never shuffled. Equal conversations become one sequence of marks. The distinct sequences are sorted by range into blocks; with
LCP[i], the turns that sequence i shares with the one before it, the trie's branching nodes are the nodes of the Cartesian tree over
LCP, those of equal LCP merged: position i belongs to the node of depth LCP[i] between its nearest smaller
values. A block finds those inside it with a stack. Nodes that cross its ends look for the nearest block whose
minimum is smaller, which are then found in that block's running minima: all nearest smaller values, in parallel.
A leaf stands where a sequence goes deeper than both its neighbours. What an interval sums up (members, leaves, words) is a
difference of running sums; depths between a node and its parent are added last, as one row each.

What comes to the driver is seven numbers for each block of ``BLOCK`` sequences. Members of a node are hashed in order: ids are
sorted by range over all tasks and joined to strings, and only these strings of one group meet in one task, as a stream.

Defined results: a null role or text is empty; turns go by ``turn``, null first, equal ones by the mark of role and
text; repeated rows are turns each; rows with a null conv_id are no conversation and are left out; a conversation's marks are one row, 16 bytes a turn,
its texts never are; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.window import Window

from kinograph.llm.common import map_arrow, materialize

#: Sequences of a block, about.
BLOCK = 1 << 17
#: Conversations that may share a head, and the turns it has at most, less one.
FAMILY, HEAD = 20, 4
#: Ids that are joined to one string.
IDS = 4096
WORD = r"[^\x20\x09-\x0D]+"
_MARK = 16
_EMPTY = hashlib.sha256(b"").hexdigest()
_FAR = (1 << 63) - 1
RESULT = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def marked(turns: DataFrame) -> DataFrame:
    """(conv_id, turns): each conversation's turns in order, as marks in hex and numbers of words."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    mark = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, 2 * _MARK)
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), mark.alias("mark"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    return rows.where("conv_id IS NOT NULL").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "mark", "words"))).alias("turns"))


def with_heads(conversations: DataFrame, family: int = FAMILY, head: int = HEAD) -> DataFrame:
    """(conv_id, turns): the first h turns of the family's first conversation, then a conversation's own after its first h."""
    first = conversations.where(F.col("conv_id") % family == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, max(head - 1, 1)).alias("head"))
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(head)).cast("int")
    both = conversations.withColumn("h", h).join(first, F.col("conv_id") - F.col("conv_id") % family == F.col("base"), "left")
    own = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    shared = F.when(F.col("head").isNotNull(), F.slice("head", F.lit(1), F.col("h"))).otherwise(F.slice("turns", 1, 0))
    return both.select("conv_id", F.concat(shared, own).alias("turns"))


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of sorted ids of one group as strings."""
    group, first, ids = None, None, []

    def flushed():
        return pa.RecordBatch.from_arrays([pa.array([group], pa.binary()), pa.array([first], pa.int64()), pa.array([",".join(map(str, ids))])], ["g", "first", "ids"])

    for batch in batches:
        out: tuple[list, list, list] = [], [], []
        for g, i in zip(batch.column("g").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
            if g != group or len(ids) >= IDS:
                if ids:
                    for column, value in zip(out, (group, first, ",".join(map(str, ids))), strict=True):
                        column.append(value)
                group, first, ids = g, i, []
            ids.append(i)
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.binary()), pa.array(out[1], pa.int64()), pa.array(out[2])], ["g", "first", "ids"])
    if ids:
        yield flushed()


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each group's strings, comma-joined, as they stream by in order."""
    group, state = None, None
    for batch in batches:
        done: list[tuple] = []
        for g, ids in zip(batch.column("g").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if g != group:
                if state is not None:
                    done.append((group, state.hexdigest()))
                group, state = g, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done])], ["g", "ends"])
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([group], pa.binary()), pa.array([state.hexdigest()])], ["g", "ends"])


def ends(members: DataFrame) -> DataFrame:
    """(g, ends): the digest of the ids of each group of ``members`` (g, conv_id), ascending."""
    strings = map_arrow(members.repartitionByRange("g", "conv_id").sortWithinPartitions("g", "conv_id"), _joined, "g binary, first long, ids string")
    return map_arrow(strings.repartition("g").sortWithinPartitions("g", "first"), _hashed, "g binary, ends string")


def common(a: bytes | None, b: bytes | None) -> int:
    """Turns that two sequences share; -1 beyond the ends of the table."""
    if a is None or b is None:
        return -1
    at, most = 0, min(len(a), len(b))
    while at < most and a[at : at + _MARK] == b[at : at + _MARK]:
        at += _MARK
    return at // _MARK


def cartesian(lcp: list[int], ids: list[int], start: int) -> tuple[list, list, list]:
    """Nodes of a block, the node of each position, and the (value, last position) that are open at its end.

    A node is [depth, left, right, positions, least id]; an end outside the block is None. The first position of the table has LCP -1.
    """
    nodes, of, stack = [], [], []
    for i, v in enumerate(lcp):
        left, least = (start + i - 1, ids[i - 1]) if i else (None, _FAR)
        while stack and stack[-1][0] > v:
            node = nodes[stack.pop()[1]]
            node[2], node[4] = start + i, min(node[4], least)
            left, least = node[1], node[4]
        if v < 0:
            of.append(None)
            stack.append([v, None, i])
        elif stack and stack[-1][0] == v:
            node = nodes[stack[-1][1]]
            node[3], node[4] = node[3] + 1, min(node[4], least)
            of.append(stack[-1][1])
            stack[-1][2] = i
        else:
            of.append(len(nodes))
            stack.append([v, len(nodes), i])
            nodes.append([v, left, None, 1, least])
    least = ids[-1]
    for _, k, _ in reversed(stack):
        if k is not None:
            least = nodes[k][4] = min(nodes[k][4], least)
    return nodes, of, [(v, start + last) for v, _, last in stack]


_PAIRS = pa.list_(pa.struct([("value", pa.int64()), ("pos", pa.int64())]))
#: A block's numbers, and the running minima from either end.
_NUMBERS = ("start", "low", "least", "n", "leaves", "t", "new")
_POINT = pa.schema(
    [(c, pa.int64()) for c in ("block", "pos", "size", "lcp", "next")]
    + [("sums", pa.list_(pa.int64())), ("ends", pa.string())]
    + [(c, pa.int64()) for c in ("n", "least", "c", "leaves", "t", "new", "low_before", "low_after", "k")]
    + [("part", pa.struct([(c, pa.int64()) for c in ("depth", "left", "right", "count", "least")]))]
    + [("summary", pa.struct([(c, pa.int64()) for c in _NUMBERS] + [("rising", _PAIRS), ("falling", _PAIRS)]))]
)


def _block(rows: pa.Table, edge: pa.Table) -> pa.Table:
    """The points of one block of sequences, the nodes of its Cartesian tree at their first positions, its summary at the first point."""
    edge, keys = edge.to_pylist()[0], rows.column("key").to_pylist()
    order = sorted(range(len(keys)), key=keys.__getitem__)
    start, keys = edge["start"], [keys[i] for i in order]
    words, n, ids, own = ([column[i] for i in order] for column in (rows.column(c).to_pylist() for c in ("words", "n", "least", "ends")))
    lcp = [common(edge["before"], keys[0]), *map(common, keys, keys[1:])]
    after = [*lcp[1:], common(keys[-1], edge["after"])]
    size = [len(k) // _MARK for k in keys]
    sums = [np.cumsum([0, *w]).tolist() for w in words]
    c, leaves = np.cumsum(n), np.cumsum([s > a for s, a in zip(size, after, strict=True)])
    t = np.cumsum([m * s[-1] for m, s in zip(n, sums, strict=True)])
    new = np.cumsum([s[-1] - s[max(v, 0)] for v, s in zip(lcp, sums, strict=True)])
    low_before, low_after = np.minimum.accumulate(ids), np.minimum.accumulate(ids[::-1])[::-1]
    nodes, of, rising = cartesian(lcp, ids, start)
    falling, part, seen = [], [], set()
    for i, v in enumerate(lcp):
        if not falling or v < falling[-1][0]:
            falling.append((v, start + i))
        k = of[i]
        part.append(None if k is None or k in seen else dict(zip(("depth", "left", "right", "count", "least"), nodes[k], strict=True)))
        seen.add(k)
    pairs = lambda x: [{"value": v, "pos": p} for v, p in x]
    summary = {"start": start, "low": min(lcp), "least": int(low_before[-1]), "n": int(c[-1]), "leaves": int(leaves[-1]), "t": int(t[-1]), "new": int(new[-1]), "rising": pairs(rising), "falling": pairs(falling)}
    m = len(keys)
    columns = [[edge["number"]] * m, range(start, start + m), size, lcp, after, sums, own, n, ids, c, leaves, t, new, low_before, low_after, of, part, [summary] + [None] * (m - 1)]
    return pa.Table.from_arrays([pa.array(list(x), f.type) for x, f in zip(columns, _POINT, strict=True)], schema=_POINT)


def points(sequences: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per distinct sequence of ``sequences`` (key, words, n, least, ends), in sorted order, with its place, LCPs and running sums."""
    blocks = max(1, -(-sequences.count() // block))
    dealt = materialize(sequences.repartitionByRange(blocks, "key").withColumn("block", F.spark_partition_id()), "sequences")
    w = Window.orderBy("block")  # a row for each block
    edges = dealt.groupBy("block").agg(F.min("key").alias("low"), F.max("key").alias("high"), F.count("*").alias("n"))
    edges = edges.select(
        "block",
        (F.row_number().over(w) - 1).cast("long").alias("number"),
        (F.sum("n").over(w) - F.col("n")).alias("start"),
        F.lag("high").over(w).alias("before"),
        F.lead("low").over(w).alias("after"),
    )
    out = dealt.groupBy("block").cogroup(materialize(edges, "edges").groupBy("block")).applyInArrow(_block, from_arrow_schema(_POINT))
    return materialize(out, "points")


class Blocks:
    """Seven numbers of each block, and searches among them."""

    def __init__(self, rows: list):
        self.of = {name: np.array([r[name] for r in rows], np.int64) for name in _NUMBERS}
        self.ends = {name: np.cumsum(self.of[name]) for name in ("n", "leaves", "t", "new")}
        self.low, self.least = self.of["low"], self.of["least"]
        self.back, self.wide, self.wide_back = self.low[::-1], _coarse(self.low), _coarse(self.low[::-1])

    def before(self, b: int, value: int) -> int:
        """The last block before ``b`` with a value below ``value``; -1 without one."""
        return _last(self.low, self.wide, b, value)

    def after(self, b: int, value: int) -> int:
        """The first block after ``b`` with a value below ``value``; -1 without one."""
        found = _last(self.back, self.wide_back, len(self.low) - 1 - b, value)
        return found if found < 0 else len(self.low) - 1 - found

    def holding(self, position: int) -> int:
        return int(np.searchsorted(self.of["start"], position, "right")) - 1


def _coarse(low: np.ndarray) -> np.ndarray:
    return np.minimum.reduceat(low, np.arange(0, len(low), 1024))


def _last(low: np.ndarray, wide: np.ndarray, b: int, value: int) -> int:
    for values, end, width in ((low[b >> 10 << 10 : b], b >> 10 << 10, 1), (wide[: b >> 10], 0, 1024)):
        hit = np.flatnonzero(values < value)
        if len(hit):
            at = end + int(hit[-1]) * width
            return at if width == 1 else at + int(np.flatnonzero(low[at : at + 1024] < value)[-1])
    return -1


def _looked_up(told):
    """For open nodes, the blocks in which their ends are."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            left = [None if r["left"] is not None else told.value.before(r["block"], r["depth"]) for r in rows]
            right = [None if r["right"] is not None else told.value.after(r["block"], r["depth"]) for r in rows]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(left, pa.int64()), pa.array(right, pa.int64())], [*batch.schema.names, "left_in", "right_in"])

    return look


def _across(told):
    """For nodes in several blocks, what lies between: the least id of whole blocks, and the sums of blocks up to the last."""

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = told.value
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for r in batch.to_pylist():
                a, b = blocks.holding(r["left"]), blocks.holding(r["right"] - 1)
                values = [int(blocks.least[a + 1 : b].min(initial=_FAR))]
                values += [int(s[b - 1] - s[a - 1] if a else s[b - 1]) if b > a else 0 for s in blocks.ends.values()]
                for column, value in zip(out, [b > a, *values], strict=True):
                    column.append(value)
            more = [pa.array(out[0], pa.bool_()), *(pa.array(x, pa.int64()) for x in out[1:])]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "crosses", "between", "d_n", "d_leaves", "d_t", "d_new"])

    return across


_NODE = "left long, right long, depth long, count long, least long"


def branching(places: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes of the whole Cartesian tree (``_NODE``, what lies between, values at both ends), and (pos, up): the least id of each position's node."""
    spark = places.sparkSession
    blocks = materialize(places.where("summary IS NOT NULL").select("block", "summary.*"), "blocks")
    rows = blocks.select(*_NUMBERS, "block").orderBy("block").collect()  # seven numbers of a block
    told, total = spark.sparkContext.broadcast(Blocks(rows)), places.count()
    parts = places.where("part IS NOT NULL").select("block", "k", "part.*")
    shut = (F.col("left").isNotNull()) & (F.col("right").isNotNull())
    open_ = map_arrow(parts.where(~shut), _looked_up(told), "block long, k long, depth long, left long, right long, count long, least long, left_in long, right_in long")
    rising = blocks.select(F.col("block").alias("left_in"), "rising")
    falling = blocks.select(F.col("block").alias("right_in"), "falling")
    found = materialize(open_, "open").join(rising, "left_in", "left").join(falling, "right_in", "left")
    found = found.select(
        "block",
        "k",
        "depth",
        F.coalesce("left", F.expr("element_at(filter(rising, x -> x.value < depth), -1).pos")).alias("left"),
        F.coalesce("right", F.expr("element_at(filter(falling, x -> x.value < depth), 1).pos"), F.lit(total)).alias("right"),
        "count",
        "least",
    )
    found = materialize(found, "found")
    merged = found.groupBy("left", "depth").agg(F.max("right").alias("right"), F.sum("count").alias("count"), F.min("least").alias("least"))
    wide = map_arrow(merged.select("left", "right", "depth", "count", "least"), _across(told), _NODE + ", crosses boolean, between long, d_n long, d_leaves long, d_t long, d_new long")
    zeros = [F.lit(False).alias("crosses"), F.lit(_FAR).alias("between"), *(F.lit(0).cast("long").alias(c) for c in ("d_n", "d_leaves", "d_t", "d_new"))]
    nodes = wide.unionByName(parts.where(shut).select("left", "right", "depth", "count", "least", *zeros))
    at_left = places.select(F.col("pos").alias("left"), "size", "lcp", "sums", "ends", "n", *[F.col(c).alias(f"l_{c}") for c in ("c", "leaves", "t", "new", "low_after")], (F.col("size") > F.col("next")).cast("long").alias("leaf"))
    at_right = places.select((F.col("pos") + 1).alias("right"), "next", *[F.col(c).alias(f"r_{c}") for c in ("c", "leaves", "t", "new", "low_before")])
    nodes = nodes.join(at_left, "left").join(at_right, "right")
    least = F.when(F.col("crosses"), F.least("between", "l_low_after", "r_low_before")).otherwise(F.col("least"))
    nodes = materialize(nodes.withColumn("least", least), "nodes")
    up_open = found.select("block", "k", "left", "depth").join(nodes.select("left", "depth", F.col("least").alias("up")), ["left", "depth"]).select("block", "k", "up")
    up_shut = parts.where(shut).select("block", "k", F.col("least").alias("up"))
    up = places.where("k IS NOT NULL").select("pos", "block", "k").join(up_open.unionByName(up_shut), ["block", "k"]).select("pos", "up")
    return nodes, up


def _expanded(nodes: DataFrame, up: DataFrame, empty: Column) -> DataFrame:
    """A row for each depth below the parent's, with its sums."""
    parent_depth = F.greatest("lcp", "next")
    door = F.when(F.col("lcp") >= F.col("next"), F.col("left")).otherwise(F.col("right"))
    nodes = nodes.withColumn("pos", door).join(up, "pos", "left")
    rows = nodes.withColumn("d", F.explode(F.sequence(parent_depth + 1, F.col("depth"))))
    before = F.when(F.col("d") > 1, F.expr("sums[cast(d - 1 AS INT)]")).otherwise(F.lit(0))
    all_words = F.element_at("sums", -1)
    saved = F.col("t_sum") - F.col("n_convs") * before - (F.col("new_sum") + all_words - before)
    last = F.col("d") == F.col("depth")
    return rows.select(
        F.col("least").alias("conv_id"),
        F.col("d").alias("depth"),
        F.when(F.col("d") == 0, F.lit(None).cast("long")).when(F.col("d") == parent_depth + 1, F.col("up")).otherwise(F.col("least")).alias("parent_conv_id"),
        "n_convs",
        F.when(last, F.col("below")).otherwise(F.lit(1).cast("long")).alias("n_children"),
        F.col("n_leaves"),
        saved.alias("saved_tokens"),
        F.when(F.col("d") == F.col("size"), F.col("ends")).otherwise(empty).alias("ends_sha256"),
    )


def prefix_trie(turns: DataFrame, family: int = FAMILY, head: int = HEAD, block: int = BLOCK) -> DataFrame:
    """One row per node of the trie of the rebuilt conversations of ``turns`` (conv_id, turn, role, text): ``RESULT``."""
    whole = with_heads(materialize(marked(turns), "conversations"), family, head)
    key = F.unhex(F.array_join(F.transform("turns", lambda t: t["mark"]), ""))
    rebuilt = whole.select("conv_id", key.alias("key"), F.transform("turns", lambda t: t["words"]).alias("words"))
    rebuilt = materialize(rebuilt.withColumn("g", F.unhex(F.sha2("key", 256))), "rebuilt")
    groups = rebuilt.groupBy("g").agg(F.min("key").alias("key"), F.min("words").alias("words"), F.count("*").alias("n"), F.min("conv_id").alias("least"))
    sequences = materialize(groups.join(ends(rebuilt.select("g", "conv_id")), "g").drop("g"), "groups")
    if sequences.isEmpty():
        return turns.sparkSession.createDataFrame([], RESULT)
    places = points(sequences, block)
    nodes, up = branching(places)
    inner = nodes.select(
        "left",
        "right",
        "depth",
        "least",
        "lcp",
        "next",
        "size",
        "sums",
        "ends",
        (F.col("d_n") + F.col("r_c") - F.col("l_c") + F.col("n")).alias("n_convs"),
        (F.col("d_leaves") + F.col("r_leaves") - F.col("l_leaves") + F.col("leaf")).alias("n_leaves"),
        (F.col("d_t") + F.col("r_t") - F.col("l_t") + F.col("n") * F.element_at("sums", -1)).alias("t_sum"),
        (F.col("d_new") + F.col("r_new") - F.col("l_new")).alias("new_sum"),
        (F.col("count") + (F.col("size") > F.col("depth")).cast("long")).alias("below"),
    )
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    alone = places.where(F.col("size") > F.greatest("lcp", "next")).select(
        F.col("pos").alias("left"),
        (F.col("pos") + 1).alias("right"),
        F.col("size").alias("depth"),
        "least",
        "lcp",
        "next",
        "size",
        "sums",
        "ends",
        F.col("n").alias("n_convs"),
        one.alias("n_leaves"),
        (F.col("n") * F.element_at("sums", -1)).alias("t_sum"),
        none.alias("new_sum"),
        none.alias("below"),
    )
    return _expanded(inner.unionByName(alone), up, F.lit(_EMPTY))
