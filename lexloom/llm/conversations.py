"""Prefix trie of conversations: a node for each distinct sequence of first turns.

A turn's id is WIDTH bytes of the SHA-256 of its role and text, and a conversation's key is the ids of its
turns, one after the other. Keys are dealt by ranges of (key, conv_id), so a range is a slice of the whole
trie, and copies of one conversation are spread over ranges. Each task inserts its keys into an adaptive radix
tree and walks it from the bottom; only byte depths that end a turn give nodes.

Two ranges share no nodes but the common prefixes of the last key of one and the first key of the next. All
that a node has is additive over ranges if a range that repeats a node of the range before doesn't count it
as new again; so only these border nodes, some for each range, are summed over ranges. The conversations that
end in a node are hashed in order as a stream.
"""

from __future__ import annotations

import hashlib
from array import array

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, save
from .radix import Tree, common
from .ranks import small

WIDTH = 16
#: A range has about so many turns, and there are at least as many ranges as shuffle partitions.
RANGE_TURNS = 1 << 18
#: Conversations that end in a border node are written as texts of about so many characters.
CHUNK = 1 << 16
TRIE = (
    "id binary, parent_id binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
    "saved_tokens long, ends_sha256 string, range int, chunk int, text string"
)
KINDS = [pa.binary(), pa.binary(), *[pa.int64()] * 7, pa.string(), pa.int32(), pa.int32(), pa.string()]
BATCH = 4096


def turn_id(role: Column, text: Column) -> Column:
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    return F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * WIDTH)


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """conv_id and turns, an array of (turn, id, length) by turn, nulls first, then by id. Rows without conv_id are in no conversation.

    A conversation is one row of about 60 bytes a turn; texts stay where they are.
    """
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct("turn", turn_id(F.col("role"), F.col("text")).alias("id"), F.coalesce(F.length("text"), F.lit(0)).alias("length")).alias("t"),
    )
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def rebuilt(own: DataFrame, most: int = 5, step: int = 100) -> DataFrame:
    """The first h turns of conversation c - c % step, then those of c itself after its first h; h = crc32(c) % (most + 1)."""
    heads = own.where(F.pmod("conv_id", F.lit(step)) == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, most).alias("head"))
    base = F.try_subtract("conv_id", F.pmod("conv_id", F.lit(step)))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)).cast("int")
    rows = own.withColumn("base", base).withColumn("h", h).join(heads, "base", "left")
    rest = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    first = F.when(F.col("head").isNull(), F.slice("turns", 1, 0)).otherwise(F.slice("head", 1, "h"))
    return rows.select("conv_id", F.concat(first, rest).alias("turns"))


def _shared(a: pd.Series, b: pd.Series) -> pd.Series:
    """Bytes that two keys share from the start; -1 where there is no second key."""
    return pd.Series([-1 if x is None or y is None else common(x, y) for x, y in zip(a, b)])


class _Slice:
    """One range of sorted keys, and the nodes that it gives.

    shared_before and shared_after are the turns that its first and last key share with the neighbouring ranges (-1:
    none there); `goes_on` says that the first key of the next range is the last key or begins with it.
    """

    def __init__(self, number: int, shared_before: int, shared_after: int, goes_on: bool):
        self.number, self.before, self.after, self.goes_on = number, shared_before, shared_after, goes_on
        self.tree, self.first, self.last = Tree(), None, None
        self.ids, self.lengths = array("q"), None

    def add(self, key: bytes, conv_id: int, lengths) -> None:
        if key != self.last:
            self.close()
            self.first, self.last, self.lengths = key if self.first is None else self.first, key, array("q", lengths.as_py())
        self.ids.append(conv_id)

    def close(self) -> None:
        """The last key has all its conversations: insert it."""
        if self.last is not None:
            self.tree.insert(self.last, [self.ids, self.lengths])
            self.ids = array("q")

    def finish(self):
        """Rows of TRIE, children before their parents."""
        self.close()
        before, after = self._prefix_ids(self.first, self.before), self._prefix_ids(self.last, self.after)
        # A frame: node, byte depth of its parent, on the first key's path, on the last key's path, results of children.
        done: list = []
        stack = [(self.tree.root, -1, True, True, done)]
        waiting: list = []
        while stack:
            node, above, left, right, out = stack.pop()
            depth = above + 1 + len(node.path) if above >= 0 else len(node.path)
            results: list = []
            waiting.append((node, above, depth, left, right, results, out))
            kids = list(node.items())
            for k, (_, kid) in enumerate(kids):
                stack.append((kid, depth, left and k == 0, right and k == len(kids) - 1, results))
        for node, above, depth, left, right, results, out in reversed(waiting):
            yield from self._close_node(node, above, depth, left, right, results, out, before, after)
        if done:
            yield from self._adopt(done[0][6], None, None)

    @staticmethod
    def _prefix_ids(key: bytes, turns: int) -> list[bytes]:
        running, out = hashlib.blake2b(digest_size=16), []
        for t in range(turns + 1):
            out.append(running.copy().digest())
            running.update(key[t * WIDTH : (t + 1) * WIDTH])
        return out

    def _close_node(self, node, above, depth, left, right, results, out, before, after):
        n, least, leaves, saved, new_kids, lengths, tops = 0, None, 0, 0, 0, None, []
        for r in results:
            n, leaves, saved, new_kids = n + r[0], leaves + r[2], saved + r[3], new_kids + r[4]
            least = r[1] if least is None else min(least, r[1])
            lengths = r[5]
            tops += r[6]
        results.clear()
        end = node.end
        if end:
            ids, lengths = end
            n, least = n + len(ids), ids[0] if least is None else min(least, ids[0])
            if not node.below and not (right and self.goes_on):
                leaves = 1
        for t in range(depth // WIDTH, (above // WIDTH if above >= 0 else -1), -1):
            shared = left and t <= self.before
            node_id = before[t] if shared else after[t] if right and t <= self.after else None
            length = lengths[t - 1] if t else 0
            saved += n * length - (0 if shared else length)
            text = ",".join(map(str, ids)) if end and t * WIDTH == depth else ""
            ends = hashlib.sha256(text.encode()).hexdigest() if node_id is None else None
            yield from self._adopt(tops, node_id, least)
            for c in range(0, len(text) if node_id else 0, CHUNK):
                yield (node_id, *[None] * 9, self.number, c // CHUNK, text[c : c + CHUNK])
            tops = [[node_id, None, least, t, None, n, new_kids, leaves, saved, ends, self.number, None, None]]
            new_kids = int(not shared)
        out.append((n, least, leaves, saved, new_kids, lengths, tops))

    @staticmethod
    def _adopt(rows, parent_id, parent):
        """Rows with their parent: its border id, or its smallest member, which is final."""
        for row in rows:
            row[1], row[4] = parent_id, None if parent_id else parent
            yield tuple(row)


def _batches(rows):
    done = []
    for row in rows:
        done.append(row)
        if len(done) == BATCH:
            yield _record(done)
            done = []
    if done:
        yield _record(done)


def _record(rows):
    names = [c.split()[0] for c in TRIE.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), KINDS)], names)


def _tries(batches):
    def rows():
        slice_ = None
        for batch in batches:
            lengths = batch.column("lengths")
            fixed = [batch.column(c).to_pylist() for c in ("range", "before", "after", "goes_on", "key", "conv_id")]
            for i, (number, before, after, goes_on, key, conv_id) in enumerate(zip(*fixed)):
                if slice_ is None or slice_.number != number:
                    if slice_:
                        yield from slice_.finish()
                    slice_ = _Slice(number, before, after, goes_on)
                slice_.add(key, conv_id, lengths[i])
        if slice_:
            yield from slice_.finish()

    yield from _batches(rows())


def _end_hashes(batches):
    """SHA-256 of the texts of each id, which come in order, joined with commas where a new range begins."""
    now, running, part = None, None, None
    for batch in batches:
        out = []
        for node, number, text in zip(*(batch.column(c).to_pylist() for c in ("id", "range", "text"))):
            if node != now:
                if running:
                    out.append((now, running.hexdigest()))
                now, running, part = node, hashlib.sha256(), number
            if number != part:
                running.update(b",")
                part = number
            running.update(text.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.binary(), pa.string()))], ["id", "hash"])
    if running:
        yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([running.hexdigest()])], ["id", "hash"])


def prefix_trie(sequences: DataFrame) -> DataFrame:
    """Nodes of the trie of `sequences` (conv_id, unique and not null; turns, an array of structs with id and length).

    Returns conv_id (the smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens
    and ends_sha256, as op12's contract has them. Sequences without turns are members of the root alone; with no
    sequence there is no node, not even a root.
    """
    spark = sequences.sparkSession
    keys = sequences.select(
        "conv_id", F.unhex(F.array_join(F.transform("turns", lambda t: t["id"]), "")).alias("key"), F.transform("turns", lambda t: t["length"].cast("long")).alias("lengths")
    )
    keys = save(keys, "keys")
    n_turns = keys.agg(F.sum(F.size("lengths"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_turns // RANGE_TURNS))
    dealt = save(keys.repartitionByRange(parts, "key", "conv_id").withColumn("range", F.spark_partition_id()), "ranges")
    edges = dealt.groupBy("range").agg(F.min("key").alias("first"), F.max("key").alias("last"))
    shared = F.pandas_udf(_shared, "long")
    # One row for each range; what goes to all tasks is four numbers of each.
    near = edges.selectExpr("range", "first", "last", "lag(last) over (order by range) as old", "lead(first) over (order by range) as next")
    near = near.select("range", F.octet_length("last").alias("size"), shared("first", "old").alias("before"), shared("last", "next").alias("after"))
    to_turns = lambda c: F.when(F.col(c) < 0, -1).otherwise(F.floor(F.col(c) / WIDTH)).cast("int").alias(c)
    near = save(near.select("range", to_turns("before"), to_turns("after"), (F.col("after") == F.col("size")).alias("goes_on")), "borders")
    last = near.agg(F.max("range")).first()[0]
    rows = dealt.join(F.broadcast(near), "range").repartitionById((last or 0) + 1, F.col("range")).sortWithinPartitions("range", "key", "conv_id")
    trie = save(rows.mapInArrow(_tries, TRIE), "trie")
    discard(keys, dealt, near)
    texts = trie.where("chunk is not null").select("id", "range", "chunk", "text").repartition("id").sortWithinPartitions("id", "range", "chunk")
    ends = texts.mapInArrow(_end_hashes, "id binary, hash string")
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    border = trie.where("id is not null and chunk is null").groupBy("id", "depth").agg(F.min("conv_id").alias("conv_id"), F.min("parent_id").alias("parent_id"), *sums)
    none = F.sha2(F.lit(""), 256)
    border = save(border.join(ends, "id", "left").withColumn("ends_sha256", F.coalesce("hash", none)).drop("hash"), "border")
    known = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    inner = trie.where("id is null and chunk is null").select("parent_id", *known)
    rows = inner.unionByName(border.drop("id").withColumn("parent_conv_id", F.lit(None).cast("long")))
    parents = small(border.select("id", F.col("conv_id").alias("parent")))
    rows = rows.join(parents, rows.parent_id == parents.id, "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "parent"))
    return rows.select(*known)


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """Nodes of the trie of rebuilt conversations, see rebuilt() and prefix_trie().

    Null roles and texts are empty; null turns come first, and rows of one conversation and turn (also repeated ones)
    follow one another by the hash of role and text. Rows with null conv_id belong to no conversation. Other
    columns are ignored; an empty table gives no node.
    """
    own = save(ordered_turns(conversations), "turns")
    return prefix_trie(rebuilt(own))
