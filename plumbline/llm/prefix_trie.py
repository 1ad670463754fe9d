"""The prefix trie of conversations: shared openings, what they would save, and who ends where.

Conversations become paths of fixed-width codes, one for each turn, and equal paths one row. Sorted paths are dealt by ranges, so
that a task sees whole neighbourhoods of the trie. Each shard writes its part of the trie as balanced parentheses, in
which a subtree is what stands between a parenthesis and its partner. Only the nodes on the first and the last path of a
shard can lie in other shards as well: these two spines are merged with those of the neighbours, round by round.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from plumbline.session import materialise

#: Bytes of one turn in a path: 16 of a hash of role and text, 8 of the text's length, most significant first.
CODE = 24
#: Nodes of one shard's encoding, apart from those of its last path; bounds what a task holds.
SHARD_NODES = 200_000
#: Partitions whose spines meet in one task of a merge.
FAN_IN = 64
#: Parentheses in one block of the excess tree.
BLOCK = 64
#: Characters of joined ids that one row carries to the task that finishes a digest.
PART_CHARS = 1 << 13
NO_ID = np.iinfo(np.int64).max
NO_ENDS = hashlib.sha256(b"").hexdigest()


class Parentheses:
    """A tree as balanced parentheses, given by the depths of its nodes in preorder.

    ``excess`` is what is open after each parenthesis. Blocks of it have their least and greatest value in a binary tree, by
    which the partner of a parenthesis is found without reading what lies between.
    """

    def __init__(self, depths: np.ndarray) -> None:
        n = len(depths)
        closed = np.append(depths[:-1] - depths[1:] + 1, depths[-1] - depths[0] + 1)  # after each node
        self.open = np.arange(n) + np.concatenate([[0], np.cumsum(closed)[:-1]])
        self.bits = np.full(2 * n, -1, np.int8)
        self.bits[self.open] = 1
        self.excess = np.cumsum(self.bits, dtype=np.int64)
        blocks = -(-2 * n // BLOCK)
        self.leaves = 1 << max(0, (blocks - 1).bit_length())
        padded = np.full(self.leaves * BLOCK, NO_ID)
        padded[: 2 * n] = self.excess
        self.low = np.full(2 * self.leaves, NO_ID)
        self.high = np.full(2 * self.leaves, -1)
        self.low[self.leaves :] = padded.reshape(-1, BLOCK).min(axis=1)
        padded[2 * n :] = -1
        self.high[self.leaves :] = padded.reshape(-1, BLOCK).max(axis=1)
        k = self.leaves
        while k > 1:
            self.low[k // 2 : k] = self.low[k : 2 * k].reshape(-1, 2).min(axis=1)
            self.high[k // 2 : k] = self.high[k : 2 * k].reshape(-1, 2).max(axis=1)
            k //= 2

    def close(self) -> np.ndarray:
        """The place of each node's closing parenthesis, by preorder."""
        out = np.full(len(self.open), -1)
        target = self.excess[self.open] - 1
        own = self.open // BLOCK
        self._scan(out, np.arange(len(out)), self.open + 1, own, target)
        left = np.flatnonzero(out < 0)
        node, want = own[left] + self.leaves, target[left]
        at = np.zeros(len(left), np.int64)
        climbing = np.arange(len(left))
        while len(climbing):  # to the first range of blocks on the right that reaches the wanted excess
            side = node[climbing] ^ 1
            here = (side > node[climbing]) & (self.low[side] <= want[climbing]) & (want[climbing] <= self.high[side])
            at[climbing[here]] = side[here]
            climbing = climbing[~here]
            node[climbing] >>= 1
        while len(down := np.flatnonzero(at < self.leaves)):
            first = at[down] * 2
            inside = (self.low[first] <= want[down]) & (want[down] <= self.high[first])
            at[down] = np.where(inside, first, first + 1)
        block = at - self.leaves
        self._scan(out, left, block * BLOCK, block, want)
        return out

    def _scan(self, out: np.ndarray, nodes: np.ndarray, at: np.ndarray, block: np.ndarray, want: np.ndarray) -> None:
        """Reads on from ``at`` to the end of ``block``; puts the first place of the wanted excess into ``out``."""
        end = np.minimum((block + 1) * BLOCK, len(self.bits))
        while len(nodes):
            live = at < end
            nodes, at, end, want = nodes[live], at[live], end[live], want[live]
            hit = self.excess[at] == want
            out[nodes[hit]] = at[hit]
            nodes, at, end, want = nodes[~hit], at[~hit] + 1, end[~hit], want[~hit]


@dataclass
class Nodes:
    """Nodes of a part of the trie in preorder, the root first.

    ``convs``, ``low``, ``leaves``, ``saved`` and ``children`` cover what is not in another node of this list: conversations
    that end in the node itself or in parts that are settled already, their least id, settled leaves and savings below,
    settled children.
    """

    depth: np.ndarray
    size: np.ndarray
    convs: np.ndarray
    low: np.ndarray
    leaves: np.ndarray
    saved: np.ndarray
    children: np.ndarray
    end: list[str | None]

    def totals(self) -> tuple[np.ndarray, ...]:
        """(parent, conversations, least id, children, leaves, savings) of each node with its whole subtree."""
        n = len(self.depth)
        tree = Parentheses(self.depth)
        close = tree.close()
        count = (close - tree.open + 1) // 2  # nodes of the subtree
        here = np.arange(n)
        keyed = self.depth * n + here
        order = np.argsort(keyed)
        parent = order[np.maximum(np.searchsorted(keyed[order], keyed - n, side="right") - 1, 0)]
        parent[0] = -1

        def below(values: np.ndarray) -> np.ndarray:
            total = np.concatenate([[0], np.cumsum(values)])
            return total[here + count] - total[here]

        convs = below(self.convs)
        children = self.children + np.bincount(parent[1:], minlength=n)
        # rank of the pairs "()" of nodes without settled children
        pair = np.zeros(2 * n, np.int64)
        pair[tree.open] = (tree.bits[tree.open + 1] < 0) & (self.children == 0)
        rank = np.cumsum(pair)
        leaves = rank[close] - rank[tree.open] + pair[tree.open] + below(self.leaves)
        saved = below((convs - 1) * self.size + self.saved)
        low = self.low.copy()
        by_depth = np.argsort(-self.depth, kind="stable")
        edges = np.flatnonzero(np.diff(self.depth[by_depth])) + 1
        for level in np.split(by_depth, edges)[:-1]:  # children before their parents
            np.minimum.at(low, parent[level], low[level])
        return parent, convs, low, children, leaves, saved


_LONGS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "unit", "size", "parent_unit")
_INTS = ("part", "place", "parent_place")
FIELDS = T.StructType(
    [T.StructField(c, T.LongType()) for c in _LONGS]
    + [T.StructField(c, T.IntegerType()) for c in _INTS]
    + [T.StructField("end", T.StringType()), T.StructField("open", T.BooleanType()), T.StructField("key", T.BinaryType())]
)


def settle(nodes: Nodes, unit: int, part: int, keys: dict[int, bytes] | None) -> pa.Table:
    """Rows of FIELDS: nodes in ``keys`` stay open, with what is settled of them; the others are final.

    ``keys`` holds the spines, with keys that name them in other units; None leaves nothing open.
    """
    n = len(nodes.depth)
    parent, convs, low, children, leaves, saved = nodes.totals()
    is_open = np.zeros(n, bool)
    is_open[list(keys or ())] = True
    hangs = np.flatnonzero(is_open & (parent >= 0))  # open nodes; their parents are open too
    own = {"convs": convs.copy(), "leaves": leaves - (children == 0), "saved": saved - (convs - 1) * nodes.size, "children": children.copy()}
    for name, total in (("convs", convs), ("leaves", leaves), ("saved", saved)):
        np.subtract.at(own[name], parent[hangs], total[hangs])
    np.subtract.at(own["children"], parent[hangs], 1)
    own_low = nodes.low.copy()
    shut = np.flatnonzero(~is_open & (parent >= 0))
    np.minimum.at(own_low, parent[shut], low[shut])
    waits = (parent >= 0) & ~is_open & is_open[parent]  # the parent's least id isn't known yet
    knows = (parent >= 0) & ~is_open & ~waits
    columns = {
        "conv_id": pa.array(np.where(is_open, own_low, low)),
        "depth": pa.array(nodes.depth),
        "parent_conv_id": pa.array(np.where(knows, low[parent], 0), mask=~knows),
        "n_convs": pa.array(np.where(is_open, own["convs"], convs)),
        "n_children": pa.array(np.where(is_open, own["children"], children)),
        "n_leaves": pa.array(np.where(is_open, own["leaves"], leaves)),
        "saved_tokens": pa.array(np.where(is_open, own["saved"], saved)),
        "end": pa.array(nodes.end, pa.string()),
        "part": pa.array(np.full(n, part, np.int32)),
        "unit": pa.array(np.full(n, unit)),
        "place": pa.array(np.arange(n, dtype=np.int32)),
        "open": pa.array(is_open),
        "key": pa.array([None] * n if not keys else [keys.get(i) for i in range(n)], pa.binary()),
        "size": pa.array(nodes.size),
        "parent_unit": pa.array(np.full(n, unit), mask=~waits),
        "parent_place": pa.array(np.where(waits, parent, 0).astype(np.int32), mask=~waits),
    }
    return pa.table(columns).select(FIELDS.names).cast(to_arrow_schema(FIELDS))


def shared(a: bytes, b: bytes) -> int:
    """Turns that two paths share from the start."""
    least, most = 0, min(len(a), len(b)) // CODE
    while least < most:
        mid = (least + most + 1) // 2
        if a[: mid * CODE] == b[: mid * CODE]:
            least = mid
        else:
            most = mid - 1
    return least


def _keys(path: bytes) -> list[bytes]:
    """A name for each node of a path, the root first."""
    h = hashlib.md5(usedforsecurity=False)
    out = [h.digest()]
    for at in range(0, len(path), CODE):
        h.update(path[at : at + CODE])
        out.append(h.copy().digest())
    return out


class Shard:
    """Gathers paths in ascending order, each with its number of conversations, their least id and a name for their list."""

    def __init__(self) -> None:
        self.first = self.last = b""
        self.new: list[bytes] = []
        self.skip: list[int] = []
        self.ends: list[tuple[int, int, str]] = []
        self.n = 1

    def add(self, path: bytes, convs: int, low: int, end: str) -> None:
        same = shared(self.last, path) if self.ends else 0
        if not self.ends:
            self.first = path
        self.new.append(path[same * CODE :])
        self.skip.append(same)
        self.n += len(path) // CODE - same
        self.ends.append((convs, low, end))
        self.last = path

    def table(self, unit: int, part: int) -> pa.Table:
        sizes = np.array([len(p) // CODE for p in self.new])
        skip = np.array(self.skip)
        begin = np.cumsum(sizes) - sizes
        codes = np.frombuffer(b"".join(self.new), np.uint8).reshape(-1, CODE)
        depth = np.concatenate([[0], np.arange(self.n - 1) - np.repeat(begin - skip, sizes) + 1]).astype(np.int64)
        at = np.where(sizes + skip > 0, begin + sizes, 0)  # where each path ends; the empty one at the root
        nodes = Nodes(depth, np.zeros(self.n, np.int64), *[np.zeros(self.n, np.int64) for _ in range(5)], [None] * self.n)
        nodes.size[1:] = np.ascontiguousarray(codes[:, 16:]).view(">u8").ravel()
        nodes.low[:] = NO_ID
        nodes.convs[at], nodes.low[at] = [e[0] for e in self.ends], [e[1] for e in self.ends]
        for i, e in zip(at.tolist(), self.ends, strict=True):
            nodes.end[i] = e[2]
        keys = dict(enumerate(_keys(self.first)))
        latest = {int(d): i for i, d in enumerate(depth)}
        keys |= {latest[d]: k for d, k in enumerate(_keys(self.last))}
        return settle(nodes, unit, part, keys)


def merged(group: pa.Table, unit: int, part: int, last: bool) -> pa.Table:
    """Open nodes of consecutive units as one unit; the spines of the whole stay open unless it is the last."""
    rows = group.sort_by([("unit", "ascending"), ("place", "ascending")])
    place: dict[bytes, int] = {}
    names = rows.column("key").to_pylist()
    to = np.array([place.setdefault(k, len(place)) for k in names])
    _, first = np.unique(to, return_index=True)
    n = len(place)

    def column(name: str) -> np.ndarray:
        return rows.column(name).to_numpy()

    def added(name: str) -> np.ndarray:
        out = np.zeros(n, np.int64)
        np.add.at(out, to, column(name))
        return out

    low = np.full(n, NO_ID)
    np.minimum.at(low, to, column("conv_id"))
    end: list[str | None] = [None] * n
    for i, e in zip(to.tolist(), rows.column("end").to_pylist(), strict=True):
        end[i] = end[i] or e
    depth = column("depth")[first]
    nodes = Nodes(depth, column("size")[first], added("n_convs"), low, added("n_leaves"), added("saved_tokens"), added("n_children"), end)
    keys = list(place)
    run = int(np.append(depth != np.arange(n), True).argmax())
    spines = set(range(run))
    need = int(depth[-1])
    for i in range(n - 1, -1, -1):
        if depth[i] == need:
            spines.add(i)
            need -= 1
    out = settle(nodes, unit, part, None if last else {i: keys[i] for i in sorted(spines)})
    return out.set_column(out.schema.get_field_index("key"), "key", pa.array(keys, pa.binary()))


def paths(turns: DataFrame, family: int = 5, longest_head: int = 8) -> DataFrame:
    """(conv_id, path) of each rebuilt conversation.

    A conversation c begins with the first h turns of conversation c - c % ``family``, if that exists, and goes on with its own
    turns after its first h; h is the crc32 of its decimal id modulo ``longest_head`` + 1.
    """
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    code = F.concat(
        F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)),
        F.lpad(F.hex(F.octet_length(text)), 16, "0"),
    )
    turn = F.struct(F.col("turn").isNotNull(), F.col("turn"), code.alias("code"))
    own = F.col("conv_id")
    # one shuffle: all conversations of a family meet in one partition, and so do their turns
    coded = turns.filter(own.isNotNull()).select(own.cast("long").alias("conv_id"), turn.alias("turn")).withColumn("base", own - own % family)
    listed = coded.repartition("base").groupBy("base", "conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    whole = listed.select("base", "conv_id", F.transform("turns", lambda t: t["code"]).alias("own"))
    heads = whole.filter(own == F.col("base")).select(F.col("base").alias("of"), F.slice("own", 1, longest_head).alias("head"))
    h = (F.crc32(own.cast("string").cast("binary")) % (longest_head + 1)).cast("int")
    tail = F.slice("own", h + 1, F.greatest(F.size("own") - h, F.lit(0)))
    rebuilt = F.concat(F.coalesce(F.slice("head", F.lit(1), h), F.array().cast("array<string>")), tail)
    return whole.join(heads, F.col("base") == F.col("of"), "left").select("conv_id", F.unhex(F.array_join(rebuilt, "")).alias("path"))


def list_digests(members: DataFrame) -> DataFrame:
    """(end, ends_sha256): SHA-256 of the ascending, comma-joined conv_ids of each ``end``.

    Rows are dealt and sorted by ranges of (end, conv_id). A task hashes the lists that lie inside its range. Of the first
    and the last one, which may go on elsewhere, it passes the joined text on in parts, and these are hashed in order: as a
    hash needs its input in sequence, one list is one stream, of which a task holds some parts at a time.
    """

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], schema.names)

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        name, ids, chars, sent, first = None, [], 0, 0, True
        rows: list[tuple] = []
        for b in batches:
            for end, conv in zip(b.column("end").to_pylist(), b.column("conv_id").to_pylist(), strict=True):
                if end != name and name is not None:
                    text = ",".join(ids)
                    rows.append((name, None, part, sent, text) if first or sent else (name, hashlib.sha256(text.encode()).hexdigest(), None, None, None))
                    ids, chars, sent, first = [], 0, 0, False
                elif chars >= PART_CHARS:
                    rows.append((name, None, part, sent, ",".join(ids)))
                    ids, chars, sent = [], 0, sent + 1
                if len(rows) >= 1000:
                    yield batch_of(rows)
                    rows = []
                name = end
                ids.append(str(conv))
                chars += len(ids[-1]) + 1
        if ids:  # the last list may go on in the next task
            rows.append((name, None, part, sent, ",".join(ids)))
        if rows:
            yield batch_of(rows)

    def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, digest = None, hashlib.sha256()
        for b in batches:
            done: list[tuple[str, str]] = []
            for end, ids in zip(b.column("end").to_pylist(), b.column("ids").to_pylist(), strict=True):
                if end == name:
                    digest.update(b",")
                else:
                    if name is not None:
                        done.append((name, digest.hexdigest()))
                    name, digest = end, hashlib.sha256()
                digest.update(ids.encode())
            if done:
                yield pa.RecordBatch.from_pydict({"end": [d[0] for d in done], "ends_sha256": [d[1] for d in done]})
        if name is not None:
            yield pa.RecordBatch.from_pydict({"end": [name], "ends_sha256": [digest.hexdigest()]})

    schema = T.StructType.fromDDL("end string, ends_sha256 string, part int, nr int, ids string")
    types = to_arrow_schema(schema).types
    ranged = members.select("end", "conv_id").repartitionByRange("end", "conv_id").sortWithinPartitions("end", "conv_id")
    found = materialise(ranged.mapInArrow(inside, schema), "ends")
    cut = found.filter(F.col("ends_sha256").isNull()).select("end", "part", "nr", "ids")
    joined = cut.repartition("end").sortWithinPartitions("end", "part", "nr").select("end", "ids").mapInArrow(streamed, "end string, ends_sha256 string")
    return found.filter(F.col("ends_sha256").isNotNull()).select("end", "ends_sha256").unionByName(joined)


def build(rebuilt: DataFrame) -> DataFrame:
    """One row per node of the trie of (conv_id, path): conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256."""
    spark = rebuilt.sparkSession
    rebuilt = materialise(rebuilt.withColumn("end", F.md5("path")), "paths")
    classes = rebuilt.groupBy("path").agg(F.count(F.lit(1)).alias("convs"), F.min("conv_id").alias("low")).withColumn("end", F.md5("path"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made, shard = TaskContext.get().partitionId(), 0, Shard()
        for batch in batches:
            for row in zip(*[batch.column(c).to_pylist() for c in ("path", "convs", "low", "end")], strict=True):
                shard.add(*row)
                if shard.n >= SHARD_NODES:
                    yield from shard.table((part << 32) | made, part).to_batches(20_000)
                    made, shard = made + 1, Shard()
        if shard.ends:
            yield from shard.table((part << 32) | made, part).to_batches(20_000)

    def merge(last: bool, level: int):  # noqa: ANN202
        def run(key: tuple, group: pa.Table) -> pa.Table:
            part = key[0].as_py()
            return merged(group, (level << 58) | (part << 32), part, last)

        return run

    ranged = classes.repartitionByRange("path").sortWithinPartitions("path")
    rounds = [materialise(ranged.mapInArrow(encode, FIELDS), "shards")]
    parts, level = (rounds[0].agg(F.max("part")).first()[0] or 0) + 1, 1
    while True:
        parts = -(-parts // FAN_IN)
        waiting = rounds[-1].filter("open").withColumn("to", F.floor(F.col("part") / FAN_IN).cast("int"))
        rounds.append(materialise(waiting.groupBy("to").applyInArrow(merge(parts == 1, level), FIELDS), "spines"))
        if parts == 1:
            break
        level += 1
    spines = rounds[1]
    for r in rounds[2:]:
        spines = spines.unionByName(r)
    every = rounds[0].unionByName(spines)
    final = every.filter(~F.col("open"))
    # a spine's least id is known once it is settled; nodes right below it name it by unit and place
    known = spines.filter(~F.col("open")).select("key", F.col("conv_id").alias("of"))
    named = every.filter("open").select(F.col("unit").alias("parent_unit"), F.col("place").alias("parent_place"), "key").join(known, "key").drop("key")
    waits = F.col("parent_unit").isNotNull()
    late = final.filter(waits).join(named, ["parent_unit", "parent_place"]).withColumn("parent_conv_id", F.col("of"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    nodes = final.filter(~waits).select(*columns, "end").unionByName(late.select(*columns, "end"))
    ended = F.col("end").isNotNull()
    with_ends = nodes.filter(ended).join(list_digests(rebuilt), "end").select(*columns, "ends_sha256")
    return with_ends.unionByName(nodes.filter(~ended).select(*columns, F.lit(NO_ENDS).alias("ends_sha256")))


def conversation_trie(turns: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations in (conv_id, turn, role, text), one row per node.

    Turns go by ``turn``, null first; equal ones by the hash of role and text. A null role or text is empty. Repeated rows are turns of their own.
    Rows without conv_id belong to no conversation. A very long text counts by its hash and length; a conversation of any number
    of turns is one row of 24 bytes a turn. Other columns are not read, whatever their names. An empty table has no trie and gives
    no rows.
    """
    return build(paths(turns))
