"""A trie of conversations by their turns, over range partitions.

1. Every turn becomes a digest of 16 bytes, and a conversation its path: the
   digests of its turns, one after the other.  In the order of (path, conv_id)
   the members of every node of the trie follow one another.
2. Spark deals the conversations into shards by ranges of that order, so copies
   of one conversation may span shards.  The splitter of two shards is the last
   path of one and the first of the next; what the two have in common is the
   way through the trie that the border cuts.  The trie of these ways, the
   skeleton, is broadcast as its array of common lengths: two numbers a shard,
   however long the paths are.
3. A task walks its sorted shard with the open nodes on a stack.  Nodes within
   the shard are finished there.  Of nodes on the skeleton it gives a partial
   aggregate, which leaves out what other skeleton nodes below add themselves.
4. Partial aggregates are reduced by node.  Sums over subtrees of the skeleton
   are differences of running sums, since a subtree is a stretch of the order
   (first shard, depth).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize

DIGEST = 16
#: Turns and conversations a shard has at most, on average.
TURNS, CONVERSATIONS = 500_000, 100_000
#: Ids of a stretch, and rows of a result batch.
STRETCH, ROWS = 10_000, 20_000
NODE, PARTIAL, ENDS = 0, 1, 2
_LOCAL = "kind int, shard int, key long, parent_key long, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, chars long, ends string, stretch int"
_KINDS = {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}
_SCHEMA = pa.schema([(n, _KINDS[k]) for n, k in (x.split() for x in _LOCAL.split(", "))])
_RESULT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
NO_ENDS = hashlib.sha256(b"").hexdigest()


def turn_digest(role: Column, text: Column) -> Column:
    """128 bits of a hash of the role, its length, and the text."""
    return F.substr(F.unhex(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256)), F.lit(1), F.lit(DIGEST))


def rebuilt(conversations: DataFrame, group: int, heads: int) -> DataFrame:
    """(conv_id, path, chars): conversations after the exchange of their first turns."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").isNotNull().alias("given"), "turn", turn_digest(role, text).alias("digest"), F.char_length(text).alias("chars")
    )
    own = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("given", F.coalesce("turn", F.lit(0)).alias("turn"), "digest", "chars"))).alias("turns"))
    own = materialize(own.select("conv_id", F.transform("turns", lambda t: F.struct(t["digest"].alias("digest"), t["chars"].alias("chars"))).alias("turns")), "trie-turns")
    first = own.where(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("of"), F.slice("turns", 1, heads - 1).alias("head"))
    h = F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(heads)).cast("int")
    joined = own.withColumn("of", F.col("conv_id") - F.col("conv_id") % group).join(first, "of", "left")
    head = F.slice(F.coalesce("head", F.array().cast(joined.schema["head"].dataType)), F.lit(1), h)
    turns = F.concat(head, F.slice("turns", h + 1, F.greatest(F.size("turns") - h, F.lit(0))))
    path = F.unhex(F.array_join(F.transform("t", lambda t: F.hex(t["digest"])), ""))
    return joined.select("conv_id", turns.alias("t")).select("conv_id", path.alias("path"), F.transform("t", lambda t: t["chars"]).alias("chars"))


def common_turns(a: bytes, b: bytes) -> int:
    """How many turns two paths begin with in common."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // DIGEST
    return int((np.frombuffer(a, "u1", n) != np.frombuffer(b, "u1", n)).argmax()) // DIGEST


class Skeleton:
    """The nodes that borders of shards cut, from common lengths of paths: ``across`` each border, ``within`` each shard."""

    def __init__(self, shards: list[int], across: list[int], within: list[int]):
        self.place = {s: i for i, s in enumerate(shards)}
        self.across, self.within = across, within

    def left(self, i: int) -> int:
        """Depth to which the first path of shard ``i`` goes on from the shard before it; -1 if there is none."""
        return self.across[i - 1] if i else -1

    def right(self, i: int) -> int:
        return self.across[i] if i < len(self.across) else -1

    def keys(self, i: int) -> list[int]:
        """The names (first shard << 32 | depth) of the nodes that shard ``i`` goes on with, by depth."""
        out, j = [], i - 1
        for depth in range(self.left(i), -1, -1):
            while j and self.within[j] >= depth and self.across[j - 1] >= depth:
                j -= 1
            out.append((j << 32) | depth)
        return out[::-1]


class Open:
    """A node on the way to the conversation at hand; ``key`` is its name if the shard goes on with it."""

    __slots__ = ("chars", "children", "conv_id", "ends", "key", "leaves", "n", "pending", "saved")

    def __init__(self, chars: int, key: int | None):
        self.chars, self.key, self.conv_id = chars, key, None
        self.n = self.children = self.leaves = self.saved = 0
        self.pending, self.ends = [], []

    def member(self, conv_id: int, n: int = 1) -> None:
        self.n += n
        self.conv_id = conv_id if self.conv_id is None else min(self.conv_id, conv_id)


class Shard:
    """The nodes of one shard, from its conversations in order."""

    def __init__(self, shard: int, skeleton: Skeleton):
        self.shard, self.place = shard, skeleton.place[shard]
        self.right, self.keys = skeleton.right(self.place), skeleton.keys(self.place)
        self.path, self.stack = b"", []
        self._open(0)

    def _open(self, chars: int) -> None:
        depth = len(self.stack)
        self.stack.append(Open(chars, self.keys[depth] if depth < len(self.keys) else None))

    def add(self, conv_id: int, path: bytes, chars: list[int]) -> Iterator[dict]:
        same = common_turns(self.path, path)
        while len(self.stack) - 1 > same:
            yield from self._close(False)
            self.keys = []  # what opens from now on begins in this shard
        for n in chars[same:]:
            self._open(n)
        self.stack[-1].member(conv_id)
        self.stack[-1].ends.append(str(conv_id))
        self.path = path

    def end(self) -> Iterator[dict]:
        while self.stack:
            yield from self._close(True)

    def _close(self, last: bool) -> Iterator[dict]:
        """Take the deepest node off the stack; ``last`` if no conversation follows."""
        node = self.stack.pop()
        depth, above = len(self.stack), self.stack[-1] if self.stack else None
        of_shard = {"shard": self.shard, "depth": depth}
        key = (self.place << 32) | depth if node.key is None and last and depth <= self.right else node.key
        if above:
            above.children += node.key is None
        if key is None:
            node.leaves += not node.children
            node.saved += (node.n - 1) * node.chars
            yield from (child | {"parent_conv_id": node.conv_id} for child in node.pending)
            ends = hashlib.sha256(",".join(node.ends).encode()).hexdigest()
            done = of_shard | {"kind": NODE, "conv_id": node.conv_id, "ends": ends}
            done |= {"n_convs": node.n, "n_children": node.children, "n_leaves": node.leaves, "saved_tokens": node.saved}
            if above:
                above.pending.append(done)
            else:
                yield done
        else:
            yield from (child | {"parent_key": key} for child in node.pending)
            parent = None if above is None else (self.place << 32) | (depth - 1) if above.key is None else above.key
            partial = of_shard | {"kind": PARTIAL, "key": key, "parent_key": parent, "conv_id": node.conv_id, "chars": node.chars}
            yield partial | {"n_convs": node.n, "n_children": node.children, "n_leaves": node.leaves, "saved_tokens": node.saved}
            yield from (of_shard | {"kind": ENDS, "key": key, "ends": part, "stretch": i} for i, part in enumerate(stretches(node.ends)))
        if above:
            above.member(node.conv_id, node.n)
            above.leaves += node.leaves
            above.saved += node.saved


def stretches(ids: list[str]) -> Iterator[str]:
    """The ids, joined by commas, in stretches."""
    for i in range(0, len(ids), STRETCH):
        yield ",".join(ids[i : i + STRETCH])


def _shards(skeleton):
    """Rows of the sorted shards of a task to rows of ``_LOCAL``."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held = None
        for batch in batches:
            for shard, conv_id, path, chars in zip(*(batch[c].to_pylist() for c in ("shard", "conv_id", "path", "chars"))):
                if held is None or held.shard != shard:
                    if held:
                        yield from held.end()
                    held = Shard(shard, skeleton.value)
                yield from held.add(conv_id, path, chars)
        if held:
            yield from held.end()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = rows(batches)
        while some := list(islice(found, ROWS)):
            yield pa.RecordBatch.from_pylist(some, schema=_SCHEMA)

    return run


def _common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lo, hi, after = (batch[c].to_pylist() for c in ("lo", "hi", "next"))
        across = [None if b is None else common_turns(a, b) for a, b in zip(hi, after)]
        columns = [batch["shard"], pa.array(across, pa.int32()), pa.array(map(common_turns, lo, hi), pa.int32())]
        yield pa.RecordBatch.from_arrays(columns, ["shard", "across", "within"])


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One hash a node from its stretches of ids, which come in order."""

    def hashes() -> Iterator[tuple[int, str]]:
        key = sha = None
        for batch in batches:
            for k, part in zip(batch["key"].to_pylist(), batch["ends"].to_pylist()):
                if k != key:
                    if sha:
                        yield key, sha.hexdigest()
                    key, sha = k, hashlib.sha256(part.encode())
                else:
                    sha.update(b"," + part.encode())
        if sha:
            yield key, sha.hexdigest()

    found = hashes()
    while some := list(islice(found, ROWS)):
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*some), (pa.int64(), pa.string()))], ["key", "ends_sha256"])


def skeleton_of(sharded: DataFrame) -> Skeleton:
    """The common lengths of the shards' paths, two numbers for each."""
    borders = sharded.groupBy("shard").agg(F.min("path").alias("lo"), F.max("path").alias("hi"))
    borders = borders.select("shard", "lo", "hi", F.lead("lo").over(W.orderBy("shard")).alias("next"))  # a row for each shard
    found = sorted(borders.mapInArrow(_common, "shard int, across int, within int").collect(), key=lambda r: r["shard"])
    return Skeleton([r["shard"] for r in found], [r["across"] for r in found[:-1]], [r["within"] for r in found])


def reduce_skeleton(partials: DataFrame, ends: DataFrame, n_shards: int) -> DataFrame:
    """(key, ...) of the skeleton's nodes, from their partial aggregates."""
    spark = partials.sparkSession
    node = partials.groupBy("key").agg(
        F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.max("parent_key").alias("parent_key"), F.max("place").alias("last"), F.max("chars").alias("chars"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
    )
    node = node.withColumn("first", F.shiftright("key", 32).cast("int"))
    node = materialize(node.withColumn("leaf", (F.col("n_children") == 0).cast("long")).withColumn("saves", (F.col("n_convs") - 1) * F.col("chars")), "trie-skeleton")
    # below (first, depth) lie the nodes that begin in this shard at this depth or more, and those that begin in the shards after it but for the last
    totals = node.groupBy("first").agg(F.sum("leaf").alias("leaf"), F.sum("saves").alias("saves"))
    so_far = W.orderBy("place").rowsBetween(W.unboundedPreceding, 0)  # a row for each shard
    places = spark.range(n_shards).select(F.col("id").cast("int").alias("place")).join(totals.withColumnRenamed("first", "place"), "place", "left")
    running = places.select("place", *[F.coalesce(F.sum(c).over(so_far), F.lit(0)).alias(c) for c in ("leaf", "saves")])
    deeper = W.partitionBy("first").orderBy(F.desc("depth")).rowsBetween(W.unboundedPreceding, 0)
    node = node.withColumn("leaf", F.sum("leaf").over(deeper)).withColumn("saves", F.sum("saves").over(deeper))
    node = node.join(running.select(F.col("place").alias("first"), F.col("leaf").alias("leaf_to_first"), F.col("saves").alias("saves_to_first")), "first")
    before = F.greatest(F.col("last") - 1, F.col("first"))
    node = node.withColumn("before", before).join(running.select(F.col("place").alias("before"), F.col("leaf").alias("leaf_to_last"), F.col("saves").alias("saves_to_last")), "before")
    ordered = ends.repartition("key").sortWithinPartitions("key", "shard", "stretch").select("key", "ends")
    hashed = ordered.mapInArrow(_ends, "key long, ends_sha256 string")
    return node.join(hashed, "key", "left").select(
        "key", "parent_key", "conv_id", "depth", "n_convs", "n_children",
        (F.col("n_leaves") + F.col("leaf") + F.col("leaf_to_last") - F.col("leaf_to_first")).alias("n_leaves"),
        (F.col("saved_tokens") + F.col("saves") + F.col("saves_to_last") - F.col("saves_to_first")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"),
    )


def trie_of_paths(paths: DataFrame, turns: int = TURNS, conversations: int = CONVERSATIONS) -> DataFrame:
    """The nodes of the trie of (conv_id, path, chars), one row a conversation."""
    paths = materialize(paths, "trie-paths")
    n, total = paths.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("chars")), F.lit(0))).first()
    n_shards = max(1, -(-total // turns), -(-n // conversations), min(n // 1000, paths.sparkSession.sparkContext.defaultParallelism))
    sharded = paths.repartitionByRange(n_shards, "path", "conv_id").withColumn("shard", F.spark_partition_id())
    sharded = materialize(sharded, "trie-shards")
    found = skeleton_of(sharded)
    skeleton = sharded.sparkSession.sparkContext.broadcast(found)
    n_shards = max([*found.place, 0]) + 1
    dealt = sharded.repartitionById(n_shards, F.col("shard")).sortWithinPartitions("shard", "path", "conv_id")
    local = materialize(dealt.mapInArrow(_shards(skeleton), _LOCAL), "trie-local")
    nodes, partials = local.where(F.col("kind") == NODE), local.where(F.col("kind") == PARTIAL)
    place = F.broadcast(sharded.sparkSession.createDataFrame(list(found.place.items()), "shard int, place int"))  # a row for each shard
    reduced = materialize(reduce_skeleton(partials.join(place, "shard"), local.where(F.col("kind") == ENDS), len(found.place)), "trie-reduced")
    # a node's parent on the skeleton is looked up in its own shard, so the root is not a frequent key
    known = reduced.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("above"))
    by_shard = partials.select("shard", F.col("key").alias("parent_key")).join(known, "parent_key")
    inner = nodes.where("parent_key IS NULL")
    outer = nodes.where("parent_key IS NOT NULL").drop("parent_conv_id").join(by_shard, ["shard", "parent_key"]).withColumn("parent_conv_id", F.col("above"))
    crossed = reduced.join(known, "parent_key", "left").withColumn("parent_conv_id", F.col("above"))
    return inner.unionByName(outer, allowMissingColumns=True).withColumn("ends_sha256", F.col("ends")).select(_RESULT).union(crossed.select(_RESULT))


def conversation_trie(conversations: DataFrame, group: int = 100, heads: int = 6, turns: int = TURNS, shard_conversations: int = CONVERSATIONS) -> DataFrame:
    """Return the nodes (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256).

    Each conversation c begins with the first crc32(c) % ``heads`` turns of
    conversation c - c % ``group`` in place of its own.  A node is a distinct
    sequence of first turns, the root the empty one; conv_id is its smallest
    member.  Subtrees include their top.

    Turns are ordered by number, null first; those of one number by their digest.
    A null role or text is empty; a null conv_id names no conversation, so its
    rows take no part; a turn given twice counts twice.  A conversation may have
    no turns left: it ends at the root.  Other columns are ignored; an empty
    table has no nodes, not even a root.

    Turns are told apart by 128 bits of SHA-256.  A conversation is one row of
    some 20 bytes a turn, whatever its texts are, and the only thing that is
    collected whole.  Copies of a conversation may span shards.  The ids that end
    at a node are hashed one after the other, as SHA-256 demands, in a stream.
    """
    return trie_of_paths(rebuilt(conversations, group, heads), turns, shard_conversations)
