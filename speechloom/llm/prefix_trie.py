"""The trie of conversation prefixes, as a table with a row for each node.

1. ``coded``: a message becomes its place in its conversation, a 128-bit digest of
   role and text, and the text's length. Texts do not move.
2. ``paths``: in the order of turns each message's digest is chained to that of the
   prefix before it. A prefix is known by the 128 bits of this chain from then on.
3. ``trie``: equal prefixes are counted. Nodes are dealt to shards so that a subtree
   is together as far as it fits: a node's tier is the number of its members in
   powers of 64, and a component is what hangs together within one tier (and within
   1,024 depths). A component has no more than 64 branches, however many
   conversations begin alike. Lower tiers are worked off first; what they add up to
   goes to the parents of the components' tops.
4. A shard's nodes get slots by minimal perfect hashing, verified by the stored
   digests. Counts are scattered into flat arrays by slot, parents looked up as
   slots, and totals passed from child to parent slots, deepest nodes first.
5. ``ends``: the ids of the conversations that end at a node are hashed in order, as
   a stream over pieces of bounded size.

Rows without a conversation id are of no conversation. Null roles and texts are
empty. A null turn comes first; messages with one turn number stand in the order of
their digests. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from speechloom.llm.columns import cut
from speechloom.llm.perfect_hash import PerfectHash
from speechloom.plans.joins import join_counted

ROOT = "0" * 32
# A tier is so many binary digits of a node's number of members.
TIER_BITS = 6
DEPTHS = 1024
SHARD_NODES = 50_000
# Ids of a node that are hashed as one piece.
PIECE = 1 << 16

PATHS = "conv_id long, depth long, node string, parent string, chars long, last boolean"
TOTALS = (
    "node string, parent string, depth long, conv_id long, parent_conv_id long, n_convs long, "
    "n_children long, n_leaves long, saved_tokens long, top boolean, above_tier long, above_block long"
)


# ----------------------------------------------------------------- messages


def coded(
    messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """``conv_id``, ``pos`` (from 1), ``code`` and ``chars`` of every message."""
    role = F.coalesce(F.col(f"`{role}`").cast("string"), F.lit(""))
    text = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    in_order = W.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "code")
    return (
        messages.where(F.col(f"`{conv}`").isNotNull())
        .select(
            F.col(f"`{conv}`").cast("long").alias("conv_id"),
            F.col(f"`{turn}`").alias("turn"),
            F.substring(F.sha2(whole.cast("binary"), 256), 1, 32).alias("code"),
            F.length(text).cast("long").alias("chars"),
        )
        .withColumn("pos", F.row_number().over(in_order).cast("long"))
        .drop("turn")
    )


def opening_turns(conv: Column) -> Column:
    """How many opening turns a rebuilt conversation takes over."""
    return F.crc32(conv.cast("string").cast("binary")) % 6


def rebuilt(messages: DataFrame, group: int = 100, most: int = 5) -> DataFrame:
    """Conversations whose first turns (of either as many as ``opening_turns``
    says) are replaced by those of the first conversation of their group, if there
    is one. Both tables are as ``coded`` gives them; here ``part`` and ``pos`` order
    a conversation, and part -1 stands for the conversation itself."""
    own_base = F.col("conv_id") - F.col("conv_id") % group
    convs = messages.where("pos = 1").select(
        "conv_id", opening_turns(F.col("conv_id")).alias("opening"), own_base.alias("base")
    )
    first = messages.where((F.col("conv_id") % group == 0) & (F.col("pos") <= most))
    # A group has at most ``group`` conversations, so no key is hot here.
    taken = (
        first.select(F.col("conv_id").alias("base"), "pos", "code", "chars")
        .join(convs, "base")
        .where(F.col("pos") <= F.col("opening"))
        .select("conv_id", F.lit(0).alias("part"), "pos", "code", "chars")
    )
    own = messages.where(F.col("pos") > opening_turns(F.col("conv_id")))
    own = own.select("conv_id", F.lit(1).alias("part"), "pos", "code", "chars")
    return taken.unionByName(own).unionByName(_conversations(convs))


def as_they_are(messages: DataFrame) -> DataFrame:
    """Conversations as ``coded`` gives them, in the shape ``paths`` takes."""
    own = messages.select("conv_id", F.lit(1).alias("part"), "pos", "code", "chars")
    return own.unionByName(_conversations(messages.where("pos = 1")))


def _conversations(convs: DataFrame) -> DataFrame:
    return convs.select(
        "conv_id",
        F.lit(-1).alias("part"),
        F.lit(0).cast("long").alias("pos"),
        F.lit("").alias("code"),
        F.lit(0).cast("long").alias("chars"),
    )


# -------------------------------------------------------------------- paths


def _chain(batches):
    """Prefix digests of messages that come in order, a conversation after another."""
    schema = pa.schema(
        [
            ("conv_id", pa.int64()),
            ("depth", pa.int64()),
            ("node", pa.string()),
            ("parent", pa.string()),
            ("chars", pa.int64()),
            ("last", pa.bool_()),
        ]
    )
    blake, held, node, depth = hashlib.blake2b, None, None, 0
    for batch in batches:
        out = []
        convs, parts, codes, chars = (batch.column(c).to_pylist() for c in ("conv_id", "part", "code", "chars"))
        for conv, part, code, size in zip(convs, parts, codes, chars):
            if held is not None:
                out.append((*held, part < 0))
            if part < 0:
                node, parent, depth = ROOT, None, 0
            else:
                parent, depth = node, depth + 1
                node = blake(bytes.fromhex(node + code), digest_size=16).hexdigest()
            held = (conv, depth, node, parent, size)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
    if held is not None:
        yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip((*held, True), schema)], schema=schema)


def paths(conversations: DataFrame) -> DataFrame:
    """A row for every prefix of every conversation, the empty one included:
    ``node`` and ``parent`` (digests), ``depth``, ``chars`` of the last text, and
    whether it is the ``last``, the conversation as a whole."""
    ordered = conversations.repartition("conv_id").sortWithinPartitions("conv_id", "part", "pos")
    return ordered.select("conv_id", "part", "code", "chars").mapInArrow(_chain, PATHS)


# -------------------------------------------------------------------- nodes


def _keys(digests: pa.ChunkedArray) -> np.ndarray:
    """Digests as rows of two numbers; a null is zero, which is the root's."""
    text = "".join(digests.fill_null(ROOT).to_pylist())
    return np.frombuffer(bytes.fromhex(text), np.uint64).reshape(-1, 2)


def _accumulate(table: pa.Table) -> pa.Table:
    """Totals of a shard's nodes. What earlier shards found below a node comes with it."""
    column = lambda name: table[name].to_numpy()
    keys = _keys(table["node"])
    hashed = PerfectHash(keys)
    slots, n = hashed.slots, len(keys)

    def scattered(values: np.ndarray) -> np.ndarray:
        flat = np.empty(n, np.int64)
        flat[slots] = values
        return flat

    parent = np.where(table["parent"].is_null().to_numpy(), -1, hashed.lookup(_keys(table["parent"])))
    top = table["node"].to_numpy() == table["component"].to_numpy()
    parent = scattered(np.where(top, -1, parent))
    if ((parent < 0) != scattered(top).astype(bool)).any():
        raise ValueError("a node's parent is not in its shard")
    depth = scattered(column("depth"))
    children = scattered(column("more_children")) + np.bincount(parent[parent >= 0], minlength=n)
    leaves = scattered(column("more_leaves")) + (children == 0)
    saved = scattered(column("more_saved")) + scattered((column("n_convs") - 1) * column("chars"))
    by_depth = np.argsort(depth, kind="stable")
    bounds = np.flatnonzero(np.diff(depth[by_depth])) + 1
    for level in reversed(np.split(by_depth, bounds)):
        level = level[parent[level] >= 0]
        np.add.at(leaves, parent[level], leaves[level])
        np.add.at(saved, parent[level], saved[level])
    kept = ["node", "parent", "depth", "conv_id", "parent_conv_id", "n_convs"]
    out = {name: table[name] for name in kept}
    out |= {"n_children": children[slots], "n_leaves": leaves[slots], "saved_tokens": saved[slots], "top": top}
    out |= {name: table[name] for name in ("above_tier", "above_block")}
    return pa.table(out)


def trie(rows: DataFrame) -> DataFrame:
    """The nodes of ``paths``: ``node`` and ``parent``, ``depth``, ``conv_id`` (the
    least member), ``parent_conv_id``, ``n_convs`` (members), ``n_children``,
    ``n_leaves`` (childless nodes of the subtree, itself included) and
    ``saved_tokens`` (code points of last texts that the subtree's nodes need not
    hold more than once)."""
    spark = rows.sparkSession
    members = rows.groupBy("node").agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("least"))
    rows = join_counted(rows.drop("last"), members, ["node"], "n_convs", "conv_id")
    tier = F.floor((F.length(F.bin("n_convs")) - 1) / TIER_BITS)
    rows = rows.withColumn("tier", tier).withColumn("block", F.floor(F.col("depth") / DEPTHS))
    down = W.partitionBy("conv_id").orderBy("depth")
    rows = rows.withColumns(
        {
            "parent_conv_id": F.lag("least").over(down),
            "above_tier": F.lag("tier").over(down),
            "above_block": F.lag("block").over(down),
        }
    )
    begins = ~(F.col("above_tier").eqNullSafe(F.col("tier")) & F.col("above_block").eqNullSafe(F.col("block")))
    component = F.last(F.when(begins, F.col("node")), ignorenulls=True)
    rows = rows.withColumn("component", component.over(down.rowsBetween(W.unboundedPreceding, 0)))
    nodes = cut(rows.where(F.col("conv_id") == F.col("least")).drop("least"))

    # As many rounds as tiers, times the thousands of the greatest depth.
    rounds = nodes.groupBy("tier", "block").count().collect()
    shuffled = int(spark.conf.get("spark.sql.shuffle.partitions"))
    done = spark.createDataFrame([], TOTALS)
    for tier, block, n in sorted(rounds, key=lambda r: (r[0], -r[1])):
        below = (
            done.where(F.col("top") & (F.col("above_tier") == tier) & (F.col("above_block") == block))
            .groupBy(F.col("parent").alias("node"))
            .agg(
                F.count("*").alias("more_children"),
                F.sum("n_leaves").alias("more_leaves"),
                F.sum("saved_tokens").alias("more_saved"),
            )
        )
        shards = max(shuffled, -(-n // SHARD_NODES))
        here = (
            nodes.where((F.col("tier") == tier) & (F.col("block") == block))
            .join(below, "node", "left")
            .fillna(0, ["more_children", "more_leaves", "more_saved"])
            .withColumn("shard", F.pmod(F.xxhash64("component"), F.lit(shards)))
        )
        done = done.unionByName(cut(here.groupBy("shard").applyInArrow(_accumulate, TOTALS)))
    return done.drop("top", "above_tier", "above_block")


# --------------------------------------------------------------------- ends


def _pieces(batches):
    """Ids of a node that follow each other, as comma-joined text of bounded length."""
    node, ids = None, []

    def piece():
        text = ",".join(map(str, ids))
        return pa.RecordBatch.from_pydict({"node": [node], "first": [ids[0]], "ids": [text]})

    for batch in batches:
        for here, conv in zip(batch.column("node").to_pylist(), batch.column("conv_id").to_pylist()):
            if here != node or len(ids) == PIECE:
                if ids:
                    yield piece()
                node, ids = here, []
            ids.append(conv)
    if ids:
        yield piece()


def _hashed(batches):
    """SHA-256 of a node's pieces, in order."""
    node, state, out = None, None, []
    for batch in batches:
        for here, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist()):
            if here != node:
                if node is not None:
                    out.append((node, state.hexdigest()))
                node, state = here, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        if out:
            yield pa.RecordBatch.from_pydict(dict(zip(("node", "ends_sha256"), map(list, zip(*out)))))
            out = []
    if node is not None:
        yield pa.RecordBatch.from_pydict({"node": [node], "ends_sha256": [state.hexdigest()]})


def ends(rows: DataFrame) -> DataFrame:
    """``node`` and ``ends_sha256``, the hash of the ascending ids, joined by commas,
    of the conversations that end there; nodes at which none ends have no row."""
    last = rows.where("last").select("node", "conv_id")
    # Dealt by node and id, so that the ids of one node are sorted in many tasks.
    dealt = last.repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id")
    pieces = dealt.mapInArrow(_pieces, "node string, first long, ids string")
    ordered = pieces.repartition("node").sortWithinPartitions("node", "first")
    return ordered.select("node", "ids").mapInArrow(_hashed, "node string, ends_sha256 string")


def node_table(conversations: DataFrame) -> DataFrame:
    """The nodes with the hash of the ids of the conversations that end there (of an
    empty text if there is none). ``conversations`` as from ``rebuilt``."""
    rows = cut(paths(conversations))
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return (
        trie(rows)
        .join(ends(rows), "node", "left")
        .withColumn("ends_sha256", F.coalesce("ends_sha256", none))
    )
