"""Prefix trie of conversations.

Every prefix of every conversation has a digest. The smallest conversation with a digest owns that node, and whoever owns
a prefix owns its longer ones, so a conversation's owned nodes are a chain from its first owned depth to its end. That depth
is found by binary search, all conversations' steps in one join a round against the minima by digest. Chains hang from nodes
of other chains; their sums are carried up by doubling, and a running sum along each chain gives its nodes' subtrees.

Conversations of any length are cut into blocks for running values, so that none has to fit one task.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import batch_of, discard, join_by_share, map_arrow, materialize

BLOCK = 4096


def positions(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, pos, digest, bytes) of each turn, pos from 0 in the order of turn (null first); ties go by the turn's digest.

    Null roles and texts are empty; rows without a conversation are left out. Turns are dealt by ranges of conversation
    and turn: each range numbers its own rows, and of those that begin inside a conversation (as many as there are ranges,
    at most) the rows before are added.
    """
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in (role_col, text_col))
    marked = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    rows = turns.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), F.unhex(F.sha2(marked.cast("binary"), 256)).alias("digest"), F.octet_length(text).cast("long").alias("bytes"))
    order = [F.col("turn").asc_nulls_first(), F.col("digest")]
    dealt = materialize(rows.repartitionByRange(parts, "conv", *order).withColumn("part", F.spark_partition_id()), "turns")
    before = F.sum("n").over(Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    later = dealt.groupBy("conv", "part").agg(F.count("*").alias("n")).withColumn("before", before).where("before > 0").select("conv", "part", "before")
    own = F.row_number().over(Window.partitionBy("conv", "part").orderBy(*order)) - 1
    numbered = dealt.withColumn("own", own).join(F.broadcast(later), ["conv", "part"], "left")
    return numbered.select("conv", (F.col("own") + F.coalesce("before", F.lit(0))).alias("pos"), "digest", "bytes")


def sequences(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations as they are: (conv, depth from 1, digest, bytes, len) and (conv, len)."""
    convs = materialize(found.groupBy("conv").agg(F.count("*").alias("len")), "conversations")
    rows = join_by_share(found, convs, ["conv"], "len")
    return rows.select("conv", (F.col("pos") + 1).alias("depth"), "digest", "bytes", "len"), convs


def grafted(found: DataFrame, group: int = 5, spread: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt on a shared start, in the form of `sequences`.

    Conversation c gets the first h turns of conversation c - c % group (the remainder has c's sign), then its own turns
    after its first h; h is crc32 of c's decimal digits modulo spread. All conversations stay, those without turns too.
    """
    heads = F.pmod(F.crc32(F.col("conv").cast("string").cast("binary")), F.lit(spread))
    own = found.groupBy("conv").agg(F.count("*").alias("n")).withColumn("h", heads).withColumn("base", F.col("conv") - F.col("conv") % group)
    own = materialize(own, "conversations")
    head = F.least("h", F.coalesce("nb", F.lit(0)))
    tail = F.greatest(F.col("n") - F.col("h"), F.lit(0))
    convs = own.join(own.selectExpr("conv AS base", "n AS nb"), "base", "left").select("conv", "base", "h", "n", head.alias("head"), (head + tail).alias("len"))
    convs = materialize(convs, "conversations")
    starts = found.where(F.col("pos") < spread - 1).withColumnRenamed("conv", "base")
    first = convs.join(starts, "base").where(F.col("pos") < F.col("h")).select("conv", (F.col("pos") + 1).alias("depth"), "digest", "bytes", "len")
    rest = join_by_share(found, convs, ["conv"], "n").where(F.col("pos") >= F.col("h"))
    rest = rest.select("conv", (F.col("pos") - F.col("h") + F.col("head") + 1).alias("depth"), "digest", "bytes", "len")
    return first.unionByName(rest), convs.select("conv", "len")


def running(rows: DataFrame, key: str, place: Column, values: dict[str, tuple], block: int) -> DataFrame:
    """Add running values along `place` (whole numbers, no ties) of each key: values has name -> (aggregate, combine, column).

    Two levels: in blocks of `block` places, and over the blocks of a key. Keys of one block need no second step.
    """
    rows = rows.withColumn("_place", place).withColumn("_block", F.floor(F.col("_place") / block))
    inner = Window.partitionBy(key, "_block").orderBy("_place").rowsBetween(Window.unboundedPreceding, 0)
    outer = Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy(key, "_block").agg(*[f(c).alias(f"_{name}") for name, (f, _, c) in values.items()])
    blocks = blocks.select(key, "_block", *[f(f"_{name}").over(outer).alias(f"_{name}") for name, (f, _, _) in values.items()])
    blocks = blocks.where(" OR ".join(f"_{name} IS NOT NULL" for name in values))
    out = rows.select("*", *[f(c).over(inner).alias(f"_own_{name}") for name, (f, _, c) in values.items()]).join(blocks, [key, "_block"], "left")
    both = {name: combine(F.col(f"_own_{name}"), F.coalesce(f"_{name}", F.lit(0).cast("long"))) for name, (_, combine, _) in values.items()}
    return out.select(*[c for c in rows.columns if c not in ("_place", "_block")], *[c.alias(name) for name, c in both.items()])


def prefixes(rows: DataFrame, convs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(conv, depth, a, b, bytes, len) for depths 0 to len: a and b digest the first `depth` turns.

    The digest of a prefix is the exclusive or of two 64-bit hashes of each (depth, turn): running and associative.
    """
    xor = lambda x, y: x.bitwiseXOR(y)
    values = {lane: (F.bit_xor, xor, F.xxhash64(F.lit(k), "depth", "digest")) for k, lane in enumerate("ab")}
    found = running(rows, "conv", F.col("depth") - 1, values, block).select("conv", "depth", "a", "b", "bytes", "len")
    zero = F.lit(0).cast("long")
    return found.unionByName(convs.select("conv", zero.alias("depth"), zero.alias("a"), zero.alias("b"), zero.alias("bytes"), "len"))


def first_owned(nodes: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv, first) for the conversations that own a node: their first owned depth.

    Binary search over depths 0 to len + 1, where everyone owns len + 1: a conversation owns a depth if it is the minimum of
    some digest there, and all deeper ones with it. One join a round, unique on both sides.
    """
    states = convs.select("conv", "len", F.lit(0).cast("long").alias("lo"), (F.col("len") + 1).alias("hi"))
    most = convs.agg(F.max("len")).first()[0] or 0
    owned = nodes.selectExpr("owner AS conv", "depth AS mid", "true AS owns")
    for _ in range((most + 1).bit_length()):
        asked = states.withColumn("mid", F.expr("(lo + hi) div 2")).join(owned.hint("merge"), ["conv", "mid"], "left")
        yes, no = F.col("owns").isNotNull(), F.col("owns").isNull()
        more = F.col("lo") < F.col("hi")
        done = asked.select("conv", "len", F.when(more & no, F.col("mid") + 1).otherwise(F.col("lo")).alias("lo"), F.when(more & yes, F.col("mid")).otherwise(F.col("hi")).alias("hi"))
        before, states = states, materialize(done, "search")
        discard(before)
    return states.where("lo <= len").select("conv", F.col("lo").alias("first"))


def carried_up(chains: DataFrame) -> DataFrame:
    """Sums of leaves and saved over each chain and all that hang below it. chains: conv, first, parent (null: root), sums.

    Round k adds the sums of the chains 2^k steps below, which then hold all less than 2^(k + 1) steps below.
    """
    held, state = chains, chains.withColumn("jump", F.col("parent"))
    while True:
        below = state.where("jump IS NOT NULL").groupBy("jump").agg(F.sum("leaves").alias("l"), F.sum("saved").alias("s"), F.count("*").alias("k"))
        below = materialize(below, "below")
        if below.isEmpty():
            return state.drop("jump")
        targets = state.select(F.col("conv").alias("jump"), F.col("jump").alias("next")).join(below.select("jump", "k"), "jump")
        hops = join_by_share(state.where("jump IS NOT NULL").select("conv", "jump"), targets, ["jump"], "k").select("conv", "next")
        sums = below.select(F.col("jump").alias("conv"), "l", "s")
        state = state.join(sums, "conv", "left").join(hops, "conv", "left")
        zero = F.lit(0)
        before, state = held, materialize(state.select("conv", "first", "parent", (F.col("leaves") + F.coalesce("l", zero)).alias("leaves"), (F.col("saved") + F.coalesce("s", zero)).alias("saved"), F.col("next").alias("jump")), "chains")
        discard(before, below)
        held = state


def end_digests(ends: DataFrame, most: int = 1 << 16) -> DataFrame:
    """(depth, a, b, ends_sha256) from (depth, a, b, conv): sha256 of each node's decimal ids, ascending, joined by commas.

    Ids are dealt and sorted by ranges and joined to texts of up to `most` characters, wherever a range begins; a node's
    texts then pass through one running hash, so that none of its lists is ever held.
    """
    key, parts = ["depth", "a", "b"], int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fields = [("depth", pa.int64()), ("a", pa.int64()), ("b", pa.int64())]
    pieces_of, hashes_of = pa.schema([*fields, ("at", pa.int64()), ("ids", pa.string())]), pa.schema([*fields, ("ends_sha256", pa.string())])

    def join(batches):
        node, held, size = None, [], 0
        for batch in batches:
            out = []
            for *at, conv in zip(*(batch.column(c).to_pylist() for c in (*key, "conv")), strict=True):
                if held and (at != node or size >= most):
                    out.append((*node, held[0], ",".join(map(str, held))))
                    held, size = [], 0
                node = at
                held.append(conv)
                size += 1 + len(str(conv))
            if out:
                yield batch_of(pieces_of, *zip(*out, strict=True))
        if held:
            yield batch_of(pieces_of, *[[x] for x in (*node, held[0], ",".join(map(str, held)))])

    def digest(batches):
        node, running = None, None
        for batch in batches:
            out = []
            for *at, ids in zip(*(batch.column(c).to_pylist() for c in (*key, "ids")), strict=True):
                if at != node:
                    if node is not None:
                        out.append((*node, running.hexdigest()))
                    node, running = at, hashlib.sha256(ids.encode())
                else:
                    running.update(b"," + ids.encode())
            if out:
                yield batch_of(hashes_of, *zip(*out, strict=True))
        if node is not None:
            yield batch_of(hashes_of, *[[x] for x in (*node, running.hexdigest())])

    dealt = ends.select(*key, "conv").repartitionByRange(parts, *key, "conv").sortWithinPartitions(*key, "conv")
    pieces = map_arrow(dealt, join, "depth long, a long, b long, at long, ids string")
    return map_arrow(pieces.repartition(*key).sortWithinPartitions(*key, "at"), digest, "depth long, a long, b long, ends_sha256 string")


def prefix_trie(rows: DataFrame, convs: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row for each distinct prefix: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256, all but the last long.

    rows: (conv, depth, digest, bytes, len), convs: (conv, len), as `sequences` or `grafted` make them. The root, depth 0, has
    all conversations, those without turns too. saved_tokens sums (n_convs - 1) * bytes of the last text over the subtree.
    Edge cases: null roles and texts are empty; turns with the same number go by their digest, null numbers come first, and
    repeated rows are turns like others; rows without a conversation are left out; other columns are ignored; an empty table
    has no node.
    """
    found = materialize(prefixes(rows, convs, block), "prefixes")
    node = ["depth", "a", "b"]
    nodes = found.groupBy(*node).agg(F.min(F.struct("conv", "len")).alias("o"), F.count("*").alias("n"), F.first("bytes").alias("bytes"))
    nodes = materialize(nodes.select(*node, F.col("o.conv").alias("owner"), F.col("o.len").alias("len"), "n", "bytes"), "nodes")
    first = materialize(first_owned(nodes, convs), "first")
    # the node above each chain's top: its digest, then whose it is
    above = found.join(first.selectExpr("conv", "first", "first - 1 AS depth"), ["conv", "depth"]).select("conv", "first", *node)
    hangs = join_by_share(above, nodes.select(*node, "owner", "n"), node, "n").select("conv", "first", F.col("owner").alias("parent"))
    hangs = materialize(hangs, "hangs")
    place = [F.col("parent").alias("owner"), (F.col("first") - 1).alias("depth")]
    hung = materialize(hangs.groupBy(*place).agg(F.count("*").alias("k")), "hung")
    own = nodes.join(hung, ["owner", "depth"], "left").groupBy("owner").agg(
        F.sum((F.col("n") - 1) * F.col("bytes")).alias("saved"), F.sum(F.when((F.col("depth") == F.col("len")) & F.col("k").isNull(), 1).otherwise(0)).alias("leaves")
    )
    chains = first.join(own, first.conv == own.owner).join(hangs.select("conv", "parent"), "conv", "left").select("conv", "first", "parent", "leaves", "saved")
    totals = carried_up(materialize(chains, "chains"))
    below = totals.where("parent IS NOT NULL").groupBy(*place).agg(F.count("*").alias("k"), F.sum("leaves").alias("l"), F.sum("saved").alias("s"))
    tops = hangs.select(F.col("conv").alias("owner"), F.col("first").alias("depth"), "parent")
    each = nodes.join(below, ["owner", "depth"], "left").join(tops, ["owner", "depth"], "left")
    zero, inner = F.lit(0).cast("long"), F.col("depth") < F.col("len")
    each = each.select(
        *node, "owner", F.when(F.col("depth") > 0, F.coalesce("parent", "owner")).alias("parent_conv_id"), F.col("n").alias("n_convs"),
        (F.coalesce("k", zero) + F.when(inner, 1).otherwise(0)).alias("n_children"),
        (F.coalesce("l", zero) + F.when(~inner & F.col("k").isNull(), 1).otherwise(0)).alias("own_leaves"),
        (F.coalesce("s", zero) + (F.col("n") - 1) * F.col("bytes")).alias("own_saved"),
    )
    add = lambda x, y: x + y
    each = running(each, "owner", -F.col("depth"), {"n_leaves": (F.sum, add, F.col("own_leaves")), "saved_tokens": (F.sum, add, F.col("own_saved"))}, block)
    ends = end_digests(found.where("depth = len").select(*node, "conv"))
    none = hashlib.sha256(b"").hexdigest()
    return each.join(ends, node, "left").select(
        F.col("owner").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256")
    )
