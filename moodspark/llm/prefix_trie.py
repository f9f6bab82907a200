"""Conversation prefix trie by depth-band rollup.

Every conversation is rebuilt (a few turns of its base conversation, then its
own), and each distinct sequence of first d turns is a node of depth d. A node's
key is the exclusive or of its turns' position-tagged digests, so that keys of
all prefixes are running values that split into blocks; a conversation holding
a third of all turns is cut by the dense index and by ``STRIDE`` turns.

Totals over subtrees: depths are cut into bands of ``BAND``. A node's weight goes
to its ancestors within its band only; those on one conversation's path are
summed first, so a path and a band make at most ``BAND`` rows. Band roots form
a trie of their own, whose depths are cut into bands again, and so on: with
depth D there are log_BAND(D) levels up. On the way down, each completed band
root adds its total to the nodes of the band above it on its path. Neither the
rounds nor the rows per node grow with the depth.

Cases: rows without conv_id belong to no conversation and take no part; null
role or text is empty; turns with the same number are ordered by the digest of
role and text, repeated rows follow each other and all count; a conversation
left without turns is a member of the root alone; very long texts are digested
where they lie and never shuffled; an empty table has no nodes; further
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moodspark.operators.ordering import global_index
from moodspark.session import materialize

BAND = 16
STRIDE = 1024
KEY = ["depth", "k1", "k2"]
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()


def turn_digests(conv: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 text_col: str = "text") -> DataFrame:
    """c, turn, digest (hex, of role and text), bytes (of the text): all that is needed of a turn."""
    role, text = (F.coalesce(F.col(x).cast("string"), F.lit("")) for x in (role_col, text_col))
    packed = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    rows = conv.where(F.col(conv_col).isNotNull())
    return rows.select(F.col(conv_col).cast("long").alias("c"), F.col(turn_col).alias("turn"), F.sha2(packed, 256).alias("digest"),
                       F.octet_length(text).cast("long").alias("bytes"))


def borrowed_turns(conv_id: Column) -> Column:
    """How many turns a conversation takes over from its base: crc32 of the decimal id, modulo 9."""
    return (F.crc32(conv_id.cast("string").cast("binary")) % 9).cast("int")


def rebuilt(turns: DataFrame, borrowed: Callable[[Column], Column] = borrowed_turns, most: int = 8) -> tuple[DataFrame, DataFrame]:
    """Rebuilt turns (c, depth, digest, bytes, last) and conversations (c, length).

    ``borrowed`` gives the number of turns taken from the base conversation, at most ``most``.
    """
    placed = global_index(materialize(turns), ["c", F.col("turn").asc_nulls_first(), "digest"], "_g").drop("turn")
    own = placed.groupBy("c").agg(F.min("_g").alias("_start"), F.count("*").alias("_n"))
    own = materialize(own.withColumn("_h", borrowed(F.col("c"))).withColumn("_base", F.col("c") - F.col("c") % 5))
    base = own.select(F.col("c").alias("_base"), F.col("_n").alias("_of_base"))
    taken = F.least(F.col("_h").cast("long"), F.coalesce("_of_base", F.lit(0)))
    info = own.join(base, "_base", "left").withColumn("_taken", taken)
    info = info.withColumn("length", F.col("_taken") + F.greatest(F.col("_n") - F.col("_h"), F.lit(0)))
    # a conversation's later turns stand behind what it borrows; a long one is a hot key here, which AQE splits
    pos = (F.col("_g") - F.col("_start") + 1).alias("_pos")
    later = placed.join(info.select("c", "_start", "_h", "_taken", "length"), "c").select("*", pos).where("_pos > _h")
    later = later.select("c", (F.col("_taken") + F.col("_pos") - F.col("_h")).alias("depth"), "digest", "bytes", "length")
    # no more than `most` turns of a base go to the few conversations around it
    heads = (placed.where("c % 5 = 0").join(own.where("c % 5 = 0").select("c", "_start"), "c").select("*", pos)
             .where(F.col("_pos") <= most).select(F.col("c").alias("_base"), "_pos", "digest", "bytes"))
    first = heads.join(info.select("c", "_base", "_h", "length"), "_base").where("_pos <= _h")
    first = first.select("c", F.col("_pos").alias("depth"), "digest", "bytes", "length")
    both = later.unionByName(first)
    return both.withColumn("last", F.col("depth") == F.col("length")).drop("length"), info.select("c", "length")


def prefixes(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row per conversation and depth from 0: c, depth, k1, k2 (key of the prefix), p1, p2 (the parent's), bytes, last."""
    half = lambda at: F.conv(F.substring("digest", at, 15), 16, 10).cast("long")
    d = F.col("depth").cast("long")
    rows = turns.select("c", "depth", "bytes", "last", half(1).alias("_a"), half(16).alias("_b"))
    rows = rows.select("c", "depth", "bytes", "last", F.xxhash64(F.lit(11), d, "_a", "_b").alias("x1"), F.xxhash64(F.lit(23), "_b", "_a", d).alias("x2"))
    rows = rows.withColumn("_s", F.floor((F.col("depth") - 1) / STRIDE))
    within = Window.partitionBy("c", "_s").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    local = rows.select("*", *[F.bit_xor(x).over(within).alias(f"_l{x}") for x in ("x1", "x2")])
    before = Window.partitionBy("c").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    strides = rows.groupBy("c", "_s").agg(F.bit_xor("x1").alias("x1"), F.bit_xor("x2").alias("x2"))
    offsets = strides.select("c", "_s", *[F.coalesce(F.bit_xor(x).over(before), F.lit(0)).alias(f"_o{x}") for x in ("x1", "x2")])
    keyed = local.join(offsets, ["c", "_s"])
    k1, k2 = (F.col(f"_l{x}").bitwiseXOR(F.col(f"_o{x}")) for x in ("x1", "x2"))
    inner = keyed.select("c", "depth", k1.alias("k1"), k2.alias("k2"), k1.bitwiseXOR(F.col("x1")).alias("p1"),
                         k2.bitwiseXOR(F.col("x2")).alias("p2"), "bytes", "last")
    zero = F.lit(0).cast("long")
    roots = convs.select("c", zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), F.lit(None).cast("long").alias("p1"),
                         F.lit(None).cast("long").alias("p2"), zero.alias("bytes"), (F.col("length") == 0).alias("last"))
    return inner.unionByName(roots)


def _up(paths: DataFrame, weights: DataFrame, step: int) -> DataFrame:
    """Totals over the part of each node's subtree that lies in its band of ``step * BAND`` depths.

    ``paths`` holds the rows (c, KEY) of depths divisible by ``step``, ``weights`` (KEY, conv_id, leaves, saved) their nodes.
    """
    own = weights.select(F.col("conv_id").alias("c"), "depth", "leaves", "saved")
    band = Window.partitionBy("c", F.floor(F.col("depth") / (step * BAND))).orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    rows = paths.select("c", *KEY).join(own, ["c", "depth"], "left")
    summed = rows.select("c", *KEY, F.sum("leaves").over(band).alias("leaves"), F.sum("saved").over(band).alias("saved"))
    # a path that is a node's first (smallest) member is so further down too: without a weight below there is nothing to hand up
    return summed.where("leaves is not null").groupBy(*KEY).agg(
        F.min("c").alias("conv_id"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))


def subtree_totals(paths: DataFrame, nodes: DataFrame, deepest: int) -> DataFrame:
    """KEY, conv_id, leaves, saved of every node, summed over its whole subtree."""
    levels, step, weights = [], 1, nodes
    while True:
        at = paths if step == 1 else paths.where(F.col("depth") % step == 0)
        weights = _up(at, weights if step == 1 else weights.where(F.col("depth") % step == 0), step)
        weights = materialize(weights) if step * BAND <= deepest else weights
        levels.append((step, at, weights))
        if step * BAND > deepest:
            break
        step *= BAND
    done = levels.pop()[2]
    for step, at, part in reversed(levels):
        done = materialize(done)
        wide = step * BAND
        between = F.col("depth") % wide != 0
        roots = done.where("depth > 0").select(F.col("conv_id").alias("c"), (F.col("depth") / wide - 1).cast("long").alias("_band"), "leaves", "saved")
        handed = (at.where(between).select("c", *KEY, F.floor(F.col("depth") / wide).alias("_band")).join(roots, ["c", "_band"])
                  .select(*KEY, F.col("c").alias("conv_id"), "leaves", "saved"))
        inner = part.where(between).unionByName(handed).groupBy(*KEY).agg(
            F.min("conv_id").alias("conv_id"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
        done = inner.unionByName(done)
    return done


def _digest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """SHA-256 of each node's comma-joined chunks, which arrive in order; only the running state of one node is held."""
    now, state = None, None
    for frame in frames:
        out = []
        for key, chunk in zip(zip(*[frame[k] for k in KEY]), frame["chunk"]):
            if key == now:
                state.update(b",")
            else:
                if now is not None:
                    out.append((*now, state.hexdigest()))
                now, state = key, hashlib.sha256()
            state.update(chunk.encode())
        yield pd.DataFrame(out, columns=[*KEY, "ends_sha256"])
    if now is not None:
        yield pd.DataFrame([(*now, state.hexdigest())], columns=[*KEY, "ends_sha256"])


def ends(paths: DataFrame) -> DataFrame:
    """KEY, ends_sha256 of every node at which a conversation ends.

    Ids go into chunks of 512 neighbouring values, a node's chunks pass one
    stream in order: a digest is one chain, so this much of a hot node is in
    one task, in bounded memory.
    """
    packed = (paths.where("last").groupBy(*KEY, F.shiftright("c", 9).alias("_chunk"))
              .agg(F.array_join(F.transform(F.sort_array(F.collect_list("c")), lambda x: x.cast("string")), ",").alias("chunk")))
    stream = packed.repartition(*KEY).sortWithinPartitions(*KEY, "_chunk")
    return stream.select(*KEY, "chunk").mapInPandas(_digest, "depth long, k1 long, k2 long, ends_sha256 string")


def prefix_trie(conv: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
                borrowed: Callable[[Column], Column] = borrowed_turns, most: int = 8) -> DataFrame:
    """One row per node: conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``saved_tokens`` are the bytes of text that need no second pass when the
    members of a subtree share their prefixes.
    """
    paths = materialize(prefixes(*rebuilt(turn_digests(conv, conv_col, turn_col, role_col, text_col), borrowed, most)))
    nodes = materialize(paths.groupBy(*KEY).agg(
        F.min("c").alias("conv_id"), F.count("*").alias("n_convs"), F.min("p1").alias("p1"), F.min("p2").alias("p2"),
        F.max("bytes").alias("bytes"), F.sum(F.col("last").cast("long")).alias("n_ends")))
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    weights = nodes.select(*KEY, "conv_id", (F.col("n_ends") == F.col("n_convs")).cast("long").alias("leaves"),
                           ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"))
    totals = subtree_totals(paths, weights, deepest).select(*KEY, "leaves", "saved")
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(
        F.count("*").alias("n_children"))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    found = nodes.join(totals, KEY).join(children, KEY, "left").join(ends(paths), KEY, "left").join(parents, ["depth", "p1", "p2"], "left")
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
                        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
                        F.coalesce("ends_sha256", F.lit(EMPTY_SHA256)).alias("ends_sha256"))
