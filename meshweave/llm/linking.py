"""Connected groups: alternating large-star and small-star, and links found in buckets without emitting all pairs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Buckets of more than this share of all members (one in HOT), and of LEAST_HOT members, are joined without a shuffle.
HOT, LEAST_HOT = 1000, 500


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """The component of every node of links(a, b): rows (node, comp), comp being the component's smallest node.

    Each node with its neighbours is a star; large-star hangs larger neighbours on the star's smallest node, small-star
    the smaller ones and the node itself, until nothing changes. Neighbourhoods are never gathered: a star's smallest
    node is an aggregate, written out and joined back, so that a join with a huge star can be split.
    """
    edges = scratch.save(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = None
    while (now := edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()) != state:
        state = now
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = scratch.save(both.groupBy("u").agg(F.min("v").alias("m")))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        large = scratch.save(large.where("u <> v").distinct())
        scratch.drop(low, edges)
        low = scratch.save(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        edges = scratch.save(small.where("u <> v").distinct())
        scratch.drop(low, large)
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct()
    out = scratch.save(edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(roots))
    scratch.drop(edges)
    return out


def join_buckets(members: DataFrame, keys: DataFrame) -> DataFrame:
    """members joined with keys(bucket, n, ...), n being the bucket's number of members.

    Buckets of more than a HOT-th of all members, fewer than HOT therefore, are broadcast, so that their members are
    joined where they lie; a task of the shuffle for the others gets no group larger than that share.
    """
    most = max(LEAST_HOT, members.count() // HOT)
    hot, cold = keys.where(F.col("n") > most), keys.where(F.col("n") <= most)
    rest = members.join(F.broadcast(hot.select("bucket")), "bucket", "left_anti")
    return rest.join(cold.hint("shuffle_hash"), "bucket").union(members.join(F.broadcast(hot), "bucket")).drop("n")


def _with_pivots(members: DataFrame, carry: tuple[str, ...], scratch: Scratch) -> DataFrame:
    """Members of buckets that hold two nodes or more, each its own component, with the bucket's smallest node (pivot)."""
    carried = [F.min_by(c, "node").alias(f"pivot_{c}") for c in carry]
    pivots = members.groupBy("bucket").agg(F.count("*").alias("n"), F.min("node").alias("pivot"), F.max("node").alias("last"), *carried)
    pivots = scratch.save(pivots.where("pivot < last").drop("last"))
    rows = join_buckets(members, pivots)
    out = scratch.save(rows.select("bucket", "node", *carry, F.col("node").alias("comp"), "pivot", F.col("pivot").alias("pivot_comp"), *[f"pivot_{c}" for c in carry]))
    scratch.drop(pivots)
    return out


def _beside_largest(members: DataFrame, scratch: Scratch) -> DataFrame:
    """The same with each bucket's largest component, in the column `largest`."""
    counts = members.groupBy("bucket", "comp").agg(F.count("*").alias("m"))
    keys = counts.groupBy("bucket").agg(F.max_by("comp", F.struct("m", "comp")).alias("largest"), F.count("*").alias("comps"), F.sum("m").alias("n"))
    keys = scratch.save(keys.where("comps > 1").drop("comps"))
    out = scratch.save(join_buckets(members, keys))
    scratch.drop(keys)
    return out


def link_buckets(
    members: DataFrame,
    verify: Callable[[DataFrame], DataFrame],
    scratch: Scratch,
    prepare: Callable[[DataFrame], None] | None = None,
    finish: Callable[[DataFrame], DataFrame] | None = None,
    carry: tuple[str, ...] = (),
    near: Column | None = None,
) -> DataFrame:
    """Components of all links between nodes that share a bucket: rows (node, comp) of the nodes that have a link.

    members(bucket, node) says who is in which bucket; verify(pairs(a, b)) keeps the pairs that are links. In each
    round every bucket compares some of its nodes (pivots) with all its others, but for those that are connected
    already; then the pivots leave. After the first round pivots are members outside the bucket's largest
    component: a pair of two components has one of these, so a bucket ends when none is left. A large bucket of one
    group thus costs about its size, and still no pair of two groups goes untested. Pivots increase sixteenfold each
    round.

    prepare(active members) is called once, before the first round. finish(active(bucket, node, comp)), if given, takes
    over after the first round and returns all links between the components that are left. `carry` are further numbers
    of members, and `near` a condition that candidate pairs must meet in their bucket, on those columns and on the
    pivot's (pivot_<column>).
    """
    active = _with_pivots(members, carry, scratch)
    if prepare:
        prepare(active)
    labels = scratch.save(members.sparkSession.createDataFrame([], "node bigint, comp bigint"))
    links, pivots_each = None, 1
    while not active.isEmpty():
        if finish and pivots_each > 1:
            found = scratch.save(finish(active))
            links = found if links is None else links.union(found)
            break
        if pivots_each == 1:
            met = active
            rest = active.where("node <> pivot").select("bucket", "node", *carry)
        else:
            part = F.pmod(F.xxhash64("node", F.lit(pivots_each)), F.lit(pivots_each))
            pivots = active.where("comp <> largest").groupBy("bucket", part.alias("part")).agg(F.min("node").alias("pivot"), *[F.min_by(c, "node").alias(f"pivot_{c}") for c in ("comp", *carry)]).drop("part")
            pivots = scratch.save(pivots)
            met = active.join(pivots, "bucket")
            rest = active.drop("largest").join(pivots.select("bucket", F.col("pivot").alias("node")), ["bucket", "node"], "left_anti")
        fits = F.lit(True) if near is None else near
        apart = (F.col("comp") != F.col("pivot_comp")) & fits
        pair = [F.least("node", "pivot").alias("a"), F.greatest("node", "pivot").alias("b")]
        if pivots_each == 1:
            # one pivot for each node first: what is connected by that needn't meet the pivots of its other buckets
            links = scratch.save(verify(met.where(apart).groupBy("node").agg(F.min("pivot").alias("pivot")).select(*pair)))
            firsts = components(links, scratch)
            known = met.select("bucket", "node", *carry, "pivot", *[f"pivot_{c}" for c in carry])
            for side, name in (("node", "comp"), ("pivot", "pivot_comp")):
                named = firsts.select(F.col("node").alias(side), F.col("comp").alias("_comp"))
                known = known.join(named, side, "left").withColumn(name, F.coalesce("_comp", side)).drop("_comp")
            met = known
        found = scratch.save(verify(met.where(apart).select(*pair).distinct()))
        links = found if links is None else links.union(found)
        if pivots_each == 1:
            scratch.drop(firsts)
            old, labels = labels, components(links, scratch)
            scratch.drop(old)
            rest = rest.join(labels, "node", "left").select("bucket", "node", *carry, F.coalesce("comp", "node").alias("comp"))
        rest = scratch.save(rest)
        old, active = active, _beside_largest(rest, scratch)
        scratch.drop(old, rest, *([] if pivots_each == 1 else [pivots]))
        pivots_each *= 16
    if pivots_each > 1:
        old, labels = labels, components(links, scratch)
        scratch.drop(old)
    return labels
