"""Groups of linked rows: connected components, and the star-shaped search for links inside buckets.

Everything here is DataFrame operations over narrow tables of 64-bit ids; each step ends in a written table, so that
lost executors cost one step, and no bucket, group or list of links ever sits in one task or on the driver.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.runtime import discard, written

#: Rows of a bucket that one task compares with the bucket's centres.
SLICE = 1024
#: The most ids that are broadcast, 8 MB of them.
NAMED = 1 << 20


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One contraction step: the neighbours of each node are tied to the least of them."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    seen = both if large else both.filter("v < u")
    least = seen.groupBy("u").agg(F.min("v").alias("_m")).select(F.col("u").alias("_u"), F.least("u", "_m").alias("_m"))
    tied = seen.join(least, F.col("u") == F.col("_u"))
    if large:
        out = tied.filter("v > u AND v <> _m").select(F.col("v").alias("u"), F.col("_m").alias("v"))
        # a node that is its own least keeps its edges, which the filter above leaves as (v, u)
        return out.distinct()
    out = tied.filter("v <> _m").select(F.col("v").alias("u"), F.col("_m").alias("v"))
    return out.unionByName(least.filter("_u <> _m").select(F.col("_u").alias("u"), F.col("_m").alias("v"))).distinct()


def components(edges: DataFrame, a: str = "u", b: str = "v") -> DataFrame:
    """(node, comp) for every node of ``edges`` that isn't the least of its component.

    Alternates the large-star and small-star steps until the edges are stars on the least nodes; the number of rounds
    grows with the logarithm of the size of a component.
    """
    now = written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct(), "edges")
    state = _state(now)
    while state[0]:
        large = written(_star(now, True), "large")
        after = written(_star(large, False), "small")
        discard(now)
        discard(large)
        now, before, state = after, state, _state(after)
        if state == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("comp"))


def beside(pairs: DataFrame, table: DataFrame, key: str, value: str, made: tuple[str, str]) -> DataFrame:
    """``pairs`` (_a, _b) with the ``value`` of both from ``table`` as ``made``; rows that no pair names stay where they are.

    The ids that pairs name are broadcast only up to NAMED; past that the table is joined whole, which costs more shuffle
    and gives the same rows.
    """
    named = written(pairs.select(F.explode(F.array("_a", "_b")).alias("_k")).distinct(), "named")
    if named.count() <= NAMED:
        table = table.join(F.broadcast(named), F.col(key) == F.col("_k"), "left_semi")
    a, b = (table.select(F.col(key).alias(x), F.col(value).alias(m)) for x, m in zip(("_a", "_b"), made, strict=True))
    return pairs.join(b, "_b").join(a, "_a")


def star_components(members: DataFrame, verify: Callable[[DataFrame], DataFrame], worth: str | None = None) -> DataFrame:
    """Components of the links that hold between rows that share a bucket: (node, comp), without the least nodes.

    ``members`` has ``bucket`` and ``rid`` (long, distinct pairs) and any payload columns. ``worth`` is an optional SQL
    condition on a pair's payload (``a_<column>`` and ``b_<column>``) that a link can't do without. ``verify`` takes pairs
    (_a, _b and their components) and returns those that are links.

    In each round a bucket has a few centres, and each of its rows is compared with them. A centre has then met all the
    bucket and leaves it; what is left of a bucket is dropped once its rows are of one component, since a pair that hasn't
    met has both its rows left. The first centre is the row that shares buckets with most others: in a group of near
    copies that is close to the text they were all made from, and nearly all of the group links to it. Later centres, up
    to eight times as many in each round, are taken only from outside a bucket's largest component. So all links between
    different components of a bucket are found, for as many pairs as rows outside the largest component times the bucket,
    not the square of its size. A bucket's rows are dealt to several tasks, SLICE to a task, and its centres to each.
    """
    payload = [c for c in members.columns if c not in ("bucket", "rid")]
    sizes = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("_c")).filter("_c > 1")
    shared = written(members.join(sizes, "bucket"), "shared")
    weight = shared.groupBy("rid").agg(F.sum("_c").alias("_w"))
    slices = F.ceil(F.col("_c") / SLICE).cast("int")
    now = written(shared.join(weight, "rid").withColumns({"_slices": slices, "_slice": F.pmod(F.xxhash64("rid"), slices).cast("int"), "_comp": F.col("rid")}).drop("_c"), "open")
    discard(shared)
    comps: DataFrame | None = None
    slots = 1
    while not now.isEmpty():
        able = now
        if slots > 1:
            groups = now.groupBy("bucket", "_comp").agg(F.count(F.lit(1)).alias("_n"))
            top = groups.groupBy(F.col("bucket").alias("_bucket")).agg(F.max_by("_comp", F.struct("_n", "_comp")).alias("_top"))
            able = now.join(top, (F.col("bucket") == F.col("_bucket")) & (F.col("_comp") != F.col("_top"))).drop("_bucket", "_top")
        slot = F.pmod(F.xxhash64("rid", F.lit(slots)), F.lit(slots))
        best = F.max_by(F.struct("rid", "_comp", "_slices", *payload), F.struct("_w", -F.col("rid")))
        centres = able.groupBy("bucket", slot.alias("_slot")).agg(best.alias("_x")).select(F.col("bucket").alias("_bucket"), "_x.*")
        centres = written(centres.select("_bucket", "_slices", F.col("rid").alias("_a"), F.col("_comp").alias("_acomp"), *(F.col(c).alias(f"a_{c}") for c in payload)), "centres")
        dealt = centres.withColumn("_at", F.explode(F.sequence(F.lit(0), F.col("_slices") - 1))).drop("_slices")
        pairs = now.join(dealt, (F.col("bucket") == F.col("_bucket")) & (F.col("_slice") == F.col("_at")) & (F.col("_comp") != F.col("_acomp")))
        pairs = pairs.withColumnsRenamed({c: f"b_{c}" for c in payload})
        if worth:
            pairs = pairs.filter(worth)
        swap = F.col("_a") > F.col("rid")
        met = F.when(swap, F.struct(F.col("rid").alias("_a"), F.col("_a").alias("_b"), F.col("_comp").alias("ca"), F.col("_acomp").alias("cb")))
        met = met.otherwise(F.struct(F.col("_a").alias("_a"), F.col("rid").alias("_b"), F.col("_acomp").alias("ca"), F.col("_comp").alias("cb")))
        pairs = written(pairs.select(met.alias("_x")).select("_x.*").distinct(), "pairs")
        links = written(verify(pairs).select("ca", "cb").distinct(), "links")
        left = now.join(centres.select(F.col("_bucket").alias("_b"), F.col("_a").alias("_r")), (F.col("bucket") == F.col("_b")) & (F.col("rid") == F.col("_r")), "left_anti")
        if not links.isEmpty():
            # components of components: only those that a link joins move
            moved = components(links, "ca", "cb")
            onto = moved.select(F.col("node").alias("_from"), F.col("comp").alias("_to"))
            left = left.join(onto, F.col("_comp") == F.col("_from"), "left").withColumn("_comp", F.coalesce("_to", "_comp")).drop("_from", "_to")
            if comps is None:
                comps = moved
            else:
                carried = comps.join(onto, F.col("comp") == F.col("_from"), "left").select("node", F.coalesce("_to", "comp").alias("comp"))
                comps = written(carried.unionByName(moved), "components")
        left = written(left, "left")
        still = left.groupBy("bucket").agg(F.min("_comp").alias("_lo"), F.max("_comp").alias("_hi")).filter("_lo <> _hi").select("bucket")
        after = written(left.join(still, "bucket"), "open")
        for done in (now, centres, pairs, links, left):
            discard(done)
        now, slots = after, slots * 8
    if comps is None:
        return now.select(F.col("rid").alias("node"), F.col("_comp").alias("comp"))
    return comps
