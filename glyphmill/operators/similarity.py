"""Set similarity joins, nearest profiles, groups of near-duplicates, profile purity, class centroids."""
from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from glyphmill.functions.hashing import md5_key, set_fingerprint
from glyphmill.operators.ranks import by_rows, hot_keys, maybe_among, numbered_by_hash, salted_join
from glyphmill.session import cut_lineage, drop_table


# Set similarity ------------------------------------------------------------------------------


def _cosine(common: Column, a: Column, b: Column) -> Column:
    return common / F.sqrt(a.cast("double") * b.cast("double"))


#: Members whose numbers are broadcast, at most.
FREQUENT = 1 << 16
#: Members of a set that are held in one row; a larger set is numbered in cells and held in several rows.
CELL_ROWS = 20_000


def _parts(size: Column) -> Column:
    """Rows that hold a set of this size: 1, or a power of two that leaves about ``CELL_ROWS`` / 4 members in each."""
    return F.when(size > CELL_ROWS, F.pow(F.lit(2.0), F.ceil(F.log2(size * 4.0 / CELL_ROWS)))).otherwise(F.lit(1.0)).cast("long")


def numbered_members(sets: DataFrame) -> DataFrame:
    """(member, df, code): all members numbered from rare to frequent, in one order for all sets.

    The order is by frequency, then by hash; members are numbered inside cells of a frequency and a hash prefix, and only the cells' sizes are added up
    (frequencies that differ are at most the root of twice the rows).
    """
    frequency = sets.filter(F.col("member").isNotNull()).groupBy("member").agg(F.count(F.lit(1)).alias("df"))
    keyed = frequency.select("member", "df", F.md5(F.col("member").cast("string")).alias("_h")).withColumn("_d", F.substring("_h", 1, 2))
    before = Window.orderBy("df", "_d").rowsBetween(Window.unboundedPreceding, -1)
    starts = keyed.groupBy("df", "_d").agg(F.count(F.lit(1)).alias("_n")).select("df", "_d", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    inside = Window.partitionBy("df", "_d").orderBy("_h", "member")
    return keyed.join(starts, ["df", "_d"]).select("member", "df", (F.row_number().over(inside) + F.col("_o")).alias("code"))


def packed_sets(sets: DataFrame) -> DataFrame:
    """(id, size, part, members, places, plain), checkpointed: the numbers of a set's members in order, an eighth of what a row per member takes.

    A set of more than ``CELL_ROWS`` members (a column of a table, say) has several rows, dealt by the rest of its members' numbers, with the members' places
    in the whole set; it is numbered inside cells, and the cells' sizes are added up, so no such set is sorted in one task.  ``places`` is null
    where the row holds the whole set.  ``plain``: no member of the row is repeated.

    The most frequent members, which most rows have, meet their numbers in a broadcast of ``FREQUENT`` entries at most, whatever the rows; only rows of
    rarer members move by member.
    """
    numbers = cut_lineage(numbered_members(sets))
    rows = numbers.agg(F.sum("df")).first()[0] or 0
    often = F.col("df") > rows // FREQUENT
    frequent = F.broadcast(numbers.filter(often).select("member", "code"))  # at most FREQUENT entries
    seldom = numbers.filter(~often)
    sizes = sets.groupBy("id").agg(F.count(F.lit(1)).alias("size"))
    large = F.broadcast(sizes.filter(F.col("size") > CELL_ROWS).select(F.col("id").alias("_id"), F.col("size").alias("_large")))  # at most members / CELL_ROWS
    near = sets.join(frequent, "member", "left").filter("code is not null or member is null").select("id", "code")
    rare = sets.join(frequent.select("member"), "member", "left_anti")
    far = salted_join(rare, seldom.select("member", "code"), ["member"], hot_keys(seldom, ["member"], "df"), ["id"]).select("id", "code")
    known = near.unionByName(far).join(large, F.col("id").eqNullSafe(F.col("_id")), "left").drop("_id")
    part = F.coalesce(F.pmod("code", _parts(F.coalesce("_large", F.lit(1)))), F.lit(0))
    packed = known.groupBy("id", "_large", part.alias("part")).agg(F.array_sort(F.collect_list("code")).alias("members"), F.count(F.lit(1)).alias("_n"))
    packed = packed.filter(F.size("members") > 0).withColumns({"size": F.coalesce("_large", "_n"), "plain": F.size(F.array_distinct("members")) == F.size("members")})
    held = cut_lineage(packed.select("id", "_large", "size", "part", "members", "plain"))
    drop_table(numbers)
    whole = held.filter("_large is null").select("id", "size", "part", "members", F.lit(None).cast("array<int>").alias("places"), "plain")
    if held.filter("_large is not null").isEmpty():
        return whole
    split = held.filter("_large is not null").select("id", "size", "part", "plain", F.explode("members").alias("member")).withColumn("_c", F.floor(F.col("member") / CELL_ROWS))
    before = Window.partitionBy("id").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    starts = split.groupBy("id", "_c").agg(F.count(F.lit(1)).alias("_n")).select(F.col("id").alias("_id"), F.col("_c").alias("_at"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    inside = F.row_number().over(Window.partitionBy("id", "_c").orderBy("member"))
    placed = split.withColumn("_r", inside).join(starts, F.col("id").eqNullSafe(F.col("_id")) & (F.col("_c") == F.col("_at"))).select(
        "id", "size", "part", "plain", F.struct("member", (F.col("_r") + F.col("_o")).cast("int").alias("place")).alias("x"))
    parts = placed.groupBy("id", "size", "part", "plain").agg(F.array_sort(F.collect_list("x")).alias("x")).select(
        "id", "size", "part", F.col("x.member").alias("members"), F.col("x.place").alias("places"), "plain")
    return whole.unionByName(cut_lineage(parts))


def _members(packed: DataFrame, *more: str) -> DataFrame:
    """(id, member, size, place, *more): a row per member again."""
    each = packed.select("id", "size", "places", *more, F.posexplode("members").alias("_p", "member"))
    return each.select("id", "member", "size", F.coalesce(F.get("places", F.col("_p")), F.col("_p") + 1).alias("place"), *more)


def ordered_members(sets: DataFrame) -> DataFrame:
    """(id, member, size, place): members of a set, by number, from rarest to most frequent, in one order for all sets."""
    return _members(packed_sets(sets))


def _packed(ordered: DataFrame) -> DataFrame:
    """Ordered members as ``packed_sets`` gives them; packed sets pass through."""
    if "members" in ordered.columns:
        return ordered
    part = F.pmod("member", _parts(F.col("size"))).alias("part")
    rows = ordered.groupBy("id", "size", part).agg(F.array_sort(F.collect_list(F.struct("member", "place"))).alias("x"))
    packed = rows.select("id", "size", "part", F.col("x.member").alias("members"), F.when(_parts(F.col("size")) > 1, F.col("x.place")).alias("places"))
    return cut_lineage(packed.withColumn("plain", F.size(F.array_distinct("members")) == F.size("members")))


def _candidates(prefix: DataFrame, sizes_fit: Column) -> DataFrame:
    """Pairs a < b that share a prefix member and whose sizes fit, with an upper bound of their overlap.

    Up to the last shared prefix member every common member was seen (k of them); after it at most the
    shorter remainder can be common.  Pairs of other sizes go before anything is shuffled by pair.
    """
    left = prefix.select(F.col("id").alias("a"), F.col("size").alias("size_a"), F.col("place").alias("pa"), "member")
    right = prefix.select(F.col("id").alias("b"), F.col("size").alias("size_b"), F.col("place").alias("pb"), "member")
    load = prefix.groupBy("member").agg(F.count(F.lit(1)).alias("n"))
    met = salted_join(left, right, ["member"], hot_keys(load, ["member"], "n"), ["a"]).filter((F.col("a") < F.col("b")) & sizes_fit)
    rest = F.least(F.col("size_a") - F.max("pa"), F.col("size_b") - F.max("pb"))
    return met.groupBy("a", "b", "size_a", "size_b").agg((F.count(F.lit(1)) + rest).alias("at_most"))


def _plain(packed: DataFrame) -> bool:
    """No set has a repeated member, so an overlap is no larger than either set; bounds by size hold only then."""
    return packed.filter("not plain").isEmpty()


#: Words of 64 bits in the signature of a set.
SIGNATURE = 8


def _signatures(packed: DataFrame) -> DataFrame:
    """(id, bits): a bit for the rest of each member's number, of sets in one row in which nothing repeats."""
    each = packed.filter("places is null and plain").select("id", F.explode("members").alias("m"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.floor(F.col("m") / SIGNATURE), F.lit(64)).cast("int"))
    words = [F.coalesce(F.bit_or(F.when(F.pmod("m", F.lit(SIGNATURE)) == i, bit)), F.lit(0).cast("long")) for i in range(SIGNATURE)]
    return each.groupBy("id").agg(F.array(*words).alias("bits"))


def _reachable(pairs: DataFrame, signatures: DataFrame, need: Column) -> DataFrame:
    """The pairs whose overlap can be ``need`` or more: a bit that only one of two sets has stands for a member that the other lacks.

    Sets without a signature pass.  A signature is a small part of a set, so most pairs go before whole sets move.
    """
    a, b = (signatures.select(F.col("id").alias(x), F.col("bits").alias(f"_{x}bits")) for x in "ab")
    signed = by_rows(by_rows(pairs, a, ["a"], "left"), b, ["b"], "left")

    def only(x: str, y: str) -> Column:
        return sum((F.bit_count(F.col(x)[i].bitwiseAND(F.bitwise_not(F.col(y)[i]))) for i in range(SIGNATURE)), F.lit(0))

    at_most = F.least(F.col("size_a") - only("_abits", "_bbits"), F.col("size_b") - only("_bbits", "_abits"))
    return signed.filter(F.col("_abits").isNull() | F.col("_bbits").isNull() | (at_most >= need)).select(*pairs.columns)


def _count_common(pairs: DataFrame, packed: DataFrame) -> DataFrame:
    """Exact overlap of each candidate pair that has any: rows of members meet, as many per pair as the larger set has.

    The rows of a set are dealt by the rest of its members' numbers by a power of two, so each common member is counted in one meeting.
    Repeated members of a set count once per copy, as in a join.
    """
    pairs = cut_lineage(pairs)
    a, b = (maybe_among(packed, "id", pairs.select(F.col(x).alias("id"))) for x in "ab")  # only sets that are in a pair move
    parts_a, parts_b = _parts(F.col("size_a")), _parts(F.col("size_b"))
    meetings = pairs.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(parts_a, parts_b) - 1))).withColumns(
        {"_ka": F.pmod("_k", parts_a), "_kb": F.pmod("_k", parts_b)}).drop("_k")
    a = a.select(F.col("id").alias("a"), F.col("part").alias("_ka"), F.col("members").alias("_ma"), F.col("plain").alias("_pa"))
    b = b.select(F.col("id").alias("b"), F.col("part").alias("_kb"), F.col("members").alias("_mb"), F.col("plain").alias("_pb"))
    copies = F.aggregate("_ma", F.lit(0), lambda n, x: n + F.size(F.filter("_mb", lambda y: y == x)))
    common = F.when(F.col("_pa") & F.col("_pb"), F.size(F.array_intersect("_ma", "_mb"))).otherwise(copies)
    met = meetings.join(a, ["a", "_ka"]).join(b, ["b", "_kb"]).select("a", "b", "size_a", "size_b", common.alias("n"))
    return met.groupBy("a", "b", "size_a", "size_b").agg(F.sum("n").alias("common")).filter("common > 0")


def _near_in_size(threshold: float) -> Column:
    """Sets of sizes size_a and size_b can have a cosine of ``threshold``."""
    return F.least("size_a", "size_b") / F.greatest("size_a", "size_b") >= threshold * threshold - 1e-9


def similar_pairs(ordered: DataFrame, threshold: float) -> DataFrame:
    """All pairs a < b with cosine >= threshold, exactly.

    Two such sets share a member among the rarest size - ceil(t^2 size) + 1 of each, and their sizes differ
    by at most 1/t^2, so only those prefixes meet.
    """
    packed = _packed(ordered)
    need = F.ceil(F.col("size") * (threshold * threshold) - 1e-9)
    prefix = _members(packed).filter(F.col("place") <= F.col("size") - need + 1)
    least = F.sqrt(F.col("size_a").cast("double") * F.col("size_b")) * threshold - 1e-9
    pairs = _candidates(prefix, _near_in_size(threshold)).filter(F.col("at_most") >= least).drop("at_most")
    got = _count_common(pairs, packed)
    return got.withColumn("cosine", _cosine(F.col("common"), F.col("size_a"), F.col("size_b"))).filter(
        F.col("cosine") >= threshold - 1e-12)


def best_neighbour(pairs: DataFrame) -> DataFrame:
    """(id, neighbour, cosine, common, size, other_size): the best partner of each set, lowest id on ties."""
    both = pairs.select(
        F.col("a").alias("id"), F.col("b").alias("neighbour"), "cosine", "common", F.col("size_a").alias("size"),
        F.col("size_b").alias("other_size"),
    ).unionByName(pairs.select(
        F.col("b").alias("id"), F.col("a").alias("neighbour"), "cosine", "common", F.col("size_b").alias("size"),
        F.col("size_a").alias("other_size")))
    order = F.struct((-F.round("cosine", 12)).alias("c"), "neighbour")
    best = both.groupBy("id").agg(F.min(F.struct(order.alias("o"), "cosine", "common", "size", "other_size")).alias("m"))
    return best.select("id", F.col("m.o.neighbour").alias("neighbour"), "m.cosine", "m.common", "m.size", "m.other_size")


#: Sets that share a member with at most so many others meet them all at the start.
FEW = 8
#: Partners of a set that are verified at the start.
FIRST_LOOKS = 2


def _both_ways(verified: DataFrame) -> DataFrame:
    return verified.unionByName(verified.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("size_b").alias("size_a"), F.col("size_a").alias("size_b"), "common"))


def _best_of(found: DataFrame) -> DataFrame:
    """(a, best: cosine in 12 digits, partner, common, size_b) from verified (a, b, size_a, size_b, common); the lowest id on ties."""
    cosine = F.round(_cosine(F.col("common"), F.col("size_a"), F.col("size_b")), 12)
    first = F.min(F.struct((-cosine).alias("c"), F.col("b").alias("partner"), "common", "size_b")).alias("m")
    return found.groupBy("a").agg(first).select("a", (-F.col("m.c")).alias("best"), "m.partner", "m.common", "m.size_b")


def nearest_partners(ordered: DataFrame, least: float = 0.0) -> DataFrame:
    """(a, best, partner, common, size_a, size_b): every set's nearest other set by cosine, exactly; the lowest id on ties.

    Sets without a partner of cosine ``least`` or more have no row.  A set first meets one hub per member (the smallest set that has the
    member, the lowest id of these) and the sharers of its rare members, and the most promising of these are counted.  What could still win is then known from the running best:

    * a better partner shares one of the set's rarest size - need + 1 members, and so does the set with the partner, where need is the smallest overlap
      that beats the best for the partner's size;
    * a partner that only ties must also have a lower id than the best so far.

    Members are looked up by (member, size of the sharer) first, so a list of sharers is opened only where one of them can win.  In a cluster of near-equal sets
    everybody ties with or beats the hub early, and the members that the cluster shares are not opened at all.

    A partner of cosine ``least`` is met among the rarest members of both sets, so only these have rows; whole sets stay packed.  Where members are repeated
    (tables with repeated rows) all members have rows.
    """
    packed = _packed(ordered).filter("id is not null")
    sure = float(least) if _plain(packed) else 0.0
    floor = F.greatest(F.ceil(F.col("size") * (sure * sure) - 1e-6), F.lit(1))  # what a partner of cosine ``least`` shares, whatever its size
    rows = _members(packed).filter(F.col("place") <= F.col("size") - floor + 1)
    lists = cut_lineage(rows.groupBy("member", F.col("size").alias("size_b")).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("low")))
    whole = lists.groupBy("member").agg(F.sum("n").alias("n"), F.min_by("low", "size_b").alias("hub"), F.min("size_b").alias("hub_size"))
    hot = cut_lineage(hot_keys(whole, ["member"], "n"))
    # start: a hub per member, and the sharers of rare members
    near, pair = _near_in_size(sure), ["a", "b", "size_a", "size_b"]
    own = salted_join(rows, whole.filter("n > 1"), ["member"], hot, ["id"])
    hubs = own.filter("id <> hub").select(F.col("id").alias("a"), F.col("hub").alias("b"), F.col("size").alias("size_a"), F.col("hub_size").alias("size_b")).filter(near)
    second = hubs.groupBy(F.col("b").alias("a"), F.col("size_b").alias("size_a")).agg(F.min(F.struct(F.col("size_a").alias("size"), F.col("a").alias("id"))).alias("m")).select(
        "a", F.col("m.id").alias("b"), "size_a", F.col("m.size").alias("size_b"))
    rare = own.filter(F.col("n") <= FEW)
    few = rare.select(F.col("id").alias("a"), F.col("size").alias("size_a"), "member").join(
        rare.select(F.col("id").alias("b"), F.col("size").alias("size_b"), "member"), "member").filter("a <> b").filter(near).select(*pair)
    met = hubs.unionByName(second).unionByName(few).groupBy(*pair).agg(F.count(F.lit(1)).alias("k"))
    looks = Window.partitionBy("a").orderBy(F.desc("k"), "b")
    flip = F.col("a") > F.col("b")
    chosen = met.withColumn("r", F.row_number().over(looks)).filter(F.col("r") <= FIRST_LOOKS).select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(flip, F.col("size_b")).otherwise(F.col("size_a")).alias("size_a"),
        F.when(flip, F.col("size_a")).otherwise(F.col("size_b")).alias("size_b")).distinct()
    size = packed.filter("places is null or array_min(places) = 1").select("id", "size")
    signed = cut_lineage(_signatures(packed))
    if sure > 0:
        chosen = _reachable(chosen, signed, F.sqrt(F.col("size_a").cast("double") * F.col("size_b")) * sure - 1e-6)
    first = cut_lineage(_best_of(_both_ways(_count_common(chosen, packed))))
    # what can still beat or tie the best
    best = F.greatest(F.coalesce("best", F.lit(0.0)), F.lit(float(least)))
    bars = size.join(first.select(F.col("a").alias("id"), "best", "partner"), "id", "left").select(
        "id", best.alias("bar"), F.when(F.coalesce("best", F.lit(-1.0)) >= least, F.col("partner")).alias("partner"))
    floor = F.greatest(F.ceil(F.col("bar") * F.col("bar") * F.col("size") - 1e-9), F.lit(1))
    probes = _members(packed.join(bars, "id"), "bar", "partner").filter(F.col("place") <= F.col("size") - floor + 1)
    opened = salted_join(probes, lists.join(whole.filter("n > 1").select("member"), "member", "left_semi"), ["member"], hot, ["id"])
    wanted = F.col("bar") * F.sqrt(F.col("size").cast("double") * F.col("size_b"))
    at_least = F.greatest(F.ceil(wanted - 1e-9), F.lit(1)).cast("int")
    reaches = F.round(at_least / F.sqrt(F.col("size").cast("double") * F.col("size_b")), 12)
    tie = reaches <= F.round(F.col("bar"), 12)  # this overlap gives the best's own cosine, so only a lower id wins by it
    any_id = F.when(tie & F.col("partner").isNotNull(), at_least + 1).otherwise(at_least)
    limits = opened.select("id", "member", "size", "place", "size_b", "partner", "low", any_id.alias("need"), at_least.alias("need_low"))
    fits = lambda need: (F.col(need) <= F.least("size", "size_b")) & (F.col("place") <= F.col("size") - F.col(need) + 1)
    open_lists = limits.filter(fits("need") | (fits("need_low") & (F.col("low") < F.col("partner"))))
    right = rows.select(F.col("id").alias("b"), "member", F.col("size").alias("size_b"), F.col("place").alias("pb"))
    # a list is hot by its (member, size) rows
    hot_lists = hot_keys(lists, ["member", "size_b"], "n")
    pairs = salted_join(open_lists.withColumnRenamed("id", "a"), right, ["member", "size_b"], hot_lists, ["a"]).filter("a <> b")
    need = F.when(F.col("partner").isNotNull() & (F.col("b") >= F.col("partner")), F.col("need")).otherwise(F.col("need_low"))
    pairs = pairs.withColumn("_need", need).filter(
        (F.col("place") <= F.col("size") - F.col("_need") + 1) & (F.col("pb") <= F.col("size_b") - F.col("_need") + 1))
    rest = F.least(F.col("size") - F.max("place"), F.col("size_b") - F.max("pb"))
    likely = pairs.groupBy("a", "b", F.col("size").alias("size_a"), "size_b", "_need").agg((F.count(F.lit(1)) + rest).alias("at_most")).filter(F.col("at_most") >= F.col("_need"))
    turned = F.col("a") > F.col("b")
    once = likely.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(turned, F.col("size_b")).otherwise(F.col("size_a")).alias("size_a"),
                         F.when(turned, F.col("size_a")).otherwise(F.col("size_b")).alias("size_b"), "_need").groupBy(*pair).agg(F.min("_need").alias("_need"))
    once = _reachable(once, signed, F.col("_need")).select(*pair)
    counted = _both_ways(_count_common(once, packed))
    before = first.join(size.select(F.col("id").alias("a"), F.col("size").alias("size_a")), "a").select("a", F.col("partner").alias("b"), "size_a", "size_b", "common")
    last = _best_of(counted.unionByName(before)).filter(F.col("best") >= F.round(F.lit(float(least)), 12))
    return last.join(size.select(F.col("id").alias("a"), F.col("size").alias("size_a")), "a").select("a", "best", "partner", "common", "size_a", "size_b")


def nearest_profiles(sets: DataFrame, ladder: tuple[float, ...] = ()) -> DataFrame:
    """Every set's nearest other set by cosine (with the Jaccard of that pair); null where nothing is shared.

    ``ladder`` is kept for callers that still name thresholds; the running best needs none.
    """
    found = nearest_partners(packed_sets(sets))
    every = cut_lineage(sets.select("id").distinct()).join(found.withColumnRenamed("a", "id"), "id", "left")
    cosine = _cosine(F.col("common"), F.col("size_a"), F.col("size_b"))
    jaccard = F.col("common") / (F.col("size_a") + F.col("size_b") - F.col("common"))
    return every.select("id", F.col("partner").alias("neighbour"), cosine.alias("cosine"), jaccard.alias("jaccard"))


# Groups --------------------------------------------------------------------------------------


def profiles(sets: DataFrame) -> DataFrame:
    """(id, profile): order-free fingerprint of the members, a fixed-size mergeable aggregate."""
    return sets.groupBy("id").agg(set_fingerprint(F.col("member")).alias("profile"))


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable over undirected edges (a, b).

    Each round takes the smallest label among the neighbours and then jumps to the label's own label, so
    long chains close in logarithmically many rounds; every round is checkpointed.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = cut_lineage(both)
    labels = cut_lineage(nodes.select("id", F.col("id").alias("component")))
    while True:  # labels only fall and a round that lowers none is the last, so this ends
        near = both.join(labels, both["b"] == labels["id"]).groupBy("a").agg(F.min("component").alias("m"))
        step = labels.join(near, labels["id"] == near["a"], "left").select(
            "id", F.col("component").alias("old"), F.least("component", "m").alias("component"))
        target = step.select(F.col("id").alias("t"), F.col("component").alias("tc"))
        jumped = step.join(target, step["component"] == target["t"]).select(
            "id", "old", F.least("component", "tc").alias("component"))
        jumped = cut_lineage(jumped)
        changed = jumped.filter("old <> component").limit(1).count()
        labels = jumped.select("id", "component")
        if not changed:
            return labels


def duplicate_groups(sets: DataFrame, threshold: float = 0.90) -> DataFrame:
    """(id, component): exact copies, plus each profile's nearest other profile at or above the threshold.

    Copies collapse to one representative first, so a group of copies costs one row in the join however
    large it is.  Sets are packed before that: copies are told by the numbers of their members, and only packed sets move by id.
    """
    packed = packed_sets(sets)
    print_of = F.md5(F.concat_ws(",", F.col("members").cast("array<string>")))
    parts = packed.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("part", print_of.alias("h"))))["h"].alias("h"), F.first("size").alias("size"))
    keyed = cut_lineage(parts.select("id", F.concat_ws("-", F.col("size").cast("string"), F.concat_ws("-", "h")).alias("profile")))
    representative = keyed.groupBy("profile").agg(F.min("id").alias("rep"))
    unique = cut_lineage(packed.join(representative.select(F.col("rep").alias("id")), "id", "left_semi"))  # many steps read it
    drop_table(packed)
    edges = cut_lineage(nearest_partners(unique, threshold).select("a", F.col("partner").alias("b")))
    drop_table(unique)
    components = connected_components(representative.select(F.col("rep").alias("id")), edges)
    placed = keyed.join(representative, "profile")
    return placed.join(components.withColumnRenamed("id", "rep"), "rep").select("id", "component")


def grouped_folds(groups: DataFrame, samples: DataFrame, k: int = 5, seed: int = 42) -> DataFrame:
    """(sid, label, component, fold): whole groups stay in one fold; folds are balanced per majority label."""
    joined = samples.join(groups, "sid")
    counts = joined.groupBy("component", "label").agg(F.count(F.lit(1)).alias("n"))
    major = counts.groupBy("component").agg(
        F.min(F.struct((-F.col("n")).alias("n"), "label")).alias("m")).select("component", F.col("m.label").alias("label"))
    numbered = numbered_by_hash(major, ["label"], md5_key(seed, F.col("component")), ["component"])
    placed = numbered.select("component", ((F.col("rn") - 1) % k).cast("int").alias("fold"))
    return joined.join(placed, "component").select("sid", "label", "component", "fold")


#: Groups above this share of a fold are units of their own; lighter ones are gathered in so many cells per fold and label.
HEAVY, CELLS, FULL = 1 / 64, 64, 1.02


def balanced_grouped_folds(groups: DataFrame, samples: DataFrame, k: int = 5, seed: int = 42) -> DataFrame:
    """(sid, label, component, fold): whole groups stay in one fold, and folds are balanced in rows and in every label.

    Units are heavy groups, and cells of light groups by a hash; at most k * (1 / HEAVY + labels * CELLS) of them, so their sizes per label fit the
    driver whatever the rows.  Largest first, a unit goes to the fold where it leaves the smallest sum of squared shares over all labels and the rows, among
    those that it does not fill beyond ``FULL`` shares of the rows; where none is left, to the one with the fewest rows.  The lowest fold wins ties.
    """
    joined = cut_lineage(samples.join(groups, "sid").select("sid", "label", "component"))
    per = joined.groupBy("component", "label").agg(F.count(F.lit(1)).alias("n"))
    sizes = per.groupBy("component").agg(F.sum("n").alias("size"), F.min(F.struct((-F.col("n")).alias("m"), "label"))["label"].alias("major"))
    total = joined.count()
    heavy = F.col("size") > max(1.0, total / k * HEAVY)
    cell = F.pmod(F.xxhash64("component", F.lit(seed)), F.lit(k * CELLS))
    light = F.concat_ws(":", F.lit("cell"), F.coalesce("major", F.lit("")), cell.cast("string"))
    unit_of = cut_lineage(sizes.select("component", F.when(heavy, F.concat_ws(":", F.lit("group"), F.col("component").cast("string"))).otherwise(light).alias("unit")))
    rows = per.join(unit_of, "component").groupBy("unit", "label").agg(F.sum("n").alias("n")).collect()
    fold_of = _deal_units([(r["unit"], r["label"], r["n"]) for r in rows], k)
    table = joined.sparkSession.createDataFrame(sorted(fold_of.items()), "unit string, fold int")
    placed = unit_of.join(F.broadcast(table), "unit").select("component", "fold")
    return joined.join(placed, "component").select("sid", "label", "component", "fold")


def _deal_units(rows: list[tuple], k: int) -> dict[str, int]:
    """The fold of each unit, from (unit, label, rows)."""
    labels = sorted({r[1] for r in rows}, key=str)
    units: dict[str, np.ndarray] = {}
    for unit, label, n in rows:
        units.setdefault(unit, np.zeros(len(labels) + 1))[[labels.index(label), -1]] += n
    total = sum(units.values(), np.zeros(len(labels) + 1))
    shares = {u: v / np.where(total > 0, total, 1) * k for u, v in units.items()}  # a fold holds 1 of each
    held, out = np.zeros((k, len(labels) + 1)), {}
    for unit in sorted(units, key=lambda u: (-shares[u].max(), u)):
        cost = (2 * held * shares[unit] + shares[unit] ** 2).sum(axis=1)
        room = held[:, -1] + shares[unit][-1] <= FULL
        out[unit] = int(np.argmin(np.round(np.where(room, cost, np.inf) if room.any() else held[:, -1], 9)))
        held[out[unit]] += shares[unit]
    return out



# Profile purity ------------------------------------------------------------------------------


def profile_detail(profile_labels: DataFrame) -> DataFrame:
    """(profile): support, majority count, label count, purity, label entropy in bits."""
    per_label = profile_labels.groupBy("profile", "label").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n")
    xlogx = F.sum(F.col("n") * F.log2(F.col("n").cast("double")))
    return per_label.groupBy("profile").agg(
        total.alias("support"), F.max("n").alias("majority_count"), F.count(F.lit(1)).alias("label_count"),
        (F.max("n") / total).alias("purity"), (F.log2(total.cast("double")) - xlogx / total).alias("entropy_bits"))


def purity_summary(detail: DataFrame) -> DataFrame:
    return detail.agg(
        F.count(F.lit(1)).alias("unique_profiles"),
        F.coalesce(F.sum(F.when(F.col("support") > 1, F.col("support"))), F.lit(0)).alias("duplicate_rows"),
        (F.sum("majority_count") / F.sum("support")).alias("weighted_purity"),
        F.count_if(F.col("label_count") > 1).alias("conflict_profiles"))


def merge_audit(raw: DataFrame, canonical: DataFrame, samples: DataFrame) -> DataFrame:
    """(canonical profile): rows, distinct raw profiles, labels, whether raw profiles were merged."""
    joined = canonical.select("id", F.col("profile").alias("canonical")).join(
        raw.select("id", F.col("profile").alias("raw")), "id").join(samples.withColumnRenamed("sid", "id"), "id")
    return joined.groupBy("canonical").agg(
        F.count(F.lit(1)).alias("row_count"), F.count_distinct("raw").alias("raw_profile_count"),
        F.count_distinct("label").alias("label_count"),
    ).withColumn("raw_merged", F.col("raw_profile_count") > 1)


def profile_lookup(fit: DataFrame, classes: list[str]) -> DataFrame:
    """(profile, support, counts): label counts of the fit rows."""
    return fit.groupBy("profile").agg(
        F.count(F.lit(1)).alias("support"), F.array(*[F.count_if(F.col("label") == c) for c in classes]).alias("counts"))


def profile_posterior(apply: DataFrame, lookup: DataFrame, prior: Column, classes: list[str],
                      strength: float) -> DataFrame:
    """(id, cls): posterior with prior strength; unmatched rows get the prior.  ``prior`` is an array column."""
    x = apply.join(lookup, "profile", "left").withColumn("_prior", prior)
    pairs = F.array(*[
        F.struct(
            F.lit(c).alias("cls"),
            F.coalesce((F.col("counts")[i] + strength * F.col("_prior")[i]) / (F.col("support") + strength),
                       F.col("_prior")[i]).alias("posterior"))
        for i, c in enumerate(classes)])
    purity = F.coalesce(F.array_max("counts") / F.col("support"), F.lit(0.0))
    return x.select(
        "id", F.col("support").isNotNull().alias("matched"), F.coalesce("support", F.lit(0)).alias("support"),
        purity.alias("purity"), F.explode(pairs).alias("x"),
    ).select("id", "matched", "support", "purity", "x.cls", "x.posterior")


# Class centroids -----------------------------------------------------------------------------


def centroids(tokens: DataFrame, samples: DataFrame, centred: bool = False) -> DataFrame:
    """(cls, token, v): share of the class that has the token; optionally minus the mean over classes."""
    sizes = samples.groupBy(F.col("label").alias("cls")).agg(F.count(F.lit(1)).alias("n"))
    hits = tokens.join(samples, "sid").groupBy(F.col("label").alias("cls"), "token").agg(F.count(F.lit(1)).alias("k"))
    rates = hits.join(sizes, "cls").select("cls", "token", (F.col("k") / F.col("n")).alias("v"))
    if not centred:
        return rates
    grid = rates.select("token").distinct().withColumn("classes", sizes.agg(F.collect_set("cls")).scalar()).select(
        "token", F.explode("classes").alias("cls"))
    full = grid.join(rates, ["cls", "token"], "left").withColumn("v", F.coalesce("v", F.lit(0.0)))
    w = Window.partitionBy("token")  # one row per class
    return full.withColumn("v", F.col("v") - F.avg("v").over(w))


def class_pair_cosine(vectors: DataFrame) -> DataFrame:
    """(class_a < class_b, cosine): a row per token holds all classes, so pairs are formed inside it."""
    rows = vectors.groupBy("token").agg(F.array_sort(F.collect_list(F.struct("cls", "v"))).alias("vs"))
    first = rows.select("vs", F.posexplode("vs").alias("i", "x"))
    pairs = first.select("x", F.explode(F.slice("vs", F.col("i") + 2, F.size("vs"))).alias("y")).groupBy(
        F.col("x.cls").alias("class_a"), F.col("y.cls").alias("class_b")
    ).agg(F.sum(F.col("x.v") * F.col("y.v")).alias("dot"))
    norms = vectors.groupBy("cls").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    na, nb = norms.select(F.col("cls").alias("class_a"), F.col("norm").alias("na")), norms.select(
        F.col("cls").alias("class_b"), F.col("norm").alias("nb"))
    return pairs.join(na, "class_a").join(nb, "class_b").select(
        "class_a", "class_b", (F.col("dot") / (F.col("na") * F.col("nb"))).alias("cosine"))


def prototype_probabilities(vectors: DataFrame, prototypes: DataFrame, classes: list[str], rows: DataFrame,
                            temperature: float = 1.0, log_prior: DataFrame | None = None) -> DataFrame:
    """(sid, cls, p): softmax of cosine to each class prototype / temperature, or plus a log prior.

    ``vectors`` are unit-length (sid, token, v); prototypes (cls, token, v) are normalised here.
    """
    norms = prototypes.groupBy("cls").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    unit = prototypes.join(norms, "cls").withColumn("u", F.col("v") / F.col("norm"))
    wide = unit.groupBy("token").agg(F.array(*[
        F.coalesce(F.sum(F.when(F.col("cls") == c, F.col("u"))), F.lit(0.0)) for c in classes]).alias("us"))
    load = vectors.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    joined = salted_join(vectors, wide, ["token"], hot_keys(load, ["token"], "n"), ["sid"])
    sums = joined.groupBy("sid").agg(F.array(*[F.sum(F.col("v") * F.col("us")[i]) for i in range(len(classes))]).alias("s"))
    full = rows.select("sid").join(sums, "sid", "left").withColumn(
        "s", F.coalesce("s", F.array(*[F.lit(0.0)] * len(classes))))
    scores = F.transform("s", lambda x: x / temperature)
    if log_prior is not None:
        full = full.withColumn("_lp", log_prior.scalar())
        scores = F.zip_with("s", "_lp", lambda x, y: x + y)
    full = full.withColumn("z", scores).withColumn("_top", F.array_max("z")).withColumn(
        "e", F.transform("z", lambda x: F.exp(x - F.col("_top"))))
    full = full.withColumn("_sum", F.aggregate("e", F.lit(0.0), lambda a, b: a + b))
    pairs = F.arrays_zip(F.array(*[F.lit(c) for c in classes]).alias("cls"), F.col("e"))
    return full.select("sid", "_sum", F.explode(pairs).alias("x")).select(
        "sid", F.col("x.cls").alias("cls"), (F.col("x.e") / F.col("_sum")).alias("p"))


# Confusion pairs and groups ------------------------------------------------------------------


def two_way_confusion(confusion: DataFrame) -> DataFrame:
    """(class_a < class_b, swapped) from (truth, pred, n)."""
    off = confusion.filter("truth <> pred")
    return off.groupBy(F.least("truth", "pred").alias("class_a"), F.greatest("truth", "pred").alias("class_b")).agg(
        F.sum("n").alias("swapped"))


def confusion_rates(confusion: DataFrame) -> DataFrame:
    """Swapped rows over the size of both classes."""
    sizes = confusion.groupBy("truth").agg(F.sum("n").alias("size"))
    a = sizes.select(F.col("truth").alias("class_a"), F.col("size").alias("sa"))
    b = sizes.select(F.col("truth").alias("class_b"), F.col("size").alias("sb"))
    got = two_way_confusion(confusion).join(a, "class_a", "left").join(b, "class_b", "left")
    both = F.greatest(F.coalesce("sa", F.lit(0)) + F.coalesce("sb", F.lit(0)), F.lit(1))
    return got.select("class_a", "class_b", "swapped", (F.col("swapped") / both).alias("rate"))


def disjoint_pairs(ranked: list[tuple], k: int) -> list[tuple]:
    """Greedy pick of pairs that share no class, from class-bounded rows already in rank order."""
    used: set[str] = set()
    out = []
    for row in ranked:
        if len(out) == k:
            break
        if row[0] not in used and row[1] not in used:
            used.update(row[:2])
            out.append(row)
    return out


def confusion_groups(pairs: list[tuple[str, str, int]], classes: list[str], n_groups: int) -> list[tuple[str, ...]]:
    """Groups of labels: the two groups with the most confusion between them become one until ``n_groups`` are left.

    A symmetric class x class table is folded: merging adds one row and column to another.  Ties go to the groups whose first
    labels come first.
    """
    names = sorted(classes)
    place = {c: i for i, c in enumerate(names)}
    table = np.zeros((len(names), len(names)), dtype=np.int64)
    for a, b, n in pairs:
        table[place[a], place[b]] = table[place[b], place[a]] = n
    owner = np.arange(len(names))
    live = list(range(len(names)))  # a group is known by its first label
    while len(live) > max(1, n_groups):
        upper = np.triu(table[np.ix_(live, live)], 1) - np.tril(np.ones((len(live), len(live)), dtype=np.int64))
        i, j = (live[x] for x in np.unravel_index(np.argmax(upper), upper.shape))
        table[i] += table[j]
        table[:, i] += table[:, j]
        owner[owner == j] = i
        live.remove(j)
    return [tuple(names[x] for x in np.flatnonzero(owner == i)) for i in live]


# Correlated columns --------------------------------------------------------------------------


def first_of_equal(tokens: DataFrame) -> DataFrame:
    """(id, first): the smallest token with the same set of samples, by an order-free fingerprint of the set."""
    keyed = cut_lineage(profiles(tokens.select(F.col("token").alias("id"), F.col("sid").alias("member"))))
    return keyed.join(keyed.groupBy("profile").agg(F.min("id").alias("first")), "profile").select("id", "first")


def correlated_tokens(tokens: DataFrame, n_rows: int, threshold: float, among: DataFrame | None = None) -> DataFrame:
    """All token pairs whose presence columns have |phi| >= threshold, exactly: (a < b, common, phi).

    A strong positive phi needs a large overlap, so tokens are treated as sets of samples and only their
    prefixes meet.  A strong negative phi needs odds(a) * odds(b) >= t^2, hence a token present in about
    half of all rows or more; there are few of those (a row has a bounded number of tokens), and they are
    counted against the tokens whose odds suffice.  ``among`` (id): only these tokens take part; they are told apart when columns are packed, so
    that rows do not move by token for it.
    """
    t2 = threshold * threshold
    sets = tokens.select(F.col("token").alias("id"), F.col("sid").alias("member"))
    packed = packed_sets(sets).filter(F.col("size") < n_rows)
    if among is not None:
        every, packed = packed, cut_lineage(by_rows(packed, among.select("id").distinct(), ["id"], "left_semi"))
        drop_table(every)
        if not _plain(packed):  # which repeated members meet depends on the numbers of the rows that take part
            drop_table(packed)
            packed = packed_sets(sets.join(among.select("id").distinct(), "id", "left_semi")).filter(F.col("size") < n_rows)
    ordered = _members(packed)
    s, n = F.col("size").cast("double"), float(n_rows)
    smallest = t2 * s * n / (n - s * (1 - t2))  # least partner support that can still reach the threshold
    need = F.ceil(F.least(threshold * s, smallest) - 1e-9)
    prefix = ordered.filter(F.col("place") <= F.col("size") - need + 1)
    a, b = F.least("size_a", "size_b").cast("double"), F.greatest("size_a", "size_b").cast("double")
    least = (threshold * F.sqrt(a * b * (n - a) * (n - b)) + a * b) / n
    met = _candidates(prefix, a * (n - b) >= t2 * b * (n - a) - 1e-6).filter(F.col("at_most") >= least - 1e-6).drop("at_most")
    positive = _count_common(met, packed)
    dense_odds = threshold * (1 - 1e-9)
    dense = ordered.filter(F.col("size") / (n - F.col("size")) >= dense_odds)
    x = dense.select(F.col("id").alias("x"), F.col("size").alias("sx"), "member")
    plain, most = _plain(packed), packed.filter(F.col("size") / (n - F.col("size")) >= dense_odds).agg(F.max("size")).first()[0]
    odds_y = F.col("size") / (n - F.col("size"))
    enough = F.lit(most is not None) if most is None or not plain else odds_y * (most / (n - most)) >= t2 * (1 - 1e-6)  # with the densest partner
    y = ordered.filter(enough).select(F.col("id").alias("y"), F.col("size").alias("sy"), "member")
    # the least phi of two sizes is that of the smallest overlap they can have
    sx, sy = F.col("sx").cast("double"), F.col("sy").cast("double")
    opposed = F.lit(not plain) | ((sx * sy >= t2 * (n - sx) * (n - sy) - 1e-6) & ((n - sx) * (n - sy) >= t2 * sx * sy - 1e-6))
    counted = x.join(y, "member").filter((F.col("x") != F.col("y")) & opposed).groupBy("x", "y", "sx", "sy").agg(F.count(F.lit(1)).alias("common"))
    flip = F.col("x") > F.col("y")
    direct = counted.select(
        F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"),
        F.when(flip, F.col("sy")).otherwise(F.col("sx")).alias("size_a"),
        F.when(flip, F.col("sx")).otherwise(F.col("sy")).alias("size_b"), "common")
    # dense tokens that never meet: overlap zero
    ids = packed.select(F.col("id").alias("y"), F.col("size").alias("sy")).distinct()
    heavy = packed.filter(F.col("size") / (n - F.col("size")) >= dense_odds).select(F.col("id").alias("x"), F.col("size").alias("sx")).distinct()
    odds = F.col("sx") / (n - F.col("sx"))
    low = F.floor(64 * t2 / (t2 + odds) - 1e-9)  # least partner share that can reach the threshold, in 64ths
    high = F.floor(64 * (1 - F.col("sx") / n) + 1e-9)
    heavy = heavy.filter(low <= high).withColumn("band", F.explode(F.sequence(low, high)))
    far = heavy.join(ids.withColumn("band", F.floor(64 * F.col("sy") / n)), "band").filter(
        (F.col("x") != F.col("y")) & (F.col("sx") * F.col("sy") >= t2 * (n - F.col("sx")) * (n - F.col("sy")) - 1e-6)
        & (F.col("sx") + F.col("sy") <= n_rows)).drop("band")
    flip2 = F.col("x") > F.col("y")
    never = far.join(counted.select("x", "y"), ["x", "y"], "left_anti").select(
        F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"),
        F.when(flip2, F.col("sy")).otherwise(F.col("sx")).alias("size_a"),
        F.when(flip2, F.col("sx")).otherwise(F.col("sy")).alias("size_b"), F.lit(0).cast("bigint").alias("common"))
    every = positive.unionByName(direct).unionByName(never).dropDuplicates(["a", "b"])
    sa, sb = F.col("size_a").cast("double"), F.col("size_b").cast("double")
    phi = (n * F.col("common") - sa * sb) / F.sqrt(sa * sb * (n - sa) * (n - sb))
    return every.withColumn("phi", phi).filter(F.abs("phi") >= threshold - 1e-12).select("a", "b", "common", "phi")


#: Links of a component that is walked in one go.
WALKED = 20_000


def _walked(edges: DataFrame) -> DataFrame:
    """(id) of those that fall, from (component, early, late): the walk in order, component by component, as a fold over its sorted links."""
    links = edges.groupBy("component", "late").agg(F.collect_set("early").alias("earlies"))
    ordered = links.groupBy("component").agg(F.array_sort(F.collect_list(F.struct("late", "earlies"))).alias("links"))
    kind = edges.schema["late"].dataType.simpleString()
    # a link's earlier end is kept unless it was dropped itself, so the dropped ones are all there is to remember
    dropped = F.aggregate("links", F.array().cast(f"array<{kind}>"), lambda out, x: F.when(
        F.size(F.array_except(x["earlies"], out)) > 0, F.concat(out, F.array(x["late"]))).otherwise(out))
    return ordered.select(F.explode(dropped).alias("id"))


def keep_earlier(nodes: DataFrame, edges: DataFrame, blocks: DataFrame | None = None) -> DataFrame:
    """(id, kept): walk ids in order, drop one that is linked to an earlier kept one.

    ``blocks`` (id, block): an id can only fall to one of its own block.  The walk is done component by component, each as one fold over its links;
    in a component of more than ``WALKED`` links all ids whose earlier neighbours are decided are decided at once, round after round.
    """
    pending = edges.select(F.least("a", "b").alias("early"), F.greatest("a", "b").alias("late"))
    if blocks is not None:
        one = lambda end: blocks.select(F.col("id").alias(end), F.col("block").alias(f"_{end}"))
        pending = pending.join(one("early"), "early").join(one("late"), "late").filter(F.col("_early").eqNullSafe(F.col("_late"))).select("early", "late")
    pending = cut_lineage(pending.distinct())
    ends = pending.select(F.explode(F.array("early", "late")).alias("id")).distinct()
    of = connected_components(ends, pending.select(F.col("early").alias("a"), F.col("late").alias("b")))
    placed = cut_lineage(pending.join(of.withColumnRenamed("id", "early"), "early"))
    large = placed.groupBy("component").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > WALKED).select("component")
    fallen = _walked(placed.join(large, "component", "left_anti"))
    rest = placed.join(large, "component", "left_semi").select("early", "late")
    if not rest.isEmpty():
        fallen = fallen.unionByName(_by_rounds(rest).filter("not kept").select("id"))
    return nodes.select("id").distinct().join(fallen.withColumn("_f", F.lit(True)), "id", "left").select("id", F.col("_f").isNull().alias("kept"))


def _by_rounds(pending: DataFrame) -> DataFrame:
    """(id, kept) of the ends of (early, late)."""
    pending = cut_lineage(pending)
    ends = pending.select(F.explode(F.array("early", "late")).alias("id")).distinct()
    state = cut_lineage(ends.withColumn("kept", F.lit(None).cast("boolean")))
    while True:  # each round decides at least the earliest open id of every component
        seen = pending.join(state.withColumnRenamed("id", "early"), "early").groupBy("late").agg(
            F.coalesce(F.max(F.col("kept").cast("int")), F.lit(0)).alias("any_kept"),
            F.count_if(F.col("kept").isNull()).alias("open"))
        ruled = state.join(seen, state["id"] == seen["late"], "left")
        decided = F.when(F.col("kept").isNotNull(), F.col("kept")).when(F.col("any_kept") == 1, F.lit(False)).when(
            F.coalesce("open", F.lit(0)) == 0, F.lit(True))
        state = cut_lineage(ruled.select("id", decided.alias("kept")))
        if state.filter("kept is null").limit(1).count() == 0:
            return state
