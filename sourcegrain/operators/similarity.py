"""Exact set similarity join and connected components.

Copies are collapsed before anything is paired, so a group of copies of any size costs one
representative. Distinct sets are paired by prefix filtering: order the shingles of a set from rare
to common; two sets with Jaccard >= t share one of their first ``n - ceil(t * n) + 1`` shingles, and the
places of the first one they share bound how many more can follow. Only rare shingles become join keys,
and no pair is lost (All-Pairs / PPJoin, public papers). Sets travel as arrays of eight-byte hashes.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sourcegrain.session import bucketed, durable, stored

# Clone threshold, shingle size, token-count ratio.
THRESHOLD = 0.72
SHINGLE = 5
TOKEN_RATIO = 0.6


def shingles(tokens: Column, size: int = SHINGLE) -> Column:
    """Distinct runs of ``size`` tokens; a shorter input is one shingle."""
    many = F.transform(F.sequence(F.lit(1), F.size(tokens) - size + 1),
                       lambda i: F.array_join(F.slice(tokens, i, size), " "))
    return F.array_distinct(F.when(F.size(tokens) < size, F.array(F.array_join(tokens, " "))).otherwise(many))


def as_set(shingled: Column) -> Column:
    """Shingles as a sorted array of eight-byte hashes, a quarter of their text or less.

    Two different shingles of one pair of sets share a hash about once in 10**13 pairs of 1,000 shingles.
    """
    return F.array_sort(F.array_distinct(F.transform(shingled, lambda x: F.xxhash64(x))))


def collapse(items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split items (id, n_tokens, shingles) into representatives (rep, n_copies, n_tokens, set) and memberships (id, rep).

    Items with the same shingle set and token count share the smallest id as representative.
    """
    hashed = items.select("id", "n_tokens", as_set(F.col("shingles")).alias("set"))
    joined = F.array_join(F.transform("set", lambda x: F.hex(x)), " ")
    hashed = hashed.withColumn("set_key", F.unhex(F.sha2(F.concat_ws(":", F.col("n_tokens").cast("string"), joined), 256)))
    keyed = bucketed(hashed, ["id"], ["id"])  # sets travel once: what later asks for the set of an id finds it where it lies
    groups = stored(keyed.groupBy("set_key").agg(F.min("id").alias("rep"), F.count("*").alias("n_copies")))
    # the keys are compared without an equality, which would deal the sets by both columns
    own = ~(keyed["set_key"] < groups["set_key"]) & ~(keyed["set_key"] > groups["set_key"])
    reps = keyed.join(groups, (keyed["id"] == groups["rep"]) & own).select(keyed["id"].alias("rep"), "n_copies", "n_tokens", "set")
    members = keyed.select("id", "set_key").join(groups, "set_key").select("id", "rep")
    return reps, members


def _prefixes(reps: DataFrame, threshold: float) -> DataFrame:
    """(rep, n, n_tokens, s, pos, band): the shingles, rare ones first, of which two sets with the threshold share one.

    A shingle of one set alone pairs nothing: it only moves the others' places back, so it leaves before the sets'
    shingles are put in order and never travels a second time.
    """
    keys = reps.select("rep", F.explode("set").alias("s")).repartition("s")  # dealt once, for the counts and for the join with them
    several = keys.groupBy("s").agg(F.count("*").alias("df"), F.min("rep").alias("low"), F.max("rep").alias("high")).where("low <> high")
    sizes = reps.select("rep", F.size("set").alias("n"), "n_tokens").distinct()  # not sent along with every shingle
    shared = keys.join(several.select("s", "df"), "s").join(sizes, "rep")
    here = Window.partitionBy("rep")
    alone = F.col("n") - F.count("*").over(here)
    placed = shared.withColumn("pos", alone + F.row_number().over(here.orderBy("df", "s")))
    # sets whose sizes differ by more than the threshold allows never meet: a band of sizes joins the key
    band = F.floor(F.log(F.col("n")) / F.lit(-math.log(threshold)) + 1e-9).cast("int")
    return placed.where(F.col("pos") <= F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1).select("rep", "n", "n_tokens", "s", "pos", band.alias("band"))


def _may_match(threshold: float, token_ratio: float | None) -> Column:
    """Length and position filters of a shared shingle at ``ia`` and ``ib``: what follows it must suffice for the threshold."""
    near = F.least("na", "nb") >= F.greatest("na", "nb") * threshold - 1e-9
    left = F.least(F.col("na") - F.col("ia"), F.col("nb") - F.col("ib")) + 1
    near = near & (left >= (F.col("na") + F.col("nb")) * (threshold / (1 + threshold)) - 1e-9)
    if token_ratio is not None:
        near = near & (F.least("ta", "tb") / F.greatest("ta", "tb") >= token_ratio)
    return near


def _side(rows: DataFrame, x: str, *more: str) -> DataFrame:
    return rows.select(F.col("rep").alias(x), F.col("n").alias(f"n{x}"), F.col("n_tokens").alias(f"t{x}"), F.col("pos").alias(f"i{x}"), "s", "band", *more)


def _candidates(prefix: DataFrame, threshold: float, token_ratio: float | None, labelled: bool = False) -> DataFrame:
    """Pairs a < b that share a prefix shingle and pass the filters; of ``labelled`` sets only those with other labels."""
    more = ["label"] if labelled else []
    left = _side(prefix, "a", *more).withColumnRenamed("label", "la")
    around = F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1))
    right = _side(prefix, "b", *more).withColumnRenamed("label", "lb").withColumn("band", around)
    near = (F.col("a") < F.col("b")) & _may_match(threshold, token_ratio)
    if labelled:
        near = near & (F.col("la") != F.col("lb"))
    return left.join(right, ["s", "band"]).where(near).select("a", "b").distinct()


def _verified(candidates: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    """Candidates (a, b) with their exact score, at the threshold or above."""
    sets = reps.select("rep", "n_copies", "set")
    scored = (candidates.join(sets.select(F.col("rep").alias("a"), F.col("set").alias("sa"), F.col("n_copies").alias("copies_a")), "a")
              .join(sets.select(F.col("rep").alias("b"), F.col("set").alias("sb"), F.col("n_copies").alias("copies_b")), "b"))
    return (scored.withColumn("score", exact_jaccard(F.col("sa"), F.col("sb"))).where(F.col("score") >= threshold)
            .select(F.col("a").alias("rep_a"), F.col("b").alias("rep_b"), "copies_a", "copies_b", "score"))


def similar_pairs(reps: DataFrame, threshold: float = THRESHOLD, token_ratio: float | None = TOKEN_RATIO) -> DataFrame:
    """All pairs of representatives (rep_a < rep_b) with Jaccard >= threshold and their exact score."""
    return _verified(_candidates(_prefixes(reps, threshold), threshold, token_ratio), reps, threshold)


def linked(reps: DataFrame, threshold: float = THRESHOLD, token_ratio: float | None = TOKEN_RATIO) -> DataFrame:
    """(rep, cluster): components of the similar pairs, without listing the pairs of a family of near copies.

    Sets that share a prefix shingle and a size band are first compared with one hub among them, which is linear in the
    postings and joins most of a family; only sets whose components still differ are then compared with each other.
    """
    prefix = stored(_prefixes(reps, threshold))
    row = F.struct("rep", "n", "n_tokens", "pos")
    hubs = prefix.groupBy("s", "band").agg(F.min(row).alias("h"), F.count("*").alias("m")).where("m > 1").select(
        "s", "band", F.col("h.rep").alias("a"), F.col("h.n").alias("na"), F.col("h.n_tokens").alias("ta"), F.col("h.pos").alias("ia"))
    spokes = _side(prefix, "b").join(hubs, ["s", "band"]).where((F.col("a") < F.col("b")) & _may_match(threshold, token_ratio)).select("a", "b").distinct()

    def edges(pairs: DataFrame) -> DataFrame:
        return _verified(pairs, reps, threshold).select(F.col("rep_a").alias("src"), F.col("rep_b").alias("dst"))

    first = stored(edges(spokes))
    label = components(reps.select(F.col("rep").alias("node")), first).select(F.col("node").alias("rep"), F.col("component").alias("label"))
    # a shingle whose sets are all of one component can connect nothing more
    marked = prefix.join(label, "rep")
    mixed = marked.groupBy("s").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("s")
    rest = edges(_candidates(marked.join(mixed, "s", "left_semi"), threshold, token_ratio, labelled=True))
    both = components(reps.select(F.col("rep").alias("node")), first.unionByName(rest))
    return both.select(F.col("node").alias("rep"), F.col("component").alias("cluster"))


def memberships(reps: DataFrame, members: DataFrame, threshold: float = THRESHOLD, token_ratio: float | None = TOKEN_RATIO) -> DataFrame:
    """(id, rep, cluster) of the items in clusters of two or more."""
    label = linked(reps, threshold, token_ratio)
    large = reps.select("rep", "n_copies").join(label, "rep").groupBy("cluster").agg(F.sum("n_copies").alias("size")).where("size >= 2")
    return members.join(label, "rep").join(large.select("cluster"), "cluster", "left_semi").select("id", "rep", "cluster")


def components(nodes: DataFrame, edges: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """Smallest node of each connected component: (node, component).

    Min-label propagation with pointer jumping; each round is checkpointed. Labels move through
    aggregates, so a node with very many neighbours is combined on the map side.
    """
    both = durable(edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
                   .where("src <> dst").distinct())
    labels = durable(nodes.select("node", F.col("node").alias("component")).distinct())
    rounds = itertools.count() if max_rounds is None else range(max_rounds)
    for _ in rounds:
        offered = (both.join(labels, both["src"] == labels["node"]).groupBy("dst").agg(F.min("component").alias("best")))
        lowered = labels.join(offered, labels["node"] == offered["dst"], "left").select(
            "node", F.col("component").alias("old"), F.least("component", F.coalesce("best", "component")).alias("mid"))
        jump = lowered.select(F.col("node").alias("mid"), F.col("mid").alias("far"))
        step = durable(lowered.join(jump, "mid", "left").select(
            "node", "old", F.least("mid", F.coalesce("far", "mid")).alias("component")))
        labels = step.select("node", "component")
        if step.where("old <> component").limit(1).count() == 0:
            return labels
    raise RuntimeError(f"components did not settle within {max_rounds} rounds")


def clusters(reps: DataFrame, members: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(memberships with their cluster, cluster rows with size and mean similarity over all member pairs).

    Pairs inside a group of copies count as similarity one without being listed.
    """
    label = components(reps.select(F.col("rep").alias("node")),
                       pairs.select(F.col("rep_a").alias("src"), F.col("rep_b").alias("dst")))
    label = label.select(F.col("node").alias("rep"), F.col("component").alias("cluster"))
    sized = reps.select("rep", "n_copies").join(label, "rep")
    inner = F.col("n_copies") * (F.col("n_copies") - 1) / 2
    by_rep = sized.groupBy("cluster").agg(F.sum("n_copies").alias("size"), F.sum(inner).alias("w"))
    weight = F.col("copies_a") * F.col("copies_b") - (F.col("excluded") if "excluded" in pairs.columns else F.lit(0))
    by_edge = (pairs.join(label, pairs["rep_a"] == label["rep"]).groupBy("cluster")
               .agg(F.sum(F.col("score") * weight).alias("es"), F.sum(weight).alias("ew")))
    rows = (by_rep.where("size >= 2").join(by_edge, "cluster", "left")
            .withColumn("edges", (F.col("w") + F.coalesce("ew", F.lit(0))).cast("long"))
            .withColumn("similarity", (F.col("w") + F.coalesce("es", F.lit(0.0))) / (F.col("w") + F.coalesce("ew", F.lit(0))))
            .select("cluster", "size", "edges", "similarity"))
    placed = members.join(label, "rep").join(rows.select("cluster"), "cluster", "left_semi").select("id", "rep", "cluster")
    return placed, rows


def exact_jaccard(a: Column, b: Column) -> Column:
    common = F.size(F.array_intersect(a, b))
    return common / (F.size(a) + F.size(b) - common)


def anchor_pairs(items: DataFrame, placed: DataFrame, anchors: DataFrame) -> DataFrame:
    """One row per member other than the anchor of its cluster, with the exact score of the two.

    ``anchors`` holds (cluster, anchor). Linear in the members: never all pairs of a cluster.
    """
    sets = items.select("id", as_set(F.col("shingles")).alias("set"))
    target = anchors.join(sets, anchors["anchor"] == sets["id"]).select("cluster", "anchor", F.col("set").alias("sa"))
    rest = placed.join(sets, "id").join(target, "cluster").where("id <> anchor")
    return rest.select("cluster", "anchor", F.col("id").alias("other"), exact_jaccard(F.col("sa"), F.col("set")).alias("similarity"))
