"""Consolidating pairwise matches into groups.

Seed-tree pruning over DataFrames: in every round each vertex connects its
neighbourhood to the smallest vertex of that neighbourhood; a vertex that
nobody chose as a minimum drops out and hangs below the minimum it was
connected to. What remains is a smaller graph with the same components. When no edge
remains, the vertices that never dropped out are the seeds (the smallest
identifier of each component), and they flow down the forest of dropped
vertices, latest round first.

The number of rounds grows with the logarithm of the longest shortest path,
also for long chains. Each round is written to the shared scratch folder, so
the lineage stays short and a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import blank_trim
from ..scratch import Scratch
from ..skew import join_on_hot_key


def group_pairs(pairs: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 200) -> DataFrame:
    """One row ``(id, group_id)`` for every identifier of ``pairs``.

    ``group_id`` is the smallest identifier linked directly or indirectly, in
    the order of the column type. Pairs with a null side link nothing and are
    left out; a pair of an identifier with itself gives a group of one;
    repeated and reversed pairs count once; an empty table gives no rows;
    other columns are ignored, whatever their names.
    """
    scratch = Scratch(pairs.sparkSession, "components")
    links = pairs.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u IS NOT NULL AND v IS NOT NULL")
    edges = scratch.write(links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    n_edges = edges.count()
    if not n_edges:
        return links.select(F.col("u").alias("id"), F.col("u").alias("group_id"))
    forest: list[DataFrame] = []
    vertices: DataFrame | None = None
    while n_edges:
        if len(forest) >= max_rounds:
            raise RuntimeError(f"no fixed point after {max_rounds} rounds")
        minima = edges.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("n"))
        told = join_on_hot_key(edges, minima, ["u"], "n", n_edges, "v").select(F.col("v").alias("u"), F.col("m").alias("target"))
        chosen = scratch.write(told.unionByName(minima.select("u", F.col("m").alias("target"))).distinct())
        n_chosen = chosen.count()
        state = scratch.write(chosen.groupBy("u").agg(F.min("target").alias("m"), F.max(F.col("target") == F.col("u")).alias("stays"), F.count("*").alias("n")))
        kept = join_on_hot_key(chosen, state.where("n > 1"), ["u"], "n", n_chosen, "target").where("target <> m").select(F.col("target").alias("u"), F.col("m").alias("v"))
        after = scratch.write(kept.unionByName(kept.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
        vertices = state if vertices is None else vertices
        forest.append(state.where("NOT stays").select("u", F.col("m").alias("parent")))
        scratch.drop(edges, chosen)
        edges, n_edges = after, after.count()
    labels = _flow_down(forest, scratch)
    seeds = vertices.join(labels.select(F.col("id").alias("u")), "u", "left_anti")
    return labels.unionByName(seeds.select(F.col("u").alias("id"), F.col("u").alias("group_id")))


def _flow_down(forest: list[DataFrame], scratch: Scratch) -> DataFrame:
    """Seeds flow from the vertices dropped last to those dropped first.

    A parent is alive at the end of its child's round, so it dropped in a later
    round or is a seed. Each level is written once and read by the levels above it, so a round adds
    two joins to the whole run and none to the plans of other rounds. The parents of a level are
    looked up once each; a parent with very many children is salted on the way back.
    """
    labels: DataFrame | None = None
    for tree in reversed(forest):
        if labels is None:
            here = tree.select(F.col("u").alias("id"), F.col("parent").alias("group_id"))
        else:
            known = labels.select(F.col("id").alias("parent"), F.col("group_id").alias("seed"))
            parents = tree.groupBy("parent").agg(F.count("*").alias("n")).join(known, "parent", "left")
            here = join_on_hot_key(tree, parents, ["parent"], "n", tree.count(), "u").select(F.col("u").alias("id"), F.coalesce("seed", "parent").alias("group_id"))
        here = scratch.write(here)
        labels = here if labels is None else labels.unionByName(here)
    return labels


def link_contacts(matches: DataFrame, contacts: DataFrame) -> DataFrame:
    """``(group_id, id)`` for each contact linked to a smaller identifier.

    Identifiers are compared in upper case without outer blanks and given as
    in ``contacts``; one that ``contacts`` does not have is given in its
    compared form. A match with a null or blank side links nothing.
    """
    key = lambda c: F.nullif(F.upper(blank_trim(F.col(c))), F.lit(""))
    scratch = Scratch(matches.sparkSession, "contacts")
    groups = group_pairs(matches.select(key("a").alias("a"), key("b").alias("b")))
    spelled = contacts.select(key("id").alias("k"), F.col("id").alias("as_is")).where("k IS NOT NULL").groupBy("k").agg(F.min("as_is").alias("as_is"))
    named = scratch.write(groups.join(spelled.withColumnRenamed("k", "id"), "id", "left").select("group_id", F.coalesce("as_is", "id").alias("id")))
    least = named.groupBy("group_id").agg(F.min("id").alias("least"), F.count("*").alias("n"))
    met = join_on_hot_key(named, least, ["group_id"], "n", named.count(), "id")
    return met.where("id <> least").select(F.col("least").alias("group_id"), "id")
