"""Best representative of each duplicate group.

A latent two-sided quality model over claims: each source has, for each kind of
field, a sensitivity (it states values that are true) and a specificity (it
does not state values that are false). Both and the truth of
every stated value are inferred together by expectation-maximisation. A value
of a multi-valued field is judged by itself, so every value judged true
survives; of a single-valued field the likeliest value does.

Sources are the address books the members were read from, and three judges, each of which states the values of the member
it prefers: the most complete, the newest, the one of the most trusted book. How far a judge can be believed is inferred like
the rest. That a survivor beats all others in all three ways is checked afterwards and only reported.

What a round needs of the data is which sources speak on a slot (a field of a group) and which of them state a value. Values
alike in both are counted together before the first round, so a round reads that table once and sends the driver one row a source.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import alnum
from ..scratch import Scratch
from ..skew import join_on_hot_key

NAMES = ["given", "family", "organization"]
VALUES = ["phones", "emails"]
#: Letters of stand-ins that mean an absent name.
STAND_INS = ["unknown", "na", "none"]
#: Pseudo-counts (Beta priors) of the model, and the prior chance that a stated value is true.
SENSITIVITY_PRIOR = (4.0, 2.0)
FALSE_POSITIVE_PRIOR = (1.0, 4.0)
TRUTH_PRIOR = 0.5
#: Store id of claims without a known store.
NO_STORE = ""
#: The judges, as sources; a blank before them keeps them apart from stores.
JUDGES = {"complete": " most complete", "newest": " newest", "trusted": " most trusted"}
#: Qualities are held by the driver and sent with each round; more sources than this are refused.
MAX_SOURCES = 1_000_000


def filled_name(c: Column) -> Column:
    """Null unless the name has a letter or digit and is no stand-in."""
    letters = F.regexp_replace(F.lower(c), r"[^\p{L}]+", "")
    return F.when((alnum(c) != "") & ~letters.isin(STAND_INS), c)


def _explode_fields(columns: list[str]) -> Column:
    return F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in columns]))


def member_values(contacts: DataFrame, groups: DataFrame, conflicts: DataFrame, stores: DataFrame) -> DataFrame:
    """Filled values of group members: ``group_id, field, contact_id, value, keys, complete, updated, trust, store``.

    ``keys`` are what the values are compared by: a name's letters and digits,
    or the different ``normalized`` of a list. Members without a row in
    ``contacts`` and fields without a filled value have no row. A contact
    listed twice in a group counts once; of several rows of one contact the
    latest counts.
    """
    stated = contacts.where("id IS NOT NULL").groupBy("id").agg(F.max(F.struct("updated", "store_id", *NAMES, *VALUES)).alias("r")).select("id", "r.*")
    members = groups.where("group_id IS NOT NULL").select("group_id", F.explode("member_ids").alias("id")).where("id IS NOT NULL").distinct()
    known = members.join(stated, "id")
    trust = stores.where("store_id IS NOT NULL").groupBy("store_id").agg(F.min("trust_rank").alias("trust"))

    side = F.explode(F.array(F.struct(F.col("destination_id").alias("id"), F.col("kept").alias("logged")), F.struct(F.col("source_id").alias("id"), F.col("not_copied").alias("logged"))))
    logged = conflicts.where(F.col("field").isin(NAMES)).select("group_id", "field", side.alias("x")).select("group_id", "field", "x.id", filled_name(F.col("x.logged")).alias("logged")).where("logged IS NOT NULL AND id IS NOT NULL")
    logged = logged.groupBy("group_id", "field", "id").agg(F.max_by("logged", F.struct(F.length(alnum(F.col("logged"))), "logged")).alias("logged"))
    names = known.select("group_id", "id", "updated", "store_id", _explode_fields(NAMES).alias("x")).select("group_id", "id", "updated", "store_id", "x.field", "x.value")
    names = names.join(logged, ["group_id", "field", "id"], "left").withColumn("value", F.coalesce(filled_name(F.col("value")), "logged")).where("value IS NOT NULL")
    names = names.withColumn("keys", F.array(alnum(F.col("value")))).withColumn("complete", F.length(F.col("keys")[0]))

    lists = known.select("group_id", "id", "updated", "store_id", _explode_fields(VALUES).alias("x")).select("group_id", "id", "updated", "store_id", "x.field", "x.value")
    lists = lists.withColumn("keys", F.array_distinct(F.filter(F.transform("value", lambda x: x["normalized"]), lambda x: x.isNotNull()))).where(F.size("keys") > 0)
    lists = lists.withColumn("complete", F.size("keys")).withColumn("value", F.array_join("keys", "; "))

    columns = ["group_id", "field", "id", "value", "keys", "complete", "updated", "store_id"]
    both = names.select(*columns).unionByName(lists.select(*columns))
    return both.join(trust, "store_id", "left").select("group_id", "field", F.col("id").alias("contact_id"), "value", "keys", "complete", "updated", "trust", F.coalesce("store_id", F.lit(NO_STORE)).alias("store"))


def unanimous(values: DataFrame) -> DataFrame:
    """``(group_id, field, contact_id)`` where one member strictly wins all three ways, or is the only filled one.

    Counted by way and level with partial aggregates only: the best level of
    each way must have one member, the same in all three. No group is gathered in one task.
    """
    ways = F.explode(
        F.array(
            F.struct(F.lit("complete").alias("way"), F.col("complete").cast("bigint").alias("level")),
            F.struct(F.lit("updated").alias("way"), F.coalesce(F.unix_micros(F.col("updated").cast("timestamp")), F.lit(-(1 << 62))).alias("level")),
            F.struct(F.lit("trust").alias("way"), F.coalesce(-F.col("trust").cast("bigint"), F.lit(-(1 << 62))).alias("level")),
        )
    )
    levels = values.select("group_id", "field", "contact_id", ways.alias("x")).groupBy("group_id", "field", "x.way", "x.level").agg(F.count("*").alias("n"), F.min("contact_id").alias("who"))
    best = levels.groupBy("group_id", "field", "way").agg(F.max_by(F.struct("n", "who"), "level").alias("b"))
    same = best.groupBy("group_id", "field").agg(F.max("b.n").alias("n"), F.min("b.who").alias("who"), F.max("b.who").alias("other"))
    return same.where("n = 1 AND who = other").select("group_id", "field", F.col("who").alias("contact_id"))


def claims_of(values: DataFrame, total: int) -> DataFrame:
    """``(group_id, field, key, source)``, distinct: what the stores and the judges state."""
    slot = ["group_id", "field"]
    age, rank = F.coalesce(F.unix_micros(F.col("updated").cast("timestamp")), F.lit(-(1 << 62))), F.coalesce("trust", F.lit(2**31 - 1))
    rows = values.select(*slot, "contact_id", "store", "keys", "complete", age.alias("age"), rank.alias("rank"))
    best = rows.groupBy(*slot).agg(F.max("complete").alias("most"), F.max("age").alias("newest"), F.min("rank").alias("trusted"), F.count("*").alias("n"))
    judged = join_on_hot_key(rows, best, slot, "n", total, "contact_id")
    says = lambda test, judge: F.when(test, F.lit(JUDGES[judge]))
    sources = F.array_compact(F.array("store", says(F.col("complete") == F.col("most"), "complete"), says(F.col("age") == F.col("newest"), "newest"), says(F.col("rank") == F.col("trusted"), "trusted")))
    return judged.select(*slot, F.explode("keys").alias("key"), sources.alias("sources")).select(*slot, "key", F.explode("sources").alias("source")).distinct()


def survivors(contacts: DataFrame, groups: DataFrame, conflicts: DataFrame, stores: DataFrame, tolerance: float = 1e-3, max_rounds: int = 50) -> DataFrame:
    """``group_id, field, key, value, contact_id, truth, decided``: the surviving values of every group.

    One row for each name field with a filled value, and one for each value of
    ``phones`` and ``emails`` judged true. ``truth`` is the model's probability,
    ``contact_id`` the best member that states the value; ``decided`` is
    ``unanimous`` if that member also wins in all three ways, else ``model``. Ties go to
    the more complete, newer, more trusted value, then to the smaller identifier. Empty
    tables give no rows; columns other than those of the tables are ignored.
    """
    scratch = Scratch(contacts.sparkSession, "survivors")
    slot = ["group_id", "field"]
    values = scratch.write(member_values(contacts, groups, conflicts, stores))
    winners = scratch.write(unanimous(values))
    truth = judge(claims_of(values, values.count()), scratch, tolerance, max_rounds)

    named = values.select(*slot, "contact_id", "value", "complete", "updated", "trust", F.explode("keys").alias("key")).join(truth, [*slot, "key"])
    order = F.struct(
        (-F.col("truth")).alias("untruth"), (-F.col("complete")).alias("gaps"), F.coalesce(-F.unix_micros(F.col("updated").cast("timestamp")), F.lit(1 << 62)).alias("age"),
        F.coalesce("trust", F.lit(2**31 - 1)).alias("trust"), "contact_id", "key", "value",
    )
    by_key = scratch.write(named.groupBy(*slot, "key").agg(F.min(order).alias("b")))
    single = by_key.where(F.col("field").isin(NAMES)).groupBy(*slot).agg(F.min("b").alias("b")).select(*slot, "b.*")
    listed = by_key.where(F.col("field").isin(VALUES) & (F.col("b.untruth") <= -0.5)).select(*slot, "b.*")
    wins = winners.select(*slot, "contact_id", F.lit(True).alias("wins"))
    both = single.unionByName(listed).join(wins, [*slot, "contact_id"], "left")
    return both.select(*slot, "key", "value", "contact_id", F.round(-F.col("untruth"), 6).alias("truth"), F.when(F.col("wins"), "unanimous").otherwise("model").alias("decided"))


def judge(claims: DataFrame, scratch: Scratch, tolerance: float = 1e-3, max_rounds: int = 50) -> DataFrame:
    """``(group_id, field, key, truth)`` by expectation-maximisation over ``claims`` (``group_id, field, key, source``, distinct).

    Sources that speak on a slot but do not state a value deny it. Rounds end when no quality moves by more than ``tolerance``.
    """
    slot = ["group_id", "field"]
    facts, quality = fit(claims, scratch, tolerance, max_rounds)
    return facts.join(F.broadcast(quality), "field").select(*slot, "key", _truth().alias("truth"))  # a row for each kind of field, of at most MAX_SOURCES numbers


def fit(claims: DataFrame, scratch: Scratch, tolerance: float, max_rounds: int) -> tuple[DataFrame, DataFrame]:
    """``facts`` (``group_id, field, key, states, covers``, sources as numbers) and the qualities of the sources, one row a kind of field:
    ``names``, ``sens``, ``fpr`` and the log-odds ``denies``, ``states_more`` of each source."""
    spark, slot = claims.sparkSession, ["group_id", "field"]
    claims = scratch.write(claims)
    names = [r["source"] for r in claims.select("source").distinct().orderBy("source").limit(MAX_SOURCES + 1).collect()]
    if len(names) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    numbered = spark.createDataFrame(list(zip(names, range(len(names)), strict=True)), "source string, s int")
    coded = claims.join(F.broadcast(numbered), "source")  # at most MAX_SOURCES rows
    # Both arrays hold different sources only.
    stated = coded.groupBy(*slot, "key").agg(F.array_sort(F.collect_set("s")).alias("states"))
    covered = coded.groupBy(*slot).agg(F.array_sort(F.collect_set("s")).alias("covers"))
    facts = scratch.write(stated.join(covered, slot))
    patterns = scratch.write(facts.groupBy("field", "states", "covers").agg(F.count("*").alias("n")))
    fields = sorted(r["field"] for r in patterns.select("field").distinct().collect())
    (a1, a0), (b1, b0) = SENSITIVITY_PRIOR, FALSE_POSITIVE_PRIOR
    sens, fpr = (np.full((len(fields), len(names)), x / (x + y)) for x, y in (SENSITIVITY_PRIOR, FALSE_POSITIVE_PRIOR))
    for _ in range(max_rounds):
        if not fields:
            break
        judged = patterns.join(F.broadcast(_quality(spark, fields, names, sens, fpr)), "field").select("field", "n", "states", "covers", _truth().alias("truth"))
        heard = judged.select("field", "n", "truth", "states", F.explode("covers").alias("s")).withColumn("stated", F.array_contains("states", F.col("s")).cast("int"))
        true, false = F.col("n") * F.col("truth"), F.col("n") * (1 - F.col("truth"))
        sums = heard.groupBy("field", "s").agg(F.sum(true).alias("true_mass"), F.sum(false).alias("false_mass"), F.sum(true * F.col("stated")).alias("hits"), F.sum(false * F.col("stated")).alias("misses")).collect()
        old = sens.copy(), fpr.copy()
        for r in sums:  # a row for each source and kind of field
            at = fields.index(r["field"]), r["s"]
            sens[at] = (r["hits"] + a1) / (r["true_mass"] + a1 + a0)
            fpr[at] = (r["misses"] + b1) / (r["false_mass"] + b1 + b0)
        if max(np.abs(sens - old[0]).max(), np.abs(fpr - old[1]).max()) <= tolerance:
            break
    return facts, _quality(spark, fields, names, sens, fpr)


def _quality(spark, fields: list[str], names: list[str], sens: np.ndarray, fpr: np.ndarray) -> DataFrame:
    denies = np.log((1 - sens) / (1 - fpr))
    more = np.log(sens / fpr) - denies
    rows = [(f, names, sens[i].tolist(), fpr[i].tolist(), denies[i].tolist(), more[i].tolist()) for i, f in enumerate(fields)]
    return spark.createDataFrame(rows, "field string, names array<string>, sens array<double>, fpr array<double>, denies array<double>, states_more array<double>")


def _truth() -> Column:
    """Probability of a value: the prior odds, "denied" by all sources of its slot, and for its own the difference to "stated"."""
    total = lambda sources, weights: F.aggregate(sources, F.lit(0.0), lambda acc, s: acc + F.get(F.col(weights), s))
    odds = F.lit(float(np.log(TRUTH_PRIOR / (1 - TRUTH_PRIOR)))) + total("covers", "denies") + total("states", "states_more")
    return 1 / (1 + F.exp(-odds))
