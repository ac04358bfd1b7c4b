"""Contacts: candidate index, duplicate groups, merge plans."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import KEY_CAP
from ..functions.normalize import email_key, group_id, name_key, phone_keys
from ..scratch import Scratch
from ..ship import ship
from ..skew import join_on_hot_key

REASONS = {"phone": "sharedPhone", "email": "sharedEmail", "name": "sharedNameAndOrganization"}


def text(c: str) -> Column:
    return F.coalesce(F.trim(c), F.lit(""))


def display_name() -> Column:
    """PRJ-09: given and family name, else the organisation, else a stand-in."""
    person = F.trim(F.concat_ws(" ", text("given"), text("family")))
    return F.coalesce(F.nullif(person, F.lit("")), F.nullif(text("organization"), F.lit("")), F.lit("(No name)"))


def canonical_row() -> Column:
    """PRJ-10: the contact as one string; the order of its phones and emails does not matter."""
    listed = lambda c: F.array_join(F.array_sort(F.transform(c, lambda x: F.concat(F.coalesce(x["label"], F.lit("")), F.lit(":"), F.coalesce(x["value"], F.lit(""))))), ",")
    return F.concat_ws("|", "id", F.coalesce("given", F.lit("")), F.coalesce("family", F.lit("")), F.coalesce("organization", F.lit("")), listed("phones"), listed("emails"))


def contact_keys(contacts: DataFrame) -> DataFrame:
    """GRF-01: ``key, kind, id``, each once: phones, emails, and name with organisation."""
    c = contacts.where("id IS NOT NULL")
    phones = c.select("id", F.explode("phones").alias("x")).select("id", F.explode(phone_keys(F.col("x.value"))).alias("k"))
    emails = c.select("id", F.explode("emails").alias("x")).select("id", email_key(F.col("x.value")).alias("k"))
    named = c.select("id", F.concat_ws("\x01", name_key(F.concat_ws(" ", text("given"), text("family"))), name_key(F.col("organization"))).alias("k"), name_key(F.concat_ws(" ", text("given"), text("family"))).alias("n"), name_key(F.col("organization")).alias("o"))
    keyed = lambda df, kind: df.where("k IS NOT NULL").select(F.concat(F.lit(f"{kind}:"), "k").alias("key"), F.lit(kind).alias("kind"), "id")
    return keyed(phones, "phone").unionByName(keyed(emails, "email")).unionByName(keyed(named.where("n IS NOT NULL AND o IS NOT NULL"), "name")).distinct()


def key_edges(keys: DataFrame, cap: int = KEY_CAP) -> DataFrame:
    """GRF-02: ``a, b, kind``: each identifier of a key with the key's smallest. Keys of one identifier or more than ``cap`` link nothing."""
    usable = keys.groupBy("key", "kind").agg(F.min("id").alias("a"), F.count("*").alias("n")).where((F.col("n") >= 2) & (F.col("n") <= cap))
    return keys.join(usable.select("key", "a"), "key").where("id <> a").select("a", F.col("id").alias("b"), "kind")


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """GRF-03: ``id, root`` of every linked identifier; the root is the smallest of its component.

    Each round takes the smallest root among neighbours and then the root of that
    root, so chains shorten by halves; rounds are written to the scratch folder. Vertices with very
    many neighbours and roots with very many members are salted.
    """
    both = scratch.write(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    n_both = both.count()
    labels = scratch.write(both.groupBy("a").agg(F.least("a", F.min("b")).alias("root"), F.count("*").alias("n")).withColumnRenamed("a", "id"))
    n_labels = labels.count()
    while True:
        told = join_on_hot_key(both, labels.withColumnRenamed("id", "b"), ["b"], "n", n_both, "a").select("a", "root")
        near = told.groupBy("a").agg(F.min("root").alias("near")).withColumnRenamed("a", "id")
        lower = scratch.write(labels.join(near, "id").select("id", "n", F.col("root").alias("was"), F.least("root", "near").alias("root")))
        up = lower.select(F.col("id").alias("root"), F.col("root").alias("above"))
        roots = lower.groupBy("root").agg(F.count("*").alias("members")).join(up, "root", "left")
        after = scratch.write(join_on_hot_key(lower, roots, ["root"], "members", n_labels, "id").select("id", "n", "was", F.coalesce("above", "root").alias("root")))
        if after.where("root <> was").isEmpty():
            return after.select("id", "root")
        scratch.drop(labels, lower)
        labels = after.select("id", "root", "n")


def duplicate_groups(contacts: DataFrame, cap: int = KEY_CAP) -> DataFrame:
    """GRF-02: ``group_id, member_ids, reasons`` of contacts that share a phone, an email, or name and organisation, directly or not.

    Reasons hold for the whole group; contacts without a partner are in none; an empty table gives no groups.
    """
    scratch = Scratch(contacts.sparkSession, "identity")
    edges = scratch.write(key_edges(contact_keys(contacts), cap).distinct())
    if edges.isEmpty():
        roots = edges.select(F.col("a").alias("id"), F.col("a").alias("root"))
    else:
        roots = components(edges, scratch)
    reasons = edges.join(roots, F.col("a") == F.col("id")).groupBy("root").agg(F.collect_set("kind").alias("kinds"))
    names = F.array_sort(F.transform("kinds", lambda k: F.when(k == "phone", REASONS["phone"]).when(k == "email", REASONS["email"]).otherwise(REASONS["name"])))
    members = roots.groupBy("root").agg(F.array_sort(F.collect_set("id")).alias("member_ids"))
    return members.join(reasons, "root").select(group_id(F.col("member_ids")).alias("group_id"), "member_ids", names.alias("reasons"))


def merge_plan(contacts: DataFrame, groups: DataFrame) -> DataFrame:
    """PLN-01: what a merge into each group's smallest member would do.

    ``group_id, destination_id, phones, emails`` (values appended from the other
    members in order of their identifiers, each key once), the names kept, and ``conflicts`` (field, kept, not copied). A
    value without a usable key counts as itself. A missing member is left out; a group without any gives no row.
    """
    c = contacts.where("id IS NOT NULL").groupBy("id").agg(F.min(F.struct("given", "family", "organization", "phones", "emails")).alias("r")).select("id", "r.*")
    members = groups.select("group_id", F.explode("member_ids").alias("id")).distinct().join(c, "id")
    raw = lambda v: F.concat(F.lit("raw:"), F.coalesce(v, F.lit("")))
    phone = lambda x: F.struct(F.coalesce(x["value"], F.lit("")).alias("value"), F.when(F.size(phone_keys(x["value"])) > 0, phone_keys(x["value"])).otherwise(F.array(raw(x["value"]))).alias("keys"))
    email = lambda x: F.struct(F.coalesce(x["value"], F.lit("")).alias("value"), F.array(F.coalesce(email_key(x["value"]), raw(x["value"]))).alias("keys"))
    listed = members.select("group_id", "id", text("given").alias("given"), text("family").alias("family"), text("organization").alias("organization"), F.coalesce(F.transform("phones", phone), F.array()).alias("phones"), F.coalesce(F.transform("emails", email), F.array()).alias("emails"))
    # One pass over each group in order: what is held of it are its result and the keys seen, never its contacts.
    ordered = listed.repartition("group_id").sortWithinPartitions("group_id", "id")
    ship(contacts.sparkSession)
    return ordered.mapInPandas(_fold_groups, PLAN)


PLAN = "group_id string, destination_id string, source_ids array<string>, phones array<string>, emails array<string>, given string, family string, organization string, conflicts array<struct<field: string, kept: string, not_copied: string>>"
_NAMES = ("given", "family", "organization")


class _Merge:
    """The plan of one group, member by member; the first is the destination."""

    def __init__(self, group: str):
        self.group, self.ids = group, []
        self.seen = {"phones": set(), "emails": set()}
        self.added: dict[str, list[str]] = {"phones": [], "emails": []}
        self.kept, self.lost = dict.fromkeys(_NAMES, ""), {f: [] for f in _NAMES}

    def add(self, id_: str, names: dict[str, str], lists: dict[str, list]) -> None:
        for f, value in names.items():
            if value and not self.kept[f]:
                self.kept[f] = value
            elif value and value != self.kept[f]:
                self.lost[f].append({"field": f, "kept": self.kept[f], "not_copied": value})
        for f, values in lists.items():
            for x in values:
                keys = set(x["keys"])
                if not self.ids:
                    self.seen[f] |= keys
                elif not self.seen[f] & keys:
                    self.seen[f] |= keys
                    self.added[f].append(x["value"])
        self.ids.append(id_)

    def row(self) -> tuple:
        return self.group, self.ids[0], self.ids[1:], self.added["phones"], self.added["emails"], *self.kept.values(), [x for f in _NAMES for x in self.lost[f]]


def _fold_groups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [x.split()[0] for x in PLAN.split(", ", 8)[:8]] + ["conflicts"]
    merge: _Merge | None = None
    for pdf in batches:
        done = []
        for r in pdf.itertuples(index=False):
            if merge is None or r.group_id != merge.group:
                if merge:
                    done.append(merge.row())
                merge = _Merge(r.group_id)
            merge.add(r.id, {f: getattr(r, f) for f in _NAMES}, {"phones": r.phones, "emails": r.emails})
        if done:
            yield pd.DataFrame(done, columns=names)
    if merge:
        yield pd.DataFrame([merge.row()], columns=names)


def apply_merges(live: DataFrame, plans: DataFrame) -> DataFrame:
    """PLN-04: ``live`` after ``plans``: destinations with the values that are appended, without the sources. Other columns stay as they are."""
    item = lambda c: F.transform(c, lambda v: F.struct(F.lit(None).cast("string").alias("label"), v.alias("value"), F.lit(None).cast("string").alias("normalized")))
    more = plans.select(F.col("destination_id").alias("id"), F.col("phones").alias("_phones"), F.col("emails").alias("_emails"))
    gone = plans.select(F.explode("source_ids").alias("id")).distinct()
    kept = live.join(gone, "id", "left_anti").join(more, "id", "left")
    for c in ("phones", "emails"):
        kept = kept.withColumn(c, F.when(F.col(f"_{c}").isNull(), F.col(c)).otherwise(F.concat(F.coalesce(F.col(c), F.array().cast(live.schema[c].dataType)), item(F.col(f"_{c}")).cast(live.schema[c].dataType))))
    return kept.drop("_phones", "_emails")


def merge_outcomes(plans: DataFrame, reviewed: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """PLN-04: ``group_id, outcome, planned, removed`` of each plan.

    ``invalidMerge`` if the plan makes no sense, ``stale`` if a contact is missing or not as it was ``reviewed`` when the change begins (``before``; such
    plans must not be applied), ``verificationFailed`` if ``after`` lacks the destination or one of the appended values (by match keys), else
    ``succeeded``; ``removed`` counts the sources that are really gone.
    """
    members = plans.select("group_id", "destination_id", F.explode(F.concat(F.array("destination_id"), "source_ids")).alias("id"))
    signed = lambda df, c: df.where("id IS NOT NULL").select("id", canonical_row().alias(c)).groupBy("id").agg(F.min(c).alias(c))
    state = members.join(signed(reviewed, "was"), "id", "left").join(signed(before, "now"), "id", "left").join(signed(after, "later"), "id", "left")
    facts = state.groupBy("group_id").agg(
        F.max(F.col("now").isNull() | (F.col("now") != F.coalesce("was", F.lit("")))).alias("drifted"),
        F.max((F.col("id") == F.col("destination_id")) & F.col("later").isNotNull()).alias("arrived"), F.count_if((F.col("id") != F.col("destination_id")) & F.col("later").isNull()).alias("removed"),
    )
    phone = lambda v: F.when(F.size(phone_keys(v)) > 0, phone_keys(v)).otherwise(F.array(F.concat(F.lit("raw:"), v)))
    email = lambda v: F.array(F.coalesce(email_key(v), F.concat(F.lit("raw:"), v)))
    have = after.where("id IS NOT NULL").select(F.col("id").alias("destination_id"), *[F.flatten(F.transform(F.coalesce(F.transform(c, lambda x: F.coalesce(x["value"], F.lit(""))), F.array().cast("array<string>")), key)).alias(f"have_{c}") for c, key in (("phones", phone), ("emails", email))])
    absent = lambda c, key: F.exists(c, lambda v: ~F.arrays_overlap(F.col(f"have_{c}"), key(v)))
    lacking = plans.join(have, "destination_id").groupBy("group_id").agg(F.min(F.coalesce(absent("phones", phone) | absent("emails", email), F.lit(False))).alias("lacking"))
    sources = F.col("source_ids")
    valid = (F.size(sources) > 0) & (F.size(F.array_distinct(sources)) == F.size(sources)) & ~F.array_contains(sources, F.col("destination_id"))
    outcome = F.when(~valid, "invalidMerge").when(F.col("drifted"), "stale").when(~F.col("arrived") | F.col("lacking"), "verificationFailed").otherwise("succeeded")
    done = outcome.isin("succeeded")
    return plans.join(facts, "group_id").join(lacking, "group_id", "left").select("group_id", outcome.alias("outcome"), F.size(sources).alias("planned"), F.when(done, F.col("removed")).otherwise(0).alias("removed"))
