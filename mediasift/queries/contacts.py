"""Queries over contacts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import normalize as N
from ..operators import catalog as C
from ..operators import identity as I
from ..sources import sinks
from . import query

_T = lambda c: f"coalesce(trim({c}, ' '), '')"
_PERSON = f"trim({_T('given')} || ' ' || {_T('family')}, ' ')"
_SEP = r" \t\x{00a0}\-()."
_FOLD = "translate(value, '०१२३४५६७८९', '0123456789')"
_DIGITS = f"regexp_replace({_FOLD}, '[^0-9]', '', 'g')"
_PLAIN = f"regexp_full_match({_FOLD}, '[{_SEP}]*\\+?[{_SEP}0-9]*') AND length({_DIGITS}) >= 4"


def phones(t) -> DataFrame:
    return t.labeled_values.where("kind = 'phone'")


@query("str_01", f"SELECT value_id, CASE WHEN value IS NULL THEN NULL WHEN NOT ({_PLAIN}) THEN '' ELSE 's:' || {_DIGITS} || CASE WHEN contains(value, '+') AND length({_DIGITS}) > 10 THEN ',n:' || right({_DIGITS}, 10) WHEN NOT contains(value, '+') AND length({_DIGITS}) = 10 THEN ',n:' || {_DIGITS} ELSE '' END END AS keys FROM labeled_values WHERE kind = 'phone'")
def str_01(t):
    return phones(t).select("value_id", F.array_join(N.phone_keys(F.col("value")), ",").alias("keys"))


@query("str_02", "SELECT value_id, normalized AS key FROM labeled_values WHERE kind = 'phone'")
def str_02(t):
    return phones(t).select("value_id", N.phone_key(F.col("value")).alias("key"))


@query("str_03", f"SELECT value_id, {_FOLD} AS folded FROM labeled_values")
def str_03(t):
    return t.labeled_values.select("value_id", N.fold_phone_digits(F.col("value")).alias("folded"))


@query("str_04", "SELECT value_id, normalized AS key FROM labeled_values WHERE kind = 'email'")
def str_04(t):
    return t.labeled_values.where("kind = 'email'").select("value_id", N.email_key(F.col("value")).alias("key"))


@query("str_05", r"SELECT id, nullif(lower(trim(regexp_replace(organization, '[\s\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{0085}]+', ' ', 'g'))), '') AS org_key FROM contacts")
def str_05(t):
    return t.contacts.select("id", N.name_key(F.col("organization")).alias("org_key"))


@query("prj_09", f"SELECT id, coalesce(nullif({_PERSON}, ''), nullif({_T('organization')}, ''), '(No name)') AS name FROM contacts")
def prj_09(t):
    return t.contacts.select("id", I.display_name().alias("name"))


_LIST = lambda c: f"array_to_string(list_sort([coalesce(x.label, '') || ':' || coalesce(x.value, '') FOR x IN {c}]), ',')"


@query("prj_10", f"SELECT id, id || '|' || coalesce(given, '') || '|' || coalesce(family, '') || '|' || coalesce(organization, '') || '|' || {_LIST('phones')} || '|' || {_LIST('emails')} AS row_text FROM contacts")
def prj_10(t):
    return t.contacts.select("id", I.canonical_row().alias("row_text"))


_FNV = lambda x: f"format('{{:x}}', list_reduce([ord(x)::HUGEINT FOR x IN string_split({x}, '')], lambda h, b: (xor(h, b) * {N.FNV_MULTIPLIER}) % 18446744073709551616, 14695981039346656037::HUGEINT))"


@query("hsh_01", f"SELECT id, {_FNV('id')} AS digest FROM (SELECT DISTINCT id FROM contacts)")
def hsh_01(t):
    return t.contacts.select("id").distinct().select("id", N.fnv_hex(F.col("id")).alias("digest"))


@query("hsh_02", f"SELECT array_to_string(member_ids, ',') AS members, 'g-' || {_FNV('array_to_string(member_ids, chr(1))')} AS computed_id FROM contact_groups")
def hsh_02(t):
    return t.contact_groups.select(F.array_join("member_ids", ",").alias("members"), N.group_id(F.col("member_ids")).alias("computed_id"))


@query("hsh_03", "SELECT media_type, count(DISTINCT id) || '|' || string_agg(DISTINCT id, ',' ORDER BY id) AS signature FROM assets GROUP BY media_type")
def hsh_03(t):
    return t.assets.groupBy("media_type").agg(N.set_signature(F.collect_set("id")).alias("signature"))


@query("hsh_04", "SELECT string_agg(DISTINCT group_id, ';' ORDER BY group_id) AS signature FROM contact_groups")
def hsh_04(t):
    return t.contact_groups.agg(F.array_join(F.array_sort(F.collect_set("group_id")), ";").alias("signature"))


@query("hsh_05", f"SELECT destination_id, source_id, {_FNV("destination_id || chr(1) || source_id")} AS identity FROM (SELECT DISTINCT destination_id, source_id FROM merge_conflicts WHERE source_id IS NOT NULL)")
def hsh_05(t):
    """A plan is identified by its destination and sources."""
    return t.merge_conflicts.where("source_id IS NOT NULL").select("destination_id", "source_id").distinct().withColumn("identity", N.fnv_hex(F.concat_ws("\x01", "destination_id", "source_id")))


@query("flt_10", "SELECT id FROM contacts WHERE len([1 FOR x IN phones IF x.normalized IS NOT NULL]) = 0 AND len([1 FOR x IN emails IF x.normalized IS NOT NULL]) = 0 AND NOT (nullif(" + _PERSON + ", '') IS NOT NULL AND nullif(" + _T("organization") + ", '') IS NOT NULL)")
def flt_10(t):
    some = lambda c, key: F.exists(c, lambda x: key(x["value"]).isNotNull())
    named = (F.trim(F.concat_ws(" ", I.text("given"), I.text("family"))) != "") & (I.text("organization") != "")
    return t.contacts.where(~some("phones", N.phone_key) & ~some("emails", N.email_key) & ~named).select("id")


@query("flt_17", "SELECT group_id, len(member_ids) >= 2 AND len(list_distinct(member_ids)) = len(member_ids) AS is_valid FROM contact_groups")
def flt_17(t):
    """A merge plan has sources, each once, and its destination is none of them."""
    sources, destination = F.slice("member_ids", 2, F.greatest(F.size("member_ids") - 1, F.lit(0))), F.get("member_ids", F.lit(0))
    return t.contact_groups.select("group_id", ((F.size(sources) > 0) & (F.size(F.array_distinct(sources)) == F.size(sources)) & ~F.array_contains(sources, destination)).alias("is_valid"))


_KEYS = f"""
WITH c AS (SELECT DISTINCT id, given, family, organization, phones, emails FROM contacts),
v AS (SELECT id, unnest(phones).value AS value FROM c),
ph AS (SELECT id, 's:' || {_DIGITS} AS k FROM v WHERE {_PLAIN}
  UNION SELECT id, 'n:' || right({_DIGITS}, 10) FROM v WHERE {_PLAIN} AND (contains(value, '+') AND length({_DIGITS}) > 10 OR NOT contains(value, '+') AND length({_DIGITS}) = 10)),
em AS (SELECT id, x.normalized AS k FROM (SELECT id, unnest(emails) AS x FROM c) WHERE x.normalized IS NOT NULL),
nm AS (SELECT id, nullif(lower(trim(regexp_replace({_PERSON}, '[\\s\\x{{00a0}}]+', ' ', 'g'))), '') AS n, nullif(lower(trim(regexp_replace(organization, '[\\s\\x{{00a0}}]+', ' ', 'g'))), '') AS o FROM c),
keys AS (SELECT DISTINCT 'phone:' || k AS key, 'phone' AS kind, id FROM ph UNION SELECT DISTINCT 'email:' || k, 'email', id FROM em UNION SELECT DISTINCT 'name:' || n || chr(1) || o, 'name', id FROM nm WHERE n IS NOT NULL AND o IS NOT NULL)
"""


@query("grf_01", _KEYS + "SELECT key, kind, id FROM keys")
def grf_01(t):
    return I.contact_keys(t.contacts)


_GROUPS = _KEYS.replace("WITH c", "WITH RECURSIVE c") + """
, usable AS (SELECT key, min(id) AS a FROM keys GROUP BY key HAVING count(*) BETWEEN 2 AND 50)
, edges AS (SELECT DISTINCT a, id AS b, kind FROM keys JOIN usable USING (key) WHERE id <> a)
, both_ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges)
, reach(id, other) AS (SELECT a, a FROM both_ways UNION SELECT r.id, e.b FROM reach r JOIN both_ways e ON e.a = r.other)
, roots AS (SELECT id, min(other) AS root FROM reach GROUP BY id)
, grouped AS (SELECT root, list_sort(list(id)) AS member_ids FROM roots GROUP BY root)
, why AS (SELECT root, string_agg(DISTINCT CASE kind WHEN 'phone' THEN 'sharedPhone' WHEN 'email' THEN 'sharedEmail' ELSE 'sharedNameAndOrganization' END, ',' ORDER BY CASE kind WHEN 'phone' THEN 'sharedPhone' WHEN 'email' THEN 'sharedEmail' ELSE 'sharedNameAndOrganization' END) AS reasons FROM edges JOIN roots ON a = id GROUP BY root)
"""


@query("grf_02", _GROUPS + "SELECT array_to_string(member_ids, ',') AS members, reasons FROM grouped JOIN why USING (root)")
def grf_02(t):
    return I.duplicate_groups(t.contacts).select(F.array_join("member_ids", ",").alias("members"), F.array_join("reasons", ",").alias("reasons"))


@query("grf_03", _GROUPS + "SELECT id, root FROM roots")
def grf_03(t):
    from ..scratch import Scratch

    return I.components(I.key_edges(I.contact_keys(t.contacts)), Scratch(t.spark, "identity"))


@query("joi_09", _GROUPS.replace("FROM contacts)", "FROM contacts WHERE id NOT IN (SELECT destination_id FROM merge_conflicts WHERE destination_id IS NOT NULL))") + "SELECT array_to_string(member_ids, ',') AS members FROM grouped")
def joi_09(t):
    """Groups found again after contacts were removed."""
    rest = C.without(t.contacts, t.merge_conflicts.select(F.col("destination_id").alias("id")))
    return I.duplicate_groups(rest).select(F.array_join("member_ids", ",").alias("members"))


@query("agg_18", "SELECT count(DISTINCT m) AS contacts FROM (SELECT unnest(member_ids) AS m FROM contact_groups)")
def agg_18(t):
    return t.contact_groups.select(F.explode("member_ids").alias("m")).agg(F.count_distinct("m").alias("contacts"))


@query("srt_06", "SELECT group_id, array_to_string(member_ids, ',') AS members FROM contact_groups ORDER BY member_ids")
def srt_06(t):
    return t.contact_groups.orderBy("member_ids").select("group_id", F.array_join("member_ids", ",").alias("members"))


_VALUE_KEYS = {
    "phones": f"CASE WHEN {_PLAIN} THEN list_concat(['s:' || {_DIGITS}], CASE WHEN contains(value, '+') AND length({_DIGITS}) > 10 OR NOT contains(value, '+') AND length({_DIGITS}) = 10 THEN ['n:' || right({_DIGITS}, 10)] ELSE [] END) ELSE ['raw:' || value] END",
    "emails": "[coalesce(normalized, 'raw:' || value)]",
}


def _appended(c: str) -> str:
    return f"""
, {c}_v AS (SELECT group_id, id, d, generate_subscripts({c}, 1) AS pos, coalesce(unnest({c}).value, '') AS value, unnest({c}).normalized AS normalized FROM mem WHERE len({c}) > 0)
, {c}_l AS (SELECT group_id, list({{'own': id = d, 'value': value, 'keys': {_VALUE_KEYS[c]}}} ORDER BY id, pos) AS ev FROM {c}_v GROUP BY group_id)
, {c}_f(group_id, ev, k, seen, added) AS (
  SELECT group_id, ev, 0, []::VARCHAR[], []::VARCHAR[] FROM {c}_l
  UNION ALL
  SELECT group_id, ev, k + 1, CASE WHEN NOT ev[k + 1].own AND list_has_any(seen, ev[k + 1].keys) THEN seen ELSE list_concat(seen, ev[k + 1].keys) END,
    CASE WHEN ev[k + 1].own OR list_has_any(seen, ev[k + 1].keys) THEN added ELSE list_append(added, ev[k + 1].value) END
  FROM {c}_f WHERE k < len(ev))
, {c}_r AS (SELECT group_id, array_to_string(added, ';') AS {c} FROM {c}_f WHERE k = len(ev))"""


_PLAN_SQL = f"""
WITH RECURSIVE mm AS (SELECT DISTINCT group_id, unnest(member_ids) AS id FROM contact_groups),
mem AS (SELECT *, min(id) OVER (PARTITION BY group_id) AS d FROM (SELECT group_id, id, {_T('given')} AS given, {_T('family')} AS family, {_T('organization')} AS organization, phones, emails FROM mm JOIN (SELECT DISTINCT id, given, family, organization, phones, emails FROM contacts) USING (id)))
{_appended('phones')}{_appended('emails')}
, n AS (SELECT group_id, list(id ORDER BY id) AS ids, {', '.join(f"[x FOR x IN list({f} ORDER BY id) IF x <> ''] AS {f}s" for f in ('given', 'family', 'organization'))} FROM mem GROUP BY group_id)
"""


@query("pln_01", _PLAN_SQL + "SELECT group_id, ids[1] AS destination_id, array_to_string(ids[2:], ',') AS source_ids, coalesce(phones, '') AS phones, coalesce(emails, '') AS emails, coalesce(givens[1], '') AS given, coalesce(familys[1], '') AS family, coalesce(organizations[1], '') AS organization, array_to_string(list_concat(list_concat(['given=' || givens[1] || '=' || x FOR x IN givens IF x <> givens[1]], ['family=' || familys[1] || '=' || x FOR x IN familys IF x <> familys[1]]), ['organization=' || organizations[1] || '=' || x FOR x IN organizations IF x <> organizations[1]]), ';') AS conflicts FROM n LEFT JOIN phones_r USING (group_id) LEFT JOIN emails_r USING (group_id)")
def pln_01(t):
    plan = I.merge_plan(t.contacts, t.contact_groups)
    pair = F.transform("conflicts", lambda x: F.concat_ws("=", x["field"], x["kept"], x["not_copied"]))
    return plan.select("group_id", "destination_id", F.array_join("source_ids", ",").alias("source_ids"), F.array_join("phones", ";").alias("phones"), F.array_join("emails", ";").alias("emails"), "given", "family", "organization", F.array_join(pair, ";").alias("conflicts"))


_FIELDS = ["given", "family", "organization"]
_LIVE = " UNION ALL ".join(f"SELECT id, '{f}' AS field, max(coalesce({f}, '')) AS live FROM contacts WHERE id IS NOT NULL GROUP BY id" for f in _FIELDS)


def stated(t) -> DataFrame:
    """``id, field, value`` of every contact and name field."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.coalesce(f, F.lit("")).alias("value")) for f in _FIELDS])
    return t.contacts.where("id IS NOT NULL").select("id", F.explode(pairs).alias("x")).select("id", "x.field", "x.value")


@query("joi_13", f"SELECT p.destination_id AS id, p.field, CASE WHEN live IS NULL THEN 'missing' WHEN live <> kept THEN 'changed' END AS drift FROM (SELECT DISTINCT destination_id, field, kept FROM merge_conflicts) p LEFT JOIN ({_LIVE}) l ON l.id = p.destination_id AND l.field = p.field WHERE live IS NULL OR live <> kept")
def joi_13(t):
    """Planned values against the live ones: missing, or changed since."""
    live = stated(t).groupBy("id", "field").agg(F.max("value").alias("live"))
    planned = t.merge_conflicts.select(F.col("destination_id").alias("id"), "field", "kept").distinct()
    return planned.join(live, ["id", "field"], "left").where("live IS NULL OR live <> kept").select("id", "field", F.when(F.col("live").isNull(), "missing").otherwise("changed").alias("drift"))


@query("joi_14", "SELECT group_id, source_id, bool_or(coalesce(c.family = m.not_copied OR c.given = m.not_copied OR c.organization = m.not_copied, false)) AS is_present FROM (SELECT DISTINCT group_id, source_id, not_copied FROM merge_conflicts) m LEFT JOIN (SELECT DISTINCT id, given, family, organization FROM contacts) c ON c.id = m.source_id GROUP BY ALL")
def joi_14(t):
    """Whether a value that should be there is, by overlap of its keys with the contact's."""
    wanted = t.merge_conflicts.select("group_id", F.col("source_id").alias("id"), "not_copied").distinct()
    have = t.contacts.select("id", F.array(*_FIELDS).alias("have")).distinct()
    return wanted.join(have, "id", "left").groupBy("group_id", F.col("id").alias("source_id")).agg(F.max(F.coalesce(F.arrays_overlap("have", F.array("not_copied")), F.lit(False))).alias("is_present"))


@query("snk_06", "SELECT DISTINCT id, CASE WHEN id IN (SELECT source_id FROM merge_conflicts) THEN NULL ELSE organization END AS organization FROM contacts WHERE id NOT IN (SELECT destination_id FROM merge_conflicts WHERE destination_id IS NOT NULL)")
def snk_06(t):
    target = t.contacts.select("id", "organization").distinct()
    changed = t.contacts.select("id").distinct().join(t.merge_conflicts.select(F.col("source_id").alias("id")), "id", "left_semi").withColumn("organization", F.lit(None).cast("string"))
    return sinks.upsert(target, changed, t.merge_conflicts.select(F.col("destination_id").alias("id")).distinct())


@query("set_06", "SELECT g.group_id, count(*) FILTER (c.id IS NOT NULL)::BIGINT AS selected, min(g.m) AS destination_id FROM (SELECT group_id, unnest(member_ids) AS m FROM contact_groups) g LEFT JOIN (SELECT DISTINCT id FROM contacts WHERE updated >= TIMESTAMP '2025-01-01') c ON c.id = g.m GROUP BY g.group_id")
def set_06(t):
    """Selected members of each group; the destination is always its smallest member."""
    chosen = t.contacts.where("updated >= TIMESTAMP_NTZ '2025-01-01 00:00:00'").select(F.col("id").alias("m"), F.lit(1).alias("on")).distinct()
    return t.contact_groups.select("group_id", F.explode("member_ids").alias("m")).join(chosen, "m", "left").groupBy("group_id").agg(F.count("on").alias("selected"), F.min("m").alias("destination_id"))


@query("set_09", "WITH live AS (SELECT DISTINCT id FROM contacts), planned AS (SELECT DISTINCT unnest(member_ids) AS id FROM contact_groups) SELECT (SELECT count(*) FROM planned WHERE id NOT IN (SELECT id FROM live)) AS vanished, (SELECT count(*) FROM live WHERE id NOT IN (SELECT id FROM planned)) AS added")
def set_09(t):
    """Set equality of planned and live identifiers: stale if either side has more."""
    planned = t.contact_groups.select(F.explode("member_ids").alias("id")).distinct().withColumn("p", F.lit(1))
    live = t.contacts.select("id").distinct().withColumn("l", F.lit(1))
    return planned.join(live, "id", "full").agg(F.count_if(F.col("l").isNull()).alias("vanished"), F.count_if(F.col("p").isNull()).alias("added"))


@query("fmt_06", "SELECT group_id, replace(replace(array_to_string(reasons, ', '), 'sharedPhone', 'same phone'), 'sharedEmail', 'same email') AS reasons_text FROM contact_groups")
def fmt_06(t):
    return t.contact_groups.select("group_id", F.array_join(F.transform("reasons", lambda r: F.when(r == "sharedPhone", "same phone").when(r == "sharedEmail", "same email").otherwise(r)), ", ").alias("reasons_text"))


@query("pln_04", "WITH m AS (SELECT DISTINCT group_id, unnest(member_ids) AS id FROM contact_groups), k AS (SELECT m.*, c.live FROM m JOIN (SELECT id, bool_or(store_id IS NOT NULL) AS live FROM contacts GROUP BY id) c USING (id)), g AS (SELECT group_id, count(*) - 1 AS planned, bool_and(live) AS fresh FROM k GROUP BY group_id) SELECT group_id, CASE WHEN planned = 0 THEN 'invalidMerge' WHEN NOT fresh THEN 'stale' ELSE 'succeeded' END AS outcome, planned::INT AS planned, CASE WHEN planned > 0 AND fresh THEN planned ELSE 0 END AS removed FROM g")
def pln_04(t):
    """Merges executed and verified; contacts without a store have gone since the plans were made."""
    from ..scratch import Scratch

    scratch = Scratch(t.spark, "merges")
    plans = scratch.write(I.merge_plan(t.contacts, t.contact_groups))
    live = t.contacts.where("store_id IS NOT NULL")
    fresh = I.merge_outcomes(plans, t.contacts, live, live).where("outcome NOT IN ('invalidMerge', 'stale')").select("group_id")
    after = scratch.write(I.apply_merges(live, plans.join(fresh, "group_id", "left_semi")))
    return I.merge_outcomes(plans, t.contacts, live, after)
