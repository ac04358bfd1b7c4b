"""Queries over ordered progress and sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import progress as P
from . import query


def samples(t) -> DataFrame:
    """Events as progress samples: each user is a run, the event type its stage."""
    return t.events.select(F.col("user_id").alias("run"), F.col("event_type").alias("stage"), F.col("event_id").alias("completed"), F.lit(200_000).alias("total"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("elapsed"))


_RATES = """
WITH RECURSIVE s AS (SELECT user_id AS run, event_type AS stage, event_id::DOUBLE AS completed, epoch_us(ts) / 1e6 AS elapsed, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) / 1e6, event_id) AS k FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
f(run, k, stage, since, done, rate, samples, completed) AS (
  SELECT run, k, stage, elapsed, completed, NULL::DOUBLE, 0, completed FROM s WHERE k = 1
  UNION ALL
  SELECT f.run, s.k, s.stage,
    CASE WHEN s.stage <> f.stage OR s.elapsed - f.since >= 1.0 THEN s.elapsed ELSE f.since END,
    CASE WHEN s.stage <> f.stage OR s.elapsed - f.since >= 1.0 THEN s.completed ELSE f.done END,
    CASE WHEN s.stage <> f.stage THEN NULL WHEN s.elapsed - f.since < 1.0 OR s.completed < f.done THEN f.rate
      WHEN f.rate IS NULL THEN (s.completed - f.done) / (s.elapsed - f.since) ELSE 0.35 * ((s.completed - f.done) / (s.elapsed - f.since)) + 0.65 * f.rate END,
    CASE WHEN s.stage <> f.stage THEN 0 WHEN s.elapsed - f.since < 1.0 OR s.completed < f.done THEN f.samples ELSE f.samples + 1 END,
    s.completed
  FROM f JOIN s ON s.run = f.run AND s.k = f.k + 1)
, last AS (SELECT * FROM f WHERE (run, k) IN (SELECT run, max(k) FROM s GROUP BY run))
"""


@query("win_05", _RATES + "SELECT run, stage, round(rate, 6) AS rate, samples::INT AS samples FROM last")
def win_05(t):
    return P.rates(samples(t)).select("run", "stage", F.round("rate", 6).alias("rate"), "samples")


@query("win_06", _RATES + "SELECT run, state, CASE WHEN state = 'remaining' THEN round((200000 - completed) / rate)::BIGINT END AS seconds FROM (SELECT *, CASE WHEN rate IS NULL OR rate <= 0 OR samples < 2 THEN 'calculating' WHEN 200000 - completed <= 0 OR (200000 - completed) / rate < 5 THEN 'finishing' ELSE 'remaining' END AS state FROM last)")
def win_06(t):
    state, seconds = P.estimate()
    return P.rates(samples(t)).select("run", state.alias("state"), seconds.alias("seconds"))


@query("win_08", "SELECT event_id, user_id FROM events ORDER BY event_id")
def win_08(t):
    """The order of the source restored after work that loses it."""
    return t.events.select("event_id", "user_id").repartition("user_id").orderBy("event_id")


_STACK = """
WITH RECURSIVE l AS (SELECT user_id, list({'undo': event_type = 'error', 'item': props, 'decision': event_type} ORDER BY ts, event_id) AS ev FROM events WHERE user_id IS NOT NULL GROUP BY user_id),
f(user_id, ev, k, stack) AS (
  SELECT user_id, ev, 0, ev[:0] FROM l
  UNION ALL
  SELECT user_id, ev, k + 1, CASE WHEN ev[k + 1].undo THEN array_slice(stack, 1, len(stack) - 1) ELSE list_append(stack, ev[k + 1]) END FROM f WHERE k < len(ev))
, kept AS (SELECT user_id, unnest(stack) AS e, generate_subscripts(stack, 1) AS place FROM f WHERE k = len(ev))
SELECT user_id, e.item AS item, arg_max(e.decision, place) AS decision FROM kept GROUP BY user_id, e.item
"""


@query("win_09", _STACK)
def win_09(t):
    """The decision each item is left with after undos; an error event undoes the latest decision that still stands."""
    log = t.events.select("user_id", F.col("props").alias("item"), "ts", "event_id", F.when(F.col("event_type") != "error", F.col("event_type")).alias("decision"))
    return P.review_log(log, ["user_id"], "item", ["ts", "event_id"], "decision")


@query("win_10", "SELECT user_id, least(greatest(max(event_id) % 100 - 20, 0), count(*))::BIGINT AS cursor, CASE WHEN least(greatest(max(event_id) % 100 - 20, 0), count(*)) = count(*) THEN count(*) ELSE 0 END AS history, count(*) FILTER (event_type = 'error') AS deletes FROM events GROUP BY user_id")
def win_10(t):
    """A session restored: the cursor within its items, the history only where it fits, deletions counted again."""
    s = t.events.groupBy("user_id").agg(F.count("*").alias("n"), (F.max("event_id") % 100 - 20).alias("saved"), F.count_if(F.col("event_type") == "error").alias("deletes"))
    cursor = F.least(F.greatest("saved", F.lit(0)), "n")
    return s.select("user_id", cursor.alias("cursor"), F.when(cursor == F.col("n"), F.col("n")).otherwise(F.lit(0)).alias("history"), "deletes")


@query("fmt_01", "SELECT event_id, CASE WHEN s < 60 THEN s || ' s' WHEN round(s / 60.0) < 60 THEN round(s / 60.0)::BIGINT || ' min' ELSE (round(s / 60.0)::BIGINT // 60) || ' h ' || (round(s / 60.0)::BIGINT % 60) || ' min' END AS text FROM (SELECT event_id, (event_id % 20000) AS s FROM events)")
def fmt_01(t):
    return t.events.select("event_id", P.remaining_text(F.col("event_id") % 20000).alias("text"))
