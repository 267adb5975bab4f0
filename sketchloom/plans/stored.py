"""Sketches as Roaring bitmaps."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import roaring as RB
from ..operators import sketch as S
from ..sources import tables as T
from . import oracle as O
from .registry import DAY_TYPE_USERS, NATION_PARTS, query

_NATIONS = O.long_cte(NATION_PARTS)
_TYPES = O.long_cte(DAY_TYPE_USERS, "day, event_type")


@query(f"""WITH {_NATIONS}, a AS (SELECT set_id, reg*32+zeros AS pos FROM lf),
g AS (SELECT set_id, CASE WHEN pos - lag(pos) OVER (PARTITION BY set_id ORDER BY pos) = 1 THEN 0 ELSE 1 END AS starts FROM a),
n AS (SELECT set_id, count(*) AS bits, sum(starts)::BIGINT AS runs FROM g GROUP BY set_id),
k AS (SELECT set_id, bits, runs, CASE WHEN bits <= 4096 THEN 2 * bits ELSE 8192 END AS plain FROM n)
SELECT set_id, bits, 4096 AS dense_bytes, (CASE WHEN 2 + 4 * runs < plain THEN 9 + 2 + 4 * runs ELSE 16 + plain END)::INT AS roaring_bytes,
       (2 + 4 * runs >= plain AND bits <= 4096)::INT AS arrays, (2 + 4 * runs >= plain AND bits > 4096)::INT AS bitmaps, (2 + 4 * runs < plain)::INT AS runs FROM k""")
def q_roaring_sizes(spark, sf_dir):
    """Bytes and forms of the nations' sketches in the portable format."""
    long = S.long_form(T.nation_parts(spark, sf_dir), "token", "set_id")
    return RB.sizes(S.pack(long, "set_id").select("set_id", RB.compressed(F.col("bitmap")).alias("roaring")), "set_id")


@query(f"""WITH {_TYPES}, b AS (SELECT DISTINCT event_type, substr(day, 1, 7) AS month, reg, zeros FROM lf),
{O.cards_cte('b', 'event_type, month')}, n AS (SELECT event_type, month, count(*) AS bits FROM b GROUP BY ALL)
SELECT event_type, month, bits, card FROM n JOIN card USING (event_type, month)""")
def q_roaring_merge(spark, sf_dir):
    """Bitmaps of each day and type united by month, and the estimates from their containers."""
    long = S.long_form(T.day_users(spark, sf_dir, "event_type"), "token", "day", "event_type")
    days = RB.from_long(long, "day", "event_type").withColumn("month", F.substring("day", 1, 7))
    months = RB.merge(days, "event_type", "month")
    return months.select("event_type", "month", RB.count(F.col("roaring")).alias("bits")).join(RB.cardinality(months, "event_type", "month"), ["event_type", "month"])


@query(f"""WITH {_TYPES}, c AS (SELECT DISTINCT day, reg, zeros FROM lf WHERE event_type = 'click'), v AS (SELECT DISTINCT day, reg, zeros FROM lf WHERE event_type = 'view'),
d AS (SELECT DISTINCT c.day FROM c SEMI JOIN v USING (day)),
m AS (SELECT coalesce(c.day, v.day) AS day, count(*) AS either, count(*) FILTER (WHERE c.day IS NOT NULL AND v.day IS NOT NULL) AS met, count(*) FILTER (WHERE v.day IS NULL) AS only_click,
  count(*) FILTER (WHERE c.day IS NULL OR v.day IS NULL) AS one FROM c FULL JOIN v ON c.day = v.day AND c.reg = v.reg AND c.zeros = v.zeros GROUP BY ALL)
SELECT day, either, met, only_click, one, met AS shared FROM m SEMI JOIN d USING (day)""")
def q_roaring_algebra(spark, sf_dir):
    """Clicks and views of each day: the four set operations, counted on what they make."""
    long = S.long_form(T.day_users(spark, sf_dir, "event_type"), "token", "day", "event_type")
    r = RB.from_long(long, "day", "event_type")
    a, b = (r.where(F.col("event_type") == t).select("day", F.col("roaring").alias(t)) for t in ("click", "view"))
    x, y = F.col("click"), F.col("view")
    return a.join(b, "day").select(
        "day", RB.count(RB.union(x, y)).alias("either"), RB.count(RB.intersection(x, y)).alias("met"), RB.count(RB.difference(x, y)).alias("only_click"),
        RB.count(RB.symmetric_difference(x, y)).alias("one"), RB.shared(x, y).alias("shared"),
    )


@query(f"WITH {_NATIONS} SELECT set_id, reg, zeros FROM lf")
def q_roaring_round_trip(spark, sf_dir):
    """Written as bitmaps, read back, spread out."""
    path = T.new_path(spark, "roaring")
    RB.from_long(S.long_form(T.nation_parts(spark, sf_dir), "token", "set_id"), "set_id").write.parquet(path)
    return RB.to_long(spark.read.parquet(path), "set_id")
