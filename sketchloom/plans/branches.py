"""Branches merged and rolled back, graphs of a range of states, exact sums of decimals, as-of joins by stretches of time."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as Y

from ..operators import pairs as P
from ..operators import sketch as S
from ..operators import store as X
from ..operators import timeline as L
from ..sources import tables as T
from . import oracle as O
from .registry import DAY_USERS, query

_DAYS = f"WITH {O.long_cte(DAY_USERS, 'day')}, cm AS (SELECT day, row_number() OVER (ORDER BY day) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT day FROM lf))"


def _long(spark, sf_dir):
    return S.long_form(T.day_users(spark, sf_dir), "token", "day")


def _log(spark, sf_dir):
    """Commits of the days: even ones on one line, odd ones on another, both from the first; with what each adds."""
    long = T.written(_long(spark, sf_dir))
    days = sorted(r[0] for r in T.bounded(long.select("day").distinct(), 10_000))
    links = spark.createDataFrame([(i, max(0, i - 2) if i else None) for i in range(len(days))], "id int, parent int")
    numbers = spark.createDataFrame(list(enumerate(days)), "id int, day string")
    return links, long.join(F.broadcast(numbers), "day").select("id", "reg", "zeros"), len(days)  # a row a day


@query(f"""{_DAYS}, x AS (SELECT CASE WHEN i % 2 = 0 THEN 'even' ELSE 'odd' END AS line, reg, zeros FROM lf JOIN cm USING (day) UNION SELECT 'odd', reg, zeros FROM lf JOIN cm USING (day) WHERE i = 0 UNION SELECT 'merged', reg, zeros FROM lf),
{O.cards_cte('x', 'line')} SELECT line, card FROM card""")
def q_branch_merge(spark, sf_dir):
    """Two lines of commits and the commit that merges them: the state of each."""
    links, deltas, n = _log(spark, sf_dir)
    even, odd = (n - 1, n - 2) if n % 2 else (n - 2, n - 1)
    merged = X.merge_commits(links, even, odd, n)
    states = [X.state_at(merged, deltas, i).withColumn("line", F.lit(line)) for line, i in (("even", even), ("odd", odd), ("merged", n))]
    return S.cardinality(states[0].unionByName(states[1]).unionByName(states[2]), "line")


@query(f"""{_DAYS}, x AS (SELECT 'before' AS state, reg, zeros FROM lf JOIN cm USING (day) WHERE i % 2 = (n - 1) % 2 OR i = 0 UNION SELECT 'after', reg, zeros FROM lf JOIN cm USING (day) WHERE i IN (0, 2, 4)), {O.cards_cte('x', 'state')}
SELECT state, card FROM card""")
def q_branch_rollback(spark, sf_dir):
    """The last day's state, and that of a commit that goes back to the fifth day's."""
    links, deltas, n = _log(spark, sf_dir)
    back = X.roll_back(links, 4, n)
    states = [X.state_at(back, deltas, i).withColumn("state", F.lit(s)) for s, i in (("before", n - 1), ("after", n))]
    return S.cardinality(states[0].unionByName(states[1]), "state")


@query(f"""{_DAYS}, r AS (SELECT lf.* FROM lf JOIN cm USING (day) WHERE i BETWEEN 5 AND 14), {O.pairs_cte('r', key='day')}
SELECT a, b, {O.TAU} AS tau, {O.RHO} AS rho FROM ps WHERE a <> b AND {O.TAU} >= 0.2 AND {O.RHO} <= 0.8""")
def q_state_graph_range(spark, sf_dir):
    """The graph of transitions among the states of ten days."""
    long = T.written(_long(spark, sf_dir))
    days = sorted(r[0] for r in T.bounded(long.select("day").distinct(), 10_000))
    return L.w_graph(long, "day", days[5], days[14], 0.2, 0.8)


@query("""SELECT l_returnflag, l_linestatus, sum(CAST(l_extendedprice AS DECIMAL(12, 2)) * (1 - CAST(l_discount AS DECIMAL(4, 2)))) AS revenue, CAST(sum(CAST(l_quantity AS DECIMAL(12, 2))) AS DECIMAL(22, 2)) AS quantity,
min(CAST(l_tax AS DECIMAL(4, 2))) AS least_tax, CAST(max(l_shipdate) AS DATE) + INTERVAL 90 DAY AS due FROM lineitem GROUP BY l_returnflag, l_linestatus""")
def q_decimal_sums(spark, sf_dir):
    """Exact sums of money, and a date some days on."""
    d = lambda c, p: F.col(c).cast(Y.DecimalType(p, 2))
    g = T.read(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.sum(d("l_extendedprice", 12) * (F.lit(1) - d("l_discount", 4))).alias("revenue"), F.sum(d("l_quantity", 12)).alias("quantity"), F.min(d("l_tax", 4)).alias("least_tax"), F.max("l_shipdate").alias("last"),
    )
    due = (F.to_date("last") + F.expr("INTERVAL 90 DAY")).cast("timestamp_ntz").alias("due")
    return g.select("l_returnflag", "l_linestatus", "revenue", "quantity", "least_tax", due)


@query("""SELECT event_id, p.event_type, p.ts, v.ts AS seen FROM (SELECT *, 1 AS one FROM events WHERE event_type IN ('purchase', 'error')) p ASOF LEFT JOIN (SELECT 1 AS one, max(ts) AS ts FROM events WHERE event_type = 'view' GROUP BY ts) v ON p.one = v.one AND p.ts >= v.ts""")
def q_asof_one_key(spark, sf_dir):
    """Each purchase or error with anyone's latest view: one key for all rows, dealt by days."""
    e = T.read(spark, sf_dir, "events").withColumn("one", F.lit(1))
    views = e.where("event_type = 'view'").select("one", "ts", F.col("ts").alias("seen"))
    asked = e.where("event_type IN ('purchase', 'error')").select("one", "event_id", "event_type", "ts")
    return L.as_of(asked, views, "ts", "seen", "one", stretch=F.to_date("ts")).drop("one")
