"""Where the plan modules register their queries."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame, with the SQL for the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


#: The token relations of ``sources.tables``, as SQL.
NATION_PARTS = "SELECT n_name AS set_id, CAST(l_partkey AS VARCHAR) AS token FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey"
BRAND_WORDS = r"SELECT p_brand AS set_id, unnest(list_filter(regexp_split_to_array(p_name, '\s+'), lambda w: w <> '')) AS token FROM part"
DAY_USERS = "SELECT strftime(ts, '%Y-%m-%d') AS day, CAST(user_id AS VARCHAR) AS token FROM events"
DAY_TYPE_USERS = "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, CAST(user_id AS VARCHAR) AS token FROM events"
