"""Pieces of SQL for DuckDB from which the queries' oracles are made.

Names ending in _cte return "name AS (...)" items to put behind WITH.
"""

from __future__ import annotations

from ..functions import hashing as H

M = 2**H.P_BITS


def _mul(x: str) -> str:
    return f"((({x})::UHUGEINT*{H.M}::UBIGINT::UHUGEINT)%18446744073709551616::UHUGEINT)::UBIGINT"


def _little(hexed: str, at: str) -> str:
    return "('0x'||" + "||".join(f"substr({hexed},({at})::INT+{2 * i},2)" for i in range(7, -1, -1)) + ")::UBIGINT"


def hash_cte(tokens: str, column: str = "token", p: str = "p") -> str:
    """``p``(token, h, reg, zeros) of the distinct tokens in a relation; zeros null if 32 or more."""
    t = f"{p}_"
    return f"""{t}0 AS (SELECT {column} AS token, hex(encode({column})) AS hx, octet_length(encode({column})) AS n FROM (SELECT DISTINCT {column} FROM {tokens} WHERE {column} IS NOT NULL)),
{t}1 AS (SELECT token, hx, n, list_transform(range(0, n//8), lambda i: {_mul(_little('hx', '16*i+1'))}) AS k FROM {t}0),
{t}2 AS (SELECT token, hx, n, list_transform(k, lambda v: {_mul('xor(v, v>>47)')}) AS k, xor({H.SEED}::UBIGINT, {_mul('n')}) AS h0 FROM {t}1),
{t}3 AS (SELECT token, hx, n, list_reduce(list_prepend(h0, k), lambda a, b: {_mul('xor(a, b)')}) AS hb FROM {t}2),
{t}4 AS (SELECT token, CASE WHEN n%8 > 0 THEN {_mul("xor(hb," + _little("rpad(substr(hx,((n//8)*16+1)::INT,(2*(n%8))::INT),16,'0')", '1') + ")")} ELSE hb END AS ht FROM {t}3),
{t}5 AS (SELECT token, {_mul('xor(ht, ht>>47)')} AS hf FROM {t}4), {t}6 AS (SELECT token, xor(hf, hf>>47) AS h FROM {t}5),
{p} AS (SELECT token, h, (h & {M - 1}::UBIGINT)::INT AS reg, CASE WHEN (h>>{H.P_BITS}) = 0 THEN NULL WHEN bit_count(xor(h>>{H.P_BITS}, (h>>{H.P_BITS})-1))-1 < {H.BITS} THEN (bit_count(xor(h>>{H.P_BITS}, (h>>{H.P_BITS})-1))-1)::INT END AS zeros FROM {t}6)"""


def long_cte(tk: str, keys: str = "set_id", name: str = "lf") -> str:
    """``tk``(keys, token), its hashes ``p`` and the long form ``name``(keys, reg, zeros)."""
    return f"tk AS ({tk}),\n{hash_cte('tk')},\n{name} AS (SELECT DISTINCT {keys}, reg, zeros FROM tk JOIN p USING (token) WHERE zeros IS NOT NULL)"


def card_cte(counts: str, keys: str, name: str = "card", column: str = "card", c: str = "c") -> str:
    """``name``(keys, column) from a relation of (keys, zeros, c); keys may be empty."""
    by = f"GROUP BY {keys}" if keys else ""
    join = f"LEFT JOIN {name}_k USING ({keys})" if keys else f"CROSS JOIN {name}_k"
    lead = f"{keys}, " if keys else ""
    return f"""{name}_k AS (SELECT {lead}min(zeros) AS k, arg_min({c}, zeros) AS ck FROM {counts} WHERE {c} > 0 AND {c} < {M} {by}),
{name} AS (SELECT {lead}greatest(0, round(sum(CASE WHEN {c} < {M} THEN -{M}*ln(1-{c}/{M}.0::DOUBLE) WHEN k IS NOT NULL THEN -{M}*ln(1-ck/{M}.0::DOUBLE)*power(2, k-zeros) ELSE {M}*ln({M}) END))) AS {column} FROM {counts} {join} {by})"""


def cards_cte(lf: str = "lf", keys: str = "set_id", name: str = "card", column: str = "card") -> str:
    """``name``(keys, column) from a long form."""
    lead = f"{keys}, " if keys else ""
    by = f"GROUP BY {lead}zeros"
    return f"{name}_c AS (SELECT {lead}zeros, count(*) AS c FROM {lf} {by}),\n" + card_cte(f"{name}_c", keys, name, column)


def pairs_cte(lf: str = "lf", other: str | None = None, name: str = "ps", key: str = "set_id") -> str:
    """``name`` with the columns of ``operators.pairs.overlaps``."""
    other = other or lf
    measures = {"card_a": "ca", "card_b": "cb", "card_ab": "cab", "card_a_not_b": "ca-cab", "card_b_not_a": "cb-cab", "card_or": "ca+cb-cab", "card_xor": "ca+cb-2*cab"}
    out = f"""{name}_a AS (SELECT {key} AS a, zeros, count(*) AS c FROM {lf} GROUP BY ALL),
{name}_b AS (SELECT {key} AS b, zeros, count(*) AS c FROM {other} GROUP BY ALL),
{name}_ab AS (SELECT x.{key} AS a, y.{key} AS b, x.zeros, count(*) AS c FROM {lf} x JOIN {other} y ON x.reg = y.reg AND x.zeros = y.zeros GROUP BY ALL),
{name}_n AS (SELECT a, b, zeros, sum(ca)::BIGINT AS ca, sum(cb)::BIGINT AS cb, sum(cab)::BIGINT AS cab FROM (
  SELECT a, b, zeros, c AS ca, 0 AS cb, 0 AS cab FROM {name}_a CROSS JOIN (SELECT DISTINCT b FROM {name}_b)
  UNION ALL SELECT a, b, zeros, 0, c, 0 FROM {name}_b CROSS JOIN (SELECT DISTINCT a FROM {name}_a)
  UNION ALL SELECT a, b, zeros, 0, 0, c FROM {name}_ab) GROUP BY ALL),
"""
    joins = []
    for k, x in measures.items():
        out += f"{name}_{k}_c AS (SELECT a, b, zeros, {x} AS c FROM {name}_n),\n" + card_cte(f"{name}_{k}_c", "a, b", f"{name}_{k}", k) + ",\n"
        joins.append(f"{name}_{k}")
    pops = f"(SELECT a, b, sum(ca)::BIGINT AS pop_a, sum(cb)::BIGINT AS pop_b, sum(cab)::BIGINT AS pop_ab FROM {name}_n GROUP BY ALL)"
    return out + f"{name} AS (SELECT a, b, {', '.join(measures)}, pop_a, pop_b, pop_ab FROM {pops} " + " ".join(f"JOIN {j} USING (a, b)" for j in joins) + ")"


def rank_cte(vectors: str, key: str, order: str, name: str = "rk") -> str:
    """``name``(i, key, is_base, rank) of a long form's vectors in order, by elimination; the CTEs are recursive.

    A vector stands as 64 bits, the XOR of a hash of each of its positions: that
    map is linear, so sums stay sums, and it keeps the rank of some 30 vectors
    but for odds of one in billions.  A basis in descending order reduces a
    number by taking the lesser of it and its sum with each element.
    """
    return f"""{name}_h AS (SELECT key, h, row_number() OVER (ORDER BY o) AS i FROM (SELECT {key} AS key, {order} AS o, bit_xor(hash(reg*32+zeros)) AS h FROM {vectors} GROUP BY {key}, {order})),
{name}_r(i, key, is_base, rank, basis) AS (SELECT 0::BIGINT, NULL::VARCHAR, false, 0, []::UBIGINT[] UNION ALL
  SELECT i, key, red <> 0, rank + (red <> 0)::INT, CASE WHEN red <> 0 THEN list_reverse_sort(list_append(basis, red)) ELSE basis END FROM (
    SELECT h.i, h.key, r.rank, r.basis, list_reduce(list_prepend(h.h, r.basis), lambda x, b: least(x, xor(x, b))) AS red FROM {name}_r r JOIN {name}_h h ON h.i = r.i + 1)),
{name} AS (SELECT i, key, is_base, rank FROM {name}_r WHERE i > 0)"""


TAU = "CASE WHEN card_b > 0 THEN greatest(0, least(1, card_ab/card_b)) ELSE 0.0 END"
RHO = "CASE WHEN card_b > 0 THEN greatest(0, least(1, card_a_not_b/card_b)) ELSE 1.0 END"


def bias_case(raw: str, steps: int = 160) -> str:
    """The bias at a raw estimate, by linear interpolation between set sizes from 0 to 5 M.

    The expected raw estimate of each size is summed up in SQL: a register's
    largest observation is at most k with probability exp(-n/M * 2^-k).
    """
    alpha = "(0.7213::DOUBLE / (1 + 1.079::DOUBLE / 65536))"
    total = f"exp(-n / {M}) + list_sum(list_transform(range(1, 64), lambda k: power(2.0::DOUBLE, -k) * (exp(-n / {M} * power(2.0::DOUBLE, -k)) - exp(-n / {M} * power(2.0::DOUBLE, 1 - k)))))"
    sizes = f"(SELECT range AS i, 5.0::DOUBLE * {M} * range / {steps - 1} AS n FROM range({steps}))"
    raws = f"(SELECT i, round({alpha} * {M} / ({total}), 4) AS x, round({alpha} * {M} / ({total}) - n, 4) AS y FROM {sizes})"
    table = f"(SELECT x AS x1, y AS y1, lead(x) OVER (ORDER BY i) AS x2, lead(y) OVER (ORDER BY i) AS y2 FROM {raws})"
    inner = f"(SELECT y1 + ({raw} - x1)/(x2 - x1)*(y2 - y1) FROM {table} v WHERE x1 < {raw} AND {raw} <= x2)"
    return f"CASE WHEN {raw} <= (SELECT min(x) FROM {raws}) THEN (SELECT max(y) FROM {raws}) WHEN {raw} > (SELECT max(x) FROM {raws}) THEN 0.0 ELSE {inner} END"
