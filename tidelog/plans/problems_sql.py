"""Oracle SQL of the queries in ``problems``."""

from __future__ import annotations

from tidelog.plans.problems import P5_NOW_US, STORED_UP_TO

KEY = """hex("cdc$stream_id") AS stream_id, lower("cdc$time") AS change_time, "cdc$batch_seq_no" AS batch_seq_no"""
TICKS = """(CAST('0x' || substr("cdc$time", 16, 3) || substr("cdc$time", 10, 4) || substr("cdc$time", 1, 8) AS BIGINT) - 122192928000000000)"""


def floor_sql(a: str, by: int) -> str:
    """Floor division of whole numbers, also below zero, where // cuts off towards zero."""
    return f"(({a} - (({a}) % {by} + {by}) % {by}) // {by})"


US = floor_sql(TICKS, 10)
ARRIVED = "epoch_us(arrived_at)"
NEVER = 2**63 - 1

ROWS = f"rows_ AS (SELECT {KEY}, {US} AS us, {ARRIVED} AS arrived_us, * FROM scalar_scylla_cdc_log)"

_COPIES = f"""
WITH c AS (SELECT {KEY}, {ARRIVED} AS arrived_us, delivery_batch, "cdc$operation" AS operation, pk, ck, v, s FROM scalar_scylla_cdc_log),
r AS (SELECT *, row_number() OVER (PARTITION BY stream_id, change_time, batch_seq_no
      ORDER BY arrived_us NULLS LAST, operation NULLS LAST, ck NULLS LAST, delivery_batch NULLS LAST, pk NULLS LAST, s NULLS LAST, v NULLS LAST) AS n FROM c)
"""


def _current(table: str, ck: list[str], cols: list[str], ranges: bool) -> str:
    """Last write wins per cell by row numbers, deletions by joins: another way than the fold's."""
    k = ", ".join(["pk", *ck])
    flags = "".join(f', "cdc$deleted_{c}" AS del_{c}' for c in cols)
    sql = f"""WITH d AS (SELECT DISTINCT {KEY}, {US} AS us, "cdc$operation" AS op, "cdc$ttl" AS ttl, {k}, {", ".join(cols)}{flags} FROM {table}),
    row_dead AS (SELECT {k}, max(us) AS us FROM d WHERE op = 3 GROUP BY ALL),
    part_dead AS (SELECT pk, max(us) AS us FROM d WHERE op = 4 GROUP BY ALL)"""
    cells = [f"SELECT {k}, '' AS col, us, 0 AS gone, NULL AS val, change_time, ttl FROM d WHERE op = 2"]
    for c in cols:
        cells.append(
            f"SELECT {k}, '{c}' AS col, us, CASE WHEN {c} IS NULL THEN 1 ELSE 0 END AS gone, "
            + (f"printf('%030.10f', {c} + 1e12)" if c == "v" else c)
            + f" AS val, change_time, ttl FROM d WHERE op IN (1, 2) AND ({c} IS NOT NULL OR del_{c})"
        )
    sql += ", cells AS (" + " UNION ALL ".join(cells) + ")"
    sql += f""", best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {k}, col ORDER BY us DESC, gone DESC, val DESC NULLS LAST,
        coalesce(ttl, {NEVER}) DESC, change_time DESC) AS n FROM cells) WHERE n = 1)"""
    on = " AND ".join(f"b.{c} IS NOT DISTINCT FROM x.{c}" for c in ["pk", *ck])
    dead = f"coalesce((SELECT max(x.us) FROM row_dead x WHERE {on}), -1), coalesce((SELECT max(x.us) FROM part_dead x WHERE x.pk = b.pk), -1)"
    if ranges:
        sql += """, rr AS (SELECT *, lag(op) OVER w AS sop, lag(pk) OVER w AS spk, lag(c1) OVER w AS s1, lag(c2) OVER w AS s2 FROM
            (SELECT DISTINCT stream_id, change_time, batch_seq_no, us, op, pk, c1, c2 FROM d WHERE op BETWEEN 5 AND 8)
            WINDOW w AS (PARTITION BY stream_id, change_time ORDER BY batch_seq_no)),
        pairs AS (SELECT * FROM rr WHERE op IN (7, 8) AND sop IN (5, 6) AND spk = pk)"""
        dead += """, coalesce((SELECT max(x.us) FROM pairs x WHERE x.pk = b.pk AND (
            (x.s2 IS NULL AND x.c2 IS NULL AND (x.s1 IS NULL OR b.c1 > x.s1 OR (x.sop = 5 AND b.c1 = x.s1))
                AND (x.c1 IS NULL OR b.c1 < x.c1 OR (x.op = 7 AND b.c1 = x.c1)))
            OR ((x.s2 IS NOT NULL OR x.c2 IS NOT NULL) AND coalesce(x.s1, x.c1) = coalesce(x.c1, x.s1) AND b.c1 = coalesce(x.s1, x.c1)
                AND (x.s2 IS NULL OR b.c2 > x.s2 OR (x.sop = 5 AND b.c2 = x.s2))
                AND (x.c2 IS NULL OR b.c2 < x.c2 OR (x.op = 7 AND b.c2 = x.c2))))), -1)"""
    sql += f""", live AS (SELECT * FROM best b WHERE gone = 0 AND (ttl IS NULL OR us + ttl * 1000000 > {P5_NOW_US})
        AND us > greatest({dead}))"""
    times = ", ".join(f"coalesce(max(CASE WHEN col = '{c}' THEN change_time END), '') AS {c}_time" for c in cols)
    return sql + f" SELECT {k}, {times} FROM live GROUP BY {k}"


_SCALAR = _current("scalar_scylla_cdc_log", ["ck"], ["v", "s"], False)
MULTI_ROWS = _current("multi_ck_scylla_cdc_log", ["c1", "c2"], ["v"], True)

_LATE = f"""WITH c AS (SELECT {KEY}, {US} AS us, min({ARRIVED}) AS first_us FROM scalar_scylla_cdc_log GROUP BY ALL),
p AS (SELECT *, {floor_sql('us', 3600000000)} * 3600000000 AS period_us FROM c),
f AS (SELECT *, CASE WHEN first_us < period_us + 3600000000 THEN 'on_time' WHEN first_us <= period_us + 25200000000 THEN 'correction' ELSE 'too_late' END AS fate FROM p)"""

GENERATIONS = f"""WITH g AS (SELECT epoch_us(time) AS generation_us, flatten(list(streams)) AS streams FROM cdc_streams_descriptions WHERE time IS NOT NULL GROUP BY time),
m AS (SELECT DISTINCT generation_us, hex(unnest(streams)) AS stream_id FROM g),
c AS (SELECT DISTINCT {KEY}, {US} AS us FROM scalar_scylla_cdc_log),
a AS (SELECT c.*, g.generation_us FROM c ASOF LEFT JOIN (SELECT generation_us FROM g) g ON c.us >= g.generation_us),
r AS (SELECT a.stream_id, change_time, batch_seq_no, a.generation_us, m.stream_id IS NOT NULL AS listed FROM a LEFT JOIN m ON m.generation_us = a.generation_us AND m.stream_id = a.stream_id)"""

_K = "stream_id, change_time, batch_seq_no"
SQL = {
    "p1_found": f"SELECT {KEY} FROM scalar_scylla_cdc_log GROUP BY ALL HAVING count(*) > 1",
    "p1_first_copies": f"{_COPIES} SELECT * EXCLUDE (n) FROM r WHERE n = 1",
    "p1_new_changes": f"""WITH c AS (SELECT {KEY}, {ARRIVED} AS arrived_us, delivery_batch FROM scalar_scylla_cdc_log),
        n AS (SELECT *, row_number() OVER (PARTITION BY {_K} ORDER BY arrived_us, delivery_batch) AS k FROM c WHERE delivery_batch > {STORED_UP_TO})
        SELECT {_K}, arrived_us, delivery_batch FROM n WHERE k = 1 AND ({_K}) NOT IN (SELECT ({_K}) FROM c WHERE delivery_batch <= {STORED_UP_TO})""",
    "p2_found": f"""WITH done AS (SELECT DISTINCT l.delivery_batch FROM (SELECT DISTINCT delivery_batch FROM scalar_scylla_cdc_log) l
        JOIN consumer_runs r ON r.status = 'committed' AND l.delivery_batch BETWEEN r.first_batch AND r.last_batch)
        SELECT {KEY} FROM scalar_scylla_cdc_log GROUP BY ALL
        HAVING count(*) FILTER (WHERE delivery_batch IN (SELECT delivery_batch FROM done)) = 0""",
    "p2_pending_batches": """SELECT delivery_batch, count(*) AS n_rows FROM scalar_scylla_cdc_log l WHERE NOT EXISTS
        (SELECT 1 FROM consumer_runs r WHERE r.status = 'committed' AND l.delivery_batch BETWEEN r.first_batch AND r.last_batch) GROUP BY 1""",
    "p2_processed_files": f"SELECT {KEY}, delivery_batch FROM scalar_scylla_cdc_log",
    "p3_found": """SELECT hex("cdc$stream_id") AS stream_id FROM scalar_scylla_cdc_log GROUP BY 1
        HAVING count(*) >= 0.02 * (SELECT count(*) FROM scalar_scylla_cdc_log)""",
    "p3_per_stream": f"""WITH r AS (SELECT hex("cdc$stream_id") AS stream_id, {US} AS us FROM scalar_scylla_cdc_log),
        o AS (SELECT *, row_number() OVER (PARTITION BY stream_id ORDER BY us) AS i, count(*) OVER (PARTITION BY stream_id) AS n FROM r)
        SELECT stream_id, count(*) AS n_rows, min(us) AS first_us, max(us) AS last_us, max(CASE WHEN i = (n * 5 + 9) // 10 THEN us END) AS median_us,
        max(CASE WHEN i = (n * 9 + 9) // 10 THEN us END) AS p90_us FROM o GROUP BY stream_id""",
    "p4_found": f"{GENERATIONS} SELECT {_K} FROM r WHERE NOT listed",
    "p4_generation_of_changes": f"{GENERATIONS} SELECT * FROM r",
    "p5_found": f"""SELECT 'scalar' AS base_table, pk, ck AS c1, CAST(0 AS BIGINT) AS c2, v_time, s_time FROM ({_SCALAR})
        UNION ALL SELECT 'multi_ck', pk, c1, c2, v_time, '' FROM ({MULTI_ROWS})""",
    "p6_found": f"{_LATE} SELECT {_K} FROM f WHERE fate = 'correction'",
    "p6_hourly": f"""{_LATE}, t AS (SELECT *, fate <> 'too_late' AS let_in, fate = 'on_time' AS early FROM f),
        g AS (SELECT *, CASE WHEN let_in THEN us - max(CASE WHEN let_in THEN us END) OVER w END AS gap, CASE WHEN early THEN us - max(CASE WHEN early THEN us END) OVER w END AS early_gap
            FROM t WINDOW w AS (PARTITION BY stream_id, period_us ORDER BY us, change_time, batch_seq_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
        SELECT stream_id, period_us, count(*) FILTER (WHERE early) AS n_provisional, count(*) FILTER (WHERE fate = 'correction') AS n_corrections,
        count(*) FILTER (WHERE let_in) AS n_final, count(*) FILTER (WHERE NOT let_in) AS n_too_late, min(us) FILTER (WHERE let_in) AS first_event_us,
        max(us) FILTER (WHERE let_in) AS last_event_us, coalesce(max(early_gap), 0) AS provisional_gap_us, coalesce(max(gap), 0) AS longest_gap_us FROM g GROUP BY 1, 2""",
}
SQL["p5_current_scalar"] = f"""WITH t AS ({_SCALAR}), l AS (SELECT lower("cdc$time") AS ct, pk, ck, max(v) AS v, max(s) AS s FROM scalar_scylla_cdc_log WHERE "cdc$operation" IN (1, 2) GROUP BY ALL)
    SELECT t.pk, t.ck, a.v, b.s FROM t LEFT JOIN l a ON a.ct = v_time AND a.pk = t.pk AND a.ck = t.ck LEFT JOIN l b ON b.ct = s_time AND b.pk = t.pk AND b.ck = t.ck"""
