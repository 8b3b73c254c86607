"""Oracle SQL of the queries in ``reference``."""

from __future__ import annotations

from tidelog.plans.problems import P5_NOW_US
from tidelog.plans.problems_sql import GENERATIONS, KEY, MULTI_ROWS, TICKS, US, floor_sql
from tidelog.plans.reference import CLOCK_MS, FROM_MS, HOUR_MS, ORIGIN_MS, REPLAY_TO_MS, TASK_TO_MS, TO_MS

_STARTS = "s AS (SELECT DISTINCT epoch_us(time) AS start_us FROM cdc_streams_descriptions WHERE time IS NOT NULL)"
_GENS = f"{_STARTS}, g AS (SELECT start_us, lead(start_us) OVER (ORDER BY start_us) AS end_us FROM s)"
_VNODES = """t AS (SELECT DISTINCT stream_id, token FROM cdc_stream_tokens WHERE stream_id IS NOT NULL AND token IS NOT NULL),
    v AS (SELECT hex(stream_id) AS stream_id, token, coalesce((SELECT min(r.token) FROM token_ring r WHERE r.token >= t.token), (SELECT min(token) FROM token_ring)) AS vnode_token FROM t),
    a AS (SELECT *, vnode_token = (SELECT min(token) FROM token_ring) AS wraparound FROM v)"""


def _within(lo_ms: int, hi_ms: int) -> str:
    return f"{TICKS} > {lo_ms * 10_000 + 9_999} AND {TICKS} <= {hi_ms * 10_000 + 9_999}"


_MS = floor_sql(TICKS, 10_000)


def _counts(length: int) -> str:
    return f"""c AS (SELECT hex("cdc$stream_id") AS stream_id, {floor_sql(f"({_MS} - {ORIGIN_MS} + {length - 1})", length)} AS bucket, count(*) AS n FROM scalar_scylla_cdc_log GROUP BY ALL)"""


def _best(table: str, keys: str, value: str, where: str = "true", time: str = US) -> str:
    """The winning write of one column."""
    return f"""b AS (SELECT * FROM (SELECT {keys}, {value} AS val, {value} IS NULL AS gone, {time} AS us, "cdc$ttl" AS ttl, lower("cdc$time") AS change_time,
        row_number() OVER (PARTITION BY {keys} ORDER BY {time} DESC, {value} IS NULL DESC, {value} DESC, coalesce("cdc$ttl", 9223372036854775807) DESC, lower("cdc$time") DESC) AS n
        FROM {table} WHERE "cdc$operation" IN (1, 2) AND ({value} IS NOT NULL OR "cdc$deleted_{value}") AND {where}) WHERE n = 1)"""


_D = """d AS (SELECT event_id AS seq, epoch_us(ts) AS ts_us, user_id AS pk, CAST((event_id * 7919 + user_id) % 10 AS INTEGER) AS op,
    CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS ck, value AS v FROM events)"""
_RANGES = """r AS (SELECT *, lag(seq) OVER w AS start_seq, lag(op) OVER w AS start_op, lag(ck) OVER w AS start_ck FROM d WHERE op BETWEEN 5 AND 8
    WINDOW w AS (PARTITION BY pk ORDER BY ts_us, seq))"""
_POST = """p AS (SELECT *, lag(op) OVER w AS prev_op, lag(seq) OVER w AS prev_seq FROM d WHERE op <> 0 WINDOW w AS (PARTITION BY pk ORDER BY ts_us, seq)),
    q AS (SELECT * FROM p WHERE op = 9 AND prev_op IN (1, 2))"""
_MPAIRS = f"""m AS (SELECT DISTINCT {KEY}, {US} AS us, "cdc$operation" AS op, pk, c1, c2 FROM multi_ck_scylla_cdc_log WHERE "cdc$operation" BETWEEN 5 AND 8),
    o AS (SELECT *, lag(op) OVER w AS sop, lag(batch_seq_no) OVER w AS start_seq, lag(c1) OVER w AS s1, lag(c2) OVER w AS s2 FROM m WINDOW w AS (PARTITION BY stream_id, change_time ORDER BY batch_seq_no)),
    pairs AS (SELECT * FROM o WHERE op IN (7, 8) AND sop IN (5, 6))"""


def _elements(elem: str, value: str, joined: str) -> str:
    return f"""WITH {_D}, e AS (SELECT pk, ts_us AS us, seq % 5 AS m, ck, seq FROM d WHERE ck IS NOT NULL),
    cells AS (SELECT pk, {elem} AS elem, us, 0 AS gone, {value} AS value FROM e WHERE m <> 2
        UNION ALL SELECT pk, {elem}, us, 1, NULL FROM e WHERE m = 2),
    w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pk, elem ORDER BY us DESC, gone DESC, value DESC) AS n FROM cells) WHERE n = 1),
    x AS (SELECT pk, max(us) - 1 AS cleared FROM e WHERE m = 4 GROUP BY pk)
    SELECT w.pk, string_agg({joined}) AS elements FROM w LEFT JOIN x ON x.pk = w.pk WHERE gone = 0 AND (cleared IS NULL OR us > cleared) GROUP BY w.pk"""


_COLUMNS = ["cdc$time", "cdc$batch_seq_no", "cdc$operation", "cdc$ttl", "cdc$deleted_v", "pk", "c1", "c2", "v", "arrived_at", "delivery_batch"]
_TOPOLOGY = "e AS (SELECT user_id AS node, epoch_us(ts) AS us, CASE event_type WHEN 'signup' THEN 'add' WHEN 'error' THEN 'remove' WHEN 'view' THEN 'up' ELSE 'down' END AS kind FROM events)"
_K = "stream_id, change_time, batch_seq_no"
_TEXT = "coalesce(CAST({} AS VARCHAR), 'NULL')"
SQL = {
    "gen_starts": f"WITH {_STARTS} SELECT * FROM s",
    "gen_list": f"WITH {_GENS} SELECT * FROM g WHERE start_us <= {FROM_MS * 1000 - 30_000_000}",
    "gen_next": f"WITH {_GENS} SELECT * FROM g WHERE start_us > {FROM_MS * 1000} ORDER BY start_us LIMIT 1",
    "gen_end": f"WITH {_STARTS} SELECT min(start_us) AS end_us FROM s WHERE start_us > {FROM_MS * 1000}",
    "gen_streams": "SELECT DISTINCT epoch_us(time) AS start_us, hex(unnest(streams)) AS stream_id FROM cdc_streams_descriptions WHERE time IS NOT NULL",
    "stream_vnodes": f"WITH {_VNODES} SELECT * FROM a",
    "vnode_tasks": f"WITH {_VNODES} SELECT vnode_token, wraparound, count(*) AS n_streams, min(stream_id) AS first_stream FROM (SELECT DISTINCT vnode_token, wraparound, stream_id FROM a) GROUP BY 1, 2",
    "window_scan": f"SELECT {KEY}, {TICKS} AS ticks, delivery_batch FROM scalar_scylla_cdc_log WHERE {_within(FROM_MS, TO_MS)}",
    "task_scan": f"""WITH {_VNODES} SELECT {KEY}, pk, delivery_batch FROM scalar_scylla_cdc_log WHERE {_within(FROM_MS, TASK_TO_MS)}
        AND hex("cdc$stream_id") IN (SELECT stream_id FROM a WHERE vnode_token = (SELECT vnode_token FROM a JOIN (SELECT hex("cdc$stream_id") AS stream_id FROM scalar_scylla_cdc_log) USING (stream_id)
            GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1))""",
    "task_scan_all": f"""WITH {_VNODES}, tasks AS (SELECT DISTINCT stream_id AS task_stream, vnode_token, wraparound FROM a) SELECT {KEY}, pk, delivery_batch, vnode_token, wraparound
        FROM scalar_scylla_cdc_log JOIN tasks ON hex("cdc$stream_id") = task_stream WHERE {_within(0, CLOCK_MS)}""",
    "window_counts": f"WITH {_counts(30_000)} SELECT * FROM c",
    "window_running_total": f"WITH {_counts(HOUR_MS)} SELECT *, CAST(sum(n) OVER (PARTITION BY stream_id ORDER BY bucket) AS BIGINT) AS total FROM c",
    "window_last_non_empty": f"WITH {_counts(30_000)} SELECT stream_id, max(bucket) AS last_bucket FROM c GROUP BY 1",
    "window_fetch": f"""WITH {_GENS}, m AS (SELECT {floor_sql('start_us', 1000)} AS a, {floor_sql('end_us', 1000)} AS b, {FROM_MS - 10_000} AS safe FROM g),
        u AS (SELECT *, coalesce(safe >= b, false) AS ends, CASE WHEN safe >= b THEN b ELSE safe END AS until FROM m),
        k AS (SELECT *, safe >= a AS ok, a > 0 AND until - a > 30000 AS crop FROM u)
        SELECT a AS gen_start_ms, CASE WHEN ok THEN a END AS start_ms, CASE WHEN ok THEN CASE WHEN crop THEN a + 30000 ELSE until END END AS end_ms,
        CASE WHEN ok THEN crop END AS cropped, CASE WHEN ok THEN ends AND NOT crop END AS last,
        CASE WHEN NOT ok THEN 30000 WHEN crop THEN 1000 ELSE 10000 END AS pace_ms FROM k""",
    "time_functions": f"""SELECT DISTINCT lower("cdc$time") AS change_time, {TICKS} AS ticks, {US} AS us, {_MS} AS ms, {_MS} * 10000 AS first_tick,
        {_MS} * 10000 + 9999 AS last_tick FROM scalar_scylla_cdc_log""",
    "operation_counts": 'SELECT CAST("cdc$operation" AS INTEGER) AS op, count(*) AS n FROM multi_ck_scylla_cdc_log GROUP BY 1',
    "operation_targets": f"""SELECT DISTINCT {KEY}, CASE WHEN "cdc$operation" = 4 THEN 'no partition/' || {_TEXT.format("pk")} ELSE CASE "cdc$operation" WHEN 1 THEN 'cells/' WHEN 2 THEN 'row/'
        WHEN 3 THEN 'no row/' ELSE 'bound/' END || {_TEXT.format("pk")} || '/' || {_TEXT.format("c1")} || '/' || {_TEXT.format("c2")} END AS target FROM multi_ck_scylla_cdc_log""",
    "row_keys": "SELECT DISTINCT pk, c1, c2 FROM multi_ck_scylla_cdc_log",
    "base_rows": "SELECT pk, ck, v, s, delivery_batch FROM scalar_scylla_cdc_log",
    "cell_states": " UNION ALL ".join(
        f"""SELECT DISTINCT {KEY}, CAST("cdc$operation" AS INTEGER) AS op, '{c}' AS col, CASE WHEN {c} IS NOT NULL THEN 'value' WHEN "cdc$deleted_{c}" THEN 'null' ELSE 'unset' END AS state
        FROM scalar_scylla_cdc_log WHERE "cdc$operation" IN (1, 2)""" for c in ("v", "s")
    ),
    "ttl_values": f"""SELECT DISTINCT {KEY}, CAST("cdc$ttl" AS INTEGER) AS ttl FROM scalar_scylla_cdc_log WHERE "cdc$ttl" IS NOT NULL""",
    "replay_delta": f"""WITH l AS (SELECT * FROM scalar_scylla_cdc_log WHERE {_within(0, REPLAY_TO_MS)} AND "cdc$operation" IN (1, 2)),
        {_best("l", "pk, ck", "v").replace("b AS", "bv AS", 1)}, {_best("l", "pk, ck", "s").replace("b AS", "bs AS", 1)},
        k AS (SELECT pk, ck, max({US}) FILTER (WHERE "cdc$operation" = 2) AS us FROM l GROUP BY ALL)
        SELECT pk, ck, bv.val AS v, bs.val AS s, greatest(k.us, bv.us, bs.us) AS write_us FROM k LEFT JOIN bv USING (pk, ck) LEFT JOIN bs USING (pk, ck)
        WHERE greatest(k.us, bv.us, bs.us) IS NOT NULL""",
    "replay_delta_all": f"""WITH l AS (SELECT * FROM scalar_scylla_cdc_log WHERE {_within(0, CLOCK_MS)} AND "cdc$operation" IN (1, 2)),
        {_best("l", "pk, ck", "v").replace("b AS", "bv AS", 1)}, {_best("l", "pk, ck", "s").replace("b AS", "bs AS", 1)},
        k AS (SELECT pk, ck, max({US}) FILTER (WHERE "cdc$operation" = 2) AS us FROM l GROUP BY ALL)
        SELECT pk, ck, bv.val AS v, bs.val AS s, greatest(k.us, bv.us, bs.us) AS write_us FROM k LEFT JOIN bv USING (pk, ck) LEFT JOIN bs USING (pk, ck)
        WHERE greatest(k.us, bv.us, bs.us) IS NOT NULL""",
    "ttl_live_rows": f"WITH {_best('scalar_scylla_cdc_log', 'pk, ck', 'v')} SELECT pk, ck, val AS v FROM b WHERE NOT gone AND (ttl IS NULL OR us + ttl * 1000000 > {P5_NOW_US})",
    "row_delete_apply": f"""WITH {_best('scalar_scylla_cdc_log', 'pk, ck', 'v')}, t AS (SELECT pk, ck, max({US}) AS us FROM scalar_scylla_cdc_log WHERE "cdc$operation" = 3 GROUP BY ALL)
        SELECT pk, ck, val AS v FROM b WHERE NOT gone AND NOT EXISTS (SELECT 1 FROM t WHERE t.pk = b.pk AND t.ck = b.ck AND t.us >= b.us)""",
    "partition_delete_apply": f"""WITH {_best('scalar_scylla_cdc_log', 'pk, ck', 'v')}, t AS (SELECT pk, max({US}) AS us FROM scalar_scylla_cdc_log WHERE "cdc$operation" = 4 GROUP BY ALL)
        SELECT pk, ck, val AS v FROM b WHERE NOT gone AND NOT EXISTS (SELECT 1 FROM t WHERE t.pk = b.pk AND t.us >= b.us)""",
    "range_delete_pairs": f"""WITH {_MPAIRS} SELECT stream_id, change_time, start_seq, batch_seq_no AS end_seq, pk, s1 AS from_c1, s2 AS from_c2, c1 AS to_c1, c2 AS to_c2,
        sop = 5 AS from_included, op = 7 AS to_included FROM pairs""",
    "range_orphans": f"WITH {_D}, {_RANGES} SELECT seq, pk, op FROM r WHERE op IN (7, 8) AND (start_op IS NULL OR start_op IN (7, 8))",
    "range_pairs_across_time": f"WITH {_D}, {_RANGES} SELECT seq AS end_seq, start_seq, pk, start_ck AS from_ck, ck AS to_ck FROM r WHERE op IN (7, 8) AND start_op IN (5, 6)",
    "range_delete_apply": f"""WITH {_best('multi_ck_scylla_cdc_log', 'pk, c1, c2', 'v')}, {_MPAIRS}
        SELECT pk, c1, c2, val AS v FROM b WHERE NOT gone AND NOT EXISTS (SELECT 1 FROM pairs x WHERE x.pk = b.pk AND x.us >= b.us AND (
        (x.s2 IS NULL AND x.c2 IS NULL AND (x.s1 IS NULL OR b.c1 > x.s1 OR (x.sop = 5 AND b.c1 = x.s1)) AND (x.c1 IS NULL OR b.c1 < x.c1 OR (x.op = 7 AND b.c1 = x.c1)))
        OR ((x.s2 IS NOT NULL OR x.c2 IS NOT NULL) AND coalesce(x.s1, x.c1) = coalesce(x.c1, x.s1) AND b.c1 = coalesce(x.s1, x.c1)
            AND (x.s2 IS NULL OR b.c2 > x.s2 OR (x.sop = 5 AND b.c2 = x.s2)) AND (x.c2 IS NULL OR b.c2 < x.c2 OR (x.op = 7 AND b.c2 = x.c2)))))""",
    "lww_cells": f"""WITH {_best('scalar_scylla_cdc_log', 'pk, ck', 'v').replace("b AS", "bv AS", 1)}, {_best('scalar_scylla_cdc_log', 'pk, ck', 's').replace("b AS", "bs AS", 1)}
        SELECT pk, ck, 'v' AS col, us, gone, change_time FROM bv UNION ALL SELECT pk, ck, 's', us, gone, change_time FROM bs""",
    "postimage_pairs": f"WITH {_D}, {_POST} SELECT seq, prev_seq, prev_op AS applied_op FROM q",
    "replay_postimage": f"WITH {_D}, {_POST} SELECT pk, ck, v, ts_us AS write_us FROM (SELECT *, row_number() OVER (PARTITION BY pk, ck ORDER BY ts_us DESC, v DESC NULLS LAST) AS n FROM q) WHERE n = 1",
    "preimage_check": """WITH p AS (SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderkey % 13 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice,
        CASE WHEN o_orderkey % 29 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority FROM orders)
        SELECT p.o_orderkey, CASE WHEN t.o_orderkey IS NULL THEN 'missing row' WHEN p.o_custkey IS DISTINCT FROM t.o_custkey THEN 'o_custkey'
        WHEN p.o_orderstatus IS DISTINCT FROM t.o_orderstatus THEN 'o_orderstatus' WHEN p.o_totalprice IS DISTINCT FROM t.o_totalprice THEN 'o_totalprice'
        WHEN p.o_orderpriority IS DISTINCT FROM t.o_orderpriority THEN 'o_orderpriority' END AS mismatch
        FROM p LEFT JOIN (SELECT * FROM orders WHERE o_orderkey % 17 <> 0) t ON t.o_orderkey = p.o_orderkey""",
    "set_apply": _elements("ck", "CAST(ck AS VARCHAR)", "CAST(elem AS VARCHAR), ',' ORDER BY CAST(elem AS VARCHAR)"),
    "map_apply": _elements("CAST(ck AS VARCHAR)", "CAST(seq AS VARCHAR)", "elem || '=' || value, ',' ORDER BY elem || '=' || value"),
    "list_apply": _elements("ck", "CAST(seq AS VARCHAR)", "value, ',' ORDER BY elem"),
    "stream_changes": f"""{GENERATIONS} SELECT stream_id, change_time, batch_seq_no, pk, ck, delivery_batch FROM (SELECT {KEY}, pk, ck, delivery_batch FROM scalar_scylla_cdc_log
        WHERE {_within(0, REPLAY_TO_MS - 10_000)}) l
        JOIN (SELECT stream_id, change_time, batch_seq_no FROM r WHERE listed) USING (stream_id, change_time, batch_seq_no)""",
    "printer_lines": f"""SELECT hex("cdc$stream_id") || ' -> Row[' || {" || ', ' || ".join([_TEXT.format('hex("cdc$stream_id")'), *[_TEXT.format(f'"{c}"') for c in _COLUMNS]])} || ']' AS line
        FROM multi_ck_scylla_cdc_log""",
    "partition_key_rows": "SELECT DISTINCT pk FROM multi_ck_scylla_cdc_log",
    "topology_changes": f"WITH {_TOPOLOGY} SELECT node, us, kind FROM e WHERE kind IN ('add', 'remove')",
    "topology_last_change": f"WITH {_TOPOLOGY} SELECT max(us) AS last_change_us FROM e WHERE kind IN ('add', 'remove')",
    "replica_multi": MULTI_ROWS,
    "replica_postimage": f"""WITH {_D}, w AS (SELECT pk, ck, ts_us AS us, CASE WHEN seq % 7 <> 0 THEN v END AS v, 1 + seq % 2 AS op FROM d WHERE ck IS NOT NULL AND seq % 11 <> 0 AND seq % 3 <> 0),
        b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pk, ck ORDER BY us DESC, v IS NULL DESC, v DESC) AS n FROM w) WHERE n = 1),
        m AS (SELECT pk, ck, max(us) FILTER (WHERE op = 2) AS us FROM w GROUP BY ALL),
        x AS (SELECT pk, ck, max(ts_us) AS us FROM d WHERE ck IS NOT NULL AND seq % 11 = 0 GROUP BY ALL),
        j AS (SELECT b.pk, b.ck, CASE WHEN b.us > coalesce(x.us, b.us - 1) THEN b.v END AS v, m.us > coalesce(x.us, m.us - 1) AS marked
            FROM b JOIN m USING (pk, ck) LEFT JOIN x ON x.pk = b.pk AND x.ck = b.ck)
        SELECT pk, ck, v FROM j WHERE v IS NOT NULL OR marked""",
    "replica_preimages": f"""WITH {_D}, e AS (SELECT pk, ck, ts_us AS us, seq AS id, v FROM (SELECT *, row_number() OVER (PARTITION BY pk, ck, ts_us ORDER BY seq DESC) AS n FROM d
            WHERE ck IS NOT NULL AND v IS NOT NULL) WHERE n = 1),
        l AS (SELECT *, lag(v) OVER (PARTITION BY pk, ck ORDER BY us) AS was FROM e),
        p AS (SELECT *, CASE WHEN id % 13 = 0 THEN v + 1 WHEN id % 17 <> 0 THEN was END AS pre, printf('%016x', us * 10 + 122192928000000000) AS h FROM l)
        SELECT pk, ck, h[9:16] || '-' || h[5:8] || '-1' || h[2:4] || '-8080-' || printf('%012x', id) AS change_time, CASE WHEN was IS NULL THEN 'missing row' ELSE 'v' END AS mismatch
        FROM p WHERE pre IS DISTINCT FROM was""",
    "generations_to_refresh": f"""WITH {_GENS}, {_TOPOLOGY}, c AS (SELECT {floor_sql("max(us)", 1000)} AS change_ms FROM e WHERE kind IN ('add', 'remove')),
        n AS (SELECT max({_MS}) AS rows_ms FROM scalar_scylla_cdc_log)
        SELECT start_us, end_us, end_us IS NULL AND ({floor_sql("start_us", 1000)} + 30000 < change_ms OR rows_ms < {CLOCK_MS - 10_000}) AS refresh FROM g, c, n""",
}
