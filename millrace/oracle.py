"""DuckDB SQL that computes the registered queries straight from the test tables.

Written from the definitions of the workload, not from the Spark plans.
"""

SQL = {}

CHG = """
line AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey
           ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS n FROM lineitem),
chg0 AS (
  SELECT o_orderkey AS okey, 'public' AS schema_name, 'orders' AS table_name,
    CASE o_orderstatus WHEN 'O' THEN 'insert' WHEN 'P' THEN 'update' ELSE 'delete' END AS op,
    CAST(o_orderkey AS VARCHAR) AS pk, 0 AS n, 0 AS partkey
  FROM orders
  UNION ALL
  SELECT l_orderkey, CASE WHEN l_linestatus = 'F' AND n % 5 = 0 THEN 'audit' ELSE 'public' END, 'lineitem',
    CASE l_returnflag WHEN 'N' THEN 'insert' WHEN 'A' THEN 'update' ELSE 'delete' END,
    l_orderkey || '-' || n, n, l_partkey
  FROM line),
chg AS (SELECT *, okey * 100000 + 11 + n AS seq, (tx_id + 1) * 256 AS lsn,
    make_timestamp(CAST(1704067200000000 + tx_id * 250000 AS BIGINT)) AS commit_ts,
    's' || (tx_id // 5000) AS session_id
  FROM (SELECT *, CASE WHEN okey % 40 = 1 THEN okey - 1 ELSE okey END AS tx_id FROM chg0))"""

SUB = """
sub0 AS (
  SELECT 'c' || o_custkey AS sub_id, 'exact' AS kind, 'orders' AS table_name,
    CAST(min(o_orderkey) AS VARCHAR) AS pk, o_custkey * 2000 AS start_lsn, o_custkey AS k
  FROM orders GROUP BY o_custkey
  UNION ALL
  SELECT 'w' || s_suppkey, 'wildcard', CASE WHEN s_suppkey % 2 = 0 THEN 'orders' ELSE 'lineitem' END,
    NULL, s_suppkey * 30000, s_suppkey FROM supplier),
sub AS (SELECT *, 'public' AS schema_name, 1 + k % 4 AS policy_id,
    CASE WHEN k % 5 = 4 THEN start_lsn + 1000000 END AS end_lsn FROM sub0)"""

# pol: update rows survive only where a listed non-key column can be present
POLICY = """
half AS (SELECT max(lsn) // 2 AS h FROM chg),
ver AS (SELECT 1 AS version, -1 AS lo, h AS hi FROM half UNION ALL SELECT 2, h, NULL FROM half),
pol(policy_id, version, table_name, upd) AS (VALUES
  (1,1,'orders',true),(1,1,'lineitem',true),(1,2,'orders',true),(1,2,'lineitem',true),
  (2,1,'orders',true),(2,2,'orders',false),
  (3,1,'orders',false),(3,1,'lineitem',true),(3,2,'lineitem',true),
  (4,1,'lineitem',true),(4,2,'lineitem',false))"""

ELIG = """
touch AS (SELECT DISTINCT tx_id, lsn, schema_name, table_name, pk FROM chg),
roots AS (SELECT tx_id, lsn, schema_name, table_name, count(*) AS n_roots FROM touch GROUP BY ALL),
elig AS (
  SELECT t.tx_id, t.lsn, s.* FROM touch t JOIN sub s ON s.kind = 'exact' AND s.schema_name = t.schema_name
    AND s.table_name = t.table_name AND s.pk = t.pk
  UNION ALL
  SELECT r.tx_id, r.lsn, s.* FROM roots r JOIN sub s ON s.kind = 'wildcard' AND s.schema_name = r.schema_name
    AND s.table_name = r.table_name)"""

OUT = """
kept AS (SELECT c.tx_id, c.schema_name, p.policy_id, c.table_name, c.pk, count(*) AS k
  FROM chg c JOIN ver v ON c.lsn > v.lo AND (v.hi IS NULL OR c.lsn <= v.hi)
  JOIN pol p ON p.version = v.version AND p.table_name = c.table_name
  WHERE c.op <> 'update' OR p.upd GROUP BY ALL),
kept_t AS (SELECT tx_id, schema_name, policy_id, table_name, sum(k) AS k FROM kept GROUP BY ALL),
kept_x AS (SELECT tx_id, schema_name, policy_id, sum(k) AS k FROM kept GROUP BY ALL),
out0 AS (
  SELECT e.*, r.n_roots,
    coalesce(CASE WHEN e.kind = 'exact' THEN kp.k ELSE kt.k END, 0) AS n_anchor, coalesce(kx.k, 0) AS n_kept
  FROM elig e
  JOIN roots r ON r.tx_id = e.tx_id AND r.schema_name = e.schema_name AND r.table_name = e.table_name
  LEFT JOIN kept kp ON kp.tx_id = e.tx_id AND kp.schema_name = e.schema_name AND kp.policy_id = e.policy_id
    AND kp.table_name = e.table_name AND kp.pk = e.pk
  LEFT JOIN kept_t kt ON kt.tx_id = e.tx_id AND kt.schema_name = e.schema_name AND kt.policy_id = e.policy_id
    AND kt.table_name = e.table_name
  LEFT JOIN kept_x kx ON kx.tx_id = e.tx_id AND kx.schema_name = e.schema_name AND kx.policy_id = e.policy_id
  WHERE e.end_lsn IS NULL OR e.lsn <= e.end_lsn),
out1 AS (SELECT *, CASE WHEN lsn <= start_lsn THEN 'below_start' WHEN n_roots > 1 THEN 'multi_root'
    WHEN n_anchor = 0 THEN 'silent' WHEN n_kept > 10 THEN 'tx_too_large' ELSE 'delivered' END AS outcome FROM out0),
viol AS (SELECT sub_id, min(lsn) AS violation_lsn FROM out1 WHERE outcome = 'tx_too_large' GROUP BY sub_id),
outc AS (SELECT o.*, CASE WHEN outcome = 'delivered' THEN n_kept ELSE 0 END AS n_delivered,
    CASE WHEN outcome = 'delivered' THEN n_kept - n_anchor ELSE 0 END AS n_beyond
  FROM out1 o LEFT JOIN viol v ON v.sub_id = o.sub_id WHERE v.violation_lsn IS NULL OR o.lsn <= v.violation_lsn)"""

ROUTE = ",".join([CHG, SUB, POLICY, ELIG, OUT])
MATCH = ",".join([CHG, SUB, ELIG])


def add(name: str, ctes: str, body: str) -> None:
    SQL[name] = f"WITH {ctes}\n{body}" if ctes else body


add("outcome_counts", ROUTE, """SELECT kind, outcome, count(*) AS n_pairs, CAST(sum(n_delivered) AS BIGINT) AS n_delivered
FROM outc GROUP BY kind, outcome""")
add("outcomes_by_sub", ROUTE, """SELECT sub_id, outcome, count(*) AS n_pairs,
  CAST(sum(n_delivered) AS BIGINT) AS n_delivered, CAST(sum(n_beyond) AS BIGINT) AS n_beyond_anchor
FROM outc GROUP BY sub_id, outcome""")
add("fan_out_work", ROUTE, """SELECT tx_id, CAST(sum(n_delivered) AS BIGINT) AS work FROM outc GROUP BY tx_id
HAVING sum(n_delivered) > 0""")
add("beyond_anchor", ROUTE, """SELECT kind, table_name, CAST(sum(n_beyond) AS BIGINT) AS n_beyond_anchor
FROM outc GROUP BY kind, table_name""")
add("terminate", ROUTE, """SELECT v.sub_id, s.kind, v.violation_lsn FROM viol v JOIN sub s ON s.sub_id = v.sub_id""")
add("match_exact", MATCH, "SELECT tx_id, sub_id, table_name, pk FROM elig WHERE kind = 'exact'")
add("match_wildcard", MATCH, """SELECT sub_id, count(*) AS n_tx, min(tx_id) AS first_tx, max(tx_id) AS last_tx
FROM elig WHERE kind = 'wildcard' GROUP BY sub_id""")
add("match_live", MATCH, """SELECT sub_id, kind, count(*) AS n_tx, min(tx_id) AS first_tx, max(tx_id) AS last_tx
FROM elig WHERE lsn > start_lsn AND (end_lsn IS NULL OR lsn <= end_lsn) GROUP BY sub_id, kind""")
add("eligible", MATCH, """SELECT tx_id, count(DISTINCT sub_id) AS n_pairs,
  count(DISTINCT CASE WHEN kind = 'exact' THEN sub_id END) AS n_exact FROM elig
WHERE end_lsn IS NULL OR lsn <= end_lsn GROUP BY tx_id""")
add("start_cutoff", MATCH, """SELECT sub_id, count(CASE WHEN lsn > start_lsn THEN 1 END) AS n_after,
  count(CASE WHEN lsn <= start_lsn THEN 1 END) AS n_before FROM elig GROUP BY sub_id""")
add("schema_scope", MATCH, """SELECT e.tx_id, e.sub_id, count(CASE WHEN c.schema_name = e.schema_name THEN 1 END) AS n_inside,
  count(CASE WHEN c.schema_name <> e.schema_name THEN 1 END) AS n_outside
FROM elig e JOIN chg c ON c.tx_id = e.tx_id WHERE e.kind = 'exact' GROUP BY e.tx_id, e.sub_id""")
add("co_tx", MATCH, """SELECT e.sub_id, e.tx_id, c.seq, c.op, c.table_name, c.pk,
  c.table_name = e.table_name AND c.pk = e.pk AS anchor
FROM elig e JOIN chg c ON c.tx_id = e.tx_id AND c.schema_name = e.schema_name
WHERE e.kind = 'exact' AND e.lsn > e.start_lsn AND (e.end_lsn IS NULL OR e.lsn <= e.end_lsn)""")
add("multi_root", CHG, """SELECT tx_id, schema_name, table_name, count(*) AS n, count(DISTINCT pk) AS n_roots,
  count(DISTINCT pk) > 1 AS multi_root FROM chg GROUP BY tx_id, schema_name, table_name""")
add("policy_asof", ",".join([CHG, SUB, POLICY]), """SELECT sub_id, policy_id, version, start_lsn AS commit_lsn
FROM sub JOIN ver ON start_lsn > lo AND (hi IS NULL OR start_lsn <= hi)""")
add("anchor_survives", ROUTE, """, first_start AS (SELECT kind, table_name, coalesce(pk, '') AS p, policy_id, min(start_lsn) AS f
  FROM sub GROUP BY ALL)
SELECT DISTINCT o.tx_id, o.kind, o.table_name, o.pk, o.policy_id, v.version,
  CAST(n_anchor AS BIGINT) AS n_anchor, CAST(n_kept AS BIGINT) AS n_kept
FROM (SELECT e.*, r.n_roots, coalesce(CASE WHEN e.kind = 'exact' THEN kp.k ELSE kt.k END, 0) AS n_anchor,
    coalesce(kx.k, 0) AS n_kept
  FROM (SELECT DISTINCT tx_id, lsn, kind, schema_name, table_name, pk, policy_id FROM elig) e
  JOIN roots r ON r.tx_id = e.tx_id AND r.schema_name = e.schema_name AND r.table_name = e.table_name
  LEFT JOIN kept kp ON kp.tx_id = e.tx_id AND kp.schema_name = e.schema_name AND kp.policy_id = e.policy_id
    AND kp.table_name = e.table_name AND kp.pk = e.pk
  LEFT JOIN kept_t kt ON kt.tx_id = e.tx_id AND kt.schema_name = e.schema_name AND kt.policy_id = e.policy_id
    AND kt.table_name = e.table_name
  LEFT JOIN kept_x kx ON kx.tx_id = e.tx_id AND kx.schema_name = e.schema_name AND kx.policy_id = e.policy_id) o
JOIN ver v ON o.lsn > v.lo AND (v.hi IS NULL OR o.lsn <= v.hi)
JOIN first_start f ON f.kind = o.kind AND f.table_name = o.table_name AND f.p = coalesce(o.pk, '')
  AND f.policy_id = o.policy_id
WHERE o.n_roots = 1 AND o.lsn > f.f""")



# ---- cells: every column a change writes -------------------------------------------

CELLS = CHG + """,
o AS (SELECT c.*, o_custkey, o_totalprice, o_orderstatus, o_orderdate, o_orderpriority
  FROM chg c JOIN orders ON o_orderkey = c.okey WHERE c.table_name = 'orders' AND c.op <> 'delete'),
l AS (SELECT c.*, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate
  FROM chg c JOIN line ON l_orderkey = c.okey AND line.n = c.n WHERE c.table_name = 'lineitem' AND c.op <> 'delete'),
cell0 AS (
  SELECT o.*, unnest([
    {'col': 'id', 'value': '"' || okey || '"'}, {'col': 'user_id', 'value': '"' || o_custkey || '"'},
    {'col': 'total', 'value': '"' || CAST(o_totalprice AS DECIMAL(18,2)) || '"'},
    {'col': 'status', 'value': '"' || o_orderstatus || '"'},
    {'col': 'placed_at', 'value': '"' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') || '"'},
    {'col': CASE WHEN op = 'update' AND okey % 3 = 0 THEN NULL ELSE 'priority' END, 'value': '"' || o_orderpriority || '"'},
    {'col': 'note', 'value': CASE WHEN okey % 4 = 0 THEN 'null'
        ELSE '"say \\"hi\\" \\u003c' || o_custkey || '\\u003e \\u0026 co"' END},
    {'col': CASE WHEN tx_id % 5000 >= 2500 THEN 'channel' END, 'value': '"web"'}]) AS cv FROM o),
cell1 AS (
  SELECT l.*, unnest([
    {'col': 'id', 'value': '"' || pk || '"'}, {'col': 'orders_id', 'value': '"' || okey || '"'},
    {'col': 'sku', 'value': '"SKU-' || l_partkey || '"'}, {'col': 'qty', 'value': CAST(CAST(l_quantity AS BIGINT) AS VARCHAR)},
    {'col': 'price', 'value': '"' || CAST(l_extendedprice AS DECIMAL(18,2)) || '"'},
    {'col': 'discount', 'value': CASE WHEN l_discount = 0 THEN '0' ELSE CAST(l_discount AS VARCHAR) END},
    {'col': 'shipped', 'value': CASE WHEN l_shipdate < TIMESTAMP '1998-09-02' THEN 'true' ELSE 'false' END},
    {'col': 'ship_date', 'value': '"' || strftime(l_shipdate, '%Y-%m-%d') || '"'},
    {'col': 'tags', 'value': '["' || l_returnflag || '","' || l_linestatus || ', x",null]'},
    {'col': 'wait', 'value': '"P' || n || 'DT1H30M"'},
    {'col': 'meta', 'value': '{"tax":' || CAST(l_tax AS VARCHAR) || ',"k":[1,2]}'},
    {'col': 'blob', 'value': '"' || to_base64(encode(l_returnflag)) || '"'}]) AS cv FROM l),
cell AS (
  SELECT okey, tx_id, lsn, commit_ts, schema_name, table_name, op, pk, seq, cv.col AS col, cv.value AS value FROM cell0 WHERE cv.col IS NOT NULL
  UNION ALL
  SELECT okey, tx_id, lsn, commit_ts, schema_name, table_name, op, pk, seq, cv.col, cv.value FROM cell1)"""


def check(*cols: str) -> str:
    text = ", ".join(f"coalesce(CAST({c} AS VARCHAR), '~')" for c in cols)
    return f"CAST(sum(CAST('0x' || substr(md5(concat_ws('|', {text})), 1, 8) AS BIGINT)) AS BIGINT) AS checksum"


MSG = CHG + """,
txs AS (SELECT o_orderkey AS tx_id FROM orders WHERE o_orderkey % 40 <> 1),
ses AS (SELECT DISTINCT o_orderkey // 5000 AS s FROM orders),
rel AS (SELECT 's' || s AS session_id, s * 500000000 + off AS seq, rel_schema, rel_table, n_columns, reason
  FROM ses, (VALUES (0,'public','orders',7,''), (1,'public','lineitem',12,''), (2,'audit','lineitem',12,''),
    (250000000,'public','orders',8,''), (400000000,'public','orders',2,'composite_key')) AS v(off, rel_schema, rel_table, n_columns, reason))"""

add("src_messages", MSG, """SELECT session_id, kind, count(*) AS n, min(seq) AS first_seq, max(seq) AS last_seq,
  CAST(sum(xid) AS BIGINT) AS xid_sum FROM (
  SELECT session_id, op AS kind, seq, NULL AS xid FROM chg
  UNION ALL SELECT 's' || (tx_id // 5000), 'begin', tx_id * 100000 + 10, tx_id FROM txs
  UNION ALL SELECT 's' || (tx_id // 5000), 'commit', tx_id * 100000 + CASE WHEN tx_id % 40 = 0 THEN 199999 ELSE 99999 END, tx_id FROM txs
  UNION ALL SELECT session_id, 'relation', seq, NULL FROM rel) GROUP BY session_id, kind""")
add("scope_filter", CHG, f"""SELECT schema_name, table_name, op, count(*) AS n, {check('pk')} FROM chg
WHERE (schema_name, table_name) IN (('public', 'orders'), ('audit', 'lineitem')) AND op IN ('insert', 'delete')
GROUP BY schema_name, table_name, op""")
add("relation_valid", MSG, """SELECT session_id, seq, rel_schema, rel_table, CAST(n_columns AS BIGINT) AS n_columns, reason FROM rel""")
add("relation_asof", MSG, """SELECT session_id, CAST(CASE WHEN table_name = 'orders' THEN 1001 WHEN schema_name = 'public' THEN 1002 ELSE 1003 END AS BIGINT) AS relation_oid,
  CAST(CASE WHEN table_name = 'lineitem' THEN 12 WHEN okey % 5000 >= 2500 THEN 8 ELSE 7 END AS BIGINT) AS n_columns,
  count(*) AS n, min(seq) AS first_seq, max(seq) AS last_seq FROM chg GROUP BY ALL""")
add("type_changes", CELLS, f"""SELECT schema_name, table_name, op, col, count(*) AS n, min(value) AS low, max(value) AS high,
  {check('seq', 'value')} FROM cell GROUP BY schema_name, table_name, op, col""")
add("pk_extract", CHG, f"""SELECT schema_name, table_name, op, 'id' AS pk_col, count(*) AS n, {check('seq', 'pk')}
FROM chg GROUP BY schema_name, table_name, op""")
add("absent_null", CELLS, f"""SELECT x.op, names.col, CASE WHEN c.col IS NULL THEN 'absent' WHEN c.value = 'null' THEN 'null' ELSE 'value' END AS state,
  count(*) AS n, {check('x.seq')}
FROM o x CROSS JOIN (VALUES ('id'), ('user_id'), ('total'), ('status'), ('placed_at'), ('priority'), ('note'), ('channel')) AS names(col)
LEFT JOIN cell c ON c.seq = x.seq AND c.col = names.col AND c.table_name = 'orders'
GROUP BY 1, 2, 3""")
BAD = "(table_name = 'lineitem' AND (partkey % 89 = 0 OR (partkey % 97 = 0 AND op <> 'delete')))"
add("assemble_tx", MSG, f"""SELECT 's' || (t.tx_id // 5000) AS session_id, t.tx_id, (t.tx_id + 1) * 256 AS commit_lsn,
  make_timestamp(CAST(1704067200000000 + t.tx_id * 250000 AS BIGINT)) AS commit_ts, coalesce(c.n, 0) AS n_changes
FROM txs t LEFT JOIN (SELECT tx_id, count(*) AS n FROM chg WHERE NOT {BAD} GROUP BY tx_id) c ON c.tx_id = t.tx_id
WHERE t.tx_id % 50 NOT IN (7, 9)""")
add("change_order", CHG, """SELECT tx_id, seq, row_number() OVER (PARTITION BY tx_id ORDER BY seq) AS change_seq FROM chg""")
add("quarantine", MSG, f"""SELECT reason, kind, count(*) AS n, {check('seq')} FROM (
  SELECT CASE WHEN table_name = 'lineitem' AND partkey % 89 = 0 THEN 'unknown_relation' WHEN {BAD} THEN 'bad_value'
    WHEN tx_id % 50 = 9 THEN 'outside_transaction' ELSE '' END AS reason, op AS kind, seq FROM chg
  UNION ALL SELECT 'relation_' || reason, 'relation', seq FROM rel WHERE reason <> '') GROUP BY reason, kind""")

add("policy_load", "", """SELECT c_custkey AS doc_id,
  CASE WHEN c_custkey % 11 = 0 THEN 'bad_json' WHEN c_custkey % 13 = 0 THEN 'no_user' ELSE 'ok' END AS state,
  CASE WHEN state = 'ok' THEN 'u' || c_custkey END AS user_id,
  CASE WHEN state = 'ok' THEN c_custkey % 7 * 10 END AS ttl_seconds,
  CASE WHEN state = 'ok' THEN CAST(CASE c_custkey % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS BIGINT) END AS n_tables,
  CASE WHEN state = 'ok' THEN CAST(CASE c_custkey % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 0 END AS BIGINT) END AS n_columns
FROM customer""")
CHANNEL = """ch AS (SELECT c_custkey AS line_no, CASE WHEN c_custkey % 9 = 2 THEN 'lineitem' WHEN c_custkey % 9 = 3 THEN 'Bad-Name' ELSE 'orders' END AS table_name,
  CASE WHEN c_custkey % 9 = 2 THEN 'wildcard' ELSE 'exact' END AS kind,
  CASE c_custkey % 9 WHEN 2 THEN NULL WHEN 4 THEN repeat('x', CAST(250 + c_custkey % 10 AS BIGINT)) WHEN 5 THEN '' ELSE CAST(c_custkey AS VARCHAR) END AS pk
  FROM customer WHERE c_custkey % 9 > 1),
ch2 AS (SELECT *, table_name || ':' || coalesce(pk, 'all') AS channel,
  table_name <> 'Bad-Name' AND (pk IS NULL OR (length(pk) BETWEEN 1 AND 256)) AS ok FROM ch)"""
add("channel_load", CHANNEL, "SELECT line_no, table_name, kind, pk, channel FROM ch2")
add("channel_valid", CHANNEL, "SELECT line_no, channel, ok FROM ch2")
add("channel_assign", CHANNEL + ", g AS (SELECT channel, row_number() OVER (ORDER BY line_no) - 1 AS slot, count(*) OVER () AS n FROM ch2 WHERE ok)",
    "SELECT s_suppkey AS number, g.channel FROM supplier JOIN g ON g.slot = s_suppkey % g.n")
add("frame_parse", "", """SELECT event_id AS frame_no,
  CASE WHEN event_id % 6 = 2 THEN 'error' ELSE 'tx' END AS event,
  CASE event_id % 6 WHEN 2 THEN '{"reason":"r' || event_id || '"}' WHEN 3 THEN '{"n":' || event_id || '}' ELSE '{"tx_id":' || event_id || '}' END AS data,
  CASE WHEN event_id % 6 >= 4 THEN CAST(event_id AS VARCHAR) END AS id FROM events WHERE event_id % 6 >= 2""")
add("events_by_channel", "", """SELECT 'ch' || (user_id % 12) AS channel, CASE WHEN event_id % 6 = 2 THEN 'error' ELSE 'tx' END AS event, count(*) AS n_events
FROM events WHERE event_id % 6 >= 2 GROUP BY 1, 2""")
add("metrics_parse", "", """SELECT 'm_' || event_type AS metric, sum(floor(value) * CASE WHEN event_id % 10 = 5 THEN 10 ELSE 1 END) AS value
FROM events WHERE event_id % 10 >= 4 GROUP BY event_type""")
add("initial_events", SUB, """SELECT sub_id, 'u' || (k % 100) AS user_id, data, CAST(length(data) + 28 AS BIGINT) AS frame_bytes
FROM sub JOIN (SELECT c_custkey, CASE c_custkey % 5 WHEN 2 THEN '{"n":' || c_custkey || ',"t":[1,"a b"]}'
    WHEN 3 THEN '"v' || c_custkey || '"' WHEN 4 THEN '[' || c_custkey || ',1.50]' END AS data
  FROM customer WHERE c_custkey % 11 <> 0 AND c_custkey % 13 <> 0) d ON d.c_custkey = k % 100
WHERE data IS NOT NULL""")

SES = """ses AS (SELECT 'q' || event_id AS sub_id, 'u' || user_id AS user_id, CASE WHEN event_id % 3 = 0 THEN 'wildcard' ELSE 'exact' END AS kind,
  ts AS c_at, make_timestamp(epoch_us(ts) + CAST(round(value * 60) AS BIGINT) * 1000000) AS d_at,
  CASE event_type WHEN 'error' THEN 'slow_consumer' WHEN 'signup' THEN 'shutdown' WHEN 'purchase' THEN 'tx_too_large' ELSE 'client_closed' END AS reason
  FROM events)"""
add("terminal_events", SES, """SELECT sub_id, reason, CASE WHEN reason = 'shutdown' THEN 'event: shutdown' || chr(10) || 'data: {"reason":"service_restart"}' || chr(10) || chr(10)
  ELSE 'event: error' || chr(10) || 'data: {"reason":"' || reason || '"}' || chr(10) || chr(10) END AS frame
FROM (SELECT user_id AS sub_id, reason, row_number() OVER (PARTITION BY user_id ORDER BY d_at, reason) AS r FROM ses)
WHERE r = 1 AND reason <> 'client_closed'""")

RFC = "regexp_replace(strftime({0}, '%Y-%m-%dT%H:%M:%S.%f'), '\\.?0+$', '') || 'Z'"
EVENT = CELLS + f""",
data AS (SELECT seq, '{{' || string_agg('"' || col || '":' || value, ',' ORDER BY col) || '}}' AS data FROM cell GROUP BY seq),
frag AS (SELECT c.*, '{{"op":"' || c.op || '","table":"' || c.table_name || '","pk":"' || c.pk || '"' || coalesce(',"data":' || d.data, '') || '}}' AS f
  FROM chg c LEFT JOIN data d ON d.seq = c.seq),
ev AS (SELECT tx_id, schema_name, count(*) AS n, '{{"tx_id":' || tx_id || ',"commit_ts":"' || {RFC.format('min(commit_ts)')} || '","changes":['
    || string_agg(f, ',' ORDER BY seq) || ']}}' AS payload FROM frag GROUP BY tx_id, schema_name),
evb AS (SELECT *, CAST(strlen(payload) + 25 + length(CAST(tx_id AS VARCHAR)) - 2 AS BIGINT) AS frame_bytes FROM ev)"""
add("encode_events", EVENT, """SELECT tx_id, schema_name, frame_bytes,
  CASE WHEN n <= 10 THEN md5(payload) END AS payload_md5, CASE WHEN n > 10 THEN 'too_many_changes' END AS reason FROM evb""")
add("payload_cap", EVENT, """SELECT schema_name, frame_bytes > 1500 AS over_cap, count(*) AS n, CAST(sum(frame_bytes) AS BIGINT) AS frame_bytes,
  CAST(sum(n) AS BIGINT) AS n_changes FROM evb GROUP BY 1, 2""")

# grant columns spelled out: which cells each policy version shows
SINK = CELLS + "," + ",".join([SUB, POLICY, ELIG, OUT]) + f""",
gc(policy_id, version, table_name, cols) AS (VALUES
  (1,1,'orders',['id','user_id','total','status','placed_at','priority','note']),
  (1,1,'lineitem',['id','orders_id','sku','qty','price','discount','shipped','ship_date','tags','wait','meta','blob']),
  (1,2,'orders',['status']), (1,2,'lineitem',['qty']), (2,1,'orders',['id','status','total']), (2,2,'orders',['id']),
  (3,1,'orders',['id']), (3,1,'lineitem',['sku','qty']), (3,2,'lineitem',['qty']),
  (4,1,'lineitem',['qty','price','discount']), (4,2,'lineitem',['id'])),
sent AS (SELECT o.sub_id, o.tx_id, o.policy_id, o.schema_name, v.version FROM outc o JOIN ver v ON o.lsn > v.lo AND (v.hi IS NULL OR o.lsn <= v.hi)
  WHERE o.outcome = 'delivered' AND o.kind = 'exact'),
seen AS (SELECT s.sub_id, c.seq, string_agg('"' || c.col || '":' || c.value, ',' ORDER BY c.col) AS d
  FROM sent s JOIN gc g ON g.policy_id = s.policy_id AND g.version = s.version
  JOIN cell c ON c.tx_id = s.tx_id AND c.schema_name = s.schema_name AND c.table_name = g.table_name
    AND (c.col = 'id' OR list_contains(g.cols, c.col)) GROUP BY s.sub_id, c.seq),
fr AS (SELECT s.sub_id, s.tx_id, c.commit_ts, c.seq, '{{"op":"' || c.op || '","table":"' || c.table_name || '","pk":"' || c.pk || '"'
    || coalesce(',"data":{{' || d.d || '}}', '') || '}}' AS f
  FROM sent s JOIN pol g ON g.policy_id = s.policy_id AND g.version = s.version
  JOIN chg c ON c.tx_id = s.tx_id AND c.schema_name = s.schema_name AND c.table_name = g.table_name AND (c.op <> 'update' OR g.upd)
  LEFT JOIN seen d ON d.sub_id = s.sub_id AND d.seq = c.seq),
dl AS (SELECT sub_id, tx_id, '{{"tx_id":' || tx_id || ',"commit_ts":"' || {RFC.format('min(commit_ts)')} || '","changes":[' || string_agg(f, ',' ORDER BY seq) || ']}}' AS payload
  FROM fr GROUP BY sub_id, tx_id)"""
add("sink_roundtrip", SINK, """SELECT sub_id, tx_id, CAST(strlen(payload) + 23 + length(CAST(tx_id AS VARCHAR)) AS BIGINT) AS frame_bytes, md5(payload) AS payload_md5 FROM dl""")
# the same events once per policy version, then per subscription of either kind
SINK_ALL = SINK.replace(" AND o.kind = 'exact'),", """),
cls AS (SELECT DISTINCT tx_id, policy_id, schema_name, version FROM sent),""").split("seen AS (")[0] + f"""
aseen AS (SELECT s.tx_id, s.policy_id, s.version, c.seq, string_agg('"' || c.col || '":' || c.value, ',' ORDER BY c.col) AS d
  FROM cls s JOIN gc g ON g.policy_id = s.policy_id AND g.version = s.version
  JOIN cell c ON c.tx_id = s.tx_id AND c.schema_name = s.schema_name AND c.table_name = g.table_name
    AND (c.col = 'id' OR list_contains(g.cols, c.col)) GROUP BY s.tx_id, s.policy_id, s.version, c.seq),
afr AS (SELECT s.tx_id, s.policy_id, s.version, s.schema_name, c.commit_ts, c.seq, '{{"op":"' || c.op || '","table":"' || c.table_name || '","pk":"' || c.pk || '"'
    || coalesce(',"data":{{' || d.d || '}}', '') || '}}' AS f
  FROM cls s JOIN pol g ON g.policy_id = s.policy_id AND g.version = s.version
  JOIN chg c ON c.tx_id = s.tx_id AND c.schema_name = s.schema_name AND c.table_name = g.table_name AND (c.op <> 'update' OR g.upd)
  LEFT JOIN aseen d ON d.tx_id = s.tx_id AND d.policy_id = s.policy_id AND d.version = s.version AND d.seq = c.seq),
adl AS (SELECT tx_id, policy_id, version, schema_name, '{{"tx_id":' || tx_id || ',"commit_ts":"' || {RFC.format('min(commit_ts)')} || '","changes":[' || string_agg(f, ',' ORDER BY seq) || ']}}' AS payload
  FROM afr GROUP BY tx_id, policy_id, version, schema_name),
amd AS (SELECT tx_id, policy_id, version, schema_name, strlen(payload) + 23 + length(CAST(tx_id AS VARCHAR)) AS frame_bytes, md5(payload) AS payload_md5 FROM adl)"""
add("sink_all", SINK_ALL, f"""SELECT s.sub_id, count(*) AS n_events, CAST(sum(a.frame_bytes) AS BIGINT) AS frame_bytes, {check('a.tx_id', 'a.payload_md5')}
FROM sent s JOIN amd a ON a.tx_id = s.tx_id AND a.policy_id = s.policy_id AND a.version = s.version AND a.schema_name = s.schema_name GROUP BY s.sub_id""")
SQL["stream_feed"] = SQL["sink_all"]
add("co_tx_all", MATCH, """, per AS (SELECT tx_id, schema_name, count(*) AS n FROM chg GROUP BY ALL),
own AS (SELECT tx_id, schema_name, table_name, pk, count(*) AS n FROM chg GROUP BY ALL),
ownt AS (SELECT tx_id, schema_name, table_name, count(*) AS n FROM chg GROUP BY ALL)
SELECT e.sub_id, e.kind, count(*) AS n_tx, CAST(sum(p.n) AS BIGINT) AS n_changes,
  CAST(sum(CASE WHEN e.kind = 'exact' THEN o.n ELSE t.n END) AS BIGINT) AS n_anchor
FROM elig e JOIN per p ON p.tx_id = e.tx_id AND p.schema_name = e.schema_name
JOIN ownt t ON t.tx_id = e.tx_id AND t.schema_name = e.schema_name AND t.table_name = e.table_name
LEFT JOIN own o ON o.tx_id = e.tx_id AND o.schema_name = e.schema_name AND o.table_name = e.table_name AND o.pk = e.pk
WHERE e.lsn > e.start_lsn AND (e.end_lsn IS NULL OR e.lsn <= e.end_lsn) GROUP BY e.sub_id, e.kind""")
add("whitelist", SINK, """SELECT g.policy_id, g.version, c.table_name, c.op, x.col, count(*) AS n, min(x.value) AS low, max(x.value) AS high
FROM chg c JOIN ver v ON c.lsn > v.lo AND (v.hi IS NULL OR c.lsn <= v.hi)
JOIN pol p ON p.version = v.version AND p.table_name = c.table_name AND (c.op <> 'update' OR p.upd)
JOIN gc g ON g.policy_id = p.policy_id AND g.version = p.version AND g.table_name = p.table_name
LEFT JOIN cell x ON x.seq = c.seq AND (x.col = 'id' OR list_contains(g.cols, x.col))
GROUP BY 1, 2, 3, 4, 5""")

# ---- mirrors -----------------------------------------------------------------------

USERS = """
u AS (SELECT event_id AS seq, (event_id + 1) * 256 AS lsn, CAST(user_id AS VARCHAR) AS pk, event_type, value AS v,
  CASE event_type WHEN 'signup' THEN 'insert' WHEN 'error' THEN 'delete' ELSE 'update' END AS op,
  CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) AS dec FROM events),
uc AS (SELECT seq, lsn, pk, op, cv.col AS col, cv.value AS value FROM (
  SELECT *, unnest([{'col': 'id', 'value': '"' || pk || '"'}, {'col': 'last', 'value': '"' || event_type || '"'},
    {'col': 'score', 'value': CASE WHEN seq % 7 = 0 THEN 'null' ELSE '"' || dec || '"' END},
    {'col': CASE WHEN seq % 3 = 0 AND op = 'update' THEN NULL ELSE 'bonus' END, 'value': '"' || dec || '"'}]) AS cv
  FROM u WHERE op <> 'delete') WHERE cv.col IS NOT NULL),
fresh AS (SELECT pk, max(seq) AS s FROM u WHERE op <> 'update' GROUP BY pk),
um AS (SELECT pk, col, value FROM (
  SELECT uc.pk, col, value, row_number() OVER (PARTITION BY uc.pk, col ORDER BY seq DESC) AS r FROM uc LEFT JOIN fresh f ON f.pk = uc.pk
  WHERE f.s IS NULL OR uc.seq >= f.s) WHERE r = 1)"""
add("mirror", CELLS + "," + USERS, f"""SELECT schema_name, table_name, col, count(*) AS n, {check('pk', 'value')} FROM (
  SELECT schema_name, table_name, pk, col, value FROM cell UNION ALL SELECT 'public', 'users', pk, col, value FROM um)
GROUP BY schema_name, table_name, col""")
add("snapshot_delta", USERS, "SELECT pk, col, value FROM um")
add("mirror_reset", """u0 AS (SELECT *, 'm' || (user_id % 6) AS sub_id FROM events),
cut AS (SELECT sub_id, max(event_id) AS e FROM u0 WHERE event_id % 50 = 0 GROUP BY sub_id),
""" + USERS.replace("FROM events)", ", sub_id FROM u0 LEFT JOIN cut USING (sub_id) WHERE cut.e IS NULL OR event_id > cut.e)"),
    "SELECT 'm' || (CAST(pk AS BIGINT) % 6) AS sub_id, pk, col, value FROM um")
add("entity_view", CELLS, f""", root AS (SELECT DISTINCT pk FROM cell WHERE table_name = 'orders')
SELECT root_pk, count(*) AS n_cells, {check('table_name', 'pk', 'col', 'value')} FROM (
  SELECT pk AS root_pk, table_name, pk, col, value FROM cell WHERE table_name = 'orders'
  UNION ALL SELECT CAST(okey AS VARCHAR), table_name, c.pk, col, value FROM cell c JOIN root ON root.pk = CAST(c.okey AS VARCHAR)
  WHERE table_name = 'lineitem' AND schema_name = 'public') GROUP BY root_pk""")
add("entity_tree", CELLS + "," + USERS, f""",
owner AS (SELECT DISTINCT c.pk, CAST(o_custkey AS VARCHAR) AS root_pk FROM cell c JOIN orders ON o_orderkey = c.okey
  JOIN (SELECT DISTINCT pk FROM um) r ON r.pk = CAST(o_custkey AS VARCHAR) WHERE c.table_name = 'orders')
SELECT root_pk, count(*) AS n_cells, {check('table_name', 'pk', 'col', 'value')} FROM (
  SELECT pk AS root_pk, 'users' AS table_name, pk, col, value FROM um
  UNION ALL SELECT o.root_pk, c.table_name, c.pk, c.col, c.value FROM cell c JOIN owner o ON o.pk = CAST(c.okey AS VARCHAR)
  WHERE c.schema_name = 'public') GROUP BY root_pk""")
add("field_diff", USERS, """SELECT seq, pk, col, CASE WHEN known THEN before END AS old, value FROM (
  SELECT c.*, p.seq IS NOT NULL AND (st.s IS NULL OR p.seq >= st.s) AS known, p.value AS before
  FROM (SELECT *, lag(seq) OVER (PARTITION BY pk, col ORDER BY seq) AS pseq FROM uc) c
  LEFT JOIN uc p ON p.pk = c.pk AND p.col = c.col AND p.seq = c.pseq
  LEFT JOIN (SELECT seq, max(CASE WHEN op <> 'update' THEN seq END) OVER (PARTITION BY pk ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS s FROM u) st
    ON st.seq = c.seq)
WHERE NOT known OR value IS DISTINCT FROM before""")

# ---- audits ------------------------------------------------------------------------

DRIFT = CHG + """,
dr0 AS (SELECT schema_name, table_name, op, pk, okey, n,
  CASE WHEN table_name = 'lineitem' AND okey % 7 = 0 AND n = 3 THEN CASE WHEN (okey + 2) % 40 = 1 THEN okey + 1 ELSE okey + 2 END ELSE tx_id END AS tx_id FROM chg),
dr_root AS (SELECT DISTINCT tx_id, pk FROM dr0 WHERE table_name = 'orders')"""
add("reconcile_tables", "", """SELECT 'public' AS schema_name, 'customer' AS table_name, 'missing' AS side
UNION ALL SELECT 'audit', 'lineitem', 'extra' WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_linestatus = 'F')""")
add("audit_unanchored", DRIFT, """SELECT d.tx_id, d.schema_name, d.pk, CAST(d.okey AS VARCHAR) AS root_pk FROM dr0 d
WHERE table_name = 'lineitem' AND (schema_name = 'audit' OR NOT EXISTS (SELECT 1 FROM dr_root r WHERE r.tx_id = d.tx_id AND r.pk = CAST(d.okey AS VARCHAR)))""")
add("audit_foreign_child", DRIFT, """SELECT d.tx_id, d.pk, CAST(d.okey AS VARCHAR) AS root_pk, r.pk AS delivered_to FROM dr0 d
JOIN (SELECT tx_id, min(pk) AS pk FROM dr_root GROUP BY tx_id HAVING count(*) = 1) r ON r.tx_id = d.tx_id
WHERE table_name = 'lineitem' AND schema_name = 'public' AND r.pk <> CAST(d.okey AS VARCHAR)""")
add("audit_multi_root", CHG, """SELECT tx_id, table_name, count(DISTINCT pk) AS n_roots, count(*) AS n FROM chg WHERE table_name = 'orders'
GROUP BY tx_id, table_name HAVING count(DISTINCT pk) > 1""")
add("audit_order", """r AS (SELECT 'r' || (event_id % 20) AS sub_id, event_id AS a,
  CASE WHEN event_id % 23 = 0 AND event_id >= 20 THEN event_id - 20 WHEN event_id % 17 = 0 AND event_id >= 40 THEN event_id - 40 ELSE event_id END AS tx FROM events),
p AS (SELECT *, lag(tx) OVER (PARTITION BY sub_id ORDER BY a) AS b FROM r)""",
    """SELECT sub_id, count(*) AS n_events, count(*) - count(DISTINCT tx) AS n_duplicates, count(CASE WHEN b > tx THEN 1 END) AS n_order_breaks FROM p GROUP BY sub_id""")

# ---- rollups -----------------------------------------------------------------------

add("fan_out", MATCH, """SELECT t.tx_id, count(e.sub_id) AS n_subs FROM (SELECT DISTINCT tx_id FROM chg) t LEFT JOIN elig e
  ON e.tx_id = t.tx_id AND (e.end_lsn IS NULL OR e.lsn <= e.end_lsn) GROUP BY t.tx_id""")
add("histogram", CHG, """, sz AS (SELECT session_id, tx_id, count(*) AS c FROM chg GROUP BY ALL)
SELECT session_id, le, count(CASE WHEN b IS NULL OR c <= b THEN 1 END) AS n, CAST(sum(c) AS BIGINT) AS total
FROM sz CROSS JOIN (VALUES ('1', 1), ('10', 10), ('100', 100), ('1000', 1000), ('10000', 10000), ('100000', 100000), ('+Inf', NULL)) AS v(le, b)
GROUP BY session_id, le""")
add("hist_quantile", SES, """, x AS (SELECT kind, epoch_us(d_at) - epoch_us(c_at) AS us FROM ses),
b(le, lo) AS (VALUES (1.0::DOUBLE, 0.0::DOUBLE), (10, 1), (60, 10), (600, 60), (3600, 600), (21600, 3600), (86400, 21600), ('inf'::DOUBLE, 86400)),
h AS (SELECT kind, le, lo, count(CASE WHEN us / 1e6 <= le THEN 1 END) AS n, count(CASE WHEN us / 1e6 <= lo AND lo > 0 THEN 1 END) AS under, count(*) AS total FROM x, b GROUP BY ALL),
r AS (SELECT h.*, q, qt, total * q AS want FROM h, (VALUES (0.5::DOUBLE, '0.5'), (0.99::DOUBLE, '0.99')) AS qs(q, qt))
SELECT kind, qt AS q, round(arg_min(CASE WHEN isinf(le) THEN lo ELSE lo + (le - lo) * (want - under) / (n - under) END, le), 6) AS value
FROM r WHERE n >= want GROUP BY kind, qt""")
add("active_subs", SES, """SELECT kind, count(CASE WHEN c_at <= TIMESTAMP '2024-01-15 12:00:00' AND d_at > TIMESTAMP '2024-01-15 12:00:00' THEN 1 END) AS n_active FROM ses GROUP BY kind""")
CALLS = """calls AS (SELECT ts, event_id, 'b' || (user_id % 4) AS backend, CASE WHEN event_id % 3 = 0 THEN 'check' ELSE 'refresh' END AS call_kind,
  CASE WHEN event_type = 'view' AND event_id % 5 = 0 THEN 'unavailable' WHEN event_type = 'error' THEN 'unavailable' WHEN event_type = 'signup' THEN 'forbidden' ELSE 'ok' END AS result,
  event_id % 10 = 0 AS health FROM events)"""
add("auth_results", CALLS, "SELECT backend, call_kind, result, count(*) AS n FROM calls GROUP BY ALL")
add("delivery_lag", """x AS (SELECT event_type, CAST(round(value * 1000) AS BIGINT) AS lag FROM events),
z AS (SELECT event_type, lag, count(*) AS c FROM x GROUP BY event_type, lag),
y AS (SELECT event_type, lag, sum(c) OVER (PARTITION BY event_type ORDER BY lag) AS upto, sum(c) OVER (PARTITION BY event_type) AS total FROM z)""",
    """SELECT event_type, qt AS q, min(lag) AS lag FROM y, (VALUES (0.5::DOUBLE, '0.5'), (0.95::DOUBLE, '0.95'), (0.99::DOUBLE, '0.99')) AS qs(q, qt)
WHERE CAST(upto AS DOUBLE) >= q * CAST(total AS DOUBLE) GROUP BY event_type, qt""")
add("session_stats", SES, """SELECT reason, count(*) AS n, round(avg((epoch_us(d_at) - epoch_us(c_at)) / 1e6), 4) AS mean_s,
  round(min((epoch_us(d_at) - epoch_us(c_at)) / 1e6), 4) AS min_s, round(max((epoch_us(d_at) - epoch_us(c_at)) / 1e6), 4) AS max_s FROM ses GROUP BY reason""")
add("feed_topn", """x AS (SELECT 'users:' || (user_id % 12) AS channel, event_id AS tx_id, row_number() OVER (PARTITION BY user_id % 12 ORDER BY event_id DESC) AS place,
  greatest(count(*) OVER (PARTITION BY user_id % 12) - 200, 0) AS n_left_out FROM events)""", "SELECT channel, tx_id, place, n_left_out FROM x WHERE place <= 200")
add("export_sorted", CHG, "SELECT lsn AS commit_lsn, seq, table_name, op, pk FROM chg")

# ---- time series -------------------------------------------------------------------

EDGE = SES + """,
e AS (SELECT user_id, t, sum(step) AS step FROM (SELECT user_id, epoch_us(c_at) AS t, 1 AS step FROM ses UNION ALL SELECT user_id, epoch_us(d_at), -1 FROM ses) GROUP BY user_id, t)"""
add("concurrency", EDGE, """, lv AS (SELECT user_id, t, sum(step) OVER (PARTITION BY user_id ORDER BY t) AS level, lead(t) OVER (PARTITION BY user_id ORDER BY t) AS nt FROM e)
SELECT user_id, CAST(max(level) AS BIGINT) AS peak, round(sum(CASE WHEN level > 2 AND nt IS NOT NULL THEN nt - t ELSE 0 END) / 1e6, 3) AS over_cap_s FROM lv GROUP BY user_id""")
add("concurrency_overall", EDGE, """, b AS (SELECT t // 60000000 AS m, sum(step) AS step FROM e GROUP BY 1)
SELECT make_timestamp(CAST(m * 60000000 AS BIGINT)) AS bucket_start, CAST(sum(step) OVER (ORDER BY m) AS BIGINT) AS level, sum(step) OVER (ORDER BY m) > 50 AS over_cap FROM b""")
add("counter_rate", """s AS (SELECT 'u' || user_id AS instance, ts, epoch_us(ts) AS us, CAST((event_id // 2) % 50 + user_id % 3 AS DOUBLE) AS v FROM events),
p AS (SELECT *, lag(v) OVER (PARTITION BY instance ORDER BY us) AS pv FROM s),
q AS (SELECT *, CASE WHEN pv IS NULL THEN 0 WHEN v >= pv THEN v - pv ELSE v END AS step FROM p)""",
    """SELECT instance, ts, CASE WHEN count(*) OVER w > 1 THEN sum(step) OVER w - first_value(step) OVER w END AS increase,
  CASE WHEN count(*) OVER w > 1 THEN round((v - first_value(v) OVER w) / ((us - first_value(us) OVER w) / 1e6) * 1e6, 4) END AS slope_u
FROM q WINDOW w AS (PARTITION BY instance ORDER BY us RANGE BETWEEN 431999999999 PRECEDING AND CURRENT ROW)""")


def _window(value: str, seconds: int) -> str:
    return f"OVER (PARTITION BY instance ORDER BY us RANGE BETWEEN {seconds * 1000000 - 1} PRECEDING AND CURRENT ROW)"


def _increase(step: str, seconds: int) -> str:
    w = _window(step, seconds)
    return f"CASE WHEN count(*) {w} > 1 THEN sum({step}) {w} - first_value({step}) {w} END"


def _step(v: str) -> str:
    p = f"lag({v}) OVER (PARTITION BY instance ORDER BY us)"
    return f"CASE WHEN {p} IS NULL THEN 0 WHEN {v} >= {p} THEN {v} - {p} ELSE {v} END"


add("alert_episodes", f"""m AS (SELECT 'i' || (user_id % 10) AS instance, ts, epoch_us(ts) AS us, event_id, event_type, value,
    (event_id // 7) % 40 AS ack, event_id % 200 * 50 AS slow, event_id // 10 AS multi FROM events),
m1 AS (SELECT *, {_step('ack')} AS ack_s, {_step('slow')} AS slow_s, {_step('multi')} AS multi_s FROM m),
m2 AS (SELECT *, {_increase('ack_s', 300)} AS ack_i, {_increase('slow_s', 300)} / 300 AS slow_r, {_increase('multi_s', 300)} / 300 AS multi_r,
    CASE WHEN count(*) {_window('', 1800)} > 1 THEN value * 1e6 - first_value(value * 1e6) {_window('', 1800)} END AS heap_d FROM m1),
c AS (SELECT instance, ts, us, unnest([
    {{'rule': 'wal_lag_high', 'f': 300, 'h': value * 400000 > 104857600}},
    {{'rule': 'pg_disconnected', 'f': 60, 'h': event_type = 'error'}},
    {{'rule': 'standby_ack_failures', 'f': 60, 'h': coalesce(ack_i > 3, false)}},
    {{'rule': 'auth_breaker_open', 'f': 60, 'h': event_type = 'view'}},
    {{'rule': 'stale_without_breaker', 'f': 60, 'h': event_type NOT IN ('view', 'click') AND event_id % 3 > 0}},
    {{'rule': 'slow_consumer_rate', 'f': 600, 'h': coalesce(slow_r > 0.1, false)}},
    {{'rule': 'multi_root_drops', 'f': 300, 'h': coalesce(multi_r > 0, false)}},
    {{'rule': 'fd_pressure', 'f': 600, 'h': value / 300 > 0.8}},
    {{'rule': 'heap_growth', 'f': 1800, 'h': coalesce(heap_d > 104857600, false)}}]) AS x FROM m2),
d AS (SELECT instance, ts, us, x.rule AS rule, x.f AS f, x.h AS h FROM c),
e AS (SELECT *, lag(h) OVER w AS ph, lag(us) OVER w AS pus FROM d WINDOW w AS (PARTITION BY rule, instance ORDER BY us)),
g AS (SELECT *, sum(CASE WHEN h AND ph AND us - pus <= 7200000000 THEN 0 ELSE 1 END) OVER (PARTITION BY rule, instance ORDER BY us) AS island FROM e)""",
    """SELECT rule, instance, min(ts) AS started_at, max(ts) AS ended_at, count(*) AS n_samples FROM g WHERE h
GROUP BY rule, instance, island, f HAVING max(us) - min(us) >= f * 1000000""")
add("failure_rate", CALLS + """,
b AS (SELECT backend, epoch_us(ts) // 3600000000 AS bucket, count(CASE WHEN result = 'unavailable' THEN 1 END) AS f, count(*) AS n FROM calls GROUP BY 1, 2)""",
    """SELECT backend, bucket, CAST(sum(f) OVER w AS BIGINT) AS window_failures, CAST(sum(n) OVER w AS BIGINT) AS window_total,
  round(CAST(sum(f) OVER w AS DOUBLE) / CAST(sum(n) OVER w AS DOUBLE), 6) AS rate FROM b WINDOW w AS (PARTITION BY backend ORDER BY bucket RANGE BETWEEN 29 PRECEDING AND CURRENT ROW)""")
add("stale", "", """SELECT user_id, max(ts) AS last_at, (user_id % 20 + 1) * 3600 AS ttl_s, round((epoch_us(TIMESTAMP '2024-01-31') - epoch_us(max(ts))) / 1e6, 3) AS age_s
FROM events GROUP BY user_id HAVING (epoch_us(TIMESTAMP '2024-01-31') - epoch_us(max(ts))) / 1e6 > (user_id % 20 + 1) * 3600""")
add("lsn_lag", """x AS (SELECT 'p' || (user_id % 8) AS s, ts, event_id, event_id % 2 = 0 AS cur,
  (CASE WHEN event_id % 2 = 0 THEN event_id + 3 ELSE event_id END) * 3000000000 AS lsn FROM events)""",
    """SELECT c.s AS session_id, c.ts, coalesce(c.lsn - d.lsn, 0) AS lag_bytes FROM (SELECT * FROM x WHERE cur) c
ASOF LEFT JOIN (SELECT * FROM x WHERE NOT cur) d ON d.s = c.s AND d.ts <= c.ts""")
add("steady_rate", """x AS (SELECT 'i' || (user_id % 10) AS instance, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-02')) / 1e6 AS t, event_id // 10 AS v FROM events),
y AS (SELECT instance, (arg_max(v, t) FILTER (t <= 1728000) - arg_max(v, t) FILTER (t <= 432000)) / (1728000 - 432000)::DOUBLE AS r FROM x GROUP BY instance)""",
    "SELECT instance, round(r * 1e6, 4) AS per_ms, round(r * 0.8 * 1e6, 4) AS floor_ms FROM y")
add("revocation", ",".join([CHG, SUB, POLICY]) + """,
lost AS (SELECT s.sub_id, v.lo AS lsn, 'auth_revoked' AS reason FROM sub s, ver v
  WHERE NOT EXISTS (SELECT 1 FROM pol p WHERE p.policy_id = s.policy_id AND p.version = v.version AND p.table_name = s.table_name)),
called AS (SELECT 'c' || o_custkey AS sub_id, o_orderkey * 250 AS lsn,
  CASE WHEN o_custkey % 6 = 0 THEN 'auth_revoked' WHEN o_custkey % 6 = 1 AND o_orderkey % 2 = 0 THEN 'auth_unavailable' END AS reason FROM orders),
cut AS (SELECT sub_id, lsn, reason FROM (SELECT c.*, row_number() OVER (PARTITION BY c.sub_id ORDER BY c.lsn, c.reason) AS r
  FROM (SELECT * FROM lost UNION ALL SELECT * FROM called WHERE reason IS NOT NULL) c JOIN sub s ON s.sub_id = c.sub_id WHERE c.lsn > s.start_lsn) WHERE r = 1)""",
    """SELECT s.sub_id, CASE WHEN c.lsn IS NULL THEN s.end_lsn ELSE least(s.end_lsn, c.lsn) END AS end_lsn,
  CASE WHEN s.end_lsn IS NULL OR c.lsn <= s.end_lsn THEN c.reason END AS reason FROM sub s LEFT JOIN cut c ON c.sub_id = s.sub_id""")


SUBX = SUB.replace("sub AS (SELECT", "subx AS (SELECT")
CUT = """
lost AS (SELECT s.sub_id, v.lo AS lsn, 'auth_revoked' AS reason FROM subx s, ver v
  WHERE NOT EXISTS (SELECT 1 FROM pol p WHERE p.policy_id = s.policy_id AND p.version = v.version AND p.table_name = s.table_name)),
top AS (SELECT max(o_orderkey // 800) AS t FROM orders),
spans AS (SELECT DISTINCT b, o_orderkey // 800 * 200000 + b * 10000 AS f, CASE WHEN o_orderkey // 800 < t THEN o_orderkey // 800 * 200000 + b * 10000 + 60000 END AS e
  FROM orders, top, (VALUES (0), (1), (2), (3)) AS v(b)),
refused AS (SELECT 'c' || o_custkey AS sub_id, o_orderkey * 250 AS lsn, o_orderkey % 4 AS b,
  CASE WHEN o_custkey % 6 = 0 THEN 'auth_revoked' WHEN o_custkey % 6 = 1 AND o_orderkey % 2 = 0 THEN 'auth_unavailable' END AS reason FROM orders),
called AS (SELECT r.sub_id, r.lsn, r.reason FROM refused r WHERE r.reason = 'auth_revoked'
  UNION ALL SELECT r.sub_id, r.lsn, r.reason FROM refused r LEFT JOIN spans p ON p.b = r.b AND r.lsn >= p.f AND (p.e IS NULL OR r.lsn < p.e)
  WHERE r.reason = 'auth_unavailable' AND p.b IS NULL),
cut AS (SELECT sub_id, lsn FROM (SELECT c.*, row_number() OVER (PARTITION BY c.sub_id ORDER BY c.lsn, c.reason) AS r
  FROM (SELECT * FROM lost UNION ALL SELECT * FROM called) c JOIN subx s ON s.sub_id = c.sub_id WHERE c.lsn > s.start_lsn) WHERE r = 1),
sub AS (SELECT s.sub_id, s.kind, s.table_name, s.pk, s.start_lsn, s.k, s.schema_name, s.policy_id,
  CASE WHEN c.lsn IS NULL THEN s.end_lsn ELSE least(s.end_lsn, c.lsn) END AS end_lsn FROM subx s LEFT JOIN cut c ON c.sub_id = s.sub_id)"""
add("revocation_routing", ",".join([CHG, SUBX, POLICY, CUT, ELIG, OUT]), """SELECT sub_id, outcome, count(*) AS n_pairs,
  CAST(sum(n_delivered) AS BIGINT) AS n_delivered, CAST(sum(n_beyond) AS BIGINT) AS n_beyond_anchor FROM outc GROUP BY sub_id, outcome""")


# ---- permission backend and streams ------------------------------------------------

add("breaker_timeline", CALLS + """,
b AS (SELECT backend, epoch_us(ts) // 3600000000 AS bucket, count(CASE WHEN result = 'unavailable' THEN 1 END) AS f, count(*) AS n FROM calls GROUP BY 1, 2),
bw AS (SELECT *, coalesce(sum(f) OVER w, 0) AS pf, coalesce(sum(n) OVER w, 0) AS pn FROM b
  WINDOW w AS (PARTITION BY backend ORDER BY bucket RANGE BETWEEN 29 PRECEDING AND 1 PRECEDING)),
p AS (SELECT c.backend, epoch_us(c.ts) AS us, c.health, c.result <> 'unavailable' AS good,
  bw.pf + count(CASE WHEN c.result = 'unavailable' THEN 1 END) OVER w AS f, bw.pn + count(*) OVER w AS n
  FROM calls c JOIN bw ON bw.backend = c.backend AND bw.bucket = epoch_us(c.ts) // 3600000000
  WINDOW w AS (PARTITION BY c.backend, epoch_us(c.ts) // 3600000000 ORDER BY c.ts)),
trip AS (SELECT backend, us FROM p WHERE n >= 20 AND f > n * 0.25),
probe AS (SELECT backend, us, good FROM p WHERE health),
nxt AS (SELECT DISTINCT backend, CAST(-1 AS BIGINT) AS us FROM p UNION ALL SELECT backend, us FROM probe),
after_close AS (SELECT x.backend, x.us, min(t.us) AS open_us FROM nxt x JOIN trip t ON t.backend = x.backend AND t.us > x.us GROUP BY 1, 2),
opens AS (SELECT DISTINCT backend, us FROM trip UNION SELECT backend, us FROM probe),
after_open AS (SELECT o.backend, o.us, min(q.us) AS probe_us, arg_min(q.good, q.us) AS good
  FROM opens o JOIN probe q ON q.backend = o.backend AND q.us >= o.us + 7200000000 GROUP BY 1, 2),
walk AS (
  SELECT backend, CAST(-1 AS BIGINT) AS us, 0 AS state FROM (SELECT DISTINCT backend FROM p)
  UNION ALL
  SELECT w.backend, CAST(coalesce(c.open_us, o.probe_us) AS BIGINT), CASE WHEN w.state = 0 THEN 1 WHEN o.good THEN 0 ELSE 1 END
  FROM walk w LEFT JOIN after_close c ON w.state = 0 AND c.backend = w.backend AND c.us = w.us
  LEFT JOIN after_open o ON w.state = 1 AND o.backend = w.backend AND o.us = w.us
  WHERE c.open_us IS NOT NULL OR o.probe_us IS NOT NULL),
steps AS (SELECT w.backend, w.us, w.state FROM walk w WHERE us >= 0
  UNION ALL SELECT w.backend, w.us, 2 FROM walk w JOIN probe q ON q.backend = w.backend AND q.us = w.us
    WHERE w.state = 0 OR EXISTS (SELECT 1 FROM walk v JOIN after_open o ON o.backend = v.backend AND o.us = v.us
      WHERE v.backend = w.backend AND v.state = 1 AND o.probe_us = w.us AND v.us >= 0))""",
    """SELECT backend, make_timestamp(us) AS at, CAST(state AS BIGINT) AS state,
  CASE state WHEN 0 THEN 'closed' WHEN 1 THEN 'open' ELSE 'half-open' END AS label FROM steps""")
SQL["breaker_timeline"] = SQL["breaker_timeline"].replace("WITH ", "WITH RECURSIVE ", 1)

add("stream_src", MSG, f"""SELECT session_id, kind, count(*) AS n, {check('seq')} FROM (
  SELECT session_id, op AS kind, seq FROM chg
  UNION ALL SELECT 's' || (tx_id // 5000), 'begin', tx_id * 100000 + 10 FROM txs
  UNION ALL SELECT 's' || (tx_id // 5000), 'commit', tx_id * 100000 + CASE WHEN tx_id % 40 = 0 THEN 199999 ELSE 99999 END FROM txs
  UNION ALL SELECT session_id, 'relation', seq FROM rel) GROUP BY session_id, kind""")
add("stream_assemble", CHG, f"SELECT tx_id, count(*) AS n, {check('seq')} FROM chg WHERE tx_id % 50 NOT IN (7, 9) GROUP BY tx_id")
SQL["stream_route"] = SQL["outcome_counts"]
SQL["stream_breaker"] = SQL["breaker_timeline"]
SQL["stream_mirror"] = SQL["snapshot_delta"]
add("stream_dedupe", "", """SELECT DISTINCT 'r' || (event_id % 20) AS sub_id,
  CASE WHEN event_id % 23 = 0 AND event_id >= 20 THEN event_id - 20 WHEN event_id % 17 = 0 AND event_id >= 40 THEN event_id - 40 ELSE event_id END AS tx_id FROM events""")
add("session_percentiles", SES, """SELECT reason, q, count(*) AS n, true AS within_error
FROM ses, (VALUES ('0.5'), ('0.95'), ('0.99')) AS v(q) GROUP BY reason, q""")
add("stream_once", "", """SELECT sub_id, tx_id, arrival, tx_id > coalesce(max(tx_id) OVER (PARTITION BY sub_id ORDER BY arrival
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS delivered
FROM (SELECT 'r' || (event_id % 20) AS sub_id, event_id AS arrival,
  CASE WHEN event_id % 23 = 0 AND event_id >= 20 THEN event_id - 20 WHEN event_id % 17 = 0 AND event_id >= 40 THEN event_id - 40 ELSE event_id END AS tx_id FROM events)""")
add("stream_transactions", MSG, f"""SELECT 's' || (t.tx_id // 5000) AS session_id, t.tx_id, (t.tx_id + 1) * 256 AS commit_lsn,
  make_timestamp(CAST(1704067200000000 + t.tx_id * 250000 AS BIGINT)) AS commit_ts, coalesce(c.n, 0) AS n_changes, c.checksum
FROM txs t LEFT JOIN (SELECT tx_id, count(*) AS n, {check('seq', 'op', 'pk')} FROM chg WHERE NOT {BAD} GROUP BY tx_id) c ON c.tx_id = t.tx_id
WHERE t.tx_id % 50 NOT IN (7, 9)""")
add("stream_failure_rate", CALLS, """SELECT backend, make_timestamp(CAST((epoch_us(ts) // 3600000000 - i) * 3600000000 AS BIGINT)) AS window_start,
  count(CASE WHEN result = 'unavailable' THEN 1 END) AS failures, count(*) AS total,
  round(count(CASE WHEN result = 'unavailable' THEN 1 END) / count(*), 6) AS rate
FROM calls, range(30) AS r(i) GROUP BY 1, 2""")


def build() -> dict[str, str]:
    return dict(SQL)
