"""Queries over a statement log, made from the events: one statement each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import logs
from ..streaming import meter as stream
from .base import derived, duck

STATEMENTS = [
    "SELECT count(*) FROM orders WHERE id = {id}",
    "  /* intent: nightly report; ticket: OPS-{id}, */ select sum(total) from sales",
    "DELETE FROM orders WHERE id = {id}",
    "/* first */ /* Actor: ann; INTENT:  , intent: fix {id} */ UPDATE orders SET status = ''void'' WHERE id = {id}",
    "SELECT 1; DROP TABLE orders",
    "EXPLAIN (FORMAT json, COSTS) SELECT * FROM orders",
    "EXPLAIN (ANALYZE) SELECT * FROM orders",
    "EXPLAIN ANALYZE SELECT * FROM orders",
    "WITH d AS (DELETE FROM orders RETURNING *) SELECT * FROM d",
    "SELECT pg_sleep({id})",
    "SELECT audit.count(id) FROM orders",
    "SELECT ''a;b'' || lower(name) FROM customers WHERE created < now()",
    "SELECT * FROM orders FOR UPDATE",
    "SELECT id INTO copy FROM orders",
    "",
    "/* open SELECT 1",
    "SELECT max(total) FROM orders WHERE coalesce(status, ''x'') = lower(''OPEN'') AND id = random()",
    "table orders",
]
W, S, X = "write_on_readonly", "stacked_statement", "parse_failed"
#: More statements: text, class, reason why it is no read (null: a read), the functions it calls, volatility of its WHERE.
MORE = [
    ("SELECT ''/*'', pg_terminate_backend(1), ''*/''", "SELECT", W, ["pg_terminate_backend"], None),
    ('SELECT "pg_sleep"(9)', "SELECT", W, ["pg_sleep"], None),
    ("WITH x AS (UPDATE ONLY t SET a = 1 RETURNING *) SELECT * FROM x", "WITH", W, [], None),
    ("WITH x AS (UPDATE t AS u SET a = 1 RETURNING *) SELECT * FROM x", "WITH", W, [], None),
    ("WITH x AS (INSERT INTO t VALUES (1) RETURNING *) SELECT * FROM x", "WITH", W, [], None),
    ("WITH x AS (MERGE INTO t USING s ON t.id = s.id WHEN MATCHED THEN DELETE) SELECT 1", "WITH", W, [], None),
    ("SELECT ''it''''s; fine'' FROM t", "SELECT", None, [], None),
    ('SELECT "update" FROM t', "SELECT", None, [], None),
    ('SELECT "a;b" FROM t', "SELECT", None, [], None),
    ('SELECT "a""(b" FROM t', "SELECT", None, [], None),
    ("SELECT $$ DROP TABLE t; $$", "SELECT", None, [], None),
    ("SELECT $q$ it is ; /* $q$, count(*) FROM t", "SELECT", None, ["count"], None),
    ("SELECT $q$ open", "SELECT", X, [], None),
    ("SELECT 1 -- ; DROP TABLE t", "SELECT", None, [], None),
    ("-- note\nSELECT 1", None, None, [], None),
    ("SELECT 1 /* a; b */ FROM t", "SELECT", None, [], None),
    ("/* outer /* inner */ SELECT 1", "SELECT", X, [], None),
    ("/* outer /* inner */ still */ SELECT 1", "STILL", X, [], None),
    ("/* outer /* inner */ SELECT 1 -- */ DELETE FROM t", "SELECT", X, [], None),
    ("SELECT ''open FROM t", "SELECT", X, [], None),
    ('SELECT "open FROM t', "SELECT", X, [], None),
    ("SELECT (1", "SELECT", X, [], None),
    ("SELECT 1;", "SELECT", None, [], None),
    ("SELECT 1; ; ", "SELECT", None, [], None),
    ("SELECT 1; SELECT 2", "SELECT", S, [], None),
    ("SELECT '';''; DELETE FROM t", "SELECT", S, [], None),
    (";", None, "empty_statement", [], None),
    ("/* only */ -- this", None, "empty_statement", [], None),
    ("SELECT * FROM t FOR SHARE", "SELECT", W, [], None),
    ("SELECT * FROM t FOR NO KEY UPDATE", "SELECT", W, [], None),
    ("SELECT * FROM t FOR KEY SHARE", "SELECT", W, [], None),
    ("SELECT * INTO TEMP u FROM t", "SELECT", W, [], None),
    ("SELECT 1 OPERATOR(pg_catalog.+) 2", "SELECT", W, ["operator"], None),
    ("SELECT x::audit.kind FROM t", "SELECT", W, [], None),
    ("SELECT CAST(x AS audit.kind) FROM t", "SELECT", W, [], None),
    ("SELECT x::int FROM t", "SELECT", None, [], None),
    ("SELECT CAST(x AS int) FROM t WHERE x IN (1, 2)", "SELECT", None, [], None),
    ("SELECT COUNT(*) FROM t", "SELECT", None, ["count"], None),
    ('SELECT "COUNT"(*) FROM t', "SELECT", W, ["COUNT"], None),
    ('SELECT "pg_catalog"."count"(*) FROM t', "SELECT", W, ["pg_catalog.count"], None),
    ("SELECT pg_catalog . count (1)", "SELECT", W, ["pg_catalog.count"], None),
    ("SELECT nextval(''s'')", "SELECT", W, ["nextval"], None),
    ("SELECT pg_read_file(''x'')", "SELECT", W, ["pg_read_file"], None),
    ("SELECT sum(lower(max(x))) FROM t", "SELECT", None, ["sum", "lower", "max"], None),
    ("VALUES (1), (2)", "VALUES", None, [], None),
    ("WITH d AS (SELECT 1) SELECT * FROM d", "WITH", None, [], None),
    ("WITH d AS MATERIALIZED (SELECT 1) SELECT * FROM d", "WITH", None, [], None),
    ("EXPLAIN SELECT 1", "EXPLAIN", None, [], None),
    ("EXPLAIN VERBOSE SELECT 1", "EXPLAIN", None, [], None),
    ("EXPLAIN (ANALYZE, BUFFERS) SELECT 1", "EXPLAIN", W, [], None),
    ("EXPLAIN (WAL) SELECT 1", "EXPLAIN", W, [], None),
    ("EXPLAIN DELETE FROM t", "EXPLAIN", W, [], None),
    ("EXPLAIN (FORMAT text) INSERT INTO t VALUES (1)", "EXPLAIN", W, [], None),
    ("COPY t TO ''/tmp/x''", "COPY", W, [], None),
    ("CALL p()", "CALL", W, ["p"], None),
    ("DO $$ BEGIN DELETE FROM t; END $$", "DO", W, [], None),
    ("SET search_path = audit", "SET", W, [], None),
    ("TRUNCATE t", "TRUNCATE", W, [], None),
    ("VACUUM t", "VACUUM", W, [], None),
    ("LOCK TABLE t", "LOCK", W, [], None),
    ("CREATE TABLE u AS SELECT 1", "CREATE", W, [], None),
    ("ALTER TABLE t ADD c int", "ALTER", W, [], None),
    ("GRANT SELECT ON t TO u", "GRANT", W, [], None),
    ("DISCARD ALL", "DISCARD", W, [], None),
    ("42", None, X, [], None),
    ('DELETE FROM t WHERE id = "random"()', "DELETE", W, ["random"], "volatile_or_unknown"),
    ("WITH d AS (DELETE FROM a WHERE id = 1 RETURNING id) UPDATE b SET x = 1 WHERE at < current_timestamp", "WITH", W, [], "clock_name"),
    ("UPDATE t SET a = random() WHERE id = 1", "UPDATE", W, ["random"], None),
    ("DELETE FROM t WHERE name = ''now()''", "DELETE", W, [], None),
    ("DELETE FROM t WHERE x = audit.lower(y)", "DELETE", W, ["audit.lower"], "volatile_or_unknown"),
    ("DELETE FROM t WHERE x = lower(y) RETURNING random()", "DELETE", W, ["lower", "random"], None),
    ("SELECT filter(1)", "SELECT", W, ["filter"], None),
    ("SELECT over(1)", "SELECT", W, ["over"], None),
    ("SELECT by(1), range(2), rows(3)", "SELECT", W, ["by", "range", "rows"], None),
    ("SELECT a, set(b) FROM t", "SELECT", W, ["set"], None),
    ("SELECT partition(b) FROM t", "SELECT", W, ["partition"], None),
    ("SELECT materialized(b), within(c) FROM t", "SELECT", W, ["materialized", "within"], None),
    ("SELECT a FROM t WHERE explain(a)", "SELECT", W, ["explain"], "volatile_or_unknown"),
    ("SELECT like(a, b), join(c) FROM t", "SELECT", W, ["like", "join"], None),
    ("SELECT 1 + over(2)", "SELECT", W, ["over"], None),
    ("SELECT count(*) FILTER (WHERE a > 1) OVER (PARTITION BY (b) ORDER BY (c)) FROM t", "SELECT", None, ["count"], None),
    ("SELECT max(a) OVER (ORDER BY b ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) FROM t", "SELECT", None, ["max"], None),
    ("SELECT a FROM t WHERE b LIKE (c) AND d NOT LIKE (e)", "SELECT", None, [], None),
    ("SELECT * FROM t JOIN (SELECT 1 AS a) u ON (t.a = u.a) LEFT JOIN (SELECT 2 AS a) v USING (a)", "SELECT", None, [], None),
    ("WITH d(a, b) AS (SELECT 1, 2) SELECT a FROM d", "WITH", None, [], None),
    ("WITH RECURSIVE d(a) AS (SELECT 1 UNION ALL SELECT (a + 1) FROM d) SELECT a FROM d", "WITH", None, [], None),
    ("WITH d AS NOT MATERIALIZED (SELECT 1) SELECT * FROM d", "WITH", None, [], None),
    ("SELECT a FROM (VALUES (1), (2)) AS v(a)", "SELECT", None, [], None),
    ("SELECT a, b FROM t GROUP BY GROUPING SETS ((a), (b))", "SELECT", None, [], None),
    ("SELECT a FROM t GROUP BY (a) HAVING (count(*)) > 1 ORDER BY (a) LIMIT (5) OFFSET (1)", "SELECT", None, ["count"], None),
    ("SELECT CASE WHEN (a) THEN (b) ELSE (c) END FROM t", "SELECT", None, [], None),
    ("SELECT a FROM t WHERE EXISTS (SELECT 1) AND b = ANY (SELECT 2) AND NOT (c) AND d BETWEEN (1) AND (2)", "SELECT", None, [], None),
    ("SELECT ARRAY(SELECT a FROM t), ROW(1, 2), CAST(a AS numeric(9, 2)), b::varchar(10)", "SELECT", None, [], None),
    ("(SELECT 1) UNION (SELECT 2) EXCEPT (SELECT 3)", None, None, [], None),
    ("((SELECT 1))", None, None, [], None),
    ("(DELETE FROM t)", None, W, [], None),
    ("SELECT a @#@ b FROM t", "SELECT", W, [], None),
    ("SELECT a <=> b FROM t", "SELECT", W, [], None),
    ("SELECT @@@@ a FROM t", "SELECT", W, [], None),
    ("DELETE FROM t WHERE id = 3 AND a @#@ b", "DELETE", W, [], "volatile_or_unknown"),
    ("SELECT a || b, a <> c, a != d, -e, a * -1, a =-1, ~f, a % 2 FROM t", "SELECT", None, [], None),
    ("SELECT j -> 1, j ->> 2, j @> k, k <@ j, j && l, a ~* b, a !~~ c FROM t", "SELECT", None, [], None),
    ("SELECT t.*, count(*), a[1], a[1:2], $1 FROM t", "SELECT", None, ["count"], None),
    ("SELECT a :: int [], b ::text FROM t", "SELECT", None, [], None),
    ("SELECT a :: audit . kind FROM t", "SELECT", W, [], None),
    ('SELECT a::"audit"."kind"[] FROM t', "SELECT", W, [], None),
    ("SELECT audit.kind ''x''", "SELECT", W, [], None),
    ("SELECT date ''2020-01-01'', interval ''1 day'', kind ''x''", "SELECT", None, [], None),
    ("SELECT 1 --\r, pg_sleep(9)", "SELECT", W, ["pg_sleep"], None),
    ("SELECT 1 --\n, pg_sleep(9)", "SELECT", W, ["pg_sleep"], None),
    ("SELECT a FROM t WHERE id = 1 --\r OR random() < 2", "SELECT", W, ["random"], "volatile_or_unknown"),
    ("SELECT 1 -- x\x0b, pg_sleep(9)", "SELECT", None, [], None),
    ("SELECT $é$''$é$, pg_sleep(9), $é$''$é$", "SELECT", W, ["pg_sleep"], None),
    ("SELECT $é$ pg_sleep(9) $é$", "SELECT", None, [], None),
    ("SELECT $a1$ $a$ pg_sleep(9) $a1$", "SELECT", None, [], None),
    ("SELECT a$b$, pg_sleep(9), c$b$ FROM t", "SELECT", W, ["pg_sleep"], None),
    ("SELECT $1a FROM t", "SELECT", X, [], None),
    ("SELECT 1or FROM t", "SELECT", X, [], None),
    ("SELECT 1.5e-3, .5, 0x1F, 1_000, 5. FROM t", "SELECT", None, [], None),
    ("SELECT 1/*x*/*/*y*/2 FROM t", "SELECT", None, [], None),
    ("SELECT 1 */ 2 FROM t", "SELECT", W, [], None),
    ("SELECT sum/**/(x), lower --\n (y) FROM t", "SELECT", None, ["sum", "lower"], None),
    ("SELECT pg_sleep/**/(9)", "SELECT", W, ["pg_sleep"], None),
    ('SELECT U&"pg_sleep"(9)', "SELECT", W, ["pg_sleep"], None),
    ('SELECT a.b.c.sum(x), "sum"(y), "a""b"(z)', "SELECT", W, ["a.b.c.sum", "sum", 'a"b'], None),
    ('SELECT "x""sum"(1)', "SELECT", W, ['x"sum'], None),
    ("SELECT a]b FROM t", "SELECT", X, [], None),
    ("SELECT )1( FROM t", "SELECT", X, [], None),
    ("SELECT (a[1) FROM t]", "SELECT", X, [], None),
    ("SELECT a FROM t FOR KEY SHARE OF t NOWAIT", "SELECT", W, [], None),
    ("SELECT * FROM (SELECT a FROM t FOR SHARE) u", "SELECT", W, [], None),
    ("SELECT substring(a FROM 1 FOR 2) FROM t", "SELECT", W, ["substring"], None),
    ("EXPLAIN (VERBOSE, FORMAT json, COSTS off) WITH d AS (SELECT (1)) SELECT * FROM d", "EXPLAIN", None, [], None),
    ("EXPLAIN (SELECT 1)", "EXPLAIN", None, [], None),
    ("EXPLAIN (COSTS) (SELECT 1)", "EXPLAIN", None, [], None),
    ("EXPLAIN (ANALYSE) SELECT 1", "EXPLAIN", W, [], None),
    ("EXPLAIN ANALYSE VERBOSE SELECT 1", "EXPLAIN", W, [], None),
    ("EXPLAIN (COSTS, SERIALIZE text) SELECT 1", "EXPLAIN", W, [], None),
    ("EXPLAIN (COSTS) SELECT pg_sleep(9)", "EXPLAIN", W, ["pg_sleep"], None),
    ("EXPLAIN SELECT 1; DROP TABLE t", "EXPLAIN", S, [], None),
    ("SELECT current_timestamp(3), localtime(0) FROM t", "SELECT", None, [], None),
    ("SELECT a FROM t TABLESAMPLE bernoulli (10)", "SELECT", W, ["bernoulli"], None),
    ("SELECT * FROM rows_of(1) AS r(a) JOIN lower(b) l ON true", "SELECT", W, ["rows_of", "lower"], None),
    ("SHOW search_path", "SHOW", W, [], None),
    ("PREPARE p AS SELECT 1", "PREPARE", W, [], None),
    ("SELEKT 1", "SELEKT", W, [], None),
    ("UPDATE t SET a = 1 WHERE b = (SELECT max(c) FROM u WHERE d < localtime)", "UPDATE", W, ["max"], "clock_name"),
    ("DELETE FROM t WHERE a = coalesce(b, greatest(c, d)) AND e = lower(f)", "DELETE", W, ["coalesce", "greatest", "lower"], None),
]
STATEMENTS += [m[0] for m in MORE]
LOG = (
    "SELECT event_id AS log_id, CAST(user_id AS STRING) AS session, CASE user_id % 4 WHEN 0 THEN 'reader' WHEN 1 THEN 'analyst' WHEN 2 THEN 'empty' ELSE 'stranger' END AS role, millis(ts) AS ts_ms,"
    + f" CAST(event_id % {len(STATEMENTS)} AS INT) AS k, CASE event_id % {len(STATEMENTS)} "
    + " ".join(f"WHEN {i} THEN '" + s.replace("{id}", "' || CAST(event_id AS STRING) || '") + "'" for i, s in enumerate(STATEMENTS))
    + " END AS sql_text FROM {events}"
)
#: What each statement is, written by hand: class, whether it is a read, the reason if not.
EXPECTED = [
    ("SELECT", True, None), ("SELECT", True, None), ("DELETE", False, "write_on_readonly"), ("UPDATE", False, "write_on_readonly"), ("SELECT", False, "stacked_statement"),
    ("EXPLAIN", True, None), ("EXPLAIN", False, "write_on_readonly"), ("EXPLAIN", False, "write_on_readonly"), ("WITH", False, "write_on_readonly"), ("SELECT", False, "write_on_readonly"),
    ("SELECT", False, "write_on_readonly"), ("SELECT", False, "write_on_readonly"), ("SELECT", False, "write_on_readonly"), ("SELECT", False, "write_on_readonly"), (None, False, "empty_statement"),
    (None, False, "parse_failed"), ("SELECT", False, "write_on_readonly"), ("TABLE", True, None),
]
EXPECTED += [(m[1], m[2] is None, m[2]) for m in MORE]
INTENT = {1: ("'nightly report'", "'OPS-' || log_id", "NULL"), 3: ("'fix ' || log_id", "NULL", "'ann'")}
VOLATILITY = {11: "clock_name", 16: "volatile_or_unknown"} | {18 + i: m[4] for i, m in enumerate(MORE) if m[4]}
CALLS = {0: ["count"], 1: ["sum"], 9: ["pg_sleep"], 10: ["audit.count"], 11: ["lower", "now"], 16: ["max", "coalesce", "lower", "random"]} | {18 + i: m[3] for i, m in enumerate(MORE) if m[3]}
ALLOWED = ["count", "sum", "max", "lower"]
#: Deciding in hand-written order: now() is not on the list of allowed functions.
PLANS = "SELECT event_id AS log_id, CASE user_id % 3 WHEN 0 THEN 'reader' WHEN 1 THEN 'analyst' ELSE 'stranger' END AS role, event_id AS a, CASE WHEN event_id % 11 = 0 THEN 'Seq Scan on t' ELSE 'Seq Scan on t  (cost=0.00..' || CAST(event_id % 5000 AS STRING) || '.50 rows=' || CAST(event_id * 7 % 9000 AS STRING) || ' width=8)' END AS plan_line FROM {events}"
PLAN_POLICY = "SELECT * FROM (VALUES ('reader', CAST(1000.5 AS DOUBLE), CAST(2000 AS BIGINT)), ('analyst', 4000.0, 8000)) AS p(role, max_plan_cost, max_plan_rows)"
REQUESTS = "SELECT event_id AS request_id, CASE event_id % 7 WHEN 0 THEN 'UPDATE' WHEN 1 THEN 'DELETE' WHEN 2 THEN 'INSERT' WHEN 3 THEN 'TRUNCATE' WHEN 4 THEN 'alter' WHEN 5 THEN 'drop' ELSE 'GRANT' END AS kind, user_id % 3 <> 0 AS has_pk, user_id % 5 <> 0 AS has_preimage, user_id % 4 = 0 AS volatile_default FROM {events}"
PROPOSALS = "SELECT CAST(event_id AS STRING) AS proposal_id, millis(ts) AS created_ms, CAST(event_id % 9 * 86400000 AS BIGINT) AS ttl_ms, event_id % 4 AS confirm_rows, CASE event_id % 3 WHEN 0 THEN 'ct-' || CAST(event_id AS STRING) || '-' || CAST(event_id % 4 AS STRING) WHEN 1 THEN 'ct-0-0' END AS confirm_token FROM {events}"
TOTALS = "SELECT CAST(event_id AS STRING) AS proposal_id, CASE WHEN user_id % 6 = 0 THEN CAST(99 AS BIGINT) ELSE event_id % 4 END AS total_rows FROM {events}"
NOW = 1_706_000_000_000
SIGNALS = "SELECT CAST(user_id AS STRING) || '/' || CAST(CAST(ts AS DATE) AS STRING) AS action, event_id AS signal_id, CASE event_type WHEN 'error' THEN 'BLOCK' WHEN 'signup' THEN 'HOLD' WHEN 'purchase' THEN 'ESCALATE' ELSE 'ALLOW' END AS verdict, event_type AS reason FROM {events}"
FLOORS = "SELECT DISTINCT CAST(user_id AS STRING) || '/' || CAST(CAST(ts AS DATE) AS STRING) AS action, CASE user_id % 3 WHEN 0 THEN 'HOLD' WHEN 1 THEN 'ALLOW' ELSE 'ESCALATE' END AS floor FROM {events} WHERE user_id % 4 <> 0"
EVENTS = "SELECT CAST(user_id AS STRING) AS session, event_id, millis(ts) AS ts_ms, CASE WHEN event_id % 211 = 0 THEN 'FloorTripped' WHEN event_id % 97 = 0 THEN 'SuspiciousPattern' WHEN event_id % 2 = 0 THEN 'BenignRead' ELSE 'BenignWrite' END AS event_type, event_id % 5 AS rows, CAST(round(value * 100) AS BIGINT) AS bytes FROM {events}"
GRANTS = "SELECT DISTINCT CAST(user_id AS STRING) AS session, CASE WHEN user_id % 3 = 0 THEN 'Agent' ELSE 'Operator' END AS granted FROM {events} WHERE user_id % 7 <> 0"
RELATIONS = "CASE k % 3 WHEN 0 THEN array('orders') WHEN 1 THEN array('orders', 'sales') ELSE array('sales', 'secret') END"


def log(spark: SparkSession, folder: str) -> DataFrame:
    return derived(spark, folder, LOG)


def with_relations(df: DataFrame) -> DataFrame:
    return df.withColumn("relations", F.expr(RELATIONS))


def whitelist(spark: SparkSession) -> DataFrame:
    return spark.sql("SELECT * FROM VALUES ('reader', array('orders')), ('analyst', array('orders', 'sales')), ('empty', cast(array() as array<string>)) AS p(role, select_whitelist)")


def allowed(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n,) for n in ALLOWED], "name string")


def catalog(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("lower", "immutable"), ("random", "volatile"), ("now", "stable")], "name string, volatility string")


def session_log(spark: SparkSession, folder: str) -> DataFrame:
    rows = with_relations(logs.with_statement_class(log(spark, folder)))
    return rows.withColumn("is_read", F.coalesce(F.col("statement_class").isin("SELECT", "TABLE"), F.lit(False)))


def text(df: DataFrame, *columns: str) -> DataFrame:
    """Arrays as comma-joined text, which both engines print alike."""
    return df.withColumns({c: F.array_join(F.transform(c, lambda x: F.coalesce(x, F.lit("-"))), ",") for c in columns})


def by_kind(values: dict[int, str]) -> str:
    return "CASE k " + " ".join(f"WHEN {i} THEN {v}" for i, v in values.items()) + " END"


def literal(x) -> str:
    return "NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x).lower()


QUERIES = {
    "p1_statement_class": lambda s, d: logs.with_statement_class(log(s, d)).select("log_id", "statement_class"),
    "p2_intent": lambda s, d: logs.with_intent(log(s, d)).select("log_id", "intent", "ticket", "actor"),
    "p3_read_verdict": lambda s, d: logs.with_read_verdict(log(s, d), allowed(s)).select("log_id", "is_read", "reason"),
    "p4_functions_used": lambda s, d: logs.functions_used(log(s, d)).groupBy("name").count().withColumnRenamed("count", "n"),
    "p7_volatility": lambda s, d: logs.with_volatility(log(s, d), catalog(s)).select("log_id", "volatility", "deterministic"),
    "p8_plan_estimate": lambda s, d: logs.with_plan_estimate(derived(s, d, PLANS)).select("log_id", "total_cost", "plan_rows"),
    "p9_gate_plans": lambda s, d: logs.gate_plans(derived(s, d, PLANS), derived(s, d, PLAN_POLICY)).select("log_id", "refused"),
    "p10_gate_relations": lambda s, d: logs.gate_relations(with_relations(log(s, d)), whitelist(s)).select("log_id", "allowed"),
    "p13_certify": lambda s, d: logs.certify(derived(s, d, REQUESTS)),
    "p14_expiry": lambda s, d: logs.with_expiry(derived(s, d, PROPOSALS), NOW).select("proposal_id", "expired", "remaining_ms"),
    "p15_confirm": lambda s, d: logs.check_confirm(derived(s, d, PROPOSALS), derived(s, d, TOTALS)).select("proposal_id", "refused"),
    "a14_max_ranked": lambda s, d: logs.max_ranked(derived(s, d, SIGNALS), ["action"], "verdict", logs.VERDICTS),
    "a15_combine_verdicts": lambda s, d: logs.combine_verdicts(derived(s, d, SIGNALS), derived(s, d, FLOORS)),
    "a16_session_trust": lambda s, d: logs.session_trust(derived(s, d, EVENTS), derived(s, d, GRANTS)),
    "a17_session_context": lambda s, d: text(logs.session_context(session_log(s, d)), "steps", "tables"),
    "a17_session_steps": lambda s, d: text(logs.session_steps(session_log(s, d), 7), "steps"),
    "a17_session_tables": lambda s, d: logs.session_tables(session_log(s, d)),
    "a17_session_summary": lambda s, d: logs.session_summary(session_log(s, d)),
    "w3_trust_timeline": lambda s, d: logs.trust_timeline(derived(s, d, EVENTS), derived(s, d, GRANTS)),
    "f7_trust_stream": lambda s, d: last(stream.replay(derived(s, d, EVENTS), stream.trust, "trust", mode="update")),
}


def last(updates: DataFrame) -> DataFrame:
    """The newest update of each session: the one that has counted most."""
    return updates.groupBy("session").agg(F.max(F.struct("n", "trust", "rows", "bytes")).alias("u")).select("session", "u.trust", "u.rows", "u.bytes")


L = f"WITH l AS ({duck(LOG)})"
P = f"WITH l AS ({duck(PLANS)}), p AS ({PLAN_POLICY}), e AS (SELECT l.*, try_cast(nullif(regexp_extract(plan_line, 'cost=[^ )]*\\.\\.([0-9.]+)', 1), '') AS DOUBLE) AS c, try_cast(nullif(regexp_extract(plan_line, 'rows=([0-9]+)', 1), '') AS BIGINT) AS r FROM l)"
V = "['ALLOW', 'ESCALATE', 'HOLD', 'BLOCK']"
T = f"""WITH e AS ({duck(EVENTS)}), g AS ({duck(GRANTS)}), x AS (SELECT e.*, CASE granted WHEN 'Operator' THEN 2 WHEN 'Agent' THEN 1 ELSE 0 END AS g,
  CASE event_type WHEN 'FloorTripped' THEN 0 WHEN 'SuspiciousPattern' THEN 1 ELSE 2 END AS c FROM e LEFT JOIN g ON g.session = e.session)"""
NAME = "['Untrusted', 'Agent', 'Operator']"
ORACLES = {
    "p1_statement_class": f"{L} SELECT log_id, {by_kind({i: literal(e[0]) for i, e in enumerate(EXPECTED)})} AS statement_class FROM l",
    "p2_intent": f"{L} SELECT log_id, {', '.join(by_kind({i: v[j] for i, v in INTENT.items()}) + f' AS {n}' for j, n in enumerate(('intent', 'ticket', 'actor')))} FROM l",
    "p3_read_verdict": f"{L} SELECT log_id, {by_kind({i: literal(e[1]) for i, e in enumerate(EXPECTED)})} AS is_read, {by_kind({i: literal(e[2]) for i, e in enumerate(EXPECTED)})} AS reason FROM l",
    "p4_functions_used": f"{L}, f AS (SELECT unnest({by_kind({i: str(v) for i, v in CALLS.items()}).replace(' END', ' ELSE [] END')}) AS name FROM l) SELECT name, count(*) AS n FROM f GROUP BY name",
    "p7_volatility": f"{L} SELECT log_id, {by_kind({i: literal(v) for i, v in VOLATILITY.items()})} AS volatility, k NOT IN ({', '.join(map(str, VOLATILITY))}) AS deterministic FROM l",
    "p8_plan_estimate": P + " SELECT log_id, c AS total_cost, r AS plan_rows FROM e",
    "p9_gate_plans": P + " SELECT log_id, CASE WHEN p.role IS NULL THEN 'unknown_role' WHEN c IS NULL THEN 'explain_failed' WHEN c > max_plan_cost THEN 'explain_cost_exceeded' WHEN r > max_plan_rows THEN 'explain_rows_exceeded' END AS refused FROM e LEFT JOIN p ON p.role = e.role",
    "p10_gate_relations": f"{L} SELECT log_id, role = 'reader' AND k % 3 = 0 OR role = 'analyst' AND k % 3 <> 2 AS allowed FROM l",
    "p13_certify": f"""SELECT *, CASE WHEN upper(kind) IN ('TRUNCATE', 'DROP', 'ALTER') THEN upper(kind) WHEN kind = 'GRANT' THEN 'NotCertified' WHEN NOT has_pk THEN 'PkLessTable'
      WHEN kind = 'INSERT' AND volatile_default THEN 'VolatileDefaultInsert' WHEN kind = 'DELETE' AND NOT has_preimage THEN 'DeleteWithoutPreimage' WHEN kind = 'UPDATE' AND NOT has_preimage THEN 'NotCertified' END AS refused FROM ({duck(REQUESTS)})""",
    "p14_expiry": f"SELECT proposal_id, {NOW} - created_ms >= ttl_ms AS expired, greatest(ttl_ms - ({NOW} - created_ms), 0) AS remaining_ms FROM ({duck(PROPOSALS)})",
    "p15_confirm": f"SELECT p.proposal_id, CASE WHEN confirm_rows <> total_rows THEN 'ROWS_DIFFER' WHEN confirm_token <> 'ct-' || p.proposal_id || '-' || total_rows THEN 'TOKEN_DIFFERS' END AS refused FROM ({duck(PROPOSALS)}) p JOIN ({duck(TOTALS)}) t ON t.proposal_id = p.proposal_id",
    "a14_max_ranked": f"SELECT action, {V}[max(list_position({V}, verdict))] AS verdict FROM ({duck(SIGNALS)}) GROUP BY action",
    "a15_combine_verdicts": f"""WITH s AS (SELECT *, list_position({V}, verdict) AS r FROM ({duck(SIGNALS)})), b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY action ORDER BY r DESC, signal_id) = 1)
      SELECT b.action, {V}[greatest(r, coalesce(list_position({V}, floor), 1))] AS verdict, CASE WHEN coalesce(list_position({V}, floor), 1) > r THEN 'clamped_to_floor' ELSE reason END AS reason FROM b LEFT JOIN ({duck(FLOORS)}) f ON f.action = b.action""",
    "a16_session_trust": T + f" SELECT session, {NAME}[least(min(g), min(c)) + 1] AS trust, [1000, 5000, 10000][least(min(g), min(c)) + 1] AS budget_bp, CAST(sum(rows) AS BIGINT) AS rows, CAST(sum(bytes) AS BIGINT) AS bytes FROM x GROUP BY session",
    "a17_session_steps": f"""{L}, n AS (SELECT session, ts_ms, log_id, {by_kind({i: literal(e[0]) for i, e in enumerate(EXPECTED)})} AS cl, row_number() OVER (PARTITION BY session ORDER BY ts_ms, log_id) - 1 AS i FROM l)
      SELECT session, i // 7 AS page, string_agg(coalesce(cl, '-'), ',' ORDER BY i) AS steps FROM n GROUP BY session, page""",
    "a17_session_tables": f"""{L} SELECT session, relation, count(*) AS statements FROM (SELECT session, unnest(CASE k % 3 WHEN 0 THEN ['orders'] WHEN 1 THEN ['orders', 'sales'] ELSE ['sales', 'secret'] END) AS relation FROM l) GROUP BY session, relation""",
    "a17_session_summary": f"""{L}, r AS (SELECT *, coalesce({by_kind({i: literal(e[0]) for i, e in enumerate(EXPECTED)})} IN ('SELECT', 'TABLE'), false) AS is_read FROM l), w AS (SELECT *, min(CASE WHEN NOT is_read THEN ts_ms END) OVER (PARTITION BY session) AS fw FROM r)
      SELECT session, count(*) AS statements, count(*) FILTER (is_read AND (fw IS NULL OR ts_ms < fw)) AS reads_before_write, count(*) / greatest((max(ts_ms) - min(ts_ms)) / 60000.0, 1.0) AS rate_per_min FROM w GROUP BY session""",
    "a17_session_context": f"""{L}, c AS (SELECT *, {by_kind({i: literal(e[0]) for i, e in enumerate(EXPECTED)})} AS cl, CASE k % 3 WHEN 0 THEN ['orders'] WHEN 1 THEN ['orders', 'sales'] ELSE ['sales', 'secret'] END AS rel FROM l),
      r AS (SELECT *, coalesce(cl IN ('SELECT', 'TABLE'), false) AS is_read FROM c), w AS (SELECT *, min(CASE WHEN NOT is_read THEN ts_ms END) OVER (PARTITION BY session) AS fw FROM r)
      SELECT session, string_agg(coalesce(cl, '-'), ',' ORDER BY ts_ms, log_id) AS steps, array_to_string(list_sort(list_distinct(flatten(list(rel)))), ',') AS tables,
        count(*) FILTER (is_read AND (fw IS NULL OR ts_ms < fw)) AS reads_before_write, count(*) / greatest((max(ts_ms) - min(ts_ms)) / 60000.0, 1.0) AS rate_per_min FROM w GROUP BY session""",
    "w3_trust_timeline": T + f" SELECT session, event_id, {NAME}[least(g, min(c) OVER w) + 1] AS trust, CAST(sum(rows) OVER w AS BIGINT) AS rows, CAST(sum(bytes) OVER w AS BIGINT) AS bytes FROM x WINDOW w AS (PARTITION BY session ORDER BY ts_ms, event_id ROWS UNBOUNDED PRECEDING)",
    "f7_trust_stream": T + f" SELECT session, {NAME}[min(c) + 1] AS trust, CAST(sum(rows) AS BIGINT) AS rows, CAST(sum(bytes) AS BIGINT) AS bytes FROM x GROUP BY session",
}
