"""Statement logs: triage, gates, sessions, trust and verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import statements as fn
from ..functions.folds import with_running
from ..schemas import BUDGET_BP, TRUST, TRUST_CEILING, VERDICTS, label, rank
from .meter import SPAN, with_caps

MOST = 9_223_372_036_854_775_807
#: Copies of a session's row that its statements are spread over.
SALTS = 8


def with_statement_class(log: DataFrame) -> DataFrame:
    return log.withColumn("statement_class", fn.leading_word(F.col("sql_text")))


def with_intent(log: DataFrame) -> DataFrame:
    rows = log.withColumn("_i", fn.intent(F.col("sql_text")))
    return rows.select(*log.columns, *[F.col(f"_i.{k}").alias(k) for k in ("intent", "ticket", "actor")])


def functions_used(log: DataFrame) -> DataFrame:
    """A row for each statement and function name it calls."""
    return log.select("log_id", F.explode(fn.function_names(fn.tokens(F.col("sql_text")))).alias("name"))


#: Names that a list of functions may hold; it is collected and becomes part of the projection.
MOST_NAMES = 20_000


def names_of(functions: DataFrame) -> list[str]:
    rows = functions.select("name").distinct().limit(MOST_NAMES + 1).collect()
    if len(rows) > MOST_NAMES:
        raise ValueError(f"more than {MOST_NAMES} function names")
    return [r["name"] for r in rows]


def with_read_verdict(log: DataFrame, allowed: DataFrame) -> DataFrame:
    """is_read and reason. ``allowed`` has a column name: bare functions a read may call; qualified names never match."""
    sql, names = F.col("sql_text"), names_of(allowed)
    rows = log.withColumn("_v", fn.let(fn.tokens(sql), lambda ts: fn.read_verdict(sql, ts, names)))
    return rows.select(*log.columns, "_v.is_read", "_v.reason")


def with_volatility(log: DataFrame, catalog: DataFrame) -> DataFrame:
    """Whether a statement's WHERE may be run twice. ``catalog``: name, volatility (immutable, stable, volatile). A text that holds
    nothing but what can't be cut into tokens is not deterministic."""
    steady = names_of(catalog.groupBy("name").agg(F.bool_and(F.col("volatility") != "volatile").alias("s")).filter("s"))
    rows = log.withColumn("volatility", fn.let(fn.tokens(F.col("sql_text")), lambda ts: fn.volatility(ts, steady)))
    return rows.select(*log.columns, "volatility", F.col("volatility").isNull().alias("deterministic"))


def with_plan_estimate(plans: DataFrame, line: str = "plan_line") -> DataFrame:
    rows = plans.withColumn("_e", fn.plan_estimate(F.col(line)))
    return rows.select(*plans.columns, "_e.total_cost", F.col("_e.rows").alias("plan_rows"))


def gate_plans(plans: DataFrame, policy: DataFrame) -> DataFrame:
    """Null where a plan passes; ceilings count inclusively, cost before rows; roles without a policy are refused."""
    rows = with_caps(with_plan_estimate(plans), policy, ["max_plan_cost", "max_plan_rows"])
    code = (
        F.when(~F.col("known_role"), "unknown_role")
        .when(F.col("total_cost").isNull(), "explain_failed")
        .when(F.col("total_cost") > F.col("max_plan_cost"), "explain_cost_exceeded")
        .when(F.col("plan_rows") > F.col("max_plan_rows"), "explain_rows_exceeded")
    )
    return rows.withColumn("refused", code).select(*plans.columns, "total_cost", "plan_rows", "refused")


def gate_relations(log: DataFrame, policy: DataFrame) -> DataFrame:
    """P10: allowed only if every relation of the statement is on its role's list; an unknown role, an empty list or a statement without relations allows nothing."""
    listed = policy.groupBy("role").agg(F.array_distinct(F.flatten(F.collect_list("select_whitelist"))).alias("_listed"))
    over = F.size(F.array_except("relations", "_listed")) > 0
    return log.join(listed, "role", "left").select(*log.columns, F.coalesce((F.size("relations") > 0) & ~over, F.lit(False)).alias("allowed"))


def certify(requests: DataFrame) -> DataFrame:
    """The closed list of writes that can be certified; null where one is. Columns: kind, has_pk, has_preimage, volatile_default."""
    kind = F.upper("kind")
    reason = (
        F.when(kind == "TRUNCATE", "TRUNCATE").when(kind == "DROP", "DROP").when(kind == "ALTER", "ALTER")
        .when(kind.isin("INSERT", "UPDATE", "DELETE") & ~F.col("has_pk"), "PkLessTable")
        .when((kind == "INSERT") & F.col("volatile_default"), "VolatileDefaultInsert")
        .when((kind == "DELETE") & ~F.col("has_preimage"), "DeleteWithoutPreimage")
        .when((kind == "INSERT") | kind.isin("UPDATE", "DELETE") & F.col("has_preimage"), F.lit(None))
        .otherwise("NotCertified")
    )
    return requests.withColumn("refused", reason)


def with_expiry(proposals: DataFrame, now_ms: int) -> DataFrame:
    """Expired once now - created reaches the ttl; the time left stops at 0."""
    age = F.lit(now_ms) - F.col("created_ms")
    return proposals.withColumn("expired", age >= F.col("ttl_ms")).withColumn("remaining_ms", F.greatest(F.col("ttl_ms") - age, F.lit(0)))


def check_confirm(requests: DataFrame, totals: DataFrame) -> DataFrame:
    """A confirmation must name the rehearsal's number of rows and, where it has a token, ct-<proposal>-<rows>."""
    rows = requests.join(totals.select("proposal_id", "total_rows"), "proposal_id")
    token = F.concat(F.lit("ct-"), F.col("proposal_id"), F.lit("-"), F.col("total_rows").cast("string"))
    reason = F.when(F.col("confirm_rows") != F.col("total_rows"), "ROWS_DIFFER").when(F.col("confirm_token").isNotNull() & (F.col("confirm_token") != token), "TOKEN_DIFFERS")
    return rows.withColumn("refused", reason)


def max_ranked(df: DataFrame, by: list[str], column: str, order: list[str]) -> DataFrame:
    """The highest label of an ordered enumeration in each group."""
    return df.groupBy(*by).agg(label(F.max(rank(column, order)), order).alias(column))


def combine_verdicts(signals: DataFrame, floors: DataFrame) -> DataFrame:
    """The tightest verdict of each action with its reason (the first by text among equals), tightened to the floor where that is tighter."""
    best = signals.withColumn("_r", rank("verdict", VERDICTS)).groupBy("action").agg(F.max(F.struct(F.col("_r").alias("r"), (-F.col("signal_id")).alias("first"), "reason")).alias("b"))
    rows = best.select("action", F.col("b.r").alias("r"), F.col("b.reason").alias("reason")).join(floors.select("action", rank("floor", VERDICTS).alias("f")), "action", "left")
    loosened = F.coalesce(F.col("f"), F.lit(0)) > F.col("r")
    return rows.select("action", label(F.greatest("r", F.coalesce("f", F.lit(0))), VERDICTS).alias("verdict"), F.when(loosened, "clamped_to_floor").otherwise(F.col("reason")).alias("reason"))


def saturated(total: Column) -> Column:
    return F.least(total, F.lit(MOST).cast("decimal(38,0)")).cast("long")


def ceiling(event: str = "event_type") -> Column:
    """The rank of the highest trust that an event allows; unknown events allow the lowest."""
    table = F.create_map(*[F.lit(x) for pair in TRUST_CEILING.items() for x in pair])
    return rank(F.coalesce(table[F.col(event)], F.lit(TRUST[0])), TRUST)


def with_grants(events: DataFrame, grants: DataFrame) -> DataFrame:
    g = grants.select("session", rank("granted", TRUST).alias("_granted"))
    return events.join(g, "session", "left").withColumn("_granted", F.coalesce("_granted", F.lit(0)))


def multiplier(r: Column) -> Column:
    return F.get(F.lit([BUDGET_BP[t] for t in TRUST]), r)


def session_trust(events: DataFrame, grants: DataFrame) -> DataFrame:
    """Each session's trust (the least of its grant and its events' ceilings), budget and totals, which saturate."""
    rows = with_grants(events, grants).groupBy("session").agg(
        F.least(F.min("_granted"), F.min(ceiling())).alias("r"), F.sum(F.col("rows").cast("decimal(38,0)")).alias("rows"), F.sum(F.col("bytes").cast("decimal(38,0)")).alias("bytes")
    )
    return rows.select("session", label(F.col("r"), TRUST).alias("trust"), multiplier(F.col("r")).alias("budget_bp"), saturated(F.col("rows")).alias("rows"), saturated(F.col("bytes")).alias("bytes"))


def trust_timeline(events: DataFrame, grants: DataFrame, span: int = SPAN) -> DataFrame:
    """Trust, which never rises, and totals after each event; a task holds a session's events of ``span`` milliseconds."""
    sums = {f"_{c}": F.col(c).cast("decimal(38,0)") for c in ("rows", "bytes")}
    rows = with_running(with_grants(events, grants), ["session"], ["ts_ms", "event_id"], span, sums, {"_ceiling": ceiling()})
    return rows.select("session", "event_id", label(F.least("_granted", "_ceiling"), TRUST).alias("trust"), *[saturated(F.col(f"_{c}")).alias(c) for c in ("rows", "bytes")])


def session_steps(log: DataFrame, page: int = 1_000, span: int = SPAN) -> DataFrame:
    """A17, steps of sessions of any size: session, page, and that page's statement classes in order; ``page`` statements each. Places
    are counted within spans of time and carried on, so neither a task nor a row holds a whole session."""
    rows = with_running(log.select("session", "ts_ms", "log_id", "statement_class"), ["session"], ["ts_ms", "log_id"], span, {"_place": F.lit(1).cast("long")})
    rows = rows.withColumn("page", F.floor((F.col("_place") - 1) / page).cast("long"))
    steps = F.transform(F.array_sort(F.collect_list(F.struct("_place", "statement_class"))), lambda s: s["statement_class"])
    return rows.groupBy("session", "page").agg(steps.alias("steps"))


def session_tables(log: DataFrame) -> DataFrame:
    """A17, tables: a row for each relation that a session names, and how many of its statements do."""
    return log.select("session", F.explode(F.array_distinct("relations")).alias("relation")).groupBy("session", "relation").agg(F.count(F.lit(1)).alias("statements"))


def session_summary(log: DataFrame) -> DataFrame:
    """A17, numbers: statements, reads before the first write (all reads if none), and statements for each minute of the session, which
    counts as one minute at least. One row for each session joins its first write back; rows of a session are spread over copies of it."""
    place = F.struct("ts_ms", "log_id")
    writes = log.groupBy(F.col("session").alias("_session")).agg(F.min(F.when(~F.col("is_read"), place)).alias("_w")).withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salt = F.pmod(F.xxhash64("log_id"), F.lit(SALTS)).cast("int")
    rows = log.withColumn("_salt", salt).join(writes, F.col("session").eqNullSafe(F.col("_session")) & (F.col("_salt") == F.col("_s")))
    return rows.groupBy("session").agg(
        F.count(F.lit(1)).alias("statements"),
        F.count_if(F.col("is_read") & (F.col("_w").isNull() | (place < F.col("_w")))).alias("reads_before_write"),
        (F.count(F.lit(1)) / F.greatest((F.max("ts_ms") - F.min("ts_ms")) / 60_000, F.lit(1.0))).alias("rate_per_min"),
    )


def session_context(log: DataFrame) -> DataFrame:
    """A17 with each session in one row: its steps in order and its tables as arrays, beside the numbers of ``session_summary``. For
    sessions that fit in a row; ``session_steps`` and ``session_tables`` hold the others."""
    arrays = log.groupBy(F.col("session").alias("_name")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("ts_ms", "log_id", "statement_class"))), lambda s: s["statement_class"]).alias("steps"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("relations")))).alias("tables"),
    )
    return session_summary(log).join(arrays, F.col("session").eqNullSafe(F.col("_name"))).select("session", "steps", "tables", "reads_before_write", "rate_per_min")
