"""Queries over bulk writes and snapshots: customer, orders and lineitem, with a second version of orders."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import snapshot
from ..plans import writes
from ..plans.writes import Catalog, ForeignKey, Write
from ..sources import versions
from ..sources.shared import shared_folder
from .base import table

CATALOG = Catalog(
    keys={"region": ("r_regionkey",), "nation": ("n_nationkey",), "customer": ("c_custkey",), "orders": ("o_orderkey",), "supplier": ("s_suppkey",), "part": ("p_partkey",)},
    foreign_keys=(
        ForeignKey("nation", ("n_regionkey",), "region"), ForeignKey("customer", ("c_nationkey",), "nation"), ForeignKey("supplier", ("s_nationkey",), "nation"),
        ForeignKey("orders", ("o_custkey",), "customer"), ForeignKey("lineitem", ("l_orderkey",), "orders"),
    ),
)
#: The same with items that have a key: lineitem repeats (l_orderkey, l_linenumber), so a delete that cascades to it is refused.
KEYED = Catalog(
    keys={"customer": ("c_custkey",), "orders": ("o_orderkey",), "items": ("l_orderkey", "l_linenumber")},
    foreign_keys=(ForeignKey("orders", ("o_custkey",), "customer"), ForeignKey("items", ("l_orderkey",), "orders")),
)
DELETE = Write("DELETE", "customer", "c_custkey % 97 = 0")
UPDATE = Write("UPDATE", "orders", "o_orderkey % 101 = 0", {"o_orderstatus": "'X'", "o_totalprice": "o_totalprice + 1"})
GONE, HIT = "c_custkey % 97 = 0", "o_orderkey % 101 = 0"
COLUMNS = {"customer": ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"], "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"], "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag"]}


def tables(spark: SparkSession, folder: str, *names: str) -> dict[str, DataFrame]:
    """The columns that both engines print alike; prices as whole cents."""
    out = {}
    for n in names or ("customer", "orders", "lineitem"):
        df = table(spark, folder, n)
        df = df.withColumn("o_totalprice", F.round(F.col("o_totalprice") * 100).cast("long")) if n == "orders" else df
        out[n] = df.select(COLUMNS[n]) if n in COLUMNS else df
    return out


def second(orders: DataFrame) -> DataFrame:
    """A later version of orders: some changed, some dropped, some added."""
    k = F.col("o_orderkey")
    kept = orders.filter(k % 101 != 0).withColumn("o_orderstatus", F.when(k % 97 == 0, "Z").otherwise(F.col("o_orderstatus"))).withColumn("o_totalprice", F.when(k % 89 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    return kept.unionByName(orders.filter(k % 103 == 0).withColumn("o_orderkey", -k - 1))


def blast(spark: SparkSession, folder: str) -> DataFrame:
    return writes.rehearse(tables(spark, folder), CATALOG, DELETE)


def counts_of(named: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in named.items():
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("relation"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def deep(spark: SparkSession, folder: str) -> DataFrame:
    t = tables(spark, folder, "region", "nation", "customer", "supplier", "orders", "lineitem")
    return counts_of(writes.cascade_closure(t, CATALOG, "nation", "n_nationkey % 5 = 0"))


def effects(spark: SparkSession, folder: str) -> DataFrame:
    """What a changed world would do instead: more customers, and a relation that nobody predicted."""
    t = tables(spark, folder)
    more = writes.rehearse(t, CATALOG, Write("DELETE", "customer", "c_custkey % 48 = 0"))
    extra = t["customer"].filter("c_custkey % 50 = 0").agg(F.count(F.lit(1)).alias("ins")).select(F.lit("mirror").alias("relation"), "ins")
    return more.select("relation", "ins", "upd", "del", "changed_bytes").unionByName(extra.withColumns({"upd": F.lit(0).cast("long"), "del": F.lit(0).cast("long"), "changed_bytes": F.lit(0).cast("long")}))


def captured(spark: SparkSession, folder: str) -> DataFrame:
    images = writes.build_inverse(tables(spark, folder), CATALOG, DELETE)[1]
    return counts_of(images).select("relation", (F.col("n") - F.when(F.col("relation") == "orders", 3).otherwise(0)).alias("captured"))


def after_delete(spark: SparkSession, folder: str) -> DataFrame:
    return counts_of(writes.apply_delete(tables(spark, folder), CATALOG, "customer", GONE))


def reverted_update(spark: SparkSession, folder: str) -> DataFrame:
    orders = tables(spark, folder, "orders")["orders"]
    image = writes.capture_preimage(orders, HIT, ["o_orderkey"], UPDATE.assignments)
    return writes.revert_update(writes.apply_update(orders, HIT, UPDATE.assignments, ["o_orderkey"]), image, ["o_orderkey"])


def reverted_delete(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    t = tables(spark, folder)
    images = writes.build_inverse(t, CATALOG, DELETE)[1]
    return writes.revert_delete(writes.apply_delete(t, CATALOG, "customer", GONE), images, list(images))


def fingerprints(named: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in named.items():
        one = snapshot.fingerprint(df, name)
        out = one if out is None else out.unionByName(one)
    return out


def mixed(spark: SparkSession, folder: str) -> DataFrame:
    """Pre-images of several relations in one table, some of a relation outside the plan, some empty."""
    images = writes.build_inverse(tables(spark, folder), CATALOG, DELETE)[1]
    rows = None
    for name, df in images.items():
        relation = F.when(F.lit(name) == "customer", F.lit(None)).when(F.pmod(F.xxhash64("text"), F.lit(1)) == 1, "x").otherwise(F.lit(name))
        one = df.select(F.to_json("before").alias("text")).select(relation.cast("string").alias("__relation"), "text")
        rows = one if rows is None else rows.unionByName(one)
    odd = tables(spark, folder, "orders")["orders"].filter("o_orderkey % 1000 = 0")
    rows = rows.unionByName(odd.select(F.lit("ghost").alias("__relation"), F.lit("{}").alias("text"))).unionByName(odd.select(F.lit("orders").alias("__relation"), F.lit(None).cast("string").alias("text")))
    return rows.withColumnRenamed("text", "before")


def plan(spark: SparkSession, folder: str) -> DataFrame:
    return writes.build_inverse(tables(spark, folder), CATALOG, DELETE)[0]


def keyed_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    t = tables(spark, folder)
    items = t.pop("lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n"), F.min("l_partkey").alias("l_partkey"), F.max("l_suppkey").alias("l_suppkey"))
    return t | {"items": versions.scratch(items)}  # a stored table, as the others are


def applied(spark: SparkSession, folder: str, write: Write) -> DataFrame:
    """Rehearsed, approved with the suggested cap, applied and read back: the published tables' fingerprints."""
    t = keyed_tables(spark, folder)
    b = versions.scratch(writes.rehearse(t, KEYED, write))  # what was approved stays what it was
    base = f"{shared_folder(spark)}/write-{uuid.uuid4().hex}"
    writes.guarded_apply(t, KEYED, write, b, writes.suggest_cap(b, 0.1), base)
    return fingerprints({name: spark.read.parquet(path) for name, path in sorted(versions.current(spark, base).items())})


def refused(spark: SparkSession, folder: str) -> DataFrame:
    """Why the delete that cascades to rows without a key may not go on."""
    t, b = tables(spark, folder), blast(spark, folder)
    try:
        writes.guarded_apply(t, CATALOG, DELETE, b, writes.suggest_cap(b, 0.1), f"{shared_folder(spark)}/write-{uuid.uuid4().hex}")
        reason = None
    except writes.Refused as e:
        reason = e.args[0]
    return writes.footprint(b).select(F.lit(reason).cast("string").alias("refused"), "total_rows")


#: Predicates on orders, and what the guard says of each.
PREDICATES = {
    "o_orderkey % 97 = 0": None, "": "NO_PREDICATE", "1 = 1": "NO_KEY_COLUMN", "o_orderkey < 900 AND o_orderstatus = 'O'": "NON_KEY_COLUMN", "o_orderkey > rand() * 100": "NOT_DETERMINISTIC",
    "o_orderkey BETWEEN 5 AND 700": None, "o_orderkey IN (1, 2, 3)": None, "o_orderkey > unix_timestamp(current_timestamp())": "NOT_DETERMINISTIC",
}


def guarded_predicates(spark: SparkSession, folder: str) -> DataFrame:
    """Each predicate, the guard's answer, and how many rows the ones that pass would touch."""
    orders = tables(spark, folder, "orders")["orders"]
    out = None
    for p in PREDICATES:
        reason = writes.guard_predicate(orders, p, KEY)
        n = orders.filter(writes.holds(p)) if reason is None else orders.limit(0)
        one = n.agg(F.count(F.lit(1)).alias("n")).select(F.lit(p).alias("predicate"), F.lit(reason).cast("string").alias("refused"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def constraints(spark: SparkSession, folder: str) -> DataFrame:
    """Orders of which some parents are gone and some keys come twice."""
    t = tables(spark, folder)
    t["orders"] = t["orders"].unionByName(t["orders"].filter("o_orderkey % 500 = 0")).withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderstatus")))
    t["customer"] = t["customer"].filter("c_custkey % 13 <> 0")
    return writes.check_constraints({n: t[n] for n in ("customer", "orders")}, CATALOG, {"orders": ["o_orderstatus"]})


ORDERS = "SELECT o_orderkey, o_custkey, o_orderstatus, CAST(round(o_totalprice * 100) AS BIGINT) AS o_totalprice, o_orderpriority FROM orders"
BASE = f"""WITH o AS ({ORDERS}), c AS (SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM customer), l AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_returnflag FROM lineitem),
gc AS (SELECT * FROM c WHERE {GONE}), go AS (SELECT * FROM o WHERE o_custkey IN (SELECT c_custkey FROM gc)), gl AS (SELECT * FROM l WHERE l_orderkey IN (SELECT o_orderkey FROM go)),
o2 AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 97 = 0 THEN 'Z' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderkey % 89 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice, o_orderpriority FROM o WHERE o_orderkey % 101 <> 0
  UNION ALL SELECT -o_orderkey - 1, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM o WHERE o_orderkey % 103 = 0),
uo AS (SELECT o_orderkey, o_custkey, CASE WHEN {HIT} THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN {HIT} THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice, o_orderpriority FROM o)"""


def size(*columns: str) -> str:
    return " + ".join(f"coalesce(strlen(CAST({c} AS VARCHAR)), 0)" for c in columns)


def digest(rows: str, *keys: str) -> str:
    enc = " || ".join(f"'I' || length(CAST({k} AS VARCHAR)) || ':' || {k}" for k in keys)
    return f"(SELECT sha256(coalesce(string_agg(d, '' ORDER BY b), '') || '#' || CAST(coalesce(sum(n), 0) AS VARCHAR)) FROM (SELECT s[1:3] AS b, sha256(string_agg(d, '' ORDER BY s)) AS d, sum(n) AS n FROM (SELECT h[1:6] AS s, sha256(string_agg(h || '*' || n, '' ORDER BY h || '*' || n)) AS d, sum(n) AS n FROM (SELECT sha256({enc}) AS h, count(*) AS n FROM {rows} GROUP BY h) GROUP BY s) GROUP BY b))"


def print_of(rows: str, name: str, *columns: str) -> str:
    text = " || '|' || ".join(f"coalesce('=' || regexp_replace(CAST({c} AS VARCHAR), '([\\\\|])', '\\\\\\1', 'g'), '~')" for c in columns)
    return f"SELECT '{name}' AS relation, md5(coalesce(string_agg(d, ',' ORDER BY p), '')) AS digest, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_rows FROM (SELECT s[1:3] AS p, md5(string_agg(d, ',' ORDER BY s)) AS d, sum(n) AS n FROM (SELECT h[1:6] AS s, md5(string_agg(h || 'x' || n, ',' ORDER BY h || 'x' || n)) AS d, sum(n) AS n FROM (SELECT md5({text}) AS h, count(*) AS n FROM {rows} GROUP BY h) GROUP BY s) GROUP BY p)"


C, O, LI = COLUMNS["customer"], COLUMNS["orders"], COLUMNS["lineitem"]
BLAST = (
    BASE
    + f""", blast AS (
  SELECT 'customer' AS relation, true AS is_target, count(*) AS n, {digest("gc", "c_custkey")} AS pk_digest, CAST(sum({size(*C)}) AS BIGINT) AS changed_bytes, true AS keyed FROM gc
  UNION ALL SELECT 'orders', false, count(*), {digest("go", "o_orderkey")}, CAST(sum({size(*O)}) AS BIGINT), true FROM go
  UNION ALL SELECT 'lineitem', false, count(*), NULL, CAST(sum({size(*LI)}) AS BIGINT), false FROM gl)"""
)
MORE = BLAST.replace("WITH o AS", "WITH RECURSIVE o AS") + """, mc AS (SELECT c_custkey FROM c WHERE c_custkey % 48 = 0), mo AS (SELECT o_orderkey FROM o WHERE o_custkey IN (SELECT c_custkey FROM mc)),
more AS (SELECT 'customer' AS relation, 0 AS ins, count(*) AS del FROM mc UNION ALL SELECT 'orders', 0, count(*) FROM mo UNION ALL SELECT 'lineitem', 0, count(*) FROM l WHERE l_orderkey IN (SELECT o_orderkey FROM mo)
  UNION ALL SELECT 'mirror', count(*), 0 FROM c WHERE c_custkey % 50 = 0)"""  # fmt: skip
DIFF = (
    BASE
    + """, d AS (SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN a.o_orderkey IS NULL THEN 'INSERT' WHEN b.o_orderkey IS NULL THEN 'DELETE'
  WHEN a.o_custkey IS DISTINCT FROM b.o_custkey OR a.o_orderstatus IS DISTINCT FROM b.o_orderstatus OR a.o_totalprice IS DISTINCT FROM b.o_totalprice OR a.o_orderpriority IS DISTINCT FROM b.o_orderpriority THEN 'UPDATE' ELSE 'SAME' END AS change,
  CASE WHEN a.o_orderkey IS NULL OR b.o_orderkey IS NULL THEN '' ELSE concat_ws(',', CASE WHEN a.o_custkey IS DISTINCT FROM b.o_custkey THEN 'o_custkey' END, CASE WHEN a.o_orderstatus IS DISTINCT FROM b.o_orderstatus THEN 'o_orderstatus' END,
  CASE WHEN a.o_totalprice IS DISTINCT FROM b.o_totalprice THEN 'o_totalprice' END, CASE WHEN a.o_orderpriority IS DISTINCT FROM b.o_orderpriority THEN 'o_orderpriority' END) END AS changed
  FROM o a FULL JOIN o2 b ON a.o_orderkey = b.o_orderkey)"""
)


def two(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    orders = tables(spark, folder, "orders")["orders"]
    return orders, second(orders)


KEY = ["o_orderkey"]
QUERIES = {
    "d1_affected": lambda s, d: writes.affected(tables(s, d, "customer")["customer"], GONE, ["c_custkey"]),
    "d2_guard_predicate": guarded_predicates,
    "d3_apply_update": lambda s, d: writes.apply_update(tables(s, d, "orders")["orders"], HIT, UPDATE.assignments, KEY),
    "d4_apply_delete": after_delete,
    "d5_capture_preimage": lambda s, d: writes.capture_preimage(tables(s, d, "orders")["orders"], HIT, KEY, ["o_orderstatus", "o_totalprice"]).select("o_orderkey", "before.*"),
    "d6_rehearse_delete": lambda s, d: blast(s, d).drop("ins", "upd", "inverse_kind").withColumnRenamed("del", "n"),
    "d7_suggest_cap": lambda s, d: writes.suggest_cap(blast(s, d), 0.25),
    "d8_footprint": lambda s, d: writes.footprint(blast(s, d)),
    "d9_check_cap": lambda s, d: writes.check_cap(blast(s, d), effects(s, d), writes.suggest_cap(blast(s, d), 0.25)),
    "d10_reconcile": lambda s, d: writes.reconcile(blast(s, d), effects(s, d), "customer", "DELETE"),
    "d11_row_coverage": lambda s, d: writes.check_row_coverage(blast(s, d), captured(s, d), "customer"),
    "d12_column_coverage": lambda s, d: writes.check_column_coverage(
        tables(s, d, "orders")["orders"].filter(HIT).select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, F.array(F.lit("o_orderstatus"))).otherwise(F.array(F.lit("o_orderstatus"), F.lit("o_totalprice"))).alias("columns")), UPDATE.assignments, KEY
    ).select("o_orderkey", F.array_join("missing", ",").alias("missing")),
    "d13_guarded_delete": lambda s, d: applied(s, d, DELETE),
    "d13_guarded_update": lambda s, d: applied(s, d, UPDATE),
    "d13_refused_delete": refused,
    "d14_check_blast": lambda s, d: writes.check_blast(blast(s, d), "customer"),
    "d15_inverse_rows": captured,
    "d16_revert_update": reverted_update,
    "d17_revert_delete": lambda s, d: fingerprints(reverted_delete(s, d)),
    "d18_route_preimages": lambda s, d: writes.route_preimages(mixed(s, d), plan(s, d), "customer").groupBy("relation", "refused").agg(F.count(F.lit(1)).alias("n")),
    "d19_revert_report": lambda s, d: writes.revert_report(writes.route_preimages(mixed(s, d), plan(s, d), "customer").filter("refused IS NULL"), plan(s, d)),
    "d20_constraints": constraints,
    "j1_cascade_rows": lambda s, d: writes.cascade_rows(tables(s, d)["customer"].filter(GONE).select("c_custkey"), tables(s, d)["orders"], ["o_custkey"], ["c_custkey"]),
    "j2_cascade_closure": deep,
    "j3_missing_preimages": lambda s, d: writes.missing_preimages(tables(s, d)["orders"].filter(HIT).select("o_orderkey"), tables(s, d)["orders"].filter(f"{HIT} AND o_orderkey % 2 = 0"), KEY),
    "j7_orphans": lambda s, d: writes.orphans(tables(s, d)["orders"], tables(s, d)["customer"].filter("c_custkey % 13 <> 0"), ["o_custkey"], ["c_custkey"]).select("o_orderkey"),
    "a11_pk_checksum": lambda s, d: writes.pk_checksum(tables(s, d)["orders"], KEY),
    "a12_check_pk": lambda s, d: writes.check_pk(tables(s, d)["lineitem"], ["l_orderkey", "l_linenumber"]),
    "a13_drift": lambda s, d: writes.drift(*two(s, d), KEY),
    "a13_drift_rows": lambda s, d: writes.drift_rows(*two(s, d), KEY),
    "l3_blast_report": lambda s, d: writes.blast_report(blast(s, d)),
    "e1_parity": lambda s, d: snapshot.is_parity(*two(s, d)),
    "e1_parity_rows": lambda s, d: snapshot.parity(*two(s, d)).select("o_orderkey", "side"),
    "e2_fingerprint": lambda s, d: fingerprints(tables(s, d)),
    "e3_restore_verdict": lambda s, d: snapshot.restore_verdict(fingerprints(tables(s, d)), fingerprints(tables(s, d) | {"orders": two(s, d)[1]})),
    "e4_snapshot_diff": lambda s, d: snapshot.snapshot_diff(*two(s, d), KEY).select("o_orderkey", "change", F.array_join("changed", ",").alias("changed")),
    "e4_changed_rows": lambda s, d: snapshot.changed_rows(*two(s, d), KEY).select("o_orderkey", "change", F.array_join("changed", ",").alias("changed")),
    "e5_counted_changes": lambda s, d: snapshot.counted_changes(*two(s, d), KEY, two(s, d)[0].filter("o_orderkey % 3 = 0"), "orders"),
    "e5_op_counts": lambda s, d: snapshot.op_counts(snapshot.snapshot_diff(*two(s, d), KEY), "orders"),
    "e6_staleness": lambda s, d: snapshot.staleness(two(s, d)[0].filter("o_orderkey % 10 < 7"), two(s, d)[0], "o_orderkey", 2),
}
ORACLES = {
    "d1_affected": f"SELECT c_custkey FROM customer WHERE {GONE}",
    "d3_apply_update": BASE + " SELECT * FROM uo",
    "d4_apply_delete": BASE + " SELECT 'customer' AS relation, (SELECT count(*) FROM c) - (SELECT count(*) FROM gc) AS n UNION ALL SELECT 'orders', (SELECT count(*) FROM o) - (SELECT count(*) FROM go) UNION ALL SELECT 'lineitem', (SELECT count(*) FROM l) - (SELECT count(*) FROM gl)",
    "d5_capture_preimage": BASE + f" SELECT o_orderkey, o_orderstatus, o_totalprice FROM o WHERE {HIT}",
    "d6_rehearse_delete": BLAST + " SELECT * FROM blast",
    "d7_suggest_cap": BLAST + " SELECT CAST(greatest(sum(n), 1) + ceil(greatest(sum(n), 1) * 0.25 - 1e-9) AS BIGINT) AS max_rows, CAST(sum(changed_bytes) + ceil(sum(changed_bytes) * 0.25 - 1e-9) AS BIGINT) AS max_bytes FROM blast",
    "d8_footprint": BLAST + " SELECT CAST(sum(n) AS BIGINT) AS total_rows, CAST(sum(changed_bytes) AS BIGINT) AS total_bytes FROM blast",
    "d9_check_cap": MORE + ", f AS (SELECT CAST((SELECT sum(ins + del) FROM more) AS BIGINT) AS total_rows, CAST((SELECT greatest(sum(n), 1) + ceil(greatest(sum(n), 1) * 0.25 - 1e-9) FROM blast) AS BIGINT) AS max_rows) SELECT CASE WHEN total_rows > max_rows THEN 'ROWS_OVER_CAP' END AS refused, total_rows, max_rows FROM f",
    "d10_reconcile": MORE + " SELECT m.relation, CASE WHEN b.relation IS NULL AND m.ins + m.del > 0 THEN 'UnpredictedRelationWrite' WHEN m.relation <> 'customer' AND m.del > b.n THEN 'RelationOverWrite' END AS refused, CASE WHEN b.relation IS NOT NULL AND m.relation <> 'customer' AND m.del > b.n THEN 'del' END AS channel FROM more m LEFT JOIN blast b ON b.relation = m.relation",
    "d11_row_coverage": BLAST + " SELECT relation, n - 3 AS captured, 'IrreversibleChange' AS refused FROM blast WHERE relation = 'orders'",
    "d12_column_coverage": f"SELECT o_orderkey, 'o_totalprice' AS missing FROM orders WHERE {HIT} AND o_orderkey % 3 = 0",
    "d13_guarded_delete": BASE + f""", kc AS (SELECT * FROM c WHERE NOT ({GONE})), ko AS (SELECT * FROM o WHERE o_orderkey NOT IN (SELECT o_orderkey FROM go)), kl AS (SELECT l_orderkey, l_linenumber, count(*) AS n, min(l_partkey) AS l_partkey, max(l_suppkey) AS l_suppkey FROM l WHERE l_orderkey NOT IN (SELECT o_orderkey FROM go) GROUP BY l_orderkey, l_linenumber)
      {print_of("kc", "customer", *C)} UNION ALL {print_of("ko", "orders", *O)} UNION ALL {print_of("kl", "items", "l_orderkey", "l_linenumber", "n", "l_partkey", "l_suppkey")}""",
    "d13_refused_delete": BLAST + " SELECT 'CASCADE_NOT_KEYED' AS refused, CAST(sum(n) AS BIGINT) AS total_rows FROM blast",
    "d2_guard_predicate": " UNION ALL ".join(
        f"SELECT '{p.replace(chr(39), chr(39) * 2)}' AS predicate, {'NULL' if r is None else repr(r)} AS refused, (SELECT count(*) FROM orders WHERE {p if r is None else 'false'}) AS n" for p, r in PREDICATES.items()
    ),
    "d13_guarded_update": BASE + " " + print_of("uo", "orders", *O),
    "d14_check_blast": BLAST + " SELECT CASE WHEN bool_and(is_target OR keyed) THEN NULL ELSE 'CASCADE_NOT_KEYED' END AS refused, CAST(sum(n) AS BIGINT) AS total_rows FROM blast",
    "d15_inverse_rows": BLAST + " SELECT relation, n - CASE relation WHEN 'orders' THEN 3 ELSE 0 END AS captured FROM blast",
    "d16_revert_update": ORDERS,
    "d17_revert_delete": BASE + f" {print_of('c', 'customer', *C)} UNION ALL {print_of('o', 'orders', *O)} UNION ALL {print_of('l', 'lineitem', *LI)}",
    "d18_route_preimages": BLAST + " SELECT relation, NULL AS refused, n FROM blast UNION ALL SELECT 'ghost', 'MalformedInverse', count(*) FROM o WHERE o_orderkey % 1000 = 0 UNION ALL SELECT 'orders', 'MalformedRow', count(*) FROM o WHERE o_orderkey % 1000 = 0",
    "d19_revert_report": BLAST + " SELECT relation, CASE relation WHEN 'customer' THEN 0 WHEN 'orders' THEN 1 ELSE 2 END AS fk_order, n AS restored FROM blast",
    "d20_constraints": BASE + """ SELECT 'orders' AS relation, 'DUPLICATE_KEY' AS reason, count(*) AS n FROM o WHERE o_orderkey % 500 = 0 HAVING count(*) > 0
      UNION ALL SELECT 'orders', 'MISSING_PARENT', count(*) + count(*) FILTER (o_orderkey % 500 = 0) FROM o WHERE o_custkey % 13 = 0 HAVING count(*) > 0
      UNION ALL SELECT 'orders', 'NULL_o_orderstatus', count(*) + count(*) FILTER (o_orderkey % 500 = 0) FROM o WHERE o_orderkey % 7 = 0 HAVING count(*) > 0""",
    "j1_cascade_rows": BASE + " SELECT * FROM go",
    "j2_cascade_closure": """WITH n AS (SELECT * FROM nation WHERE n_nationkey % 5 = 0), c AS (SELECT * FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM n)), o AS (SELECT * FROM orders WHERE o_custkey IN (SELECT c_custkey FROM c))
      SELECT 'nation' AS relation, count(*) AS n FROM n UNION ALL SELECT 'customer', count(*) FROM c UNION ALL SELECT 'supplier', count(*) FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM n)
      UNION ALL SELECT 'orders', count(*) FROM o UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM o)""",
    "j3_missing_preimages": f"SELECT o_orderkey FROM orders WHERE {HIT} AND o_orderkey % 2 <> 0",
    "j7_orphans": "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 13 <> 0)",
    "a11_pk_checksum": f"SELECT {digest('orders', 'o_orderkey')} AS digest, (SELECT count(*) FROM orders) AS n",
    "a12_check_pk": "SELECT CASE WHEN count(*) FILTER (n > 1) > 0 THEN 'DUPLICATE_KEY' END AS reason, CASE WHEN count(*) FILTER (n > 1) > 0 THEN count(*) FILTER (n > 1) ELSE count(*) END AS n FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)",
    "a13_drift": BASE + " SELECT CASE WHEN (SELECT list(o_orderkey ORDER BY o_orderkey) FROM o) = (SELECT list(o_orderkey ORDER BY o_orderkey) FROM o2) THEN 'PROCEED' ELSE 'ABORT' END AS decision, (SELECT count(*) FROM o) AS n_before, (SELECT count(*) FROM o2) AS n_after",
    "a13_drift_rows": BASE + " SELECT o_orderkey, 'LEFT' AS change FROM o WHERE o_orderkey NOT IN (SELECT o_orderkey FROM o2) UNION ALL SELECT o_orderkey, 'CAME' FROM o2 WHERE o_orderkey NOT IN (SELECT o_orderkey FROM o)",
    "l3_blast_report": BLAST + """ SELECT '{' || string_agg('"' || relation || '":{"ins":0,"upd":0,"del":' || n || '}', ',' ORDER BY relation) || '}' AS effect_by_table, CAST(sum(n) AS BIGINT) AS total_rows FROM blast""",
    "e1_parity": BASE + ", m AS (SELECT * FROM o EXCEPT SELECT * FROM o2), x AS (SELECT * FROM o2 EXCEPT SELECT * FROM o) SELECT (SELECT count(*) FROM m) AS missing, (SELECT count(*) FROM x) AS extra, (SELECT count(*) FROM m) + (SELECT count(*) FROM x) = 0 AS is_parity",
    "e1_parity_rows": BASE + ", m AS (SELECT * FROM o EXCEPT SELECT * FROM o2), x AS (SELECT * FROM o2 EXCEPT SELECT * FROM o) SELECT o_orderkey, 'missing' AS side FROM m UNION ALL SELECT o_orderkey, 'extra' FROM x",
    "e2_fingerprint": BASE + f" {print_of('c', 'customer', *C)} UNION ALL {print_of('o', 'orders', *O)} UNION ALL {print_of('l', 'lineitem', *LI)}",
    "e3_restore_verdict": "SELECT * FROM (VALUES ('customer', true), ('orders', false), ('lineitem', true)) AS v(relation, restored)",
    "e4_snapshot_diff": DIFF + " SELECT * FROM d",
    "e4_changed_rows": DIFF + " SELECT * FROM d WHERE change <> 'SAME'",
    "e5_counted_changes": DIFF + " SELECT 'orders' AS relation, count(*) FILTER (change = 'INSERT') AS ins, count(*) FILTER (change = 'UPDATE') AS upd, count(*) FILTER (change = 'DELETE') AS del FROM d",
    "e5_op_counts": DIFF + " SELECT 'orders' AS relation, count(*) FILTER (change = 'INSERT') AS ins, count(*) FILTER (change = 'UPDATE') AS upd, count(*) FILTER (change = 'DELETE') AS del FROM d",
    "e6_staleness": "SELECT (SELECT max(o_orderkey) FROM orders) - (SELECT max(o_orderkey) FROM orders WHERE o_orderkey % 10 < 7) AS lag, (SELECT max(o_orderkey) FROM orders) - (SELECT max(o_orderkey) FROM orders WHERE o_orderkey % 10 < 7) > 2 AS rejected",
}
