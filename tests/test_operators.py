"""Cases that tables do not show: refusals, mutations of each guard, edges, streams in several batches, sources and sinks."""

import itertools
import json

from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from ledgerline.functions.encode import digest_of_set
from ledgerline.functions.folds import folded, with_running
from ledgerline.operators import audit, logs, meter, scoring, snapshot, watch
from ledgerline.plans import writes
from ledgerline.plans.writes import Catalog, ForeignKey, Refused, Write
from ledgerline.schemas import CHAIN, GENESIS, LOCKS, TRUST, TRUST_CEILING
from ledgerline.sources import tables as sources
from ledgerline.sources import versions
from ledgerline.streaming import meter as stream
from ledgerline.streaming import watch as live

CATALOG = Catalog({"accounts": ("id",), "entries": ("account_id", "line_no")}, (ForeignKey("entries", ("account_id",), "accounts"),))


@pytest.fixture()
def bank(spark):
    accounts = spark.createDataFrame([(i, f"o{i}" if i != 3 else None, i * 1000) for i in range(1, 9)], "id int, owner string, balance long")
    entries = spark.createDataFrame([(i, j, f"m{j}", 5) for i in range(1, 9) for j in (1, 2)], "account_id int, line_no int, memo string, amount long")
    return {"accounts": accounts, "entries": entries}


@pytest.mark.parametrize(
    ("predicate", "reason"),
    [
        ("id = 3", None), ("id IN (1, 2)", None), ("id BETWEEN 2 AND 4", None), ("id % 2 = 0 AND abs(id) > 1", None), (None, "NO_PREDICATE"), ("  ", "NO_PREDICATE"), ("true", "NO_KEY_COLUMN"),
        ("balance > 10", "NON_KEY_COLUMN"), ("id > rand()", "NOT_DETERMINISTIC"), ("id < day(current_date())", "NOT_DETERMINISTIC"), ("id > 1 AND current_user() = 'x'", "NOT_DETERMINISTIC"), ("now() > timestamp'2020-01-01' AND id = 1", "NOT_DETERMINISTIC"),
    ],
)
def test_guard_predicate(bank, predicate, reason):
    assert writes.guard_predicate(bank["accounts"], predicate, ["id"]) == reason


def test_guard_refuses_subqueries_and_user_functions(spark, bank):
    bank["entries"].createOrReplaceTempView("e")
    for p in ("id IN (SELECT account_id FROM e)", "EXISTS (SELECT 1 FROM e WHERE account_id = id)", "id = (SELECT max(account_id) FROM e)"):
        assert writes.guard_predicate(bank["accounts"], p, ["id"]) == "SUBQUERY"
    spark.udf.register("own", lambda x: x, "int")
    assert writes.guard_predicate(bank["accounts"], "own(id) = 1", ["id"]) == "NOT_DETERMINISTIC"


def apply(bank, write, tmp_path, blast=None, cap=None):
    b = blast if blast is not None else writes.rehearse(bank, CATALOG, write)
    return writes.guarded_apply(bank, CATALOG, write, b, cap if cap is not None else writes.suggest_cap(b, 0.0), str(tmp_path / "base"))


@pytest.mark.parametrize("write", [Write("DELETE", "accounts", "id <= 3"), Write("UPDATE", "accounts", "id <= 3", {"owner": "'x'", "balance": "balance + 1"})])
def test_apply_then_revert_restores_the_fingerprint(spark, bank, tmp_path, write):
    before = {n: snapshot.fingerprint(t, n).first()["digest"] for n, t in bank.items()}
    plan, images = writes.build_inverse(bank, CATALOG, write)
    paths = apply(bank, write, tmp_path)
    now = bank | {n: spark.read.parquet(p) for n, p in paths.items()}
    assert any(snapshot.fingerprint(now[n], n).first()["digest"] != before[n] for n in now)
    order = [r["relation"] for r in plan.orderBy("fk_order").collect()]
    if write.kind == "DELETE":
        back = now | writes.revert_delete(now, images, order)
        assert writes.check_restored(back, CATALOG, order).count() == 0
        again = back | writes.revert_delete(back, images, order)  # a second revert collides
        assert {r["reason"] for r in writes.check_restored(again, CATALOG, order).collect()} == {"DUPLICATE_KEY"}
    else:
        back = now | {"accounts": writes.revert_update(now["accounts"], images["accounts"], ["id"])}
        assert back["accounts"].filter("id = 3").first()["owner"] is None  # a null comes back as a null
    assert {n: snapshot.fingerprint(t, n).first()["digest"] for n, t in back.items()} == before


def test_each_guard_stops_the_write(spark, bank, tmp_path):
    write = Write("DELETE", "accounts", "id <= 3")
    blast = writes.rehearse(bank, CATALOG, write)
    cap = writes.suggest_cap(blast, 0.0)
    none = blast.limit(0)
    cases = {
        "NO_BLAST_RADIUS": (none, cap), "TARGET_MISSING": (blast.filter("relation <> 'accounts'"), cap), "UnpredictedRelationWrite": (blast.filter("relation = 'accounts'"), cap),
        "CAP_BELOW_PREDICTION": (blast, cap.withColumn("max_rows", F.lit(1).cast("long"))), "RelationOverWrite": (blast.withColumn("del", F.when(F.col("relation") == "entries", 1).otherwise(F.col("del")).cast("long")), cap),
        "ROWS_OVER_CAP": (blast.withColumn("del", F.when(F.col("relation") == "accounts", 1).otherwise(F.col("del")).cast("long")), cap.withColumn("max_rows", F.lit(8).cast("long"))), "BYTES_OVER_CAP": (blast, cap.withColumn("max_bytes", F.lit(1).cast("long"))),
    }
    for code, (b, c) in cases.items():
        with pytest.raises(Refused, match=code):
            apply(bank, write, tmp_path, b, c)
        assert versions.current(spark, str(tmp_path / "base")) == {}
    twice = bank | {"accounts": bank["accounts"].union(bank["accounts"])}
    with pytest.raises(Refused, match="DUPLICATE_KEY"):
        apply(twice, write, tmp_path, blast, cap.withColumn("max_rows", F.lit(99).cast("long")))
    with pytest.raises(Refused, match="KEY_ASSIGNED"):
        writes.apply_update(bank["accounts"], "id = 1", {"id": "2"}, ["id"])
    with pytest.raises(Refused, match="PK_LESS_TABLE"):
        writes.rehearse(bank, Catalog({}), write)


def test_null_predicate_touches_nothing(bank):
    assert writes.apply_update(bank["accounts"], "owner = null", {"balance": "0"}).filter("balance = 0").count() == 0
    assert writes.affected(bank["accounts"], "null", ["id"]).count() == 0


def test_drift_with_equal_counts_aborts(bank):
    a, b = bank["accounts"].filter("id <= 3"), bank["accounts"].filter("id BETWEEN 2 AND 4")
    assert writes.drift(a, b, ["id"]).first()["decision"] == "ABORT"
    assert writes.drift(a, a, ["id"]).first()["decision"] == "PROCEED"


def test_cascade_depth(bank):
    with pytest.raises(Refused, match="CASCADE_TOO_DEEP"):
        writes.cascade_closure(bank, CATALOG, "accounts", "true", 0)


def test_deep_cascades(spark):
    levels = 13
    chain = {f"t{i}": spark.createDataFrame([(k, k) for k in range(4)], "id long, up long") for i in range(levels)}
    catalog = Catalog({n: ("id",) for n in chain}, tuple(ForeignKey(f"t{i + 1}", ("up",), f"t{i}") for i in range(levels - 1)))
    found = writes.cascade_closure(chain, catalog, "t0", "id <= 1")
    assert list(found) == list(chain) and all(df.count() == 2 for df in found.values())
    assert all(df.count() == 2 for df in writes.apply_delete(chain, catalog, "t0", "id <= 1").values())
    with pytest.raises(Refused, match="CASCADE_TOO_DEEP"):
        writes.cascade_closure(chain, catalog, "t0", "id <= 1", 8)
    assert len(writes.cascade_closure(chain, catalog, "t0", "id > 99", 8)) == levels  # nothing lies that deep


def test_keyless_rows_reached_twice_and_trees(spark):
    people = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 3), (5, None)] + [(i, i - 1) for i in range(6, 18)], "id long, boss long")
    notes = spark.createDataFrame([(2, 3, "same")] * 5 + [(5, 4, "one"), (5, None, "none")], "author long, reader long, text string")
    catalog = Catalog({"people": ("id",)}, (ForeignKey("people", ("boss",), "people"), ForeignKey("notes", ("author",), "people"), ForeignKey("notes", ("reader",), "people")))
    found = writes.cascade_closure({"people": people, "notes": notes}, catalog, "people", "id = 1")
    assert {r["id"] for r in found["people"].collect()} == {1, 2, 3, 4} and found["notes"].count() == 6  # equal rows without a key stay apart
    assert writes.cascade_closure({"people": people, "notes": notes}, catalog, "people", "id = 5")["people"].count() == 13
    left = writes.apply_delete({"people": people, "notes": notes}, catalog, "people", "id = 1")
    assert left["people"].count() == 13 and left["notes"].count() == 1
    with pytest.raises(Refused, match="CASCADE_TOO_DEEP"):
        writes.cascade_closure({"people": people, "notes": notes}, catalog, "people", "id = 5", 8)


def test_guards_on_keys_images_and_predicates(spark, bank, tmp_path):
    delete, update = Write("DELETE", "accounts", "id <= 3"), Write("UPDATE", "accounts", "id <= 3", {"balance": "0", "owner": "'x'"})
    bare = Catalog({"accounts": ("id",)}, tuple(fk for fk in CATALOG.foreign_keys if fk.parent == "accounts"))
    blast = writes.rehearse(bank, bare, delete)
    with pytest.raises(Refused, match="CASCADE_NOT_KEYED"):
        writes.guarded_apply(bank, bare, delete, blast, writes.suggest_cap(blast, 0.0), str(tmp_path / "a"))
    whole = writes.build_inverse(bank, CATALOG, delete)[1]
    blast = writes.rehearse(bank, CATALOG, delete)
    cap = writes.suggest_cap(blast, 0.0)
    for broken in ({k: v for k, v in whole.items() if k != "entries"}, whole | {"accounts": whole["accounts"].filter("id <> 2")}):
        with pytest.raises(Refused, match="IrreversibleChange"):
            writes.guarded_apply(bank, CATALOG, delete, blast, cap, str(tmp_path / "b"), broken)
    with pytest.raises(Refused, match="DeleteWithoutPreimage"):
        writes.guarded_apply(bank, CATALOG, delete, blast, cap, str(tmp_path / "c"), {})
    blast = writes.rehearse(bank, CATALOG, update)
    thin = {"accounts": writes.capture_preimage(bank["accounts"], update.predicate, ["id"], ["balance"])}
    with pytest.raises(Refused, match="MissingPreImageColumn"):
        writes.guarded_apply(bank, CATALOG, update, blast, writes.suggest_cap(blast, 0.0), str(tmp_path / "d"), thin)
    loose = Write("UPDATE", "accounts", "balance > 0", update.assignments)
    with pytest.raises(Refused, match="NON_KEY_COLUMN"):
        writes.guarded_apply(bank, CATALOG, loose, blast, writes.suggest_cap(blast, 0.0), str(tmp_path / "e"))
    assert all(versions.current(spark, str(tmp_path / x)) == {} for x in "abcde")


def test_publishing_after_a_failed_attempt_and_two_writers(spark, bank, tmp_path, monkeypatch):
    base = str(tmp_path / "b")
    versions.publish(bank, base)
    bank["accounts"].write.parquet(f"{base}/versions/accounts/left-behind")  # a writer that died before its pointer
    versions.publish({"accounts": bank["accounts"].filter("id = 1")}, base)
    assert versions.read(spark, base, "accounts").count() == 1
    stale = versions.newest(spark, base)
    versions.publish({"accounts": bank["accounts"].filter("id <= 2")}, base)
    for i in range(4):  # writers that all saw the version before, and are late
        monkeypatch.setattr(versions, "newest", lambda *a: stale)
        with pytest.raises(versions.Outrun):
            versions.publish({"accounts": bank["accounts"].filter(f"id = {i}")}, base)
        monkeypatch.undo()
    assert versions.read(spark, base, "accounts").count() == 2 and versions.newest(spark, base)[0] == stale[0] + 1
    assert versions.pointers(spark, base).filter(f"number = {stale[0] + 1}").count() == 1


def test_of_writers_on_one_version_exactly_one_wins(spark, tmp_path, monkeypatch):
    """Whatever the order and the names: the winner's publish stays, the others are told."""
    base = str(tmp_path / "b")
    for number in range(4):
        names = iter(["f" * 32, "draft", "0" * 32, "draft"] if number % 2 else ["0" * 32, "draft", "f" * 32, "draft"])
        stale = versions.newest(spark, base)
        assert stale[0] == number
        monkeypatch.setattr(versions, "newest", lambda *a, stale=stale: stale)
        monkeypatch.setattr(versions.uuid, "uuid4", lambda names=names: type("U", (), {"hex": next(names)}))
        versions.publish_paths(spark, {"t": f"/a{number}"}, base)
        with pytest.raises(versions.Outrun):
            versions.publish_paths(spark, {"t": f"/b{number}"}, base)
        monkeypatch.undo()
        assert versions.current(spark, base) == {"t": f"/a{number}"}
    with pytest.raises(versions.Outrun):
        versions.publish_paths(spark, {"t": "/late"}, base, on=2)
    stale = versions.newest(spark, base)
    monkeypatch.setattr(versions, "newest", lambda *a: stale)

    def attempt(i):
        try:
            return versions.publish_paths(spark, {"t": f"/{i}"}, base)
        except versions.Outrun:
            return None

    with ThreadPoolExecutor(8) as pool:
        won = [x for x in pool.map(attempt, range(16)) if x]
    monkeypatch.undo()
    assert len(won) == 1 and versions.current(spark, base) == won[0]
    assert not [f for f in (tmp_path / "b" / "_current").iterdir() if "draft" in f.name and not f.name.endswith(".crc")]


def test_publish_keeps_other_relations(spark, bank, tmp_path):
    base = str(tmp_path / "b")
    versions.publish(bank, base)
    versions.publish({"accounts": bank["accounts"].filter("id = 1")}, base)
    assert versions.read(spark, base, "accounts").count() == 1 and versions.read(spark, base, "entries").count() == 16


def sealed(spark, n=40, chains=("a", "b")):
    log = spark.createDataFrame([(c, i, f'{{"reason_code":"r{i % 3}"}}') for c in chains for i in range(n)], "chain_id string, ts_ms long, payload string")
    return audit.seal(log, ["ts_ms"])


@pytest.mark.parametrize(
    ("edit", "kind"),
    [
        (lambda df: df, None), (lambda df: df.withColumn("payload", F.when(F.col("seq") == 16, "x").otherwise(F.col("payload"))), "HASH_MISMATCH"), (lambda df: df.filter("seq <> 15"), "SEQ_GAP"), (lambda df: df.filter("seq <> 16"), "SEQ_GAP"),
        (lambda df: df.filter("seq >= 7"), "BAD_GENESIS"),
    ],
)
@pytest.mark.parametrize("bucket", [8, 65_536])
def test_tampering(spark, edit, kind, bucket):
    rows = audit.verify_chain(edit(sealed(spark)), bucket).collect()
    assert {(r["ok"], r["kind"]) for r in rows} == {(kind is None, kind)}


def test_a_repeated_number_is_a_break(spark):
    rows = audit.verify_chain(sealed(spark).withColumn("seq", F.when(F.col("seq") > 20, F.col("seq") - 1).otherwise(F.col("seq")))).collect()
    assert not any(r["ok"] for r in rows)


def test_sealing_goes_on_from_heads(spark):
    whole = sealed(spark)
    first = audit.seal(whole.filter("seq < 10").select("chain_id", "ts_ms", "payload"), ["ts_ms"])
    more = audit.seal(whole.filter("seq >= 10").select("chain_id", "ts_ms", "payload"), ["ts_ms"], audit.chain_heads(first))
    assert snapshot.is_parity(whole, first.unionByName(more)).first()["is_parity"]


def test_anchors(spark):
    keys, chain = {"k": b"key"}, sealed(spark)
    good = audit.make_anchors(audit.chain_heads(chain.filter("seq <= 20")), "k", keys)
    status = lambda c, a, **o: {r["status"] for r in audit.verify_anchors(c, a, keys, **o).collect()}
    assert status(chain, good) == {"HEAD_MISMATCH"} and status(chain, good, prefix=True) == {"VERIFIED"}
    assert status(chain.filter("seq <= 20"), good) == {"VERIFIED"} and status(chain, good.limit(0)) == {"NO_ANCHOR"}
    assert status(chain, good.withColumn("seq", F.col("seq") - 1), prefix=True) == {"BAD_SIGNATURE"}
    assert status(chain, good.withColumn("key_id", F.lit("lost"))) == {"BAD_SIGNATURE"}
    assert audit.verify_then_anchor(chain, good, keys, "k", 10**6).count() == 2
    assert audit.verify_then_anchor(chain, good, keys, "k", 10**6, strict=True).count() == 0
    assert audit.verify_then_anchor(chain.filter("seq <> 5"), good, keys, "k", 10**6).count() == 0
    plan = good._jdf.queryExecution().toString()
    assert keys["k"].hex() not in plan


def test_tail_clamps(spark):
    chain = sealed(spark, 60, ("a",))
    assert audit.audit_tail(chain).count() == 50 and audit.audit_tail(chain, 5000).count() == 60 and [r["seq"] for r in audit.audit_tail(chain, 2).collect()] == [58, 59]


def test_chain_files(spark, tmp_path):
    chain, path = sealed(spark), str(tmp_path / "chain")
    sources.append_chain(chain, path)
    spark.createDataFrame([("c", 0, GENESIS, "x", "not json", 1)], chain.schema).write.mode("append").parquet(path)
    rows = sources.read_chain(spark, path)
    assert rows.count() == 81 and [r["chain_id"] for r in rows.filter("corrupt").collect()] == ["c"]
    anchors = audit.make_anchors(audit.chain_heads(chain), "k", {"k": b"x"})
    sources.append_anchors(anchors, str(tmp_path / "anchors"))
    assert snapshot.is_parity(anchors, sources.read_anchors(spark, str(tmp_path / "anchors"))).first()["is_parity"]
    sources.append_batch(chain, 0, str(tmp_path / "s"))
    sources.append_batch(chain, 0, str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == 80


def test_golden_and_allowed(spark, tmp_path):
    (tmp_path / "g.json").write_text(json.dumps([{"id": "a", "class": "legit", "payload": "p", "vector": "v", "expected_verdict": "ALLOW", "defense_layer": "x"}]))
    assert sources.read_golden(spark, str(tmp_path / "g.json")).first()["expected_verdict"] == "ALLOW"
    policy = spark.createDataFrame([("r", ["nation"]), ("none", [])], "role string, select_whitelist array<string>")
    allow = lambda role: set(sources.read_allowed(spark, "/root/testdata/sf0.001", role, ["nation", "orders"], policy))
    assert allow("r") == {"nation"} and allow("none") == set() and allow("unknown") == set()


CAPS = "role string, max_rows long, max_bytes long, window_ms long, window_max_rows long, window_max_bytes long"


def test_cutoff_edges(spark):
    policy = spark.createDataFrame([("r", 3, 100, 10, 3, 100)], CAPS)
    rows = spark.createDataFrame(
        [("exact", i, "r", b) for i, b in enumerate([40, 30, 30, 0])] + [("late", i, "r", b) for i, b in enumerate([90, 20, 1])] + [("zero", i, "r", 0) for i in range(5)] + [("unknown", 0, "x", 1)],
        "q string, i long, role string, bytes long",
    )
    got = {r["q"]: r for r in meter.cutoff_report(rows, ["q"], ["i"], "bytes", policy).collect()}
    assert (got["exact"]["rows_out"], got["exact"]["breach"]) == (3, "max_rows")
    assert (got["late"]["rows_out"], got["late"]["breach"]) == (1, "max_bytes")  # the small row after the breach stays in
    assert (got["zero"]["rows_out"], got["zero"]["breach"]) == (3, "max_rows") and (got["unknown"]["rows_out"], got["unknown"]["breach"]) == (0, "unknown_role")


def test_window_state():
    charge = lambda w, t, n: w.charge(t, n, n, 100, 5, 50)
    w = meter.WindowState()
    assert [charge(w, 0, 4), charge(w, 50, 3), charge(w, 60, 1), charge(w, 99, 1), charge(w, 100, 5)] == ["ok", "window_rows", "ok", "window_rows", "ok"]
    assert w.anchor == 100
    k = meter.WindowState()
    assert [k.charge(0, 9, 1, 100, 5, 50, True), k.charge(500, 1, 1, 100, 5, 50, True)] == ["window_rows", "session_killed"]


def test_window_stream_in_several_batches_equals_the_batch(spark):
    policy = spark.createDataFrame([("r", 9, 9, 20, 4, 60)], CAPS)
    rows = spark.createDataFrame([(f"s{i % 3}", "r", i, i * 3, 1, (i * 7) % 30) for i in range(60)], "session string, role string, id long, ts_ms long, rows long, bytes long")
    batch = meter.window_meter(rows, policy)
    streamed = stream.replay(rows.orderBy("ts_ms").coalesce(1), lambda x: stream.window_meter(x, policy), "w")
    assert snapshot.is_parity(batch, streamed).first()["is_parity"]


def test_breaker():
    b, log = watch.Breaker(), []
    for now, reason, probe in [(0, None, "ok"), (10, "a", None), (20, "b", None), (39, None, None), (40, None, None), (41, "c", None), (71, None, "failed"), (101, None, "ok"), (102, None, None)]:
        b.tick(now, reason, probe, 30)
        log.append((b.state, b.reason, b.opened))
    assert log == [("Closed", None, None), ("Open", "a", 10), ("Open", "b", 10), ("Open", "b", 10), ("HalfOpen", "b", 10), ("Open", "c", 41), ("Open", "probe_failed", 71), ("Closed", None, None), ("Closed", None, None)]


def test_chain_stream(spark):
    assert stream.replay(sealed(spark).coalesce(1), live.verify_chain_stream, "c").count() == 0
    bad = sealed(spark).filter("seq <> 9")
    late = spark.createDataFrame([(None, None, None, None, None, 10**12)], CHAIN)
    assert {r["kind"] for r in stream.replay(bad, live.verify_chain_stream, "c", 1, then=late).collect()} == {"SEQ_GAP"}


def test_trust_never_rises(spark):
    """All short sequences of events, from every grant."""
    events, grants = [], []
    for n, (granted, *kinds) in enumerate(itertools.product(TRUST, TRUST_CEILING, TRUST_CEILING, TRUST_CEILING)):
        grants.append((f"s{n}", granted))
        events += [(f"s{n}", n * 10 + i, i, kind, 1, 1) for i, kind in enumerate(kinds)]
    e = spark.createDataFrame(events, "session string, event_id long, ts_ms long, event_type string, rows long, bytes long")
    rows = logs.trust_timeline(e, spark.createDataFrame(grants, "session string, granted string")).orderBy("session", "event_id").collect()
    for _, run in itertools.groupby(rows, key=lambda r: r["session"]):
        ranks = [TRUST.index(r["trust"]) for r in run]
        assert ranks == sorted(ranks, reverse=True)


def test_saturation(spark):
    e = spark.createDataFrame([("s", i, i, "BenignRead", 2**62, 1) for i in range(3)], "session string, event_id long, ts_ms long, event_type string, rows long, bytes long")
    g = spark.createDataFrame([("s", "Agent")], "session string, granted string")
    assert logs.session_trust(e, g).first()["rows"] == 2**63 - 1


def test_lock_order(spark):
    df = spark.createDataFrame([(1, "RowShare"), (1, "AccessExclusive"), (1, "Share"), (2, "nonsense")], "p int, mode string")
    assert {r["p"]: r["mode"] for r in logs.max_ranked(df, ["p"], "mode", LOCKS).collect()} == {1: "AccessExclusive", 2: None}


def test_scoring_edges(spark):
    g = spark.createDataFrame([("1", "dangerous", "v", "BLOCK"), ("2", "dangerous", "v", "BOUND"), ("3", "dangerous", "v", "REVERTED"), ("4", "legit", "v", "ALLOW")], "id string, class string, vector string, expected_verdict string")
    o = spark.createDataFrame([("1", "ALLOW", 0, 0, 0, False), ("2", "BOUND", 101, 100, 0, False), ("3", "REVERTED", 0, 0, 5, False), ("4", "BLOCK", 0, 0, 0, False)], "id string, verdict string, bytes_out long, budget_bytes long, prod_rows_touched long, reverted_with_verified_diff boolean")
    r = scoring.gate_report(scoring.score(g, o)).first()
    assert (r["catastrophic_fn"], r["false_positives"], r["clean"], r["green"]) == (3, 1, 0, False)


def test_pk_checks(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c")], "k int, v string")
    assert writes.check_pk(df, []).first()["reason"] == "NO_KEY" and writes.check_pk(df, ["k"]).first()["reason"] == "NULL_KEY" and writes.check_pk(df.filter("k = 1"), ["k"]).first()["reason"] == "DUPLICATE_KEY"
    d = lambda x: writes.pk_checksum(x, ["k", "v"]).first()["digest"]
    assert d(df) == d(df.orderBy(F.desc("v"))) != d(df.unionByName(df.limit(1)))
    assert d(spark.createDataFrame([("1", "2")], "k string, v string")) != d(spark.createDataFrame([("12", "")], "k string, v string"))
    with pytest.raises(ValueError, match="floating"):
        writes.pk_checksum(df.withColumn("k", F.col("k").cast("double")), ["k"])


def test_volume_on_a_stream_is_part_of_the_batch(spark):
    rows = spark.range(200).select((F.lit(1_700_000_000) + F.col("id") * 60).cast("timestamp").alias("ts"), (F.col("id") % 3).alias("user"), F.lit(5).cast("long").alias("size"))
    batch = {tuple(r) for r in meter.volume_by_window(rows, "ts", "user", "size", "30 minutes").collect()}
    closed = [tuple(r) for r in stream.replay(rows, lambda x: meter.volume_by_window(x, "ts", "user", "size", "30 minutes", "5 minutes"), "volume").collect()]
    assert closed and set(closed) <= batch and len(set(closed)) == len(closed)


def test_activity_stream(spark, tmp_path):
    t = watch.Thresholds(runaways=2)
    activity = spark.createDataFrame([(1, 10, i, "agent" if i % 2 else None, None, "active", 60_000 + i) for i in range(4)], sources.ACTIVITY)
    activity.write.parquet(str(tmp_path / "a"))
    seen = []
    q = sources.read_activity(spark, str(tmp_path / "a")).writeStream.foreachBatch(lambda df, _: seen.extend(watch.assess_backends(df, t).collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r["terminate"], r["spared"], r["runaways"]) for r in seen] == [([1, 3], [2], 3)]  # exactly the limit is no runaway
    ticks = spark.createDataFrame([(1, 10, 0), (1, 11, 1 << 40)], "cluster_id long, tick long, lag_bytes long")
    slots = spark.createDataFrame([(1, 10, "b", 1, 1 << 40), (1, 10, "a", 2, 1 << 40), (1, 10, "c", 0, 5)], "cluster_id long, tick long, slot_name string, position long, retained_wal_bytes long")
    reasons = watch.trip_reasons(ticks, watch.assess_backends(activity, t), watch.slot_alarms(slots, t), t).collect()
    assert {r["tick"]: r["reason"] for r in reasons} == {10: "slot:b", 11: "lag"}


def test_read_verdicts_of_escapes(spark):
    from ledgerline.operators import logs

    cases = [
        ("SELECT E'it\\'s', 1", True), ("SELECT E'\\\\'; DROP TABLE t; --'", False), ("SELECT 'a\\' FROM t", True), ("SELECT e'\\'' || pg_sleep(1)", False), ("SELECT name'x' FROM t", True), ("SELECT U&'d' FROM t", True),
        ("select $a$ $b$ $a$", True), ("select $a$ $b$ ; $b$", False), ("SELECT count(*)\nFROM t -- (", True), ("SELECT '--' , count(*) FROM t", True), ("SELECT 1 FROM t WHERE a = '/*' -- */", True), (None, False),
    ]
    log = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(cases)], "log_id int, sql_text string")
    got = {r["log_id"]: r["is_read"] for r in logs.with_read_verdict(log, spark.createDataFrame([("count",)], "name string")).collect()}
    assert [got[i] for i in range(len(cases))] == [read for _, read in cases]


@pytest.mark.parametrize(("span", "hot"), [(1, 10**9), (7, 5), (1000, 10**9), (1000, 20), (1000, 60)])
def test_running_values_do_not_depend_on_the_span(spark, span, hot):
    rows = [(None if i % 5 == 0 else f"s{i % 3}", (i * 7) % 40, i, None if i % 11 == 0 else i % 6) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, at long, id long, v long")
    got = with_running(df, ["k"], ["at", "id"], span, {"n": F.lit(1).cast("long"), "s": F.col("v")}, {"low": F.col("v")}, hot)
    seen, want = {}, set()
    for k, at, i, v in sorted(rows, key=lambda r: (r[1], r[2])):
        n, s, low = seen.get(k, (0, None, None))
        if v is not None:
            s, low = (s or 0) + v, v if low is None else min(low, v)
        seen[k] = n + 1, s, low
        want.add((k, at, i, v, n + 1, s, low))
    assert {tuple(r) for r in got.collect()} == want


def test_folds_go_on_over_batches_and_keep_null_keys_apart(spark):
    rows = [(None if i % 4 == 0 else f"k{i % 4}", i) for i in range(500)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        made = folded(spark.createDataFrame(rows, "k string, i long"), "k", ["i"], lambda row: [], lambda held, row: held.append(row["i"]) or ((row["k"], row["i"], len(held)) if len(held) % 2 else None), "k string, i long, n long").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert {tuple(r) for r in made} == {(k, i, i // 4 + 1) for k, i in rows if i // 4 % 2 == 0}
    assert folded(spark.createDataFrame([], "k string, i long"), "k", ["i"], lambda row: 0, lambda s, row: (row["k"], s), "k string, n long").count() == 0


def test_digests_count_repeated_rows(spark):
    one = spark.createDataFrame([(1,), (2,), (2,), (None,)], "k long")
    same, other = spark.createDataFrame([(2,), (None,), (1,), (2,)], "k long"), spark.createDataFrame([(1,), (1,), (2,), (None,)], "k long")
    for digest in (lambda df: digest_of_set(df, ["k"]).first(), lambda df: tuple(snapshot.fingerprint(df, "t").first())):
        assert digest(one) == digest(same) != digest(other)


def test_both_violations_of_one_record_are_reported(spark):
    chain = spark.createDataFrame([("c", -1, "aa", "h1", '{"prev_hash":"bb"}', 0), ("c", 2, "h1", "h2", '{"prev_hash":"h1"}', 1)], CHAIN)
    assert {tuple(r) for r in audit.chain_constraints(chain).collect()} == {("c", "NEGATIVE_SEQ", "-1", 1), ("c", "PAYLOAD_PREV_HASH", "aa", 1)}
