"""Safe bulk writes: rehearse an UPDATE or DELETE, guard it by what was approved, apply, and revert.

Tables are DataFrames by relation name; a Catalog names their keys and the foreign keys between them. Nothing is written but by
``publish``, which the guarded apply calls last.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.encode import digest_of_set

Tables = dict[str, DataFrame]


@dataclass(frozen=True)
class ForeignKey:
    child: str
    columns: tuple[str, ...]
    parent: str
    cascade: bool = True


@dataclass(frozen=True)
class Catalog:
    keys: dict[str, tuple[str, ...]]  # no entry: the relation has no key
    foreign_keys: tuple[ForeignKey, ...] = ()

    def children(self, parent: str) -> list[ForeignKey]:
        return [fk for fk in self.foreign_keys if fk.parent == parent and fk.cascade]


@dataclass(frozen=True)
class Write:
    kind: str  # UPDATE or DELETE
    relation: str
    predicate: str
    assignments: dict[str, str] = field(default_factory=dict)


class Refused(Exception):
    """A write that may not go on; the first argument is the reason's code."""


def holds(predicate: str) -> Column:
    """The predicate, null counting as false."""
    return F.coalesce(F.expr(predicate), F.lit(False))


def affected(df: DataFrame, predicate: str, keys: Iterable[str]) -> DataFrame:
    """Keys of the rows that the predicate picks."""
    return df.filter(holds(predicate)).select(*keys)


#: Catalyst classes whose value depends on when or for whom a query runs, and user code, of which nothing is known.
UNSTABLE = {"CurrentDate", "CurrentTimestamp", "Now", "LocalTimestamp", "CurrentTime", "CurrentUser", "PythonUDF", "ScalaUDF", "PythonUDAF"}


def guard_predicate(df: DataFrame, predicate: str | None, pk: Iterable[str]) -> str | None:
    """Why a predicate may not be used, or null. It may read key columns, literals and deterministic functions only.

    Reads the analysed plan: the deterministic flag alone passes subqueries and clock functions, so these are looked for too.
    """
    if predicate is None or not predicate.strip():
        return "NO_PREDICATE"
    plan = df.filter(predicate)._jdf.queryExecution().analyzed()
    while plan.getClass().getSimpleName() != "Filter":
        plan = plan.children().head()
    condition = plan.condition()
    names: set[str] = set()
    open_ = [condition]
    while open_:
        node = open_.pop()
        names.add(node.getClass().getSimpleName().rstrip("$"))
        below = node.children()
        open_ += [below.apply(i) for i in range(below.size())]
    if any("Subquery" in n or n in ("Exists", "ListQuery") for n in names):
        return "SUBQUERY"
    if not condition.deterministic() or names & UNSTABLE:
        return "NOT_DETERMINISTIC"
    read = condition.references().toSeq()
    columns = {read.apply(i).name().lower() for i in range(read.size())}
    if not columns:
        return "NO_KEY_COLUMN"
    return None if columns <= {k.lower() for k in pk} else "NON_KEY_COLUMN"


def check_pk(df: DataFrame, keys: Iterable[str] | None) -> DataFrame:
    """One row (reason, n): NO_KEY, NULL_KEY or DUPLICATE_KEY with how many rows or keys, or null and the number of keys."""
    keys = list(keys or [])
    if not keys:
        return df.agg(F.lit("NO_KEY").alias("reason"), F.count(F.lit(1)).alias("n"))
    missing = functools.reduce(operator.or_, [F.col(k).isNull() for k in keys])
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("c"))
    all_ = counts.agg(F.coalesce(F.sum(F.when(missing, F.col("c"))), F.lit(0)).alias("nulls"), F.count_if(F.col("c") > 1).alias("twice"), F.count(F.lit(1)).alias("keys"))
    reason = F.when(F.col("nulls") > 0, "NULL_KEY").when(F.col("twice") > 0, "DUPLICATE_KEY")
    return all_.select(reason.alias("reason"), F.when(F.col("nulls") > 0, F.col("nulls")).when(F.col("twice") > 0, F.col("twice")).otherwise(F.col("keys")).alias("n"))


def pk_checksum(df: DataFrame, keys: Iterable[str]) -> DataFrame:
    """(digest, n) of the key set."""
    return digest_of_set(df, list(keys))


def drift(before: DataFrame, after: DataFrame, keys: Iterable[str]) -> DataFrame:
    """PROCEED only if both sets of keys are the same; the same number of other rows is an ABORT."""
    a, b = (pk_checksum(x, keys) for x in (before, after))
    both = a.select(F.col("digest").alias("before"), F.col("n").alias("n_before")).join(b.select(F.col("digest").alias("after"), F.col("n").alias("n_after")))
    return both.select(F.when(F.col("before") == F.col("after"), "PROCEED").otherwise("ABORT").alias("decision"), "n_before", "n_after")


def drift_rows(before: DataFrame, after: DataFrame, keys: Iterable[str]) -> DataFrame:
    """What an ABORT is about: keys that left and keys that came, as often as they did."""
    a, b = before.select(*keys), after.select(*keys)
    return a.exceptAll(b).withColumn("change", F.lit("LEFT")).unionByName(b.exceptAll(a).withColumn("change", F.lit("CAME")))


def renamed(parent: DataFrame, fk: Iterable[str], pk: Iterable[str]) -> tuple[DataFrame, Column]:
    """The parent's keys under names of their own, and the join with a child's foreign key."""
    fk, pk = list(fk), list(pk)
    keys = parent.select(*[F.col(k).alias(f"_key_{i}") for i, k in enumerate(pk)])
    return keys, functools.reduce(operator.and_, [F.col(f) == F.col(f"_key_{i}") for i, f in enumerate(fk)])


def cascade_rows(parent_keys: DataFrame, child: DataFrame, fk: Iterable[str], pk: Iterable[str]) -> DataFrame:
    """Child rows of the given parent keys. AQE broadcasts the keys where they are few."""
    parents, same = renamed(parent_keys, fk, pk)
    return child.join(parents, same, "left_semi")


def cycles(catalog: Catalog, relation: str) -> list[list[str]]:
    """The relations that cascades reach from ``relation``, parents first; relations that reach each other are one entry."""
    below: dict[str, set[str]] = {}

    def reach(name: str) -> set[str]:
        found, open_ = set(), [name]
        while open_:
            for fk in catalog.children(open_.pop()):
                if fk.child not in found:
                    found.add(fk.child)
                    open_.append(fk.child)
        return found

    names = sorted({relation} | reach(relation))
    below = {n: reach(n) for n in names}
    parts = {frozenset([n, *(m for m in below[n] if n in below[m])]) for n in names}
    # A part that reaches more relations stands before those it reaches.
    return [sorted(part) for part in sorted(parts, key=lambda part: (-max(len(below[n] | part) for n in part), sorted(part)))]


def depths(catalog: Catalog, relation: str) -> dict[str, int]:
    """The most levels down at which each relation is reached, cycles walked once."""
    out = {relation: 0}
    for part in cycles(catalog, relation):
        inside = max((out[n] for n in part if n in out), default=0)
        for n in part:
            out[n] = max(inside, out.get(n, 0))
            for fk in catalog.children(n):
                if fk.child not in part:
                    out[fk.child] = max(out.get(fk.child, 0), out[n] + 1)
    return out


def picked(child: DataFrame, parents: list[tuple[DataFrame, ForeignKey]], catalog: Catalog, also: Column | None = None) -> DataFrame:
    """Rows of a child that have any of the given parents' keys, or satisfy ``also``; each row once, whether it has a key or not."""
    if len(parents) == 1 and also is None:
        keys, fk = parents[0]
        return cascade_rows(keys, child, fk.columns, catalog.keys[fk.parent])
    hit, rows = also if also is not None else F.lit(False), child
    for i, (keys, fk) in enumerate(parents):
        one = keys.select(*[F.col(k).alias(f"_key_{i}_{j}") for j, k in enumerate(catalog.keys[fk.parent])]).distinct().withColumn(f"_hit_{i}", F.lit(True))
        rows = rows.join(one, functools.reduce(operator.and_, [F.col(f) == F.col(f"_key_{i}_{j}") for j, f in enumerate(fk.columns)]), "left")
        hit = hit | F.coalesce(F.col(f"_hit_{i}"), F.lit(False))
    return rows.filter(hit).select(*child.columns)


def cascade_closure(tables: Tables, catalog: Catalog, relation: str, predicate: str, max_depth: int | None = None) -> Tables:
    """The rows of every relation that go with the rows of ``relation`` that the predicate picks, whatever the depth.

    Relations are walked parents first, each once, by the union of its foreign keys. Relations that reach each other or
    themselves are walked level by level, each time from the keys that are new, until none is. The keys of every relation that
    has children are written to the shared folder once and serve all that hangs below. ``max_depth`` refuses (CASCADE_TOO_DEEP)
    where rows lie deeper; nothing is ever cut off.
    """
    from ..sources.versions import scratch

    out: Tables = {}
    keys: Tables = {}
    deep = depths(catalog, relation)
    for part in cycles(catalog, relation):
        own = [fk for n in part for fk in catalog.children(n) if fk.child in part]
        for name in part:
            coming = [(keys[fk.parent], fk) for fk in catalog.foreign_keys if fk.cascade and fk.child == name and fk.parent in keys and fk.parent not in part]
            out[name] = picked(tables[name], coming, catalog, holds(predicate) if name == relation else None) if coming or name == relation else tables[name].limit(0)
        if own:
            for name in part:
                if not catalog.keys.get(name):
                    raise Refused("PK_LESS_TABLE")  # what refers to itself is known by its key
            new = {n: scratch(out[n].select(*catalog.keys[n]).distinct()) for n in part}
            found, level = dict(new), max(deep[n] for n in part)
            while True:
                nxt: Tables = {}
                for name in part:
                    coming = [(new[fk.parent], fk) for fk in own if fk.child == name]
                    if coming:
                        rows = picked(tables[name], coming, catalog).select(*catalog.keys[name]).distinct()
                        nxt[name] = scratch(rows.join(found[name], list(catalog.keys[name]), "left_anti"))
                new = {n: df for n, df in nxt.items() if not df.isEmpty()}
                if not new:
                    break
                level += 1
                if max_depth is not None and level > max_depth:
                    raise Refused("CASCADE_TOO_DEEP")
                found = {n: found[n].unionByName(new[n]) if n in new else found[n] for n in part}
                own = [fk for n in part for fk in catalog.children(n) if fk.child in part and n in new]
            for name in part:
                keys[name] = found[name]
                out[name] = tables[name].join(found[name], list(catalog.keys[name]), "left_semi")
        for name in part:
            if max_depth is not None and deep[name] > max_depth and not out[name].isEmpty():
                raise Refused("CASCADE_TOO_DEEP")
            if name not in keys and catalog.children(name):
                keys[name] = scratch(out[name].select(*catalog.keys[name]).distinct())
    return {n: out[n] for n in sorted(out, key=lambda n: (deep[n], [m for part in cycles(catalog, relation) for m in part].index(n)))}


def missing_preimages(written: DataFrame, preimages: DataFrame, keys: Iterable[str]) -> DataFrame:
    """Written rows of which no pre-image was taken."""
    return written.join(preimages, list(keys), "left_anti")


def orphans(child: DataFrame, parent: DataFrame, fk: Iterable[str], pk: Iterable[str]) -> DataFrame:
    """Child rows whose parent is missing; a null foreign key has no parent to miss."""
    fk = list(fk)
    set_ = functools.reduce(operator.and_, [F.col(f).isNotNull() for f in fk])
    parents, same = renamed(parent, fk, pk)
    return child.filter(set_).join(parents, same, "left_anti")


def apply_update(df: DataFrame, predicate: str, assignments: dict[str, str], keys: Iterable[str] = ()) -> DataFrame:
    """D3: the new version of the table. Assignments all read the old row; keys cannot be assigned."""
    if set(assignments) & set(keys):
        raise Refused("KEY_ASSIGNED")
    hit = holds(predicate)
    return df.select(*[F.when(hit, F.expr(assignments[c]).cast(df.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c in assignments else F.col(c) for c in df.columns])


def apply_delete(tables: Tables, catalog: Catalog, relation: str, predicate: str, gone: Tables | None = None) -> Tables:
    """New versions of the relation and all that cascades from it. ``gone``: the closure, where it is known already."""
    gone = cascade_closure(tables, catalog, relation, predicate) if gone is None else gone
    out = {relation: tables[relation].filter(~holds(predicate))}
    for name in gone:
        for fk in [f for f in catalog.foreign_keys if f.child == name and f.parent in gone and f.cascade]:
            keys = catalog.keys[fk.parent]
            parents = gone[fk.parent].select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
            kept = out.get(name, tables[name])
            out[name] = kept.join(parents, functools.reduce(operator.and_, [kept[f] == parents[f"_{k}"] for f, k in zip(fk.columns, keys, strict=True)]), "left_anti")
    return out


def capture_preimage(df: DataFrame, rows: DataFrame | str, keys: Iterable[str], columns: Iterable[str] | None = None) -> DataFrame:
    """Keys and ``before`` of the rows to be written: the columns that an UPDATE sets, or the whole row. Save it before the new version is made."""
    keys = list(keys)
    picked = df.filter(holds(rows)) if isinstance(rows, str) else rows
    before = [c for c in (columns if columns is not None else df.columns) if columns is None or c not in keys]
    return picked.select(*keys, F.struct(*before).alias("before"))


def size_of(df: DataFrame, columns: Iterable[str]) -> Column:
    return functools.reduce(operator.add, [F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in columns]).cast("long")


def effects_of(tables: Tables, catalog: Catalog, write: Write) -> list[tuple[str, DataFrame]]:
    if write.kind == "UPDATE":
        return [(write.relation, tables[write.relation].filter(holds(write.predicate)))]
    return list(cascade_closure(tables, catalog, write.relation, write.predicate).items())


def rehearse(tables: Tables, catalog: Catalog, write: Write) -> DataFrame:
    """The blast radius, one row for each relation: operations, digest of the keys (relations without a key have none), bytes changed, and the inverse's kind. Writes nothing."""
    keys = catalog.keys.get(write.relation)
    if not keys:
        raise Refused("PK_LESS_TABLE")
    if reason := guard_predicate(tables[write.relation], write.predicate, keys):
        raise Refused(reason)
    out = []
    for name, rows in effects_of(tables, catalog, write):
        mine = catalog.keys.get(name)
        images = size_of(rows, rows.columns) * (2 if write.kind == "UPDATE" else 1)
        counts = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(images), F.lit(0)).alias("changed_bytes"))
        digest = pk_checksum(rows, mine).select("digest") if mine else counts.select(F.lit(None).cast("string").alias("digest"))
        zero, n = F.lit(0).cast("long"), F.col("n")
        out.append(
            counts.join(digest).select(
                F.lit(name).alias("relation"), F.lit(name == write.relation).alias("is_target"), zero.alias("ins"), (n if write.kind == "UPDATE" else zero).alias("upd"), (n if write.kind == "DELETE" else zero).alias("del"),
                F.col("digest").alias("pk_digest"), "changed_bytes", F.lit(mine is not None).alias("keyed"), F.lit("PREIMAGE_UPSERT" if write.kind == "UPDATE" else "INSERT").alias("inverse_kind"),
            )
        )
    return functools.reduce(DataFrame.unionByName, out)


def blast_report(blast: DataFrame) -> DataFrame:
    """L3: the blast radius as one JSON text, relations in order of name."""
    ops = F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("relation", F.struct("ins", "upd", "del"))))))
    return blast.agg(ops.alias("effect_by_table"), F.sum(F.col("ins") + F.col("upd") + F.col("del")).alias("total_rows"))


def footprint(blast: DataFrame) -> DataFrame:
    """All rows and bytes that a write changes."""
    return blast.agg(F.coalesce(F.sum(F.col("ins") + F.col("upd") + F.col("del")), F.lit(0)).alias("total_rows"), F.coalesce(F.sum("changed_bytes"), F.lit(0)).alias("total_bytes"))


def suggest_cap(blast: DataFrame, headroom: float) -> DataFrame:
    """Base + ceil(base * headroom - 1e-9), of rows (base at least 1) and bytes; a headroom that is negative or no number counts as 0."""
    h = headroom if headroom >= 0 and headroom < float("inf") else 0.0
    capped = lambda base: (base + F.ceil(base * F.lit(h) - 1e-9)).cast("long")
    return footprint(blast).select(capped(F.greatest("total_rows", F.lit(1))).alias("max_rows"), capped(F.col("total_bytes")).alias("max_bytes"))


def check_cap(predicted: DataFrame, actual: DataFrame, cap: DataFrame) -> DataFrame:
    """Null, or CAP_BELOW_PREDICTION, ROWS_OVER_CAP or BYTES_OVER_CAP, in this order."""
    p, a = footprint(predicted), footprint(actual)
    both = p.select(F.col("total_rows").alias("predicted")).join(a).join(cap.select("max_rows", "max_bytes"))
    reason = F.when(F.col("max_rows") < F.col("predicted"), "CAP_BELOW_PREDICTION").when(F.col("total_rows") > F.col("max_rows"), "ROWS_OVER_CAP").when(F.col("total_bytes") > F.col("max_bytes"), "BYTES_OVER_CAP")
    return both.select(reason.alias("refused"), "total_rows", "max_rows")


def reconcile(predicted: DataFrame, actual: DataFrame, target: str, kind: str) -> DataFrame:
    """D10 (J4): each relation's first channel above its prediction. The target's own channel is the cap's concern; fewer changes are fine."""
    channels = ["ins", "upd", "del"]
    p = predicted.select("relation", *[F.col(c).alias(f"p_{c}") for c in channels], F.lit(True).alias("known"))
    rows = actual.select("relation", *channels).join(p, "relation", "full_outer")
    own = {"UPDATE": "upd", "DELETE": "del", "INSERT": "ins"}[kind]
    over = lambda c: (F.col(c) > F.col(f"p_{c}")) & ~((F.col("relation") == target) & F.lit(c == own))
    some = F.coalesce(functools.reduce(operator.add, [F.col(c) for c in channels]), F.lit(0)) > 0
    channel = F.when(over("ins"), "ins").when(over("upd"), "upd").when(over("del"), "del")
    reason = F.when(F.col("known").isNull() & some, "UnpredictedRelationWrite").when(channel.isNotNull(), "RelationOverWrite")
    return rows.select("relation", reason.alias("refused"), F.when(F.col("known").isNotNull(), channel).alias("channel"))


def check_row_coverage(effects: DataFrame, captured: DataFrame, target: str) -> DataFrame:
    """Relations whose deletions, or updates outside the target, exceed the captured rows (relation, captured)."""
    rows = effects.join(captured, "relation", "left").withColumn("captured", F.coalesce("captured", F.lit(0)))
    bad = (F.col("del") > F.col("captured")) | ((F.col("relation") != target) & (F.col("upd") > F.col("captured")))
    return rows.filter(bad).select("relation", "captured", F.lit("IrreversibleChange").alias("refused"))


def check_column_coverage(images: DataFrame, required: Iterable[str], keys: Iterable[str]) -> DataFrame:
    """Pre-images (keys, columns array<string>) that lack a written column; none declared means that an image may not be empty."""
    need = [c for c in required if c not in set(keys)]
    missing = F.array_except(F.lit(need), F.col("columns")) if need else F.when(F.size("columns") == 0, F.array(F.lit("*"))).otherwise(F.array().cast("array<string>"))
    return images.withColumn("missing", missing).filter(F.size("missing") > 0)


def check_blast(blast: DataFrame, target: str) -> DataFrame:
    """One row with what an approval needs of its blast radius."""
    mine = F.col("relation") == target
    rows = blast.agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.bool_or(mine), F.lit(False)).alias("has_target"), F.coalesce(F.bool_or(mine & F.col("keyed")), F.lit(False)).alias("target_keyed"),
        F.coalesce(F.sum(F.col("ins") + F.col("upd") + F.col("del")), F.lit(0)).alias("total_rows"), F.coalesce(F.bool_and(mine | F.col("keyed")), F.lit(True)).alias("cascades_keyed"),
    )
    reason = (
        F.when(F.col("n") == 0, "NO_BLAST_RADIUS").when(~F.col("has_target"), "TARGET_MISSING").when(~F.col("target_keyed"), "TARGET_NOT_KEYED")
        .when(F.col("total_rows") == 0, "EMPTY_FOOTPRINT").when(~F.col("cascades_keyed"), "CASCADE_NOT_KEYED")
    )
    return rows.select(reason.alias("refused"), "total_rows")


def build_inverse(tables: Tables, catalog: Catalog, write: Write, gone: Tables | None = None) -> tuple[DataFrame, Tables]:
    """The plan (relation, kind, fk_order, caveat), parents first, and each relation's pre-images. ``gone``: the closure, where it is known already."""
    spark = tables[write.relation].sparkSession
    keys = catalog.keys
    if write.kind == "UPDATE":
        images = {write.relation: capture_preimage(tables[write.relation], write.predicate, keys[write.relation], write.assignments)}
        order, kind = [write.relation], "PREIMAGE_UPSERT"
    else:
        found = cascade_closure(tables, catalog, write.relation, write.predicate) if gone is None else gone
        order, kind = list(found), "INSERT"
        images = {name: capture_preimage(tables[name], rows, keys.get(name, ())) for name, rows in found.items()}
    plan = [(name, kind, i, "tables derived downstream, surrogate ids and notifications already sent are not restored") for i, name in enumerate(order)]
    return spark.createDataFrame(plan, "relation string, kind string, fk_order int, caveat string"), images


def revert_update(df: DataFrame, preimage: DataFrame, keys: Iterable[str]) -> DataFrame:
    """The captured columns back in place, nulls included; rows that are gone stay gone."""
    keys = list(keys)
    columns = preimage.schema["before"].dataType.names
    joined = df.join(preimage.withColumn("_was", F.lit(True)), keys, "left")
    return joined.select(*[F.when(F.col("_was"), F.col(f"before.{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in df.columns])


def revert_delete(tables: Tables, preimages: Tables, order: list[str]) -> Tables:
    """The relations with the deleted rows back in them, parents first."""
    return {name: tables[name].unionByName(preimages[name].select("before.*")) for name in order}


def check_restored(tables: Tables, catalog: Catalog, order: list[str]) -> DataFrame:
    """What forbids publishing a restored state: key collisions and children without parents."""
    out = []
    for name in order:
        keys = catalog.keys.get(name)
        if keys:
            out.append(check_pk(tables[name], keys).filter("reason IS NOT NULL").select(F.lit(name).alias("relation"), "reason", "n"))
        for fk in [f for f in catalog.foreign_keys if f.child == name and f.parent in tables]:
            lost = orphans(tables[name], tables[fk.parent], fk.columns, catalog.keys[fk.parent])
            out.append(lost.agg(F.count(F.lit(1)).alias("n")).filter("n > 0").select(F.lit(name).alias("relation"), F.lit("MISSING_PARENT").alias("reason"), "n"))
    return functools.reduce(DataFrame.unionByName, out)


def route_preimages(rows: DataFrame, plan: DataFrame, target: str) -> DataFrame:
    """The relation of each mixed pre-image row (__relation, or the target), refused if the plan lacks it or the image is empty."""
    routed = rows.withColumn("relation", F.coalesce("__relation", F.lit(target)))
    known = plan.select("relation", F.lit(True).alias("_known")).distinct()
    reason = F.when(F.col("_known").isNull(), "MalformedInverse").when(F.col("before").isNull(), "MalformedRow")
    return routed.join(known, "relation", "left").withColumn("refused", reason).drop("_known", "__relation")


def revert_report(restored: DataFrame, plan: DataFrame) -> DataFrame:
    """Restored rows (relation) counted in the plan's order, 0 where there are none."""
    counts = restored.groupBy("relation").agg(F.count(F.lit(1)).alias("restored"))
    return plan.select("relation", "fk_order").join(counts, "relation", "left").select("relation", "fk_order", F.coalesce("restored", F.lit(0)).alias("restored"))


def check_constraints(tables: Tables, catalog: Catalog, not_null: dict[str, list[str]]) -> DataFrame:
    """Violations of keys, foreign keys and not-null columns."""
    out = [check_restored(tables, catalog, list(tables))]
    for name, columns in not_null.items():
        for c in columns:
            out.append(tables[name].agg(F.count_if(F.col(c).isNull()).alias("n")).filter("n > 0").select(F.lit(name).alias("relation"), F.lit(f"NULL_{c}").alias("reason"), "n"))
    return functools.reduce(DataFrame.unionByName, out)


def actual_effects(before: Tables, after: Tables, catalog: Catalog, meant: Tables | None = None) -> DataFrame:
    """Operation counts by comparing versions: by key where there is one, else by whole rows. ``meant`` holds the keys that a write
    was meant to touch, by relation; it makes the comparison cheaper, never blind to other rows."""
    from ..operators.snapshot import changed_rows, counted_changes, op_counts

    out = []
    for name in after:
        keys = catalog.keys.get(name)
        if keys and meant is not None and name in meant:
            out.append(counted_changes(before[name], after[name], list(keys), meant[name], name))
        elif keys:
            out.append(op_counts(changed_rows(before[name], after[name], list(keys)), name))
        else:
            gone, came = (x.exceptAll(y).agg(F.count(F.lit(1)).alias(n)) for x, y, n in ((before[name], after[name], "del"), (after[name], before[name], "ins")))
            out.append(gone.join(came).select(F.lit(name).alias("relation"), "ins", F.lit(0).cast("long").alias("upd"), "del"))
    return functools.reduce(DataFrame.unionByName, out)


def changed_bytes(before: Tables, after: Tables, images: Tables, catalog: Catalog, write: Write) -> DataFrame:
    """Bytes of what was really changed: the deleted rows, or the updated rows as they were and as they are."""
    out = []
    for name, image in images.items():
        if write.kind == "UPDATE":
            keys = list(catalog.keys[name])
            rows = functools.reduce(DataFrame.unionByName, [t[name].join(image.select(*keys), keys, "left_semi") for t in (before, after)])
        else:
            rows = image.select("before.*")
        out.append(rows.agg(F.coalesce(F.sum(size_of(rows, rows.columns)), F.lit(0)).alias("changed_bytes")).select(F.lit(name).alias("relation"), "changed_bytes"))
    return functools.reduce(DataFrame.unionByName, out)


def written_columns(write: Write) -> list[str]:
    return list(write.assignments) if write.kind == "UPDATE" else []


def guarded_apply(tables: Tables, catalog: Catalog, write: Write, blast: DataFrame, cap: DataFrame, base: str, captured: Tables | None = None) -> dict[str, str]:
    """Certify, predicate, prechecks, capture, forward, reconcile, cap, coverage, publish; the first failure raises and nothing is published.

    Returns the paths of the published versions. Pre-images and new versions are written before anything is compared, so a later
    step never reads a table that an earlier one has changed; the staged versions are what gets published. ``captured``: pre-images
    that were taken before (by relation, as ``capture_preimage`` makes them); they must hold every written row and column.
    """
    from ..operators.logs import certify
    from ..sources.versions import publish_paths, stage, stage_path

    def first(df: DataFrame, what: str) -> None:
        row = df.filter(F.col(what).isNotNull()).select(what).first()
        if row:
            raise Refused(row[0])

    spark, mine = tables[write.relation].sparkSession, catalog.keys.get(write.relation)
    blast = stage(blast, f"{base}/_blast")
    asked = spark.createDataFrame([(write.kind, bool(mine), captured is None or write.relation in captured, False)], "kind string, has_pk boolean, has_preimage boolean, volatile_default boolean")
    first(certify(asked), "refused")
    if reason := guard_predicate(tables[write.relation], write.predicate, mine):
        raise Refused(reason)
    first(check_blast(blast, write.relation), "refused")
    first(check_cap(blast, blast.limit(0), cap), "refused")
    first(check_pk(tables[write.relation], mine), "reason")
    gone = None
    if write.kind == "DELETE":
        gone = {name: stage(rows, f"{base}/_gone/{name}") for name, rows in cascade_closure(tables, catalog, write.relation, write.predicate).items()}
    written = gone or {write.relation: tables[write.relation].filter(holds(write.predicate))}
    images = captured if captured is not None else build_inverse(tables, catalog, write, gone)[1]
    images = {name: stage(df, f"{base}/_preimages/{name}") for name, df in images.items()}
    for name, rows in written.items():
        keys = list(catalog.keys.get(name, ()))
        if not keys:
            raise Refused("CASCADE_NOT_KEYED")
        image = images.get(name, rows.limit(0))
        if not missing_preimages(rows.select(*keys), image, keys).isEmpty():
            raise Refused("IrreversibleChange")
        if name in images:
            had = images[name].schema["before"].dataType.names
            need = written_columns(write) or [c for c in tables[name].columns if c not in keys]
            first(check_column_coverage(images[name].select(*keys, F.lit(had).alias("columns")), need, keys).select(F.lit("MissingPreImageColumn").alias("refused")), "refused")
    if write.kind == "UPDATE":
        new = {write.relation: apply_update(tables[write.relation], write.predicate, write.assignments, mine)}
    else:
        new = apply_delete(tables, catalog, write.relation, write.predicate, gone)
    paths = {name: stage_path(df, f"{base}/_staged/{name}") for name, df in new.items()}
    new = {name: spark.read.schema(new[name].schema).parquet(path) for name, path in paths.items()}
    actual = actual_effects(tables, new, catalog, {name: images[name] for name in new if name in images})
    if write.kind == "UPDATE":  # an update that changes nothing still writes
        actual = actual.withColumn("upd", F.lit(images[write.relation].count()))
    actual = stage(actual.join(changed_bytes(tables, new, images, catalog, write), "relation", "left").withColumn("changed_bytes", F.coalesce("changed_bytes", F.lit(0))), f"{base}/_actual")
    first(reconcile(blast, actual, write.relation, write.kind), "refused")
    first(check_cap(blast, actual, cap), "refused")
    counts = functools.reduce(DataFrame.unionByName, [df.agg(F.count(F.lit(1)).alias("captured")).select(F.lit(name).alias("relation"), "captured") for name, df in images.items()])
    first(check_row_coverage(actual, counts, write.relation), "refused")
    return publish_paths(spark, paths, base)
