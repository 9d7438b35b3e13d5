"""References between records: scans for orphans, placeholders, broken category trees, duplicate names."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """child.column holds ids of parent."""

    child: str
    column: str
    parent: str


#: The ledger model's references, in scanning order.
RULES = (
    Rule("account", "ledger_id", "ledger"),
    Rule("account", "repay_account_id", "account"),
    Rule("category", "ledger_id", "ledger"),
    Rule("category", "parent_id", "category"),
    Rule("tag", "ledger_id", "ledger"),
    Rule("txn", "ledger_id", "ledger"),
    Rule("txn", "account_id", "account"),
    Rule("txn", "to_account_id", "account"),
    Rule("txn", "category_id", "category"),
    Rule("budget", "ledger_id", "ledger"),
    Rule("budget", "category_id", "category"),
    Rule("attachment", "ledger_id", "ledger"),
    Rule("attachment", "txn_id", "txn"),
)
#: What orders fixes in a report.
FIX_ORDER = ["entity", "record_id", "column", "kind"]
#: Fixed value: parents that are followed before a category counts as nested too deeply.
MOST_STEPS = 8


def spread(key: Column, by: Column) -> Column:
    """0 for a key, and one of many numbers for a null one: a second join key, gathered() on the other side, so that rows
    that can't match anything don't meet in one task."""
    return F.when(key.isNull(), F.pmod(F.xxhash64(by), F.lit(4096)).cast("int") + 1).otherwise(0)


def gathered(key: Column) -> Column:
    """0, as a hash: a constant would be moved out of the join's keys."""
    return F.pmod(F.xxhash64(key), F.lit(1)).cast("int")


def orphan_rows(child: DataFrame, parent: DataFrame, column: str, strict: bool = False) -> DataFrame:
    """Rows whose reference names no parent; tombstones count as parents. A null reference is none, but if strict, and
    there is no parent at all, it is an orphan, as SQL's NOT IN has it."""
    ids = parent.select(F.col("id").alias("_parent")).distinct()
    out = child.where(F.col(column).isNotNull()).join(ids, F.col(column) == F.col("_parent"), "left_anti")
    if not strict:
        return out
    some = parent.select(F.lit(1).alias("_some")).limit(1)
    return out.unionByName(child.where(F.col(column).isNull()).join(some, F.lit(True), "left_anti"))


def orphans(tables: dict[str, DataFrame], rules: tuple[Rule, ...] = RULES, touched: set[str] | None = None, strict: bool = False) -> DataFrame:
    """(rule, n) for every rule whose tables and column are given; touched limits the scan to those child tables.

    Each child table is scanned once: its references, of which the null ones are left out first, are counted by value
    with partial sums, so that a parent that a third of all rows name is one row, and the values meet each parent's ids
    in one join.
    """
    given = [r for r in rules if r.child in tables and r.parent in tables and r.column in tables[r.child].columns and (touched is None or r.child in touched)]
    if not given:
        raise ValueError("no rule applies to these tables")
    name = lambda r: F.lit(f"{r.child}.{r.column}")
    counts = None
    for parent in dict.fromkeys(r.parent for r in given):
        named = None
        for child in dict.fromkeys(r.child for r in given if r.parent == parent):
            refs = [F.struct(name(r).alias("rule"), F.col(r.column).cast("string").alias("ref")) for r in given if (r.child, r.parent) == (child, parent)]
            part = tables[child].select(F.explode(F.array(*refs)).alias("x")).select("x.rule", "x.ref").where("ref is not null")
            named = part if named is None else named.unionByName(part)
        ids = tables[parent].select(F.col("id").cast("string").alias("ref")).distinct()
        lost = named.groupBy("rule", "ref").agg(F.count("*").alias("n")).join(ids, "ref", "left_anti").groupBy("rule").agg(F.sum("n").alias("n"))
        counts = lost if counts is None else counts.unionByName(lost)
    if strict:
        for r in given:
            empty = tables[r.parent].limit(1).count() == 0
            if empty:
                counts = counts.unionByName(tables[r.child].where(F.col(r.column).isNull()).agg(F.count("*").alias("n")).select(name(r).alias("rule"), "n"))
    spark = next(iter(tables.values())).sparkSession
    every = spark.createDataFrame([(f"{r.child}.{r.column}",) for r in given], "rule string")
    return every.join(counts.groupBy("rule").agg(F.sum("n").alias("n")), "rule", "left").select("rule", F.coalesce("n", F.lit(0)).alias("n"))


#: References that a missing parent is made up for, as (child, column, parent).
REPAIRED = (("account", "repay_account_id", "account"), ("txn", "account_id", "account"), ("txn", "category_id", "category"), ("txn", "to_account_id", "account"), ("budget", "category_id", "category"))


def missing_parents(incoming: dict[str, DataFrame], known: dict[str, DataFrame]) -> DataFrame:
    """(parent, ref, entity, record_id, column, ledger_id, currency, income, stage) of incoming records' references to
    accounts and categories that neither known (id) nor the incoming records have. Null references are left out before
    anything is joined."""
    parts = None
    for stage, child in enumerate(dict.fromkeys(c for c, _, _ in REPAIRED)):
        if child not in incoming:
            continue
        df = incoming[child]
        text = lambda c: F.col(c).cast("string") if c in df.columns else F.lit(None).cast("string")  # noqa: B023, E731
        refs = [F.struct(F.lit(p).alias("parent"), F.lit(c).alias("column"), F.col(c).cast("string").alias("ref")) for k, c, p in REPAIRED if k == child and c in df.columns]
        if not refs:
            continue
        income = (F.col("type") == 2) if child == "txn" else F.lit(False)
        rows = df.select(F.explode(F.array(*refs)).alias("x"), F.lit(child).alias("entity"), text("id").alias("record_id"), text("ledger_id").alias("ledger_id"), text("currency").alias("currency"), income.alias("income"), F.lit(stage).alias("stage"))
        rows = rows.select("x.parent", "x.ref", "entity", "record_id", "x.column", "ledger_id", "currency", "income", "stage").where("ref is not null")
        parts = rows if parts is None else parts.unionByName(rows)
    if parts is None:
        spark = next(iter(incoming.values())).sparkSession
        return spark.createDataFrame([], "parent string, ref string, entity string, record_id string, column string, ledger_id string, currency string, income boolean, stage int")
    ids = None
    for parent in ("account", "category"):
        for df in (known.get(parent), incoming.get(parent)):
            if df is not None:
                part = df.select(F.lit(parent).alias("parent"), F.col("id").cast("string").alias("ref"))
                ids = part if ids is None else ids.unionByName(part)
    return parts if ids is None else parts.join(ids, ["parent", "ref"], "left_anti")


def _common(device_id: str, at_ms: int) -> list[Column]:
    at = F.lit(at_ms).cast("long")
    return [at.alias("created_at"), at.alias("updated_at"), F.lit(None).cast("long").alias("deleted_at"), F.lit(device_id).alias("device_id"), F.lit(1).cast("long").alias("rev")]


def _none(*names: str, kind: str = "string") -> list[Column]:
    return [F.lit(None).cast(kind).alias(n) for n in names]


def made_up(lost: DataFrame, parent: str, device_id: str, at_ms: int) -> DataFrame:
    """Complete placeholder rows of a parent table for missing_parents(), one an id, after its first reference by stage,
    record (numbers as such) and column: an archived account in that currency, or a hidden category of that direction,
    whose name ends with the id's last eight characters."""
    first = lost.where(F.col("parent") == parent).groupBy("ref").agg(F.min(F.struct("stage", F.col("record_id").try_cast("long").alias("number"), "record_id", "column", "ledger_id", "currency", "income")).alias("f"))
    number = lambda n, c: F.lit(n).cast("long").alias(c)
    key = F.col("ref")
    head = [key.alias("id"), F.col("f.ledger_id").alias("ledger_id")]
    if parent == "account":
        own = [F.lit("missing account").alias("name"), number(1, "type"), F.coalesce("f.currency", F.lit("CNY")).alias("currency"), number(0, "opening_balance_minor"), *_none("credit_limit_minor", "statement_day", "due_day", kind="long"), *_none("repay_account_id", "icon", "color"), number(1, "is_archived"), number(0, "sort_order"), F.lit("made by an import: merge it into the account that is meant").alias("note")]
    else:
        own = [*_none("parent_id"), F.when(F.col("f.income"), 2).otherwise(1).cast("long").alias("kind"), F.concat(F.lit("missing "), F.when(F.length(key) > 8, F.right(key, F.lit(8))).otherwise(key)).alias("name"), *_none("icon", "color"), number(0, "is_system"), number(1, "is_hidden"), number(0, "sort_order")]
    return first.select(*head, *own, *_common(device_id, at_ms))


def placeholder_accounts(txns: DataFrame, accounts: DataFrame, device_id: str, at_ms: int) -> DataFrame:
    """An archived account for every id that transactions or repayments name and nobody has."""
    return _typed(made_up(missing_parents({"txn": txns, "account": accounts}, {}), "account", device_id, at_ms), accounts.select("id"), txns)


def placeholder_categories(txns: DataFrame, categories: DataFrame, device_id: str, at_ms: int, budgets: DataFrame | None = None) -> DataFrame:
    """A hidden category for every id that transactions or budgets name and nobody has; income if its first reference is
    an income's."""
    incoming = {"txn": txns} if budgets is None else {"txn": txns, "budget": budgets}
    return _typed(made_up(missing_parents(incoming, {"category": categories}), "category", device_id, at_ms), categories.select("id"), txns)


def _typed(rows: DataFrame, parents: DataFrame, children: DataFrame) -> DataFrame:
    """rows with ids of the types that the tables have."""
    kinds = {"id": dict(parents.dtypes)["id"], "ledger_id": dict(children.dtypes)["ledger_id"]}
    return rows.select(*[F.col(c).cast(kinds.get(c, t)).alias(c) for c, t in rows.dtypes])


def repaired(incoming: dict[str, DataFrame], state: dict[str, DataFrame], device_id: str, at_ms: int) -> tuple[dict[str, DataFrame], dict[str, DataFrame], DataFrame]:
    """Incoming records with broken category parents set to null, placeholder rows by table, and the fixes made:
    (entity, record_id, column, kind, reason, referenced_id, placeholder_name). Local records are not touched."""
    lost = missing_parents(incoming, state)
    made = {p: made_up(lost, p, device_id, at_ms) for p in ("account", "category") if p in state}
    names = None
    for parent, rows in made.items():
        part = rows.select(F.lit(parent).alias("parent"), F.col("id").alias("ref"), F.col("name").alias("placeholder_name"))
        names = part if names is None else names.unionByName(part)
    fixes = None
    if names is not None:
        kind = F.concat(F.lit("placeholder_"), F.col("parent"))
        fixes = lost.join(names, ["parent", "ref"]).select("entity", "record_id", "column", kind.alias("kind"), F.lit("missing").alias("reason"), F.col("ref").alias("referenced_id"), "placeholder_name")
    out = dict(incoming)
    if "category" in incoming and "category" in state:
        own = incoming["category"]
        columns = [c for c in ("id", "parent_id", "deleted_at", "ledger_id", "kind", "name") if c in own.columns and c in state["category"].columns]
        local = state["category"].select(*columns)
        merged = own.select(*columns).unionByName(local.join(own.select("id"), "id", "left_anti"))
        broken = promotions(merged).join(own.select("id"), "id", "left_semi")
        up = broken.select(F.lit("category").alias("entity"), F.col("id").cast("string").alias("record_id"), F.lit("parent_id").alias("column"), F.lit("promote_to_root").alias("kind"), "reason", F.col("parent_id").cast("string").alias("referenced_id"), F.lit(None).cast("string").alias("placeholder_name"))
        fixes = up if fixes is None else fixes.unionByName(up)
        bad = broken.select(F.col("id").alias("_bad"))
        out["category"] = own.join(bad, F.col("id") == F.col("_bad"), "left").withColumn("parent_id", F.when(F.col("_bad").isNull(), F.col("parent_id"))).drop("_bad")
        if {"ledger_id", "kind", "name"} <= set(columns):
            l = local.where("deleted_at is null and parent_id is not null").select(F.col("id").alias("_id"), *[F.col(c).alias(f"_{c}") for c in ("ledger_id", "kind", "name", "parent_id")])  # noqa: E741
            same = [F.col(c) == F.col(f"_{c}") for c in ("ledger_id", "kind", "name", "parent_id")]
            twins = out["category"].where("parent_id is not null").join(l, [*same, F.col("id") != F.col("_id")]).groupBy("id").agg(F.min("_id").alias("twin"))
            fixes = fixes.unionByName(twins.select(F.lit("category"), F.col("id").cast("string"), F.lit("name"), F.lit("duplicate_name"), F.lit("duplicate_name"), F.col("twin").cast("string"), F.lit(None).cast("string")).toDF(*fixes.columns))
    return out, made, fixes


def promotions(categories: DataFrame, most_steps: int = MOST_STEPS) -> DataFrame:
    """(id, parent_id, reason) of categories that must become roots: missing, deleted, cycle or too_deep.

    Parents are followed by at most `most_steps` joins on the original links of live categories; a chain that comes back
    to its start, or to any category before it, is a cycle. A chain that goes on beyond is too deep. Chains that are
    settled have no next parent; their null keys are spread over all tasks.
    """
    up = categories.select(F.col("id").alias("_p"), F.when(F.col("deleted_at").isNull(), F.col("parent_id")).alias("_pp"), F.col("deleted_at").isNotNull().alias("_pd"))
    kids = categories.where("parent_id is not null").select("id", "parent_id")
    known = kids.join(up, F.col("parent_id") == F.col("_p"), "left")
    direct = F.when(F.col("parent_id") == F.col("id"), "cycle").when(F.col("_p").isNull(), "missing").when(F.col("_pd"), "deleted")
    walk = known.select("id", "parent_id", direct.alias("reason"), F.col("_pp").alias("next"), F.array("id", "parent_id").alias("path"))
    above = up.select(F.col("_p").alias("step"), gathered(F.col("_p")).alias("_spread"), F.col("_pp").alias("next"))
    for _ in range(most_steps - 1):
        walk = walk.withColumn("reason", F.coalesce("reason", F.when(F.array_contains("path", F.col("next")), "cycle")))
        walk = walk.withColumn("step", F.when(F.col("reason").isNull(), F.col("next"))).drop("next")
        walk = walk.withColumn("path", F.when(F.col("step").isNotNull(), F.concat("path", F.array("step"))).otherwise(F.col("path")))
        walk = walk.withColumn("_spread", spread(F.col("step"), F.col("id"))).join(above, ["step", "_spread"], "left").drop("step", "_spread")
    end = F.when(F.array_contains("path", F.col("next")), "cycle").when(F.col("next").isNotNull(), "too_deep")
    return walk.select("id", "parent_id", F.coalesce("reason", end).alias("reason")).where("reason is not null")


def promote(categories: DataFrame, most_steps: int = MOST_STEPS) -> DataFrame:
    """categories with broken parents set to null."""
    broken = promotions(categories, most_steps).select(F.col("id").alias("_broken"))
    out = categories.join(broken, F.col("id") == F.col("_broken"), "left")
    return out.withColumn("parent_id", F.when(F.col("_broken").isNull(), F.col("parent_id"))).drop("_broken")


def duplicate_names(categories: DataFrame, roots: bool = False) -> DataFrame:
    """(ledger_id, kind, parent_key, name, n) of names that live siblings share; roots only if asked for."""
    rows = categories.where("deleted_at is null")
    rows = rows if roots else rows.where("parent_id is not null")
    return rows.groupBy("ledger_id", "kind", F.coalesce("parent_id", F.lit("")).alias("parent_key"), "name").agg(F.count("*").alias("n")).where("n > 1")


def fix_report(fixes: DataFrame) -> DataFrame:
    """Fixes in the order of a report."""
    return fixes.orderBy(*FIX_ORDER)
