"""Data-quality operators: constraint report (O2), missing purchase
timestamps (O4) and payment reconciliation (O5).

The reference declares keys, references and checks in its DDL and lets the
database enforce them at load. Spark enforces none, so they are measured
after loading: the rules of all tables that share a key come from one grouping
by that key, and the report is their union, one row per rule.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from souk.operators.semantic import order_payment_totals

REPORT_COLUMNS = ["table_name", "constraint_name", "kind", "violations"]


@dataclass(frozen=True)
class RowRule:
    """A rule checked row by row: NOT NULL or CHECK. ``bad`` is a SQL
    predicate, true on a violating row."""
    table: str
    name: str
    kind: str
    bad: str


@dataclass(frozen=True)
class KeyRule:
    table: str
    name: str
    columns: tuple[str, ...]


@dataclass(frozen=True)
class ReferenceRule:
    table: str
    name: str
    column: str
    parent: str
    parent_column: str


def _nn(table: str, column: str) -> RowRule:
    return RowRule(table, f"nn_{table}_{column}", "not_null", f"{column} IS NULL")


def _nonneg(*cols: str) -> str:
    return "NOT (" + " AND ".join(f"COALESCE({c}, 0) >= 0" for c in cols) + ")"


# Fixed rule set of the reference schema (names of CHECK and FOREIGN KEY
# constraints are the reference's own).
ROW_RULES = [
    _nn("customers", "customer_id"), _nn("customers", "customer_unique_id"),
    _nn("products", "product_id"),
    _nn("sellers", "seller_id"),
    _nn("product_category_name_translation", "product_category_name"),
    _nn("orders", "order_id"), _nn("orders", "customer_id"),
    _nn("order_items", "order_id"), _nn("order_items", "order_item_id"),
    _nn("order_payments", "order_id"), _nn("order_payments", "payment_sequential"),
    _nn("order_reviews", "order_id"),
    RowRule("products", "chk_products_dimensions_nonnegative", "check",
            _nonneg("product_weight_g", "product_length_cm", "product_height_cm", "product_width_cm")),
    RowRule("order_items", "chk_order_items_money_nonnegative", "check",
            _nonneg("price", "freight_value")),
    RowRule("order_payments", "chk_order_payments_values", "check",
            "NOT (COALESCE(payment_sequential, 0) > 0 AND COALESCE(payment_installments, 0) >= 0"
            " AND COALESCE(payment_value, 0) >= 0)"),
    RowRule("order_reviews", "chk_review_score_range", "check",
            "NOT (review_score IS NULL OR review_score BETWEEN 1 AND 5)"),
]

KEY_RULES = [
    KeyRule("customers", "pk_customers", ("customer_id",)),
    KeyRule("products", "pk_products", ("product_id",)),
    KeyRule("sellers", "pk_sellers", ("seller_id",)),
    KeyRule("product_category_name_translation", "pk_product_category_name_translation",
            ("product_category_name",)),
    KeyRule("orders", "pk_orders", ("order_id",)),
    KeyRule("order_items", "pk_order_items", ("order_id", "order_item_id")),
    KeyRule("order_payments", "pk_order_payments", ("order_id", "payment_sequential")),
    KeyRule("order_reviews", "pk_order_reviews", ("order_id",)),
]

REFERENCE_RULES = [
    ReferenceRule("orders", "fk_orders_customer", "customer_id", "customers", "customer_id"),
    ReferenceRule("order_items", "fk_order_items_order", "order_id", "orders", "order_id"),
    ReferenceRule("order_items", "fk_order_items_product", "product_id", "products", "product_id"),
    ReferenceRule("order_items", "fk_order_items_seller", "seller_id", "sellers", "seller_id"),
    ReferenceRule("order_payments", "fk_order_payments_order", "order_id", "orders", "order_id"),
    ReferenceRule("order_reviews", "fk_order_reviews_order", "order_id", "orders", "order_id"),
]


@dataclass(frozen=True)
class KeyGroup:
    """Rules that one grouping by a key answers: the rows of ``owned`` tables (keys and row
    rules; each has the key as first primary-key column) and the references to the first of
    them."""
    key: str
    owned: tuple[str, ...]
    references: tuple[ReferenceRule, ...]


def key_groups() -> list[KeyGroup]:
    """The tables of the reference schema by the first column of their primary key; the
    parent is the table whose whole key that column is."""
    keys = {k.table: k.columns for k in KEY_RULES}
    groups = []
    for parent in [r.parent for r in REFERENCE_RULES] + list(keys):
        column = keys[parent][0]
        if len(keys[parent]) > 1 or any(g.owned[0] == parent for g in groups):
            continue
        refs = tuple(r for r in REFERENCE_RULES if r.parent == parent)
        own = [r.table for r in refs if keys[r.table][0] == r.column]
        if not any(parent in g.owned for g in groups):
            groups.append(KeyGroup(column, (parent, *own), refs))
    return groups


def group_report(tables: Mapping[str, DataFrame], group: KeyGroup, partitions: int | None = None) -> DataFrame:
    """All rules of a group from one tagged union of its tables, grouped by the key.

    Rows of every table meet at their key with a tag: keys are counted with the rest of the
    primary key first (a repeated key has more than one row), then per key value it is
    known how many rows each table has, so references without a parent need no join. Rows
    carry their broken rules as one number of bits. Where whole primary keys are counted, rows
    are shuffled by the key once for both groupings, into ``partitions`` where that is given (enough
    of them that a grouping needs no spill); elsewhere they are combined map-side,
    so a value that very many rows share is one row a task."""
    keys = {k.table: k for k in KEY_RULES}
    rules = [r for r in ROW_RULES if r.table in group.owned]
    width = max(len(keys[t].columns) for t in group.owned) - 1
    parts = []
    for table in group.owned:
        rest = [F.col(c).cast("string") for c in keys[table].columns[1:]]
        rest += [F.lit(None).cast("string")] * (width - len(rest))
        broken = sum((F.when(F.expr(r.bad), 1 << i).otherwise(0) for i, r in enumerate(rules) if r.table == table), F.lit(0))
        parts.append((F.col(group.key), table, rest, broken))
    for r in group.references:
        if r.table not in group.owned:
            parts.append((F.col(r.column), r.name, [F.lit(None).cast("string")] * width, F.lit(0)))
    tags = [tag for _, tag, _, _ in parts]
    union = None
    for at, (key, tag, rest, broken) in enumerate(parts):
        source = tag if tag in tables else next(r.table for r in group.references if r.name == tag)
        part = tables[source].select(key.alias("__key"), F.lit(at).alias("__tag"), *[c.alias(f"__s{i}") for i, c in enumerate(rest)],
                                     broken.cast("bigint").alias("__bad"))
        union = part if union is None else union.unionAll(part)
    if width:                                             # rows meet once, both groupings are done where they lie
        union = union.repartition(*([partitions] if partitions else []), "__key")
    union = union.select("*", *[F.getbit("__bad", F.lit(i)).alias(f"c{i}") for i in range(len(rules))]).drop("__bad")
    broken = [F.sum(f"c{i}").alias(f"c{i}") for i in range(len(rules))]
    if width:                                             # count whole primary keys first
        union = union.groupBy("__key", "__tag", *[f"__s{i}" for i in range(width)]).agg(F.count(F.lit(1)).alias("__n"), *broken)
        rows, repeated = F.sum, lambda at: F.count_if((F.col("__tag") == at) & (F.col("__n") > 1))
        amount = F.col("__n")
    else:
        rows, repeated, amount = F.count, None, F.lit(1)
    count = [rows(F.when(F.col("__tag") == i, amount)).alias(f"n{i}") for i in range(len(tags))]
    if repeated is not None:
        count += [repeated(i).alias(f"pk{i}") for i in range(len(group.owned))]
    per_key = union.groupBy("__key").agg(*count, *broken)
    orphan = F.col("__key").isNotNull() & (F.coalesce(F.col("n0"), F.lit(0)) == 0)
    totals, entries = [], []
    for i, table in enumerate(group.owned):
        many = F.col(f"pk{i}") if repeated is not None else F.when(F.col(f"n{i}") > 1, 1)
        totals.append(F.sum(many))
        entries.append((table, keys[table].name, "primary_key"))
    for r in group.references:
        at = tags.index(r.table if r.table in group.owned else r.name)
        totals.append(F.sum(F.when(orphan, F.col(f"n{at}"))))
        entries.append((r.table, r.name, "foreign_key"))
    for i, r in enumerate(rules):
        totals.append(F.sum(f"c{i}"))
        entries.append((r.table, r.name, r.kind))
    one = per_key.agg(*[t.cast("bigint").alias(f"t{i}") for i, t in enumerate(totals)])
    pairs = ", ".join(f"'{t}', '{n}', '{k}', coalesce(t{i}, 0)" for i, (t, n, k) in enumerate(entries))
    return one.selectExpr(f"stack({len(entries)}, {pairs}) as ({', '.join(REPORT_COLUMNS)})")


def duplicate_keys(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Key values that occur more than once (one row per such key)."""
    return df.groupBy(*columns).count().filter(F.col("count") > 1)


def dangling_references(child: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """Non-NULL references without a parent row, one row per value with its number of
    child rows (``count``). Child rows are counted per value before the join (combined
    map-side), so a value that very many rows share is one row there."""
    keys = parent.select(F.col(parent_column).alias("__parent_key"))
    return (child.filter(F.col(column).isNotNull()).groupBy(column).count()
            .join(keys, F.col(column) == F.col("__parent_key"), "left_anti"))


def check_constraints(tables: Mapping[str, DataFrame], partitions: int | None = None) -> DataFrame:
    """O2: one row per constraint of the reference schema with the number of
    violations: NULLs in NOT NULL columns, repeated primary-key values,
    references without a parent (a NULL reference is not a violation) and
    rows failing a CHECK. Tables that share a key are grouped together once
    (:func:`group_report`), so each is read once per key it has or refers to, and only in the
    columns that rules name."""
    report = None
    for group in key_groups():
        part = group_report(tables, group, partitions)
        report = part if report is None else report.unionByName(part)
    return report


def missing_timestamp_count(orders: DataFrame) -> DataFrame:
    """Number of orders without a purchase timestamp (one row)."""
    return (orders.filter(F.col("order_purchase_timestamp").isNull())
            .agg(F.count(F.lit(1)).cast("bigint").alias("missing_timestamp_count")))


def payment_reconciliation(items: DataFrame, payments: DataFrame, tolerance: float = 1.0,
                           limit: int | None = None) -> DataFrame:
    """Orders whose items plus freight differ from their payments by
    strictly more than ``tolerance``, either sign.

    Both sides are summed per order first (instalments would otherwise
    multiply items) and then meet on ``order_id``; both aggregates are
    already partitioned by it, so the join adds no exchange. Orders lacking
    items or payments are not reported (inner join). ``limit`` keeps that many
    examples, by the size of the difference, then order id.
    """
    cost = items.groupBy("order_id").agg(
        F.sum(F.col("price") + F.col("freight_value")).alias("total_items_cost"))
    paid = order_payment_totals(payments)
    diff = F.col("total_items_cost") - F.col("total_payment")
    out = (cost.join(paid, "order_id", "inner")
           .filter(F.abs(diff) > F.lit(Decimal(str(tolerance))))
           .select("order_id",
                   F.col("total_items_cost").cast("double").alias("total_items_cost"),
                   F.col("total_payment").cast("double").alias("total_payment"),
                   diff.cast("double").alias("difference"))
           )
    if limit is None:
        return out
    return out.orderBy(F.abs(F.col("difference")).desc(), F.col("order_id")).limit(limit)
