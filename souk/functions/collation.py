"""Text equality of the reference's database: case, accents and trailing blanks do not count.

Comparing and grouping collated columns row by row would work out a collation key for every
row. A column has far fewer spellings than rows, so the engine's collation decides once per
distinct spelling which of them are equal; every row's text is then replaced by one spelling
of its class, by an ordinary join on the text as it is, and all operators go on with plain
strings. A spelling that very many rows share is one row of the grouping (combined
map-side), and the join is of a size the engine knows (it broadcasts small lists and splits
hot texts of large ones).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souk.sources.staging import stage

#: Unicode order without case, accents and trailing blanks (leading blanks count).
COLLATION = "UNICODE_CI_AI_RTRIM"


def spellings(values: DataFrame, declared: Sequence[str] = (), collation: str = COLLATION) -> DataFrame:
    """spelling, canonical: for every distinct text of the one column of ``values`` the
    spelling that stands for its class: a declared one, else the least in byte order. NULL
    has no row."""
    (column,) = values.columns
    found = values.select(F.col(column).alias("spelling")).filter("spelling IS NOT NULL").distinct()
    key = F.collate("spelling", collation)
    named = found.select("spelling", F.lit(None).cast("string").alias("wanted"))
    if declared:
        spark = values.sparkSession
        named = named.unionAll(spark.createDataFrame([(d, d) for d in declared], "spelling string, wanted string"))
    classes = (named.groupBy(key.alias("class"))
               .agg(F.coalesce(F.min("wanted"), F.min("spelling")).alias("canonical")))
    return (found.withColumn("class", key).join(classes, "class")
            .select("spelling", "canonical"))


def unify(tables: dict[str, DataFrame], columns: Sequence[tuple[str, str]], declared: Sequence[str] = (),
          collation: str = COLLATION) -> dict[str, DataFrame]:
    """The tables with one spelling per class in the given (table, column)s, which share
    their spellings: texts of different tables that are equal stay equal."""
    values = None
    for table, column in columns:
        part = tables[table].select(F.col(column).alias("value"))
        values = part if values is None else values.unionAll(part)
    known = spellings(values, declared, collation)
    changed = stage(known.filter("spelling != canonical"), "spellings")
    out = dict(tables)
    for table, column in columns:
        names = out[table].columns
        out[table] = (out[table].join(changed.withColumnRenamed("spelling", column), column, "left")
                      .withColumn(column, F.coalesce("canonical", column)).select(*names))
    return out


def collate_tables(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The text columns that the analyses compare or group: statuses (towards the status
    that they filter on), states and categories."""
    from souk.operators.semantic import DELIVERED

    out = unify(tables, [("orders", "order_status")], [DELIVERED])
    out = unify(out, [("customers", "customer_state"), ("sellers", "seller_state")])
    return unify(out, [("products", "product_category_name"),
                       ("product_category_name_translation", "product_category_name")])
