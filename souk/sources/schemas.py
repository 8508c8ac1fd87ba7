"""Declared schemas of the nine marketplace tables.

Schemas are always declared, never inferred. Text columns are plain strings
(no CHAR padding), money and dimensions are DECIMAL(12,2), coordinates
DECIMAL(12,8) and all datetimes are zone-less ``TIMESTAMP_NTZ``.
"""

from __future__ import annotations

from pyspark.sql import types as T

S = T.StringType()
I = T.IntegerType()
MONEY = T.DecimalType(12, 2)
COORD = T.DecimalType(12, 8)
TS = T.TimestampNTZType()


def _schema(*fields: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in fields])


CUSTOMERS = _schema(
    ("customer_id", S, False),
    ("customer_unique_id", S, False),
    ("customer_zip_code_prefix", I, True),
    ("customer_city", S, True),
    ("customer_state", S, True),
)

# Column spellings follow the source CSV headers on purpose.
PRODUCTS = _schema(
    ("product_id", S, False),
    ("product_category_name", S, True),
    ("product_name_lenght", I, True),
    ("product_description_lenght", I, True),
    ("product_photos_qty", I, True),
    ("product_weight_g", MONEY, True),
    ("product_length_cm", MONEY, True),
    ("product_height_cm", MONEY, True),
    ("product_width_cm", MONEY, True),
)

SELLERS = _schema(
    ("seller_id", S, False),
    ("seller_zip_code_prefix", I, True),
    ("seller_city", S, True),
    ("seller_state", S, True),
)

CATEGORY_TRANSLATION = _schema(
    ("product_category_name", S, False),
    ("product_category_name_english", S, True),
)

GEOLOCATION = _schema(
    ("geolocation_zip_code_prefix", I, True),
    ("geolocation_lat", COORD, True),
    ("geolocation_lng", COORD, True),
    ("geolocation_city", S, True),
    ("geolocation_state", S, True),
)

ORDERS = _schema(
    ("order_id", S, False),
    ("customer_id", S, False),
    ("order_status", S, True),
    ("order_purchase_timestamp", TS, True),
    ("order_approved_at", TS, True),
    ("order_delivered_carrier_date", TS, True),
    ("order_delivered_customer_date", TS, True),
    ("order_estimated_delivery_date", TS, True),
)

ORDER_ITEMS = _schema(
    ("order_id", S, False),
    ("order_item_id", I, False),
    ("product_id", S, True),
    ("seller_id", S, True),
    ("shipping_limit_date", TS, True),
    ("price", MONEY, True),
    ("freight_value", MONEY, True),
)

ORDER_PAYMENTS = _schema(
    ("order_id", S, False),
    ("payment_sequential", I, False),
    ("payment_type", S, True),
    ("payment_installments", I, True),
    ("payment_value", MONEY, True),
)

ORDER_REVIEWS = _schema(
    ("review_id", S, True),
    ("order_id", S, False),
    ("review_score", I, True),
    ("review_comment_title", S, True),
    ("review_comment_message", S, True),
    ("review_creation_date", TS, True),
    ("review_answer_timestamp", TS, True),
)

# Table name -> schema. The names are the reference's table names and also
# the default CSV / Parquet file stems.
TABLES: dict[str, T.StructType] = {
    "customers": CUSTOMERS,
    "sellers": SELLERS,
    "products": PRODUCTS,
    "product_category_name_translation": CATEGORY_TRANSLATION,
    "geolocation": GEOLOCATION,
    "orders": ORDERS,
    "order_items": ORDER_ITEMS,
    "order_payments": ORDER_PAYMENTS,
    "order_reviews": ORDER_REVIEWS,
}
