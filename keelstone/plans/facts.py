"""Fact loads: stage, look up or validate, key, measure."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelstone.operators.columns import UNKNOWN_KEY, any_null, null_keys_to_unknown
from keelstone.operators.dedupe import first_per_key, latest_per_key
from keelstone.operators.joins import keyed_join
from keelstone.operators.keys import assign_surrogate_keys, number_rows
from keelstone.operators.lookup import Lookup, lookup, lookup_many
from keelstone.operators.merge import merge

MONEY = "decimal(19,4)"


def stage_order_lines(orders: DataFrame, lines: DataFrame, products: DataFrame) -> DataFrame:
    """Order lines with their order's customer and their product's category and price."""
    head = orders.select(F.col("o_orderkey").alias("orderid"), F.col("o_custkey").alias("custid"))
    line = lines.select(
        F.col("l_orderkey").alias("orderid"),
        F.col("l_linenumber").alias("linenumber"),
        F.col("l_partkey").alias("productid"),
        F.col("l_suppkey").alias("supplierid"),
        F.col("l_quantity").cast("smallint").alias("qty"),
        F.col("l_discount").cast("decimal(4,3)").alias("discount"),
    )
    product = products.select(
        F.col("p_partkey").alias("productid"),
        F.col("p_type").alias("categoryid"),
        F.col("p_retailprice").cast(MONEY).alias("unitprice"),
    )
    # A product or an order may hold a large share of the lines.
    return keyed_join(keyed_join(line, product, ["productid"], "inner"), head, ["orderid"], "inner")


def with_total(fact: DataFrame, quantity: str = "qty", price: str = "unitprice", name: str = "total_amount") -> DataFrame:
    """Add quantity x price, multiplied as decimals and cast back to money."""
    amount = F.col(quantity).cast("decimal(10,0)") * F.col(price).cast(MONEY)
    return fact.withColumn(name, amount.cast(MONEY))


def fact_load(
    staged: DataFrame,
    lookups: Sequence[Lookup],
    business_keys: Sequence[str],
    sk: str,
    target: DataFrame | None = None,
    newest_by: str | None = None,
) -> DataFrame:
    """Staged lines -> fact rows.

    NULL foreign keys that go to a defaulting lookup become the unknown key first, so
    they can be part of the business key. Lines are reduced to one per business key,
    numbered in business-key order and looked up; the lookups left by then keep every line,
    so they run once, on the lines that numbering has written. With a ``target`` known lines
    keep their number and the result is the merged fact table.
    """
    defaulted = dict.fromkeys(fk for spec in lookups if spec.miss == "default" for fk in spec.on)
    lines = null_keys_to_unknown(staged, *defaulted, unknown=UNKNOWN_KEY)
    for spec in lookups:
        if spec.miss == "drop":
            lines = lookup(lines, spec)
    if newest_by:
        lines = latest_per_key(lines, business_keys, newest_by)
    else:
        lines = first_per_key(lines, business_keys)
    keeping = {str(i): spec for i, spec in enumerate(lookups) if spec.miss != "drop"}
    numbered = number_rows(lines, business_keys, sk) if target is None else assign_surrogate_keys(lines, target, business_keys, sk)
    facts = lookup_many(numbered, keeping)
    facts = facts.select(*[c for c in facts.columns if c != sk], sk)
    if target is None:
        return facts
    return merge(target, facts.filter(~any_null(business_keys)), business_keys, source_is_unique=True)
