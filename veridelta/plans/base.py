"""Plain relational smoke queries over the star schema."""

from pyspark.sql import functions as F

from veridelta.plans.registry import query, table


@query(
    "order_totals",
    """SELECT o_orderstatus, count(*) AS n_orders, round(sum(CAST(o_totalprice AS DOUBLE)), 2) AS total
       FROM orders GROUP BY o_orderstatus""",
)
def order_totals(spark, sf_dir):
    return (
        table(spark, sf_dir, "orders")
        .groupBy("o_orderstatus")
        .agg(
            F.count("*").alias("n_orders"),
            F.round(F.sum(F.col("o_totalprice").cast("double")), 2).alias("total"),
        )
    )
