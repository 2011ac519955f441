"""Seeded generators of a retail star schema; every value is a function of the row's number and the seed."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import Warehouse

#: Rows of the dimensions.
ROWS = {"date_dim": 2190, "item": 5000, "customer": 20000, "customer_address": 15000, "customer_demographics": 1920, "household_demographics": 7200, "store": 50, "promotion": 200, "time_dim": 1440}
FACTS = ("store_sales", "store_returns", "catalog_sales")


def pick(seed: int, salt: str, n: int) -> Column:
    """A number from 0 to n - 1, the same for the same row wherever it is computed."""
    return F.pmod(F.xxhash64(F.col("id"), F.lit(seed), F.lit(salt)), F.lit(n))


def price(seed: int, salt: str, top: int) -> Column:
    return F.floor(pick(seed, salt, top * 100) + 0.5) / 100


def dimension(spark: SparkSession, name: str, seed: int = 1) -> DataFrame:
    sk = F.col("id") + 1
    day = F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int"))
    columns = {
        "date_dim": {"d_date_sk": sk, "d_date": day, "d_year": F.year(day), "d_moy": F.month(day), "d_dom": F.dayofmonth(day), "d_dow": F.dayofweek(day) - 1},
        "time_dim": {"t_time_sk": sk, "t_hour": F.floor(F.col("id") / 60).cast("int"), "t_minute": (F.col("id") % 60).cast("int")},
        "item": {"i_item_sk": sk, "i_brand_id": pick(seed, "brand", 1000), "i_manufact_id": pick(seed, "manufact", 200), "i_category": F.concat(F.lit("category"), pick(seed, "cat", 10).cast("string")), "i_current_price": price(seed, "price", 300)},
        "customer": {"c_customer_sk": sk, "c_current_addr_sk": pick(seed, "addr", ROWS["customer_address"]) + 1, "c_current_cdemo_sk": pick(seed, "cd", ROWS["customer_demographics"]) + 1, "c_customer_id": F.format_string("C%016d", sk)},
        "customer_address": {"ca_address_sk": sk, "ca_state": F.concat(F.lit("S"), pick(seed, "state", 50).cast("string")), "ca_zip": F.lpad(pick(seed, "zip", 99999).cast("string"), 5, "0")},
        "customer_demographics": {"cd_demo_sk": sk, "cd_gender": F.when(pick(seed, "g", 2) == 0, "M").otherwise("F"), "cd_education_status": F.concat(F.lit("edu"), pick(seed, "edu", 7).cast("string"))},
        "household_demographics": {"hd_demo_sk": sk, "hd_dep_count": pick(seed, "dep", 10).cast("int"), "hd_vehicle_count": pick(seed, "veh", 5).cast("int")},
        "store": {"s_store_sk": sk, "s_store_name": F.concat(F.lit("store"), sk.cast("string")), "s_state": F.concat(F.lit("S"), pick(seed, "sst", 50).cast("string"))},
        "promotion": {"p_promo_sk": sk, "p_channel_email": F.when(pick(seed, "em", 2) == 0, "N").otherwise("Y")},
    }[name]
    return spark.range(ROWS[name]).select(*[c.alias(n) for n, c in columns.items()])


def fact_batch(spark: SparkSession, name: str, rows: int, batch: int, seed: int = 1) -> DataFrame:
    """One batch of a fact table; the same batch number gives the same rows."""
    s, p = seed * 1_000_003 + batch, {"store_sales": "ss", "store_returns": "sr", "catalog_sales": "cs"}[name]
    home = ("store", 50) if name != "catalog_sales" else ("call_center", 10)
    columns = {
        "sold_date_sk": pick(s, "date", ROWS["date_dim"]) + 1, "item_sk": pick(s, "item", ROWS["item"]) + 1, "customer_sk": pick(s, "customer", ROWS["customer"]) + 1, f"{home[0]}_sk": pick(s, home[0], home[1]) + 1,
        "ticket_number": F.lit(batch * 10**6) + F.col("id"), "quantity": (pick(s, "qty", 100) + 1).cast("int"), "sales_price": price(s, "price", 200), "ext_sales_price": price(s, "ext", 20000), "net_profit": price(s, "profit", 5000) - 1000,
    }
    return spark.range(rows).select(*[c.alias(f"{p}_{n}") for n, c in columns.items()])


def stream_batches(spark: SparkSession, wh: Warehouse, idents: dict[str, tuple[str, str]], batches: int, rows: dict[str, int] | None = None, seed: int = 1) -> Iterator[str]:
    """Append batches to the fact tables in turn, as a micro-batch writer would."""
    for b in range(batches):
        name = FACTS[b % len(FACTS)]
        if name in idents:
            wh.append(idents[name], fact_batch(spark, name, (rows or {}).get(name, 500), b, seed))
            yield name


def burst_waits(n: int, per_minute: float, seed: int = 1, burst: int = 10, longest: float = 30.0) -> list[float]:
    """Seconds to wait before each of n commits: bursts, and exponential quiet times of at most `longest` between them."""
    import random

    rng = random.Random(seed)
    return [min(longest, rng.expovariate(per_minute / 60 / burst)) if i % burst == 0 else 0.0 for i in range(n)]
