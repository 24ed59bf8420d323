"""Generated log records: the same arguments give the same rows, on any number of tasks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the workload: environments, regions, search phrases, and message templates by level and service.
ENVS = ("prod", "prod", "prod", "staging", "dev")
REGIONS = ("us-east-1", "us-west-2", "eu-west-1", "ap-south-1")
PHRASES = ("wireless headphones", "running shoes", "coffee grinder", "phone case", "kitchen knife", "gaming mouse", "yoga mat", "backpack")
TEMPLATES = (
    ("INFO", "web-gateway", "request GET /api/orders/%ORDER% 200 in %MS%ms user=%USER%"),
    ("INFO", "web-gateway", "request POST /api/checkout 202 in %MS%ms user=%USER%"),
    ("INFO", "web-gateway", "request GET /api/products/%SKU% 200 in %MS%ms"),
    ("INFO", "checkout", "order created id=%ORDER% user=%USER% amount=%AMOUNT% USD items=%ITEMS%"),
    ("INFO", "checkout", "cart updated user=%USER% items=%ITEMS%"),
    ("INFO", "search", 'query executed q="%QUERY%" results=%RESULTS% in %MS%ms'),
    ("INFO", "payments", "payment authorized order=%ORDER% amount=%AMOUNT% card=****%CARD%"),
    ("INFO", "payments", "settlement batch closed count=%RESULTS% total=%AMOUNT%"),
    ("INFO", "inventory", "stock updated sku=%SKU% delta=%DELTA% remaining=%STOCK%"),
    ("INFO", "inventory", "warehouse sync completed sku=%SKU% at %MS%ms"),
    ("INFO", "email", "notification sent to user=%USER% template=order-confirmation"),
    ("INFO", "email", "notification sent to user=%USER% template=shipping-update"),
    ("WARN", "web-gateway", "upstream response 502 from checkout retry=%RETRY%"),
    ("WARN", "web-gateway", "request GET /api/products/%SKU% slow %MS%ms threshold_ms=200"),
    ("WARN", "search", 'slow query q="%QUERY%" %MS%ms threshold_ms=100'),
    ("WARN", "inventory", "low stock sku=%SKU% remaining=%STOCK% threshold=10"),
    ("WARN", "payments", "retryable failure order=%ORDER% code=%CODE% attempt=%RETRY%"),
    ("ERROR", "checkout", "payment gateway timeout for user=%USER% order=%ORDER%"),
    ("ERROR", "payments", 'payment declined order=%ORDER% code=%CODE% reason="insufficient funds"'),
    ("ERROR", "payments", 'payment declined order=%ORDER% code=%CODE% reason="card expired"'),
    ("ERROR", "inventory", "stock reconciliation failed sku=%SKU% expected=%DELTA% actual=%STOCK%"),
    ("ERROR", "web-gateway", 'request POST /api/checkout 500 in %MS%ms user=%USER% cause="downstream timeout"'),
)
WEIGHTS = {"INFO": 8, "WARN": 3, "ERROR": 1}
#: Least value and number of values of each whole-number token, and what stands before it.
NUMBERS = {"USER": (1000, 9000, ""), "ORDER": (500_000, 500_000, ""), "SKU": (1000, 9000, "SKU-"), "MS": (1, 500, ""), "ITEMS": (1, 8, ""), "RESULTS": (0, 200, ""), "DELTA": (-20, 41, ""), "STOCK": (0, 500, ""), "RETRY": (1, 3, ""), "CODE": (400, 200, "")}


def logs(spark: SparkSession, tenant_id: str, count: int, seed: int = 42, base_ms: int = 1_700_000_000_000, hours: int = 24) -> DataFrame:
    """count records (tenant_id, ts_ms, tags, message, seq) of the `hours` up to base_ms."""

    def draw(salt: str, n: int) -> Column:
        return F.pmod(F.xxhash64("id", F.lit(seed), F.lit(salt)), F.lit(n)).cast("int")

    def choice(salt: str, values: tuple) -> Column:
        return F.get(F.array(*map(F.lit, values)), draw(salt, len(values)))

    slots = [k for k, (level, _, _) in enumerate(TEMPLATES) for _ in range(WEIGHTS[level])]
    template = F.get(F.array(*[F.struct(*map(F.lit, t)) for t in TEMPLATES]), choice("template", tuple(slots)))
    tokens = {name: F.concat(F.lit(before), (draw(name, n) + low).cast("string")) for name, (low, n, before) in NUMBERS.items()}
    tokens |= {"CARD": F.lpad(draw("CARD", 10_000).cast("string"), 4, "0"), "AMOUNT": F.format_string("%.2f", 5 + draw("AMOUNT", 49_500) / 100), "QUERY": choice("QUERY", PHRASES)}
    base = spark.range(count).withColumn("t", template)
    message = reduce(lambda m, kv: F.replace(m, F.lit(f"%{kv[0]}%"), kv[1]), tokens.items(), F.col("t.col3"))
    tags = F.create_map(F.lit("env"), choice("env", ENVS), F.lit("service"), F.col("t.col2"), F.lit("level"), F.col("t.col1"), F.lit("region"), choice("region", REGIONS))
    ts = F.lit(base_ms - hours * 3_600_000) + F.pmod(F.xxhash64("id", F.lit(seed), F.lit("ts")), F.lit(hours * 3_600_000))
    return base.select(F.lit(tenant_id).alias("tenant_id"), ts.cast("long").alias("ts_ms"), tags.alias("tags"), message.alias("message"), F.col("id").alias("seq"))
