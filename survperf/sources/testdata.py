"""The engine's input tables, read or derived from a folder of Parquet tables.

A folder holds order and customer tables; districts are nations, months those of orders, counts the
orders of a cell and populations their summed prices. The mapping exercises every operator on
tables of any size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from survperf.functions.session import cut
from survperf.operators.national import observed_of
from survperf.operators.simple import simple_annual

DRAWS = 20
#: Keys whose shapes one task makes.
KEYS_EACH = 1 << 14
#: Orders whose class matches count as polio, and statuses as surveillance types.
CLASS_PATTERN, TYPES = "URGENT", ("F", "O")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def orders(spark: SparkSession, folder: str) -> DataFrame:
    """(district, orderkey, day, month, price, status, priority): orders with the nation of their customer."""
    o, c = table(spark, folder, "orders"), table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    rows = o.join(c, o.o_custkey == c.c_custkey)
    day = F.to_date("o_orderdate")
    return rows.select(F.col("c_nationkey").cast("string").alias("district"), F.col("o_orderkey").alias("orderkey"), day.alias("day"), F.trunc(day, "MM").alias("month"), F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))


def cases(spark: SparkSession, folder: str) -> DataFrame:
    """A line list in the default columns, with missing dates as in practice."""
    o = table(spark, folder, "orders")
    first = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.to_date(F.min("l_shipdate")).alias("stool"))
    n = table(spark, folder, "nation").select("n_nationkey", "n_regionkey")
    c = table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    rows = o.join(c, o.o_custkey == c.c_custkey).join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).join(first, o.o_orderkey == first.l_orderkey, "left")
    day = F.to_date("o_orderdate")
    return rows.select(
        F.col("o_orderkey").alias("case_id"), F.col("n_regionkey").cast("string").alias("adm1_guid"), F.col("c_nationkey").cast("string").alias("adm2_guid"), F.col("o_orderpriority").alias("classification_all"), F.col("o_orderstatus").alias("surveillance_type_name"),
        F.when(F.col("o_orderkey") % 10 != 0, day).alias("paralysis_onset_date"), F.when(F.col("o_orderkey") % 20 != 0, day).alias("case_date"), F.col("stool").alias("stool1collection_date"),
        F.when(F.col("o_orderkey") % 7 == 0, F.lit(" ")).when(F.col("o_orderkey") % 3 == 0, F.lit("No")).otherwise(F.lit("Yes")).alias("adequate_stool_with_condition"),
    )


def areas(spark: SparkSession, folder: str) -> DataFrame:
    """(district, area, name)."""
    return table(spark, folder, "nation").select(F.col("n_nationkey").cast("string").alias("district"), F.col("n_regionkey").cast("string").alias("area"), F.col("n_name").alias("name"))


def annual(spark: SparkSession, folder: str) -> DataFrame:
    """(district, year, observed, pop) through ``simple_annual``."""
    rows = orders(spark, folder).groupBy("district", F.year("day").alias("year")).agg(F.count(F.lit(1)).alias("npafp_cases"), F.round(F.sum("price"), 2).alias("population_u15"))
    return simple_annual(rows)


def panel(spark: SparkSession, folder: str) -> DataFrame:
    """(district, month, count, pop): a complete monthly grid; populations are yearly.

    Orders are read once: the grid's months and the populations come from the occupied cells.
    """
    cells = cut(orders(spark, folder).groupBy("district", "month").agg(F.count(F.lit(1)).alias("count"), F.sum("price").alias("price")))
    months = cells.agg(F.min("month").alias("a"), F.max("month").alias("b")).select(F.explode(F.expr("sequence(a, b, interval 1 month)")).alias("month"))
    yearly = cells.groupBy("district", F.year("month").alias("year")).agg(F.round(F.sum("price"), 2).alias("pop"))
    grid = areas(spark, folder).select("district").join(F.broadcast(months), F.lit(True)).withColumn("year", F.year("month"))
    full = grid.join(cells, ["district", "month"], "left").join(yearly, ["district", "year"], "left")
    return full.select("district", "month", F.coalesce("count", F.lit(0)).cast("long").alias("count"), "pop")


def draws(p: DataFrame, n: int = DRAWS, first: int = 1998) -> DataFrame:
    """(district, month, draw, expected): deterministic draws around each district's mean month of a panel."""
    base = p.groupBy("district").agg(F.avg("count").alias("base"))
    cells = p.filter(F.year("month") >= first).join(base, "district").select("district", "month", "base")
    noise = F.sin(F.col("draw") * 1.7 + F.col("district").cast("int") + F.month("month"))
    drawn = cells.select("*", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("draw"))
    return drawn.select("district", "month", "draw", (F.col("base") * F.exp(F.lit(0.2) * noise)).alias("expected"))


def observed(p: DataFrame, period: Column, first: int = 1998, pop: str = "avg") -> DataFrame:
    """Observed counts of a panel's drawn months by period."""
    return observed_of(p.filter(F.year("month") >= first), period, pop=pop)


def process(spark: SparkSession, folder: str, days: int = -640) -> DataFrame:
    """(district, year, n_cases, n_adequate, n_transport, n_transport_timely)."""
    first = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.to_date(F.min("l_shipdate")).alias("ship"))
    rows = orders(spark, folder).join(first, F.col("orderkey") == F.col("l_orderkey"), "left")
    n = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("int")).cast("int")
    return rows.groupBy("district", F.year("day").alias("year")).agg(F.count(F.lit(1)).cast("int").alias("n_cases"), n(F.col("status") == "F").alias("n_adequate"), n(F.col("ship").isNotNull()).alias("n_transport"), n(F.datediff("ship", "day") <= days).alias("n_transport_timely"))


def detections(spark: SparkSession, folder: str) -> DataFrame:
    """(district, year, n, serotype): rare returned items by customer nation and order year."""
    l = table(spark, folder, "lineitem").filter("l_returnflag = 'R' and l_quantity >= 50 and l_discount >= 0.1")  # noqa: E741
    p = table(spark, folder, "part").select("p_partkey", "p_type")
    rows = l.join(p, l.l_partkey == p.p_partkey).join(orders(spark, folder), F.col("l_orderkey") == F.col("orderkey"))
    return rows.groupBy("district", F.year("day").alias("year"), F.col("p_type").alias("serotype")).agg(F.count(F.lit(1)).cast("int").alias("n"))


def environmental(spark: SparkSession, folder: str) -> DataFrame:
    """(district, year, n): the same by supplier nation and shipping year."""
    l = table(spark, folder, "lineitem").filter("l_returnflag = 'R' and l_quantity >= 50 and l_discount >= 0.1")  # noqa: E741
    s = table(spark, folder, "supplier").select("s_suppkey", F.col("s_nationkey").cast("string").alias("district"))
    return l.join(s, l.l_suppkey == s.s_suppkey).groupBy("district", F.year("l_shipdate").alias("year")).agg(F.count(F.lit(1)).cast("int").alias("n"))


def vertices(spark: SparkSession, folder: str, shift_from: int = 10**9) -> DataFrame:
    """(district, part, ring, seq, x, y): a unit square for each nation, five to a row; those from ``shift_from`` on far off."""
    n = table(spark, folder, "nation").select(F.col("n_nationkey").cast("int").alias("k"))
    off = F.when(F.col("k") >= shift_from, 100.0 * (F.col("k") - shift_from + 1)).otherwise(0.0)
    corners = [(0, 0), (1, 0), (1, 1), (0, 1), (0, 0)]
    points = F.array(*[F.struct(F.lit(i).alias("seq"), F.lit(float(dx)).alias("dx"), F.lit(float(dy)).alias("dy")) for i, (dx, dy) in enumerate(corners)])
    rows = n.select("k", off.alias("off"), F.inline(points))
    return rows.select(F.col("k").cast("string").alias("district"), F.lit(0).alias("part"), F.lit(0).alias("ring"), "seq", (F.col("k") % 5 + F.col("dx") + F.col("off")).alias("x"), (F.floor(F.col("k") / 5) + F.col("dy") + F.col("off")).alias("y"))


def parcel_keys(spark: SparkSession, folder: str) -> DataFrame:
    """(k): the customers, dealt to as many tasks as their number asks for: a small file is read by one, and its shapes are many times as large."""
    k = table(spark, folder, "customer").select(F.col("c_custkey").alias("k"))
    return k.repartition(max(1, -(-k.count() // KEYS_EACH)))


def parcels(spark: SparkSession, folder: str, apart: int = 0, shake: float = 6e-6) -> DataFrame:
    """(district, part, ring, seq, x, y): a square for each customer, forty to a row, its corners moved by up to ``shake`` so that neighbours' corners lie up to three times as far apart.

    With ``apart`` every so many squares lie far from all others.
    """
    k = parcel_keys(spark, folder)
    corners = F.array(*[F.struct(F.lit(i).alias("seq"), F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for i, (dx, dy) in enumerate([(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0), (0.0, 0.0)])])
    rows = k.select("k", F.inline(corners))
    turn = F.col("k") * 12.9898 + F.pmod("seq", F.lit(4)) * 78.233
    off = F.when(F.col("k") % apart == 0, 3.0 * F.col("k") + 0.001 * F.col("k") * F.col("k") + 200).otherwise(0.0) if apart else F.lit(0.0)
    x, y = F.col("k") % 40 + F.col("dx") + off, F.floor(F.col("k") / 40) + F.col("dy") + 2 * off
    return rows.select(F.col("k").cast("string").alias("district"), F.lit(0).alias("part"), F.lit(0).alias("ring"), "seq", (x + F.sin(turn) * shake).alias("x"), (y + F.cos(turn) * shake).alias("y"))


def parcel_provinces(spark: SparkSession, folder: str) -> DataFrame:
    """(district, province): blocks of parcels seven by five, less every eleventh parcel, which together are a province of their own."""
    k = F.col("c_custkey")
    block = F.concat_ws("-", F.floor(k % 40 / 7).cast("string"), F.floor(k / 200).cast("string"))
    return table(spark, folder, "customer").select(k.cast("string").alias("district"), F.when(k % 11 == 0, "holes").otherwise(block).alias("province"))


#: (kind, part, ring, x, y, side) of the squares of parcels by kind: holes and parts, rightly placed and not.
PLACED = [(k, 0, 0, 0.0, 0.0, 1.0) for k in range(9)] + [(2, 0, 1, 5.0, 5.0, 0.25), (3, 0, 1, 0.25, 0.25, 0.5), (4, 1, 0, 0.25, 0.25, 0.5), (6, 1, 0, 0.5, 0.5, 1.0), (7, 0, 1, 0.2, 0.2, 0.6), (7, 1, 0, 0.4, 0.4, 0.2), (8, 0, 1, 0.2, 0.2, 0.6), (8, 0, 2, 0.4, 0.4, 0.2)]


def drawn_parcels(spark: SparkSession, folder: str) -> DataFrame:
    """(district, part, ring, seq, x, y): parcels of nine kinds by ``PLACED``; those of kind 1 cross themselves, those of kind 5 do not close."""
    k = parcel_keys(spark, folder)
    squares = F.broadcast(spark.createDataFrame(PLACED, "kind long, part int, ring int, px double, py double, side double"))
    corners = F.array(*[F.struct(F.lit(i).alias("seq"), F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for i, (dx, dy) in enumerate([(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0), (0.0, 0.0)])])
    rows = k.join(squares, F.col("k") % 9 == F.col("kind")).select("*", F.inline(corners)).filter("kind <> 5 or seq < 4")
    turned = F.when((F.col("kind") == 1) & F.col("seq").isin(1, 2), 3 - F.col("seq")).otherwise(F.col("seq"))
    return rows.select(F.col("k").cast("string").alias("district"), "part", "ring", turned.alias("seq"), (F.col("k") % 40 + F.col("px") + F.col("dx") * F.col("side")).alias("x"), (F.floor(F.col("k") / 40) + F.col("py") + F.col("dy") * F.col("side")).alias("y"))
