"""The concepts of the library, derived by Spark from the driver's tables; the SQL says the same for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TZ = "Asia/Jerusalem"
#: In January that zone is two hours ahead, which is what the SQL uses.
SHIFT = 7_200_000
RULES = ("early", "late")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def padded(number, letter: str):
    """The letter and the number in five digits, more where it is longer."""
    return F.format_string(letter + "%05d", number.cast("long"))


def number(padded_id: str):
    return F.expr(f"cast(substring({padded_id}, 2) as bigint)")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as sensor rows: a user is a device, the event type a table, three devices a subject."""
    return as_events(table(spark, sf_dir, "events"))


def as_events(e: DataFrame) -> DataFrame:
    return e.select(
        F.col("event_id").alias("_id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp"), padded(F.col("user_id"), "D").alias("device_id"),
        padded(F.floor(F.col("user_id") / 3), "S").alias("subject_id"), F.col("event_type").alias("table_name"), F.col("props").alias("data"), "value", "user_id",
    )


EVENTS = """e AS (SELECT event_id AS _id, epoch_us(ts) // 1000 AS timestamp, printf('D%05d', CAST(user_id AS BIGINT)) AS device_id,
    printf('S%05d', CAST(user_id // 3 AS BIGINT)) AS subject_id, event_type AS table_name, props AS data, value, user_id FROM events)"""


def raw(ev: DataFrame) -> DataFrame:
    return ev.select("_id", "timestamp", "device_id", "table_name", "data", "value")


def devices(ev: DataFrame) -> DataFrame:
    return ev.select("subject_id", "device_id").distinct()


DEVICES = "dev AS (SELECT DISTINCT subject_id, device_id FROM e)"


def _dated(s: DataFrame) -> DataFrame:
    """T1 is 2 to 6 January and T2 24 to 27 January, by the subject's number."""
    no = number("subject_id")
    s = s.withColumn("t1_date", F.date_add(F.lit("2024-01-02").cast("date"), (no % 5).cast("int"))).withColumn("t2_date", F.date_add(F.lit("2024-01-24").cast("date"), (no % 4).cast("int")))
    ms = lambda c: F.unix_millis(F.to_utc_timestamp(F.col(c).cast("timestamp"), TZ))
    return s.withColumn("t1_ms", ms("t1_date")).withColumn("t2_ms", ms("t2_date")).withColumn("score", (no * 37 % 101).cast("double"))


def subjects(ev: DataFrame) -> DataFrame:
    return _dated(ev.select("subject_id").distinct())


SUBJECTS = f"""sub AS (SELECT subject_id, t1_date, t2_date, epoch_ms(CAST(t1_date AS TIMESTAMP)) - {SHIFT} AS t1_ms, epoch_ms(CAST(t2_date AS TIMESTAMP)) - {SHIFT} AS t2_ms, score
    FROM (SELECT subject_id, DATE '2024-01-02' + CAST(no % 5 AS INTEGER) AS t1_date, DATE '2024-01-24' + CAST(no % 4 AS INTEGER) AS t2_date, CAST(no * 37 % 101 AS DOUBLE) AS score
          FROM (SELECT DISTINCT subject_id, CAST(substr(subject_id, 2) AS BIGINT) AS no FROM e)))"""


def windows(ev: DataFrame) -> DataFrame:
    """Early and late windows of seven days for every device and table of each subject."""
    from ..operators.windows import early_late_windows

    # From one distinct of the events: subject, device and the tables there are for any.
    each = _dated(ev.select("subject_id", "device_id").distinct())
    w = early_late_windows(each, 7, TZ, keep=["device_id"]).filter(F.col("window_rule").isin(*RULES))
    tables = ev.agg(F.collect_set("table_name").alias("tables"))  # one row
    return w.join(F.broadcast(tables)).withColumn("table_name", F.explode("tables")).drop("tables")


WINDOWS = """win AS (SELECT s.subject_id, d.device_id, t.table_name, w.window_rule, w.start_ms, w.end_ms FROM sub s JOIN dev d USING (subject_id) CROSS JOIN (SELECT DISTINCT table_name FROM e) t
    CROSS JOIN LATERAL (SELECT 'early' AS window_rule, s.t1_ms AS start_ms, s.t1_ms + 604800000 AS end_ms UNION ALL SELECT 'late', s.t2_ms - 604800000, s.t2_ms) w)"""


def windowed(ev: DataFrame, data=None) -> DataFrame:
    """Events in their subject's windows, with a payload made from the row if one is given."""
    from ..operators.rangejoin import range_join

    rows = raw(ev) if data is None else raw(ev).withColumn("data", data)
    return range_join(rows, windows(ev))


WINDOWED = """we AS (SELECT win.subject_id, win.window_rule, win.start_ms, win.end_ms, e._id, e.timestamp, e.device_id, e.table_name, e.data, e.value, e.user_id
    FROM e JOIN win ON e.device_id = win.device_id AND e.table_name = win.table_name AND e.timestamp >= win.start_ms AND e.timestamp < win.end_ms)"""

ALL = f"WITH {EVENTS}, {DEVICES}, {SUBJECTS}, {WINDOWS}, {WINDOWED}"


def payload(**fields):
    """A JSON payload from columns."""
    return F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]))


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as a three-axis signal: a supplier is a device, an item a sample every 200 ms of its day."""
    rows = table(spark, sf_dir, "lineitem")
    ms = F.unix_millis(F.col("l_shipdate").cast("timestamp")) + (F.col("l_orderkey") * 7 + F.col("l_linenumber")) % 432_000 * 200
    return rows.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("_id"), ms.alias("timestamp"), padded(F.col("l_suppkey"), "D").alias("device_id"), padded(F.floor(F.col("l_suppkey") / 3), "S").alias("subject_id"),
        (F.col("l_quantity") / 10).alias("x"), (F.col("l_discount") * 10).alias("y"), (F.col("l_tax") * 10).alias("z"),
    )


SIGNAL = """sig AS (SELECT l_orderkey * 10 + l_linenumber AS _id, epoch_ms(l_shipdate) + (l_orderkey * 7 + l_linenumber) % 432000 * 200 AS timestamp,
    printf('D%05d', CAST(l_suppkey AS BIGINT)) AS device_id, printf('S%05d', CAST(l_suppkey // 3 AS BIGINT)) AS subject_id, l_quantity / 10 AS x, l_discount * 10 AS y, l_tax * 10 AS z FROM lineitem)"""


def features_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, largest and number of values per subject and table, some missing, as a long feature table."""
    e = events(spark, sf_dir)
    g = e.groupBy("subject_id", "table_name").agg(F.round(F.avg("value"), 6).alias("mean_value"), F.max("value").alias("max_value"), F.count(F.lit(1)).cast("double").alias("n_events"))
    g = g.withColumn("max_value", F.when(F.col("n_events") % 5 != 0, F.col("max_value")))
    return g.unpivot(["subject_id", "table_name"], ["mean_value", "max_value", "n_events"], "feature", "value")


LONG = f"""{EVENTS}, g AS (SELECT subject_id, table_name, round(avg(value), 6) AS mean_value, max(value) AS m, CAST(count(*) AS DOUBLE) AS n_events FROM e GROUP BY ALL),
    lng AS (SELECT subject_id, table_name, 'mean_value' AS feature, mean_value AS value FROM g UNION ALL SELECT subject_id, table_name, 'max_value', CASE WHEN n_events % 5 <> 0 THEN m END FROM g
            UNION ALL SELECT subject_id, table_name, 'n_events', n_events FROM g)"""


def exact_mean(column: str, digits: int):
    """The mean rounded to `digits`, from a sum in decimals, which no order of the rows changes: equal rows have equal
    means on every run.  Values that no such decimal holds (over 22 digits, NaN, infinite) take the mean of doubles."""
    x = F.col(column)
    held = x.try_cast("decimal(30, 8)")
    return F.when(F.count(held) == F.count(x), F.round(F.avg(held), digits).cast("double")).otherwise(F.round(F.avg(x), digits))


def cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as subjects: score y, and features from their orders, NULL where there are none."""
    c = table(spark, sf_dir, "customer")
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).cast("double").alias("n_orders"), exact_mean("o_totalprice", 4).alias("mean_price"), F.max("o_totalprice").alias("max_price"))
    return c.join(o, c["c_custkey"] == o["o_custkey"], "left").select(padded(F.col("c_custkey"), "C").alias("subject_id"), F.col("c_acctbal").alias("y"), "n_orders", "mean_price", "max_price", "c_mktsegment", "c_nationkey")


COHORT = """co AS (SELECT printf('C%05d', CAST(c_custkey AS BIGINT)) AS subject_id, c_acctbal AS y, n_orders, mean_price, max_price, c_mktsegment, c_nationkey FROM customer
    LEFT JOIN (SELECT o_custkey, CAST(count(*) AS DOUBLE) AS n_orders, round(avg(o_totalprice), 4) AS mean_price, max(o_totalprice) AS max_price FROM orders GROUP BY 1) ON c_custkey = o_custkey)"""
