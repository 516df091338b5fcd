"""The given tables as subjects, fills, observations, conditions and other event frames.

Every frame is keyed by ``pid``. ``SQL`` has the same frames as common table expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.distributed import dealt
from ..storage import kept

INDEX_CODES = ("1-URGENT", "2-HIGH")
AS_OF = "2001-01-01"


class Lens:
    def __init__(self, spark: SparkSession, sf_dir: str, cohort: DataFrame | None = None):
        self.spark, self.sf_dir, self._cohort = spark, sf_dir, cohort

    def with_stored_cohort(self) -> Lens:
        """The same frames; the cohort is worked out once, not anew inside each stage that joins it."""
        return Lens(self.spark, self.sf_dir, kept(self.cohort(), "cohort"))

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def subjects(self) -> DataFrame:
        nation, region = self.table("nation"), self.table("region")
        places = nation.join(F.broadcast(region), nation["n_regionkey"] == region["r_regionkey"])
        found = self.table("customer").join(F.broadcast(places), F.col("c_nationkey") == F.col("n_nationkey"))
        return found.select(
            F.col("c_custkey").alias("pid"),
            F.col("c_name").alias("name"),
            F.col("c_mktsegment").alias("stratum"),
            F.col("r_name").alias("region"),
            F.col("c_acctbal").alias("balance"),
            F.date_sub(F.to_date(F.lit(AS_OF)), (F.lit(9000) + F.col("c_custkey") % 20000).cast("int")).alias("birth"),
            F.when(F.col("c_custkey") % 11 == 0, F.to_date(F.lit("2000-06-30"))).alias("death"),
        )

    def _by_subject(self, rows: DataFrame) -> DataFrame:
        """Rows of orders, dealt by subject."""
        return dealt(rows, "pid", self.table("orders").count())

    def rows_by_subject(self, rows: DataFrame) -> DataFrame:
        """Rows of which a subject has one, dealt by subject: parts of a join that all sort there in one task."""
        return dealt(rows, "pid", self.table("customer").count())

    def fills(self) -> DataFrame:
        return self._by_subject(self._fills())

    def _fills(self) -> DataFrame:
        start = F.to_date("o_orderdate")
        return self.table("orders").select(
            F.col("o_custkey").alias("pid"),
            F.col("o_orderpriority").alias("code"),
            start.alias("start"),
            F.when(F.col("o_orderkey") % 7 != 0, F.date_add(start, (F.lit(15) + F.col("o_orderkey") % 60).cast("int"))).alias("stop"),
            F.col("o_orderkey").alias("encounter"),
            F.col("o_totalprice").alias("total"),
            (F.col("o_totalprice") * 0.6).alias("covered"),
        )

    def _lines(self) -> DataFrame:
        n = self.table("lineitem").count()
        orders = self.table("orders").select("o_orderkey", F.col("o_custkey").alias("pid"))
        # Both into as many parts, so that they meet without another shuffle.
        return dealt(self.table("lineitem"), "l_orderkey", n).join(dealt(orders, "o_orderkey", n), F.col("l_orderkey") == F.col("o_orderkey"))

    def observations(self) -> DataFrame:
        rows = self._lines().select("pid", F.col("l_returnflag").alias("code"), F.to_date("l_shipdate").alias("date"), F.col("l_quantity").alias("value"))
        return dealt(rows, "pid", self.table("lineitem").count())

    def conditions(self) -> DataFrame:
        part = self.table("part").select("p_partkey", F.col("p_brand").alias("code"))
        rows = self._lines().join(part, F.col("l_partkey") == F.col("p_partkey")).select("pid", "code", F.to_date("l_shipdate").alias("start"))
        return dealt(rows, "pid", self.table("lineitem").count())

    def encounters(self) -> DataFrame:
        kind = F.when(F.col("o_orderpriority") == "1-URGENT", "emergency").when(F.col("o_orderpriority") == "2-HIGH", "inpatient").when(F.col("o_orderpriority") == "3-MEDIUM", "urgentcare")
        return self._by_subject(self.table("orders").select(F.col("o_custkey").alias("pid"), kind.otherwise("ambulatory").alias("class"), F.to_date("o_orderdate").alias("start")))

    def payers(self) -> DataFrame:
        return self._by_subject(self.table("orders").select(F.col("o_custkey").alias("pid"), F.col("o_orderstatus").alias("payer"), F.to_date("o_orderdate").alias("start"), F.col("o_orderkey").alias("tie")))

    def cohort(self) -> DataFrame:
        """One row for each subject with an index date: the first index-class fill after two years of data."""
        if self._cohort is not None:
            return self._cohort
        # Not dealt: one row a subject and task is all that is shuffled.
        fills = self._fills().where(F.col("code").isin(*INDEX_CODES) & (F.col("start") >= F.to_date(F.lit("1997-01-01"))))
        return fills.groupBy("pid").agg(F.min("start").alias("index_date"))

    def feed(self) -> DataFrame:
        """Dispense feed: purchases are dispenses, other events are orders that were not filled."""
        return self.table("events").select(
            F.col("user_id").alias("pid"),
            F.to_date("ts").alias("date"),
            F.when(F.col("event_type") == "purchase", "Paid").otherwise("reversed").alias("status"),
            F.when(F.col("event_type") == "purchase", F.col("event_type")).alias("product"),
            F.when(F.col("event_id") % 5 != 0, (F.col("event_id") % 90).cast("string")).alias("days_supply"),
            "event_id",
        )

    def consent(self) -> DataFrame:
        """By id: no record, granted, denied, unknown, or stale."""
        bucket = F.col("c_custkey") % 10
        state = F.when(bucket < 6, "granted").when(bucket < 8, "denied").otherwise("unknown")
        days = F.when(bucket == 5, 500).when(bucket != 4, (F.col("c_custkey") % 300).cast("int"))
        return self.table("customer").where(bucket != 9).select(
            F.col("c_custkey").alias("pid"), state.alias("internal"), F.when(bucket < 4, "granted").otherwise(state).alias("external"), F.date_sub(F.to_date(F.lit(AS_OF)), days).alias("as_of")
        )

    def attributions(self) -> DataFrame:
        """Long ``(pid, driver, value, raw)`` from fixed coefficients."""
        c = F.col("c_custkey")
        spread = lambda m, s: (((c * m) % 97).cast("double") - s) / 50
        rows = [("access", spread(3, 30)), ("cost", spread(7, 40)), ("isolation", spread(13, 60)), ("regimen", spread(19, 45)), ("bp_trend", spread(29, 50))]
        safety = F.when(c % 23 == 0, 1.0).otherwise(0.0)
        parts = F.array(*(F.struct(F.lit(n).alias("driver"), v.alias("value"), F.lit(0.0).alias("raw")) for n, v in rows), F.struct(F.lit("safety").alias("driver"), F.lit(0.05).alias("value"), safety.alias("raw")))
        return self.table("customer").select(c.alias("pid"), F.explode(parts).alias("x")).select("pid", "x.*")

    def scores(self) -> DataFrame:
        """A deterministic risk score and outcome for each subject."""
        c = F.col("c_custkey")
        risk = F.round(((c * 37) % 101) / 101, 6)
        event = (((c * 37) % 101 + (c * 11) % 60) > 90).cast("int")
        return self.table("customer").select(c.alias("pid"), F.col("c_mktsegment").alias("stratum"), risk.alias("risk"), event.alias("event"), (F.lit(1) + (c * 53) % 180).cast("int").alias("time"))


SQL = {
    "subjects": f"""SELECT c_custkey AS pid, c_name AS name, c_mktsegment AS stratum, r_name AS region, c_acctbal AS balance,
        DATE '{AS_OF}' - (9000 + c_custkey % 20000)::INT AS birth, CASE WHEN c_custkey % 11 = 0 THEN DATE '2000-06-30' END AS death
        FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "fills": """SELECT o_custkey AS pid, o_orderpriority AS code, o_orderdate::DATE AS start,
        CASE WHEN o_orderkey % 7 <> 0 THEN o_orderdate::DATE + (15 + o_orderkey % 60)::INT END AS stop,
        o_orderkey AS encounter, o_totalprice AS total, o_totalprice * 0.6::DOUBLE AS covered FROM orders""",
    "observations": """SELECT o_custkey AS pid, l_returnflag AS code, l_shipdate::DATE AS date, l_quantity AS value
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "conditions": """SELECT o_custkey AS pid, p_brand AS code, l_shipdate::DATE AS start
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey""",
    "encounters": """SELECT o_custkey AS pid, CASE o_orderpriority WHEN '1-URGENT' THEN 'emergency' WHEN '2-HIGH' THEN 'inpatient'
        WHEN '3-MEDIUM' THEN 'urgentcare' ELSE 'ambulatory' END AS class, o_orderdate::DATE AS start FROM orders""",
    "payers": "SELECT o_custkey AS pid, o_orderstatus AS payer, o_orderdate::DATE AS start, o_orderkey AS tie FROM orders",
    "cohort": """SELECT o_custkey AS pid, min(o_orderdate::DATE) AS index_date FROM orders
        WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderdate::DATE >= DATE '1997-01-01' GROUP BY o_custkey""",
    "feed": """SELECT user_id AS pid, ts::DATE AS date, CASE WHEN event_type = 'purchase' THEN 'Paid' ELSE 'reversed' END AS status,
        CASE WHEN event_type = 'purchase' THEN event_type END AS product,
        CASE WHEN event_id % 5 <> 0 THEN (event_id % 90)::VARCHAR END AS days_supply, event_id FROM events""",
    "consent": f"""SELECT c_custkey AS pid, state AS internal, CASE WHEN b < 4 THEN 'granted' ELSE state END AS external,
        DATE '{AS_OF}' - (CASE WHEN b = 5 THEN 500 WHEN b <> 4 THEN c_custkey % 300 END)::INT AS as_of
        FROM (SELECT *, c_custkey % 10 AS b, CASE WHEN c_custkey % 10 < 6 THEN 'granted' WHEN c_custkey % 10 < 8 THEN 'denied' ELSE 'unknown' END AS state FROM customer)
        WHERE b <> 9""",
    "attributions": """SELECT c_custkey AS pid, x.driver AS driver, x.value AS value, x.raw AS raw FROM (SELECT c_custkey, unnest([
        {'driver': 'access', 'value': ((c_custkey * 3) % 97 - 30)::DOUBLE / 50, 'raw': 0.0::DOUBLE},
        {'driver': 'cost', 'value': ((c_custkey * 7) % 97 - 40)::DOUBLE / 50, 'raw': 0.0::DOUBLE},
        {'driver': 'isolation', 'value': ((c_custkey * 13) % 97 - 60)::DOUBLE / 50, 'raw': 0.0::DOUBLE},
        {'driver': 'regimen', 'value': ((c_custkey * 19) % 97 - 45)::DOUBLE / 50, 'raw': 0.0::DOUBLE},
        {'driver': 'bp_trend', 'value': ((c_custkey * 29) % 97 - 50)::DOUBLE / 50, 'raw': 0.0::DOUBLE},
        {'driver': 'safety', 'value': 0.05::DOUBLE, 'raw': CASE WHEN c_custkey % 23 = 0 THEN 1.0 ELSE 0.0 END::DOUBLE}]) AS x FROM customer)""",
    "scores": """SELECT c_custkey AS pid, c_mktsegment AS stratum, round(((c_custkey * 37) % 101)::DOUBLE / 101, 6) AS risk,
        ((c_custkey * 37) % 101 + (c_custkey * 11) % 60 > 90)::INT AS event, (1 + (c_custkey * 53) % 180)::INT AS time FROM customer""",
}


def with_frames(body: str, *names: str) -> str:
    """``body`` after the named frames as common table expressions; a body may go on with more of them."""
    ctes = ", ".join(f"{n} AS ({SQL[n]})" for n in names)
    return f"WITH {ctes}{'' if not body.lstrip().startswith(',') else ' '}{body}"
