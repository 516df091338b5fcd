"""Reading, writing and normalising tables and feeds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import empty_to_null

#: name, access mode, least/typical/greatest latency in days, needs an encounter, confirms dispenses, may be scanned in batch (fixed values).
PROFILES = [
    ("surescripts", "prescriber_initiated", 1, 7, 14, 1, 1, 0),
    ("rxfill", "batch_permitted", 0, 0, 1, 0, 1, 1),
    ("claims", "batch_permitted", 15, 30, 90, 0, 1, 1),
    ("local_file", "batch_permitted", 0, 0, 0, 0, 1, 1),
]


def ingest_csv(spark: SparkSession, src: str, dst: str, force_string: Sequence[str] = ()) -> None:
    """CSV to Parquet: codes stay text, dates stay text, numbers are inferred."""
    inferred = spark.read.csv(src, header=True, inferSchema=True).schema
    as_text = ("date", "timestamp", "timestamp_ntz")
    fields = ", ".join(f"`{f.name}` {'string' if f.name in force_string or f.dataType.typeName() in as_text else f.dataType.simpleString()}" for f in inferred)
    spark.read.csv(src, header=True, schema=fields).write.mode("overwrite").option("compression", "zstd").parquet(dst)


def ingest_csv_all_string(spark: SparkSession, src: str, dst: str) -> None:
    spark.read.csv(src, header=True).write.mode("overwrite").option("compression", "zstd").parquet(dst)


def ingest_directory(spark: SparkSession, src: str, dst: str, names: Sequence[str], exclude: Sequence[str] = (), all_string: Sequence[str] = (), force_string: Sequence[str] = ()) -> DataFrame:
    """Each ``<name>.csv`` but the excluded ones; a report ``(table, rows)``."""
    report = None
    for name in names:
        if name in exclude:
            continue
        if name in all_string:
            ingest_csv_all_string(spark, f"{src}/{name}.csv", f"{dst}/{name}.parquet")
        else:
            ingest_csv(spark, f"{src}/{name}.csv", f"{dst}/{name}.parquet", force_string)
        row = spark.read.parquet(f"{dst}/{name}.parquet").agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows")
        report = row if report is None else report.union(row)
    return report if report is not None else spark.createDataFrame([], "table string, rows long")


def materialize_code_subset(df: DataFrame, codes: Sequence[str], dst: str, code_col: str = "code") -> DataFrame:
    """A filtered copy of a huge table."""
    df.where(F.col(code_col).isin(*codes)).write.mode("overwrite").parquet(dst)
    return df.sparkSession.read.parquet(dst)


def load_tables(spark: SparkSession, directory: str, required: dict[str, Sequence[str]], renames: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """Tables by name, checked for their required columns; a missing table or column is named in the error."""
    out = {}
    for name, columns in required.items():
        try:
            df = spark.read.parquet(f"{directory}/{name}.parquet")
        except Exception as e:
            raise FileNotFoundError(f"table {name} is missing in {directory}") from e
        for old, new in (renames or {}).items():
            df = df.withColumnRenamed(old, new)
        if missing := [c for c in columns if c not in df.columns]:
            raise ValueError(f"table {name} lacks {', '.join(missing)}")
        out[name] = df
    return out


def code_groups(dictionary: DataFrame, groups: Sequence[str] | None = None) -> DataFrame:
    """``(code_group, code, action)`` of a dictionary with ``(code_group, action, codes)``; by default the groups with an action."""
    rows = dictionary.where(F.col("code_group").isin(*groups)) if groups else dictionary.where("action is not null and codes is not null")
    return rows.select("code_group", F.explode("codes").alias("code"), "action")


def read_claims_fills(feed: DataFrame, ids: DataFrame, start: str, end: str) -> DataFrame:
    """Paid claims with a valid date within the closed window, of known subjects."""
    if missing := [c for c in ("pid", "date", "status") if c not in feed.columns]:
        raise ValueError(f"the claims export lacks {', '.join(missing)}")
    day = F.col("date").cast("string").try_cast("date")
    rows = feed.withColumn("date", day).where((F.lower("status") == "paid") & F.col("date").between(F.to_date(F.lit(start)), F.to_date(F.lit(end))))
    return rows.join(ids.select("pid").distinct(), "pid", "left_semi")


def source_profiles(spark: SparkSession) -> DataFrame:
    names = "source string, access_mode string, min_latency int, typical_latency int, max_latency int, requires_encounter int, confirms_dispense int, batch_permitted int"
    return spark.createDataFrame(PROFILES, names)


def invalid_profiles(profiles: DataFrame) -> DataFrame:
    return profiles.where("not (min_latency <= typical_latency and typical_latency <= max_latency)").select("source")


def dispense_events(fills: DataFrame, profiles: DataFrame, source: str, default_product: str = "unknown") -> DataFrame:
    """Normalised events: product with a default, whole days of supply or null, what the source can confirm and its typical latency."""
    profile = profiles.where(F.col("source") == source).select("source", F.col("confirms_dispense").alias("is_dispense"), F.col("typical_latency").alias("latency_days"))
    rows = fills.select("pid", "date", F.coalesce(empty_to_null(F.col("product")), F.lit(default_product)).alias("product"), F.col("days_supply").try_cast("int").alias("days_supply"))
    return rows.join(F.broadcast(profile))


def label_derived_events(labels: DataFrame, as_of: str) -> DataFrame:
    return labels.where("has_30_day_gap = 0").select("pid", F.to_date(F.lit(as_of)).alias("date"), F.lit("label").alias("source"))


def select_sources(keys: DataFrame, profiles: DataFrame, chain: Sequence[str], available: DataFrame, batch: bool = False, key: str = "pid") -> DataFrame:
    """``(key, position, source, outcome, max_latency)``: of each key the attempts in the order of the chain, up to the one that served.

    ``available (key, source)`` has what can be reached for a key; a batch run may only scan what permits it.
    """
    rows = keys.select(key).distinct().select(key, F.posexplode(F.array(*map(F.lit, chain))).alias("position", "source"))
    reached = available.select(key, "source").distinct().withColumn("reached", F.lit(True))
    rows = rows.join(F.broadcast(profiles), "source").join(reached, [key, "source"], "left").withColumn("reached", F.coalesce("reached", F.lit(False)))
    rows = rows.withColumn("usable", F.col("reached") & ((F.col("batch_permitted") == 1) | F.lit(not batch)))
    first = F.min(F.when(F.col("usable"), F.col("position"))).over(Window.partitionBy(key))  # one row for each source of the chain
    rows = rows.withColumn("first", first).where(F.col("first").isNull() | (F.col("position") <= F.col("first")))
    outcome = F.when(F.col("position") == F.col("first"), "served").when(F.col("reached"), "not_permitted").otherwise("auth_failed")
    return rows.select(key, "position", "source", outcome.alias("outcome"), F.when(outcome == "served", F.col("max_latency")).alias("max_latency"))


def select_source(profiles: DataFrame, chain: Sequence[str], available: Sequence[str], batch: bool = False) -> DataFrame:
    """The attempts of a whole run, for which the ``available`` sources can be reached."""
    spark = profiles.sparkSession
    one = spark.range(1).select(F.col("id").alias("run"))
    reached = spark.createDataFrame([(0, s) for s in available], "run long, source string")
    return select_sources(one, profiles, chain, reached, batch, "run").drop("run")


def write_snapshot(df: DataFrame, path: str, format: str = "parquet") -> None:
    df.write.mode("overwrite").format(format).save(path)


def read_snapshot(spark: SparkSession, path: str, schema, format: str = "parquet") -> DataFrame:
    """What was written; an absent snapshot is an empty table."""
    from pyspark.errors import AnalysisException

    try:
        df = spark.read.schema(schema).format(format).load(path)
        df.schema  # noqa: B018  resolves the path
        return df
    except AnalysisException:
        return spark.createDataFrame([], schema)
