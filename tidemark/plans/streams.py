"""Streams and their batch forms (T1-T3). The stream source is the table itself, one file or a folder of parts."""

from pyspark.sql import functions as F

from tidemark.operators import clean, profile, states
from tidemark.plans.derived import DERIVED
from tidemark.plans.indexes import table_state
from tidemark.plans.profiling import NUMERIC, STAR, union_sql
from tidemark.plans.registry import query
from tidemark.sources.scratch import scratch_dir
from tidemark.streaming import catalog, ingest, rate_limit as RL, search_log as SL


def stream_of(t, name, **options):
    """A stream needs a folder to watch: the table's own, or for a single file the folder it is in, cut to that file."""
    path = t.spark._jvm.org.apache.hadoop.fs.Path(f"{t.sf_dir}/{name}.parquet")
    stream = t.spark.readStream.schema(getattr(t, name).schema).options(**options)
    if path.getFileSystem(t.spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        return stream.parquet(path.toString())
    return stream.option("pathGlobFilter", path.getName()).parquet(path.getParent().toString())


def run_to_table(t, stream, name):
    """Run a stream over all present input into a Parquet table and read that."""
    base = scratch_dir(t.spark, name)
    q = (stream.writeStream.format("parquet").option("checkpointLocation", f"{base}/checkpoint")
         .outputMode("append").trigger(availableNow=True).start(f"{base}/table"))
    q.awaitTermination()
    return t.spark.read.schema(stream.schema).parquet(f"{base}/table")


_LIVE = "list_filter(r.recent, lambda x: e.us - x < 86400000000)"
_ACCEPTED = f"""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
    r AS (SELECT user_id, event_id, rn, true AS accepted, [us] AS recent FROM e WHERE rn = 1
      UNION ALL SELECT e.user_id, e.event_id, e.rn, len({_LIVE}) < 3, CASE WHEN len({_LIVE}) < 3 THEN list_append({_LIVE}, e.us) ELSE {_LIVE} END
      FROM r JOIN e ON e.user_id = r.user_id AND e.rn = r.rn + 1)
    SELECT event_id, user_id, accepted FROM r"""


@query("rate_limit", _ACCEPTED)
def rate_limit(t):
    return RL.rate_limit(t.events, (3, 86400)).select("event_id", "user_id", "accepted")


@query("rate_limit_stream", _ACCEPTED)
def rate_limit_stream(t):
    out = run_to_table(t, RL.rate_limit_stream(stream_of(t, "events"), (3, 86400)), "rate")
    return out.select("event_id", "user_id", "accepted")


_WINDOWS = """SELECT date_trunc('day', created_at)::TIMESTAMP AS window_start, date_trunc('day', created_at)::TIMESTAMP + INTERVAL 1 DAY AS window_end,
    query_type, count(*) AS searches, round(avg(search_time_ms)::DECIMAL(28,9), 4)::DOUBLE AS avg_ms FROM search_log GROUP BY ALL"""


@query("search_log_windows", _WINDOWS)
def search_log_windows(t):
    return SL.log_windows(t.search_log)


@query("search_log_stream", f"SELECT * FROM ({_WINDOWS}) WHERE window_end <= (SELECT max(created_at) - INTERVAL 1 HOUR FROM search_log)")
def search_log_stream(t):
    log = t.spark.sql(DERIVED["search_log"], events=stream_of(t, "events"))
    out = run_to_table(t, SL.log_windows_stream(log), "log")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")})


@query("incremental_ingest", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def incremental_ingest(t):
    base = scratch_dir(t.spark, "ingest")
    types = clean.decide_types(t.customer)
    ingest.ingest_stream(stream_of(t, "customer"), base, f"{base}/checkpoint", "customer", "c_name", "c_custkey", types).awaitTermination()
    return t.spark.read.parquet(f"{base}/rows").drop("batch")


def streamed_catalog(t, name="events", batches=3):
    """The folder of the states of a table that arrives in about three micro-batches.

    The files of a table's own folder are watched; one file or two are first dealt into parts.
    """
    base = scratch_dir(t.spark, "catalog")
    n = len(table_state(t, name))
    if n >= batches:  # files of the folder
        stream = stream_of(t, name, maxFilesPerTrigger=-(-n // batches))
    else:
        rows = getattr(t, name)
        rows.repartition(batches, STAR[name][0]).write.parquet(f"{base}/inbox")
        stream = t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/inbox")
    catalog.catalog_stream(stream, f"{base}/states", f"{base}/checkpoint", name).awaitTermination()
    return f"{base}/states"


def _exact_profile(n, c, d, key):
    num = lambda f: f"round({f}({c}::DOUBLE), 3)" if d in NUMERIC else "NULL::DOUBLE"
    return f"""SELECT '{n}' AS "table", '{c}' AS "column", '{d}' AS dtype, count(*) AS rows, count(*) - count({c}) AS null_count,
        count(*) > count({c}) AS is_nullable, {num('min')} AS min_value, {num('max')} AS max_value, {num('avg')} AS avg_value FROM {n}"""


@query("running_catalog", union_sql(_exact_profile, ["events"]))
def running_catalog(t):
    """The exact columns of a catalog whose table arrived in several micro-batches."""
    return catalog.catalog_at(t.spark, streamed_catalog(t)).select(
        "table", "column", "dtype", "rows", "null_count", "is_nullable", "min_value", "max_value", "avg_value")


@query("running_catalog_error", union_sql(
    lambda n, c, d, key: f"""SELECT '{n}' AS "table", '{c}' AS "column", true AS distinct_near, true AS median_near, true AS top_near""", ["events"]))
def running_catalog_error(t):
    """Whether the estimates of a streamed catalog keep their stated errors against all rows (distinct values and medians: about five standard errors)."""
    found = catalog.catalog_at(t.spark, streamed_catalog(t))
    exact = profile.profile_columns(t.events, "events").select("table", "column", F.col("distinct_count").alias("exact"))
    cells = profile.melt(t.events, "events").where("value IS NOT NULL")
    counts = cells.groupBy("table", "column", states.shown(F.col("value")).alias("value")).count()
    most = counts.groupBy("table", "column").agg(F.max("count").alias("most"))
    # the share of values up to the estimated median
    median = found.where("median_value IS NOT NULL").select("table", "column", "median_value")
    below = cells.join(median, ["table", "column"]).groupBy("table", "column").agg(
        F.avg((F.col("value").cast("double") <= F.col("median_value")).cast("double")).alias("upto"),
        F.avg((F.col("value").cast("double") < F.col("median_value")).cast("double")).alias("under"))
    all_of = found.join(exact, ["table", "column"]).join(most, ["table", "column"], "left").join(below, ["table", "column"], "left")
    top = F.coalesce(F.get("top_values", F.lit(0))["count"], F.lit(0))
    few = F.col("exact") < 0.6 * states.TOP_TRACKED
    return all_of.select(
        "table", "column", (F.abs(F.col("distinct_count") - F.col("exact")) <= 0.05 * F.col("exact")).alias("distinct_near"),
        F.coalesce((F.col("upto") >= 0.44) & (F.col("under") <= 0.56), F.lit(True)).alias("median_near"),
        F.coalesce(F.when(few, top == F.col("most")).otherwise(F.abs(top - F.col("most")) <= states.TOP_ERROR * F.col("rows")), F.lit(True)).alias("top_near"))
