"""Named queries over the shared tables, each with equivalent SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from starling.functions.vectors import hash_uniform
from starling.operators import evaluate, prepare, profile, reduce, report, scale, soft
from starling.operators.dbscan import dbscan_labels
from starling.operators.divisive import divisive
from starling.operators.hdbscan import hdbscan, with_core_distances
from starling.operators.hierarchical import hierarchical
from starling.operators.kmeans import assign, elbow, first_distinct_rows, inertia, kmeans, kmeans_lloyd, knee
from starling.operators.moments import group_moments
from starling.operators.spectral import spectral
from starling.plans import sql as S
from starling.plans.run import run, run_batch
from starling.session import cut_lineage, scratch_path
from starling.sources import generate
from starling.sources.log import EventLog
from starling.sources.store import CenterModel, Store, latest, live_models, write_labelled
from starling.sources.tables import list_files, read_table
from starling.streaming.scoring import minibatch_kmeans_stream, score_stream, write_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

LINE_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
PART_COLUMNS = ["p_size", "p_retailprice"]
ORDER_COLUMNS = ["sum_quantity", "avg_price", "avg_discount", "n_lines"]
DBSCAN_EPS, DBSCAN_MIN = 0.1, 5


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name."""

    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE[fn.__name__] = sql
        return fn

    return add


# ---------------------------------------------------------------- shared frames


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf_dir}/{name}.parquet")


def rnd(column: Column | str, digits: int = 6) -> Column:
    return F.round(column, digits)


def part_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare.to_features(table(spark, sf_dir, "part"), PART_COLUMNS, "p_partkey")


def part_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return prepare.to_features(scale.fit_scaler(part, PART_COLUMNS).transform(part), PART_COLUMNS, "p_partkey")


def order_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-order measures, aggregated once and written: fitting reads them several times."""
    return cut_lineage(table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.sum("l_quantity").alias("sum_quantity"), F.avg("l_extendedprice").alias("avg_price"),
        F.avg("l_discount").alias("avg_discount"), F.count("*").cast("double").alias("n_lines"),
    ))


def order_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = order_table(spark, sf_dir)
    return prepare.to_features(scale.fit_scaler(orders, ORDER_COLUMNS).transform(orders), ORDER_COLUMNS, "l_orderkey")


def embedding_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare.to_features(table(spark, sf_dir, "embeddings"), ["embedding"], "vec_id", keep=["label"])


def embedding_centers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_moments(embedding_features(spark, sf_dir), by="label").select(F.col("label").alias("cluster"), "center")


def labelled_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_features(spark, sf_dir).withColumn("cluster", (F.col("row_id") % 4).cast("int"))


def noisy_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_features(spark, sf_dir).withColumn("cluster", (F.col("row_id") % 5 - 1).cast("int"))


def labelled_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_features(spark, sf_dir).withColumn("cluster", (F.col("row_id") % 4).cast("int"))


def gappy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", *LINE_COLUMNS)
    return lines.withColumns({
        "l_quantity": F.nullif("l_quantity", F.lit(1.0)), "l_discount": F.nullif("l_discount", F.lit(0.0)),
        "l_tax": F.nullif("l_tax", F.lit(0.0)),
    })


GAPPY_SQL = (
    "SELECT l_orderkey, nullif(l_quantity, 1.0) AS l_quantity, l_extendedprice, nullif(l_discount, 0.0) AS l_discount, "
    "nullif(l_tax, 0.0) AS l_tax FROM lineitem"
)


def one_row(spark: SparkSession, **values) -> DataFrame:
    """One row of counts (int) and scores (float, NULL where undefined)."""
    schema = ", ".join(f"{k} {'long' if isinstance(v, int) else 'double'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema)


def cells(ff: DataFrame, column: str = "features", digits: int = 6) -> DataFrame:
    return ff.select("row_id", F.posexplode(column).alias("position", "value")).select(
        "row_id", F.col("position").cast("long").alias("position"), rnd("value", digits).alias("value")
    )


# ---------------------------------------------------------------- sources and sinks


@query("SELECT c_custkey, c_mktsegment, c_acctbal FROM customer")
def csv_scan(spark, sf_dir):
    path = scratch_path(spark, "customer") + ".csv"
    table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal").write.csv(path, header=True)
    return read_table(spark, path).withColumn("c_custkey", F.col("c_custkey").cast("long"))


@query("SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders")
def json_scan(spark, sf_dir):
    path = scratch_path(spark, "orders") + ".json"
    table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority").write.json(path)
    return read_table(spark, path, schema="o_orderkey long, o_totalprice double, o_orderpriority string")


@query("SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice FROM lineitem")
def parquet_scan(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")


INSPECTED = [
    "benchmark", "conversations", "customer", "documents", "embeddings", "events", "labels", "lineitem", "nation", "orders", "pages", "part", "region", "supplier",
]
NUMERIC_SQL = "(SELECT count(*) FROM (DESCRIBE {t}) WHERE column_type IN ('BIGINT', 'INTEGER', 'DOUBLE', 'FLOAT'))"


@query(" UNION ALL ".join(
    f"SELECT '{t}' AS table_name, count(*) AS n_rows, (SELECT count(*) FROM (DESCRIBE {t})) AS n_columns, {NUMERIC_SQL.format(t=t)} AS n_numeric FROM {t}"
    for t in INSPECTED
))
def inspect_tables(spark, sf_dir):
    parts = [
        profile.inspect(table(spark, sf_dir, t)).select(F.lit(t).alias("table_name"), "n_rows", "n_columns", "n_numeric")
        for t in INSPECTED
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query(" UNION ALL ".join(
    f"SELECT '{t}.parquet' AS filename, count(*) AS n_rows, {NUMERIC_SQL.format(t=t)} AS n_numeric FROM {t}" for t in INSPECTED
))
def file_listing(spark, sf_dir):
    return list_files(spark, sf_dir).select("filename", "n_rows", F.col("n_numeric").cast("long").alias("n_numeric"))


@query("SELECT p_partkey, p_brand, p_retailprice FROM part")
def dataset_save_load(spark, sf_dir):
    store = Store(spark, scratch_path(spark, "store"))
    dataset = store.save_dataset(table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_retailprice"), "part")
    return store.load_dataset(dataset)


@query("SELECT p_partkey, p_size::BIGINT AS p_size, p_retailprice, p_partkey % 4 AS cluster FROM part")
def labelled_csv_sink(spark, sf_dir):
    path = scratch_path(spark, "labelled") + ".csv"
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice")
    labels = part.select(F.col("p_partkey").alias("row_id"), (F.col("p_partkey") % 4).cast("int").alias("cluster"))
    write_labelled(part, labels, "p_partkey", path)
    return read_table(spark, path, schema="p_partkey long, p_size long, p_retailprice double, cluster long")


@query(f"""WITH {S.PART}, {S.LABELLED}, c AS (SELECT cluster, avg(f0) AS f0, avg(f1) AS f1 FROM lab GROUP BY cluster)
SELECT row_id, cluster, {S.r('c.f0')} AS center_0, {S.r('c.f1')} AS center_1 FROM lab JOIN c USING (cluster)""")
def results_save_load(spark, sf_dir):
    labelled = labelled_part(spark, sf_dir)
    store = Store(spark, scratch_path(spark, "store"))
    centers = group_moments(labelled).select("cluster", "center")
    saved = store.load_results(store.save_results(labelled, algorithm="rule", experiment_id="e", centers=centers))
    return saved["assignments"].join(saved["centers"], "cluster").select(
        "row_id", "cluster", rnd(F.col("center")[0]).alias("center_0"), rnd(F.col("center")[1]).alias("center_1")
    )


@query("SELECT p_partkey, p_brand, p_retailprice, p_partkey % 4 AS cluster FROM part")
def results_export(spark, sf_dir):
    store = Store(spark, scratch_path(spark, "store"))
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_retailprice")
    labels = part.select(F.col("p_partkey").alias("row_id"), (F.col("p_partkey") % 4).cast("int").alias("cluster"))
    path = scratch_path(spark, "export") + ".csv"
    store.export_results(store.save_results(labels, algorithm="rule", experiment_id="e"), part, "p_partkey", path)
    return read_table(spark, path, schema="p_partkey long, p_brand string, p_retailprice double, cluster long")


LEDGER_SQL = """last AS (SELECT * FROM (SELECT user_id AS id, event_id, ts, value,
  CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'deleted' ELSE 'running' END AS status,
  row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1)"""


def event_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events read as a run ledger: one id per user, the type as its state."""
    kind = F.col("event_type")
    status = F.when(kind == "purchase", "completed").when(kind == "error", "failed").when(kind == "signup", "deleted").otherwise("running")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("id"), "event_id", "ts", "value", status.alias("status"))


@query(f"WITH {LEDGER_SQL} SELECT id, event_id, value, status FROM last")
def experiment_ledger(spark, sf_dir):
    return latest(event_ledger(spark, sf_dir), order=("ts", "event_id")).select("id", "event_id", "value", "status")


@query(f"WITH {LEDGER_SQL} SELECT id, event_id, status FROM last WHERE status <> 'deleted'")
def model_registry(spark, sf_dir):
    return live_models(event_ledger(spark, sf_dir), order=("ts", "event_id")).select("id", "event_id", "status")


@query(f"WITH {LEDGER_SQL} SELECT id, event_id, status FROM last WHERE status <> 'deleted'")
def ledger_log(spark, sf_dir):
    """The registry from a log that two writers fill at once, three days of events a commit, compacted on the way."""
    events = event_ledger(spark, sf_dir)
    log = EventLog(spark, scratch_path(spark, "ledger"), "id long, event_id long, ts timestamp_ntz, status string", every=4)
    span = F.floor(F.dayofyear("ts") / 3)
    parts = sorted(r[0] for r in events.select(span).distinct().collect())  # at most 123
    with ThreadPoolExecutor(2) as writers:
        list(writers.map(lambda part: log.append(events.where(span.eqNullSafe(part))), parts))
    return live_models(log.read(), order=("ts", "event_id")).select("id", "event_id", "status")


@query(f"""WITH {S.PART}, {S.LABELLED}, c AS (SELECT cluster, avg(f0) AS f0, avg(f1) AS f1 FROM lab GROUP BY cluster), {S.nearest('c', 'a', 2)}
SELECT row_id, best.c AS cluster, {S.r('sqrt(best.d)')} AS distance FROM a""")
def model_save_predict(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    centers = group_moments(labelled_part(spark, sf_dir)).select("cluster", "center")
    store = Store(spark, scratch_path(spark, "store"))
    model_id = store.save_model_metadata("part", "kmeans")
    store.save_model(CenterModel(scale.fit_scaler(part, PART_COLUMNS), centers), model_id)
    return store.load_model(model_id).predict(part, "p_partkey").withColumn("distance", rnd("distance"))


# ---------------------------------------------------------------- generators over the tables' ids


def ids(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    return table(spark, sf_dir, name).select(F.col(key).alias("row_id"))


def label_sql(groups: int, key: str) -> str:
    label = "'label'"
    return f"floor({S.uniform(key, label, '42')} * {groups})::INT"


def gap_sql(value: str, key: str, j: int, rate: float) -> str:
    gap = "'gap'"
    return f"CASE WHEN NOT ({S.uniform(key, gap, str(j), '42')} < {rate}) THEN {value} END"


def _blob_sql() -> str:
    center = "'center'"
    values = [f"({S.uniform(center, 'l', str(j), '42')} * 2.0 - 1.0) * 10.0 + 1.5 * {S.normal(42, 'k', str(j))}" for j in range(3)]
    values.append(f"0.5 * {S.normal(42, 'k', '3')}")
    shown = ", ".join(f"{S.r(gap_sql(v, 'k', j, 0.05))} AS feature_{j}" for j, v in enumerate(values))
    return f"SELECT k AS row_id, {shown}, l AS true_label FROM (SELECT o_orderkey AS k, {label_sql(4, 'o_orderkey')} AS l FROM orders)"


@query(_blob_sql())
def gen_blobs(spark, sf_dir):
    frame = generate.gen_blobs(
        spark, ids(spark, sf_dir, "orders", "o_orderkey"), d=3, k=4, std=1.5, noise_dims=1, noise_std=0.5, missing_rate=0.05
    )
    return frame.select("row_id", *[rnd(F.col("features")[j]).alias(f"feature_{j}") for j in range(4)], "true_label")


def _three_sql() -> str:
    n = lambda j: S.normal(42, "k", str(j))
    return f"""WITH a AS (SELECT c_custkey AS k, {label_sql(3, 'c_custkey')} AS l FROM customer),
b AS (SELECT k, l, CASE l WHEN 0 THEN 2.0 WHEN 1 THEN 6.0 ELSE 2.0 END::DOUBLE + 0.8 * {n(0)} AS f1,
             CASE l WHEN 0 THEN 2.0 WHEN 1 THEN 6.0 ELSE 6.0 END::DOUBLE + 0.8 * {n(1)} AS f2 FROM a)
SELECT k AS row_id, {S.r('f1')} AS feature_1, {S.r('f2')} AS feature_2, {S.r(f'f1 + f2 + 0.1 * {n(2)}')} AS feature_3,
       {S.r(f'f1 * f2 + 0.5 * {n(3)}')} AS feature_4, {S.r(n(4))} AS feature_5, l AS true_label FROM b"""


@query(_three_sql())
def gen_three_clusters(spark, sf_dir):
    frame = generate.gen_three_clusters(spark, ids(spark, sf_dir, "customer", "c_custkey"))
    return frame.select("row_id", *[rnd(f"feature_{j}").alias(f"feature_{j}") for j in range(1, 6)], "true_label")


def _classification_sql() -> str:
    corner, mix = "'corner'", "'mix'"
    inf = [f"CASE WHEN {S.uniform(corner, 'l', str(j), '42')} < 0.5 THEN -1.0 ELSE 1.0 END::DOUBLE + {S.normal(42, 'k', str(j))}" for j in range(3)]
    mixed = [" + ".join(f"x{i} * ({S.uniform(mix, str(q), str(i), '42')} * 2.0 - 1.0)" for i in range(3)) for q in range(2)]
    values = ["x0", "x1", "x2", *mixed, S.normal(42, "k", "3")]
    shown = ", ".join(f"{S.r(v)} AS feature_{j}" for j, v in enumerate(values))
    return f"""WITH a AS (SELECT c_custkey AS k, {label_sql(3, 'c_custkey')} AS l FROM customer),
b AS (SELECT k, l, {', '.join(f'{v} AS x{j}' for j, v in enumerate(inf))} FROM a)
SELECT k AS row_id, {shown}, l AS true_label FROM b"""


@query(_classification_sql())
def gen_classification(spark, sf_dir):
    frame = generate.gen_classification(spark, ids(spark, sf_dir, "customer", "c_custkey"), d=6, informative=3, redundant=2, classes=3)
    return frame.select("row_id", *[rnd(F.col("features")[j]).alias(f"feature_{j}") for j in range(6)], "true_label")


def _mixed_sql() -> str:
    values = [S.normal(42, "k", str(j)) for j in range(3)]
    values += [f"floor({S.uniform('k', '3', '42')} * 5)::DOUBLE", f"floor({S.uniform('k', '4', '42')} * 2)::DOUBLE"]
    z = lambda j: f"(x{j} - (SELECT avg(x{j}) FROM a)) / (SELECT stddev_pop(x{j}) FROM a)"
    shown = ", ".join(f"{S.r(gap_sql(f'x{j}', 'k', j, 0.05))} AS feature_{j}" for j in range(5))
    return f"""WITH a AS MATERIALIZED (SELECT k, {', '.join(f'{v} AS x{j}' for j, v in enumerate(values))} FROM (SELECT o_orderkey AS k FROM orders))
SELECT k AS row_id, {shown}, CASE WHEN {z(0)} > 1.0 THEN 0 WHEN {z(1)} > 0.5 THEN 1 WHEN {z(2)} < -0.5 THEN 2 ELSE 3 END AS true_label FROM a"""


@query(_mixed_sql())
def gen_mixed(spark, sf_dir):
    frame = generate.gen_mixed(spark, ids(spark, sf_dir, "orders", "o_orderkey"), numeric=3, categorical=1, binary=1)
    return frame.select("row_id", *[rnd(F.col("features")[j]).alias(f"feature_{j}") for j in range(5)], "true_label")


def _timeseries_sql(steps: int = 50) -> str:
    at = lambda stop: f"(t * {stop!r} / {steps - 1})"
    noise = S.normal(42, "k", "t")
    return f"""WITH a AS (SELECT c_custkey AS k, {label_sql(4, 'c_custkey')} AS l FROM customer),
b AS (SELECT k, l, t, {noise} AS e FROM a CROSS JOIN (SELECT unnest(range({steps})) AS t)),
c AS (SELECT k, l, t, CASE l WHEN 0 THEN {at(10.0)} + e * 0.5 WHEN 1 THEN sin({at(4 * 3.141592653589793)}) + e * 0.3
      WHEN 2 THEN exp(-{at(3.0)}) + e * 0.2 ELSE sum(e * 0.1) OVER (PARTITION BY k ORDER BY t) END AS v FROM b)
SELECT k AS row_id, {S.r('arg_min(v, t)')} AS first_value, {S.r('arg_max(v, t)')} AS last_value, {S.r('avg(v)')} AS mean, {S.r('stddev_pop(v)')} AS std,
       {S.r('min(v)')} AS min, {S.r('max(v)')} AS max, {S.r('median(v)')} AS median, l AS true_label FROM c GROUP BY k, l"""


@query(_timeseries_sql())
def gen_timeseries(spark, sf_dir):
    frame = generate.gen_timeseries(spark, ids(spark, sf_dir, "customer", "c_custkey"))
    return frame.select(
        "row_id", rnd(F.col("series")[0]).alias("first_value"), rnd(F.col("series")[49]).alias("last_value"),
        *[rnd(c).alias(c) for c in ("mean", "std", "min", "max", "median")], "true_label",
    )


# ---------------------------------------------------------------- profiling and preparation


@query("SELECT o_orderkey::DOUBLE AS o_orderkey, o_totalprice FROM orders")
def numeric_selection(spark, sf_dir):
    return prepare.split_target(table(spark, sf_dir, "orders"), "o_custkey")[0]


@query(f"WITH {S.EMBEDDING_CELLS} SELECT row_id, position, {S.r('value')} AS value FROM cells")
def feature_frame(spark, sf_dir):
    return cells(embedding_features(spark, sf_dir))


@query(f"""WITH g AS ({GAPPY_SQL}), n AS (SELECT count(*) AS n FROM g)
SELECT c AS column_name, m AS missing_count, {S.r('m * 100.0 / n')} AS missing_percent FROM n, (""" + " UNION ALL ".join(
    f"SELECT '{c}' AS c, count(*) FILTER ({c} IS NULL) AS m FROM g" for c in ["l_orderkey", *LINE_COLUMNS]) + ")")
def missing_report(spark, sf_dir):
    return profile.missing_report(gappy_lines(spark, sf_dir)).withColumn("missing_percent", rnd("missing_percent"))


@query("""SELECT CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double'
WHEN 'VARCHAR' THEN 'string' ELSE 'timestamp_ntz' END AS data_type, count(*) AS n_columns FROM (DESCRIBE lineitem) GROUP BY 1""")
def type_histogram(spark, sf_dir):
    return profile.type_histogram(table(spark, sf_dir, "lineitem")).withColumn("n_columns", F.col("n_columns").cast("long"))


DESCRIBED = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", *LINE_COLUMNS]


@query(" UNION ALL ".join(
    f"""SELECT '{c}' AS column_name, count({c}) AS count, {S.r(f'avg({c})')} AS mean, {S.r(f'stddev_samp({c})')} AS std, min({c})::DOUBLE AS min,
{S.r(f'quantile_cont({c}, 0.25)')} AS q25, {S.r(f'quantile_cont({c}, 0.5)')} AS q50, {S.r(f'quantile_cont({c}, 0.75)')} AS q75, max({c})::DOUBLE AS max FROM lineitem"""
    for c in DESCRIBED
))
def describe(spark, sf_dir):
    out = profile.describe(table(spark, sf_dir, "lineitem"))
    return out.withColumns({c: rnd(c) for c in ("mean", "std", "q25", "q50", "q75")})


@query("SELECT " + ", ".join(
    f"CASE WHEN length({c}::VARCHAR) > 10 THEN substr({c}::VARCHAR, 1, 10) || '...' ELSE {c}::VARCHAR END AS {c}"
    for c in ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate"]
) + " FROM (SELECT * FROM orders o ORDER BY o.o_orderkey LIMIT 100)")
def preview(spark, sf_dir):
    return profile.preview(table(spark, sf_dir, "orders"), ["o_orderkey"])


def _impute_sql(fn: str) -> str:
    shown = ", ".join(f"{S.r(f'coalesce({c}, (SELECT {fn}({c}) FROM g))')} AS {c}" for c in LINE_COLUMNS)
    return f"WITH g AS MATERIALIZED ({GAPPY_SQL}) SELECT l_orderkey, {shown} FROM g"


@query(_impute_sql("avg"))
def impute_mean(spark, sf_dir):
    return _rounded_lines(prepare.impute(gappy_lines(spark, sf_dir), "mean", LINE_COLUMNS))


@query(_impute_sql("median"))
def impute_median(spark, sf_dir):
    return _rounded_lines(prepare.impute(gappy_lines(spark, sf_dir), "median", LINE_COLUMNS))


def _rounded_lines(lines: DataFrame) -> DataFrame:
    return lines.select("l_orderkey", *[rnd(c).alias(c) for c in LINE_COLUMNS])


def _mode_sql(column: str) -> str:
    return f"coalesce({column}, (SELECT {column} FROM g WHERE {column} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1))"


@query(f"""WITH g AS MATERIALIZED (SELECT o_orderkey, nullif(o_orderstatus, 'F') AS o_orderstatus, nullif(o_orderpriority, '1-URGENT') AS o_orderpriority,
CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_custkey END AS o_custkey FROM orders)
SELECT o_orderkey, {_mode_sql('o_orderstatus')} AS o_orderstatus, {_mode_sql('o_orderpriority')} AS o_orderpriority, {_mode_sql('o_custkey')} AS o_custkey FROM g""")
def impute_mode(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.nullif("o_orderstatus", F.lit("F")).alias("o_orderstatus"),
        F.nullif("o_orderpriority", F.lit("1-URGENT")).alias("o_orderpriority"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_custkey")).alias("o_custkey"),
    )
    return prepare.impute(orders, "mode", ["o_orderstatus", "o_orderpriority", "o_custkey"])


LINE_SOURCE = "SELECT l_orderkey, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem"


@query(f"WITH {S.sequential_filter(LINE_COLUMNS, LINE_SOURCE, 'iqr', 0.4)} SELECT * FROM t4")
def outliers_iqr(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", *LINE_COLUMNS)
    return prepare.remove_outliers(lines, "iqr", 0.4, LINE_COLUMNS)


@query(f"WITH {S.sequential_filter(LINE_COLUMNS, LINE_SOURCE, 'zscore', 1.5)} SELECT * FROM t4")
def outliers_zscore(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", *LINE_COLUMNS)
    return prepare.remove_outliers(lines, "zscore", 1.5, LINE_COLUMNS)


@query(f"""WITH {S.sequential_filter(['value'], 'SELECT event_id, value FROM events', 'iqr', 1.5)}
SELECT n AS n_rows, n - k AS removed, {S.r('(n - k) * 100.0 / n')} AS removed_percent FROM (SELECT count(*) AS n FROM t0), (SELECT count(*) AS k FROM t1)""")
def outlier_report(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    kept = prepare.remove_outliers(events, "iqr", columns=["value"])
    return prepare.outlier_report(events, kept).withColumn("removed_percent", rnd("removed_percent"))


def _scale_sql(form: str) -> str:
    shown = ", ".join(f"{S.r(form.replace('{c}', c))} AS {c}" for c in LINE_COLUMNS)
    return f"SELECT l_orderkey, {shown} FROM lineitem"


def _scaled_lines(spark, sf_dir, method) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", *LINE_COLUMNS)
    return _rounded_lines(scale.fit_scaler(lines, LINE_COLUMNS, method).transform(lines))


@query(_scale_sql("({c} - (SELECT avg({c}) FROM lineitem)) / (SELECT stddev_pop({c}) FROM lineitem)"))
def scale_standard(spark, sf_dir):
    return _scaled_lines(spark, sf_dir, "standard")


@query(_scale_sql("({c} - (SELECT min({c}) FROM lineitem)) / (SELECT max({c}) - min({c}) FROM lineitem)"))
def scale_minmax(spark, sf_dir):
    return _scaled_lines(spark, sf_dir, "minmax")


@query(_scale_sql("({c} - (SELECT median({c}) FROM lineitem)) / (SELECT quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) FROM lineitem)"))
def scale_robust(spark, sf_dir):
    return _scaled_lines(spark, sf_dir, "robust")


@query(_scale_sql("{c}"))
def scale_none(spark, sf_dir):
    return _scaled_lines(spark, sf_dir, None)


@query(_scale_sql("{c}"))
def scale_inverse(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", *LINE_COLUMNS)
    scaler = scale.fit_scaler(lines, LINE_COLUMNS, "standard")
    return _rounded_lines(scaler.inverse(scaler.transform(lines)))


@query(f"WITH {S.ORDER_RAW} " + " UNION ALL ".join(
    f"SELECT {i} AS i, {j} AS j, {S.r(f'covar_samp(f{i}, f{j})', 4)} AS value FROM raw" for i in range(4) for j in range(i, 4)
))
def covariance(spark, sf_dir):
    ff = prepare.to_features(order_table(spark, sf_dir), ORDER_COLUMNS, "l_orderkey")
    return reduce.covariance(ff).withColumn("value", rnd("value", 4))


# With two features the components have a closed form.
PCA_SQL = f"""WITH {S.PART_RAW}, m AS (SELECT avg(f0) AS m0, avg(f1) AS m1, var_samp(f0) AS a, covar_samp(f0, f1) AS b, var_samp(f1) AS c FROM raw),
e AS (SELECT *, (a + c) / 2 + sqrt((a - c) * (a - c) / 4 + b * b) AS l1, (a + c) / 2 - sqrt((a - c) * (a - c) / 4 + b * b) AS l2 FROM m),
u AS (SELECT *, b / sqrt(b * b + (l1 - a) * (l1 - a)) AS x0, (l1 - a) / sqrt(b * b + (l1 - a) * (l1 - a)) AS x1 FROM e),
v AS (SELECT *, CASE WHEN (abs(x0) > abs(x1) AND x0 < 0) OR (abs(x0) <= abs(x1) AND x1 < 0) THEN -1 ELSE 1 END AS s1,
      CASE WHEN (abs(x1) > abs(x0) AND x1 < 0) OR (abs(x1) <= abs(x0) AND x0 > 0) THEN -1 ELSE 1 END AS s2 FROM u),
p AS (SELECT row_id, s1 * ((f0 - m0) * x0 + (f1 - m1) * x1) AS pc1, s2 * ((f0 - m0) * x1 - (f1 - m1) * x0) AS pc2, l1 / (l1 + l2) AS ratio FROM raw, v)"""


@query(f"{PCA_SQL} SELECT row_id, {S.r('pc1', 4)} AS pc1, {S.r('pc2', 4)} AS pc2, {S.r('ratio')} AS ratio FROM p")
def pca_coordinates(spark, sf_dir):
    projected, ratios = reduce.plot_coordinates(part_raw(spark, sf_dir), 2)
    x = F.col("features")
    return projected.select("row_id", rnd(x[0], 4).alias("pc1"), rnd(x[1], 4).alias("pc2"), rnd(F.lit(ratios[0])).alias("ratio"))


@query(f"{PCA_SQL} SELECT row_id, {S.r('pc2 * pc2 / 2', 4)} AS error FROM p")
def pca_reconstruction_error(spark, sf_dir):
    ff = part_raw(spark, sf_dir)
    return reduce.fit_pca(ff, 1).reconstruction_error(ff).withColumn("error", rnd("error", 4))


@query()
def pca_embeddings(spark, sf_dir):
    reduced, _ = reduce.reduce_if_wide(embedding_features(spark, sf_dir), 10)
    return cells(reduced)


@query(f"""WITH RECURSIVE {S.FIRST_AXIS} SELECT e.vec_id AS row_id,
{S.r('abs(list_dot_product(list_transform(range(64), lambda i: e.embedding[i + 1]::DOUBLE - m.mean[i + 1]), axis.v))', 4)} AS size,
{S.r('axis.ratio', 6)} AS ratio FROM embeddings e, m, axis""")
def pca_first_axis(spark, sf_dir):
    """How far each embedding lies along the first component, found without a covariance matrix."""
    ff = embedding_features(spark, sf_dir)
    model = reduce.fit_pca_range(ff, 1, oversample=11)
    ratio = rnd(F.lit(float(model.explained_variance_ratio[0]))).alias("ratio")
    return model.project(ff).select("row_id", rnd(F.abs(F.col("features")[0]), 4).alias("size"), ratio)


@query(f"""WITH {S.EMBEDDING_CELLS} SELECT row_id, {S.r('avg(value)')} AS mean, {S.r('stddev_pop(value)')} AS std, {S.r('min(value)')} AS min,
{S.r('max(value)')} AS max, {S.r('median(value)')} AS median FROM cells GROUP BY row_id""")
def row_summary(spark, sf_dir):
    from starling.functions.vectors import row_summary as summary

    out = embedding_features(spark, sf_dir).select("row_id", *summary(F.col("features")))
    return out.select("row_id", *[rnd(c).alias(c) for c in ("mean", "std", "min", "max", "median")])


ROW_ID = "row_id"


def _augment_sql() -> str:
    shown = ", ".join(
        f"{S.r(f'f{j} + 0.1 * {S.normal(42, ROW_ID, str(j))}')} AS noise_{j}, "
        f"{S.r(f'CASE WHEN {S.uniform(ROW_ID, str(j), str(43))} < 0.1 THEN 0.0 ELSE f{j} END')} AS dropout_{j}" for j in range(2)
    )
    return f"WITH {S.PART} SELECT row_id, {shown} FROM ff"



@query(_augment_sql())
def augment(spark, sf_dir):
    views = prepare.augment(part_features(spark, sf_dir))
    return views.select(
        "row_id",
        *[rnd(F.col("view_noise")[j]).alias(f"noise_{j}") for j in range(2)],
        *[rnd(F.col("view_dropout")[j]).alias(f"dropout_{j}") for j in range(2)],
    )


@query(f"WITH {S.PART_RAW} SELECT row_id, " + ", ".join(f"{S.r(f'f{j} / sqrt(f0 * f0 + f1 * f1)')} AS x{j}" for j in range(2)) + " FROM raw")
def l2_normalize(spark, sf_dir):
    x = F.col("features")
    return prepare.normalize_rows(part_raw(spark, sf_dir)).select("row_id", rnd(x[0]).alias("x0"), rnd(x[1]).alias("x1"))


# ---------------------------------------------------------------- clustering


@query()
def kmeans_best_of_ten(spark, sf_dir):
    fit = kmeans(order_features(spark, sf_dir), 3)
    return fit.labels.groupBy("cluster").agg(F.count("*").alias("size")).withColumn("inertia", rnd(F.lit(fit.inertia)))


@query(f"WITH {S.ORDERS}, {S.lloyd(3, 5, 4)} SELECT row_id, best.c AS cluster, {S.r('sqrt(best.d)', 4)} AS distance FROM assigned")
def kmeans_fixed_start(spark, sf_dir):
    ff = order_features(spark, sf_dir).persist()
    try:
        labelled, _, _ = kmeans_lloyd(ff, first_distinct_rows(ff, 3), 5)
    finally:
        ff.unpersist()
    return labelled.select("row_id", "cluster", rnd("distance", 4).alias("distance"))


@query(f"""WITH {S.ORDERS}, {S.lloyd(3, 5, 4)}, lab AS MATERIALIZED (SELECT *, best.c AS cluster FROM assigned), {S.dispersion('lab', 4)}
SELECT cluster, count(*) AS size, {S.r('count(*) * 100.0 / (SELECT count(*) FROM lab)')} AS percent, """ + ", ".join(
    f"{S.r(f'avg(f{j})', 4)} AS center_{j}, {S.r(f'stddev_pop(f{j})', 4)} AS std_{j}" for j in range(4)
) + f", {S.r('(SELECT ch FROM disp)', 3)} AS calinski_harabasz FROM lab GROUP BY cluster")
def order_clusters(spark, sf_dir):
    """Orders from lineitem: impute, scale, k-means, report."""
    orders = prepare.impute(order_table(spark, sf_dir), "mean", ORDER_COLUMNS)
    scaler = scale.fit_scaler(orders, ORDER_COLUMNS)
    ff = prepare.to_features(scaler.transform(orders), ORDER_COLUMNS, "l_orderkey").persist()
    try:
        labelled, _, _ = kmeans_lloyd(ff, first_distinct_rows(ff, 3), 5)
        score = evaluate.calinski_harabasz(labelled)
    finally:
        ff.unpersist()
    out = report.cluster_report(labelled)
    return out.select(
        "cluster", "size", rnd("percent").alias("percent"),
        *[rnd(F.col("center")[j], 4).alias(f"center_{j}") for j in range(4)],
        *[rnd(F.col("std")[j], 4).alias(f"std_{j}") for j in range(4)],
        rnd(F.lit(score), 3).alias("calinski_harabasz"),
    )


@query(f"""WITH {S.EMBEDDING_CELLS}, {S.EMBEDDING_CENTERS}, {S.EMBEDDING_GAPS},
best AS (SELECT row_id, min({{'d': d2, 'c': cluster}}) AS b FROM gaps GROUP BY row_id)
SELECT row_id, b.c AS cluster, {S.r('sqrt(b.d)')} AS distance FROM best""")
def assign_nearest(spark, sf_dir):
    out = assign(embedding_features(spark, sf_dir), embedding_centers(spark, sf_dir))
    return out.select("row_id", "cluster", rnd("distance").alias("distance"))


@query(f"WITH {S.PART}, {S.LABELLED}, {S.dispersion('lab', 2)} SELECT {S.r('w')} AS inertia FROM disp")
def inertia_of_labels(spark, sf_dir):
    return inertia(labelled_part(spark, sf_dir)).withColumn("inertia", rnd("inertia"))


KNEE_COSTS = "costs AS (SELECT l_linenumber + 1 AS k, sum(l_extendedprice * l_discount / l_linenumber) AS inertia FROM lineitem GROUP BY 1)"


@query(f"""WITH {KNEE_COSTS}, b AS (SELECT k, lead(inertia) OVER w - 2 * inertia + lag(inertia) OVER w AS bend FROM costs WINDOW w AS (ORDER BY k))
SELECT k::BIGINT AS k FROM b WHERE bend IS NOT NULL ORDER BY bend DESC, k LIMIT 1""")
def elbow_knee(spark, sf_dir):
    costs = table(spark, sf_dir, "lineitem").groupBy((F.col("l_linenumber") + 1).alias("k")).agg(
        F.sum(F.col("l_extendedprice") * F.col("l_discount") / F.col("l_linenumber")).alias("inertia")
    )
    return knee(costs)


@query()
def elbow_table(spark, sf_dir):
    return elbow(order_features(spark, sf_dir))[1].withColumn("inertia", rnd("inertia", 4))


@query()
def elbow_scores(spark, sf_dir):
    ff = part_features(spark, sf_dir)
    scores = evaluate.elbow_scores(ff, range(2, max(2, min(20, ff.count() // 2)) + 1))
    return scores.select("k", rnd("inertia", 4).alias("inertia"), rnd("silhouette", 4).alias("silhouette"))


@query(f"WITH RECURSIVE {S.PART}, {S.dbscan(DBSCAN_EPS, DBSCAN_MIN)} SELECT row_id, cluster FROM lab")
def dbscan_part(spark, sf_dir):
    return dbscan_labels(part_features(spark, sf_dir), DBSCAN_EPS, DBSCAN_MIN).select("row_id", "cluster")


@query(f"""WITH RECURSIVE wide AS MATERIALIZED (SELECT vec_id AS row_id, {', '.join(f'embedding[{j + 1}]::DOUBLE AS f{j}' for j in range(64))} FROM embeddings),
{S.dbscan(1.12, 3, 'wide', 64)} SELECT row_id, cluster FROM lab""")
def dbscan_embeddings(spark, sf_dir):
    return dbscan_labels(embedding_features(spark, sf_dir), 1.12, 3).select("row_id", "cluster")


@query()
def hierarchical_ward(spark, sf_dir):
    return hierarchical(part_features(spark, sf_dir), 4).labels.select("row_id", "cluster")


@query()
def spectral_rbf(spark, sf_dir):
    return spectral(part_features(spark, sf_dir), 4).labels.select("row_id", "cluster")


@query()
def hdbscan_part(spark, sf_dir):
    return hdbscan(part_features(spark, sf_dir), 10).labels.select("row_id", "cluster")


# ------------------------------------------------ clusterings with one right answer


def blob_features(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    """Four separated squares of points, placed by the table's ids."""
    group = F.pmod(F.col(key), F.lit(4))
    noise = lambda j: hash_uniform(42, F.col(key), F.lit("blob"), F.lit(j)) * 2.0 - 1.0
    x = (group % 2) * 20.0 + noise(0)
    y = F.floor(group / 2) * 20.0 + noise(1)
    return table(spark, sf_dir, name).select(F.col(key).cast("long").alias("row_id"), F.array(x, y).alias("features"))


def blob_sql(name: str, key: str) -> str:
    noise = [f"({S.uniform(key, chr(39) + 'blob' + chr(39), str(j), '42')} * 2.0 - 1.0)" for j in range(2)]
    return (
        f"blobs AS MATERIALIZED (SELECT {key}::BIGINT AS row_id, {key} % 4 AS g, ({key} % 4) % 2 * 20.0::DOUBLE + {noise[0]} AS f0, "
        f"({key} % 4) // 2 * 20.0::DOUBLE + {noise[1]} AS f1 FROM {name}), "
        "named AS MATERIALIZED (SELECT row_id, g, f0, f1, dense_rank() OVER (ORDER BY first) - 1 AS cluster "
        "FROM (SELECT *, min(row_id) OVER (PARTITION BY g) AS first FROM blobs))"
    )


def named_by_first_row(labelled: DataFrame) -> DataFrame:
    """Clusters numbered by their smallest row."""
    firsts = labelled.groupBy("cluster").agg(F.min("row_id").alias("first"))
    names = firsts.select(F.col("cluster").alias("old"), (F.row_number().over(Window.orderBy("first")) - 1).alias("name"))
    return labelled.join(F.broadcast(names), F.col("cluster") == F.col("old")).select("row_id", F.col("name").cast("bigint").alias("cluster"))


BLOB_LABELS = "SELECT row_id, cluster::BIGINT AS cluster FROM named"


@query(f"WITH {blob_sql('orders', 'o_orderkey')} {BLOB_LABELS}")
def kmeans_blobs(spark, sf_dir):
    return named_by_first_row(kmeans(blob_features(spark, sf_dir, "orders", "o_orderkey"), 4).labels)


@query(f"""WITH {blob_sql('part', 'p_partkey')}, m AS (SELECT g, avg(f0) AS m0, avg(f1) AS m1 FROM named GROUP BY g)
SELECT count(DISTINCT g)::INTEGER AS k, {S.r('sum((f0 - m0) ** 2 + (f1 - m1) ** 2)', 4)} AS inertia FROM named JOIN m USING (g)""")
def elbow_blobs(spark, sf_dir):
    k, costs = elbow(blob_features(spark, sf_dir, "part", "p_partkey"), 8)
    return costs.where(F.col("k") == k).select(F.col("k").cast("int").alias("k"), rnd("inertia", 4).alias("inertia"))


@query(f"""WITH {blob_sql('part', 'p_partkey')}, {S.silhouette('named', 2)}, m AS (SELECT g, avg(f0) AS m0, avg(f1) AS m1 FROM named GROUP BY g)
SELECT 4 AS k, (SELECT {S.r('sum((f0 - m0) ** 2 + (f1 - m1) ** 2)', 4)} FROM named JOIN m USING (g)) AS inertia, {S.r('avg(silhouette)', 4)} AS silhouette FROM sil""")
def elbow_scores_blobs(spark, sf_dir):
    scores = evaluate.elbow_scores(blob_features(spark, sf_dir, "part", "p_partkey"), range(3, 6)).where("k = 4")
    return scores.select("k", rnd("inertia", 4).alias("inertia"), rnd("silhouette", 4).alias("silhouette"))


@query(f"WITH {blob_sql('part', 'p_partkey')} {BLOB_LABELS}")
def ward_blobs(spark, sf_dir):
    return named_by_first_row(hierarchical(blob_features(spark, sf_dir, "part", "p_partkey"), 4).labels)


@query(f"WITH {blob_sql('orders', 'o_orderkey')} {BLOB_LABELS}")
def divisive_blobs(spark, sf_dir):
    return named_by_first_row(divisive(blob_features(spark, sf_dir, "orders", "o_orderkey"), 4).labels)


@query(f"WITH {blob_sql('part', 'p_partkey')} SELECT linkage, row_id, cluster::BIGINT AS cluster FROM named, (VALUES ('average'), ('complete'), ('single')) l(linkage)")
def linkage_blobs(spark, sf_dir):
    ff = blob_features(spark, sf_dir, "part", "p_partkey")
    parts = [named_by_first_row(hierarchical(ff, 4, linkage=name).labels).select(F.lit(name).alias("linkage"), "*") for name in ("average", "complete", "single")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"WITH {blob_sql('supplier', 's_suppkey')} {BLOB_LABELS}")
def spectral_blobs(spark, sf_dir):
    return named_by_first_row(spectral(blob_features(spark, sf_dir, "supplier", "s_suppkey"), 4).labels)


@query(f"WITH {blob_sql('part', 'p_partkey')} {BLOB_LABELS}")
def hdbscan_blobs(spark, sf_dir):
    return named_by_first_row(hdbscan(blob_features(spark, sf_dir, "part", "p_partkey"), 20).labels)


@query(f"WITH {blob_sql('supplier', 's_suppkey')} {BLOB_LABELS}")
def deep_embedding_blobs(spark, sf_dir):
    return named_by_first_row(soft.deep_embedding(blob_features(spark, sf_dir, "supplier", "s_suppkey"), 4, latent_dim=2).labels)


@query(f"""WITH {blob_sql('part', 'p_partkey')},
gaps AS (SELECT a.row_id, sqrt((a.f0 - b.f0) ** 2 + (a.f1 - b.f1) ** 2) AS gap FROM named a JOIN named b ON a.row_id <> b.row_id)
SELECT row_id, {S.r('gap')} AS core FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY gap) AS place FROM gaps) WHERE place = 10""")
def hdbscan_core_distances(spark, sf_dir):
    points = blob_features(spark, sf_dir, "part", "p_partkey").withColumn("n", F.lit(1.0))
    return with_core_distances(points, 10).select("row_id", rnd("core").alias("core"))


@query(f"WITH {S.EMBEDDING_CELLS}, {S.EMBEDDING_CENTERS}, {S.EMBEDDING_GAPS}, {S.SOFT} SELECT row_id, cluster::BIGINT AS position, {S.r('q')} AS value FROM soft")
def soft_assignment(spark, sf_dir):
    return cells(soft.soft_assign(embedding_features(spark, sf_dir), embedding_centers(spark, sf_dir)), "q")


@query(f"WITH {S.EMBEDDING_CELLS}, {S.EMBEDDING_CENTERS}, {S.EMBEDDING_GAPS}, {S.SOFT}, {S.TARGET} SELECT row_id, cluster::BIGINT AS position, {S.r('p')} AS value FROM target")
def target_distribution(spark, sf_dir):
    q = soft.soft_assign(embedding_features(spark, sf_dir), embedding_centers(spark, sf_dir))
    return cells(soft.target_distribution(q), "p")


@query(f"""WITH {S.EMBEDDING_CELLS}, {S.EMBEDDING_CENTERS}, {S.EMBEDDING_GAPS}, {S.SOFT}, {S.TARGET}
SELECT {S.r('sum(p * ln(p / q)) / count(DISTINCT row_id)', 8)} AS kl FROM target""")
def kl_loss(spark, sf_dir):
    q = soft.soft_assign(embedding_features(spark, sf_dir), embedding_centers(spark, sf_dir))
    return soft.kl_divergence(soft.target_distribution(q)).withColumn("kl", rnd("kl", 8))


@query(f"""WITH {S.PART}, {S.dec(3, 3, 5.0)},
best AS (SELECT row_id, min({{'q': -q, 'c': cluster}}) AS b FROM q3 GROUP BY row_id)
SELECT row_id, b.c AS cluster, {S.r('-b.q', 4)} AS membership FROM best""")
def dec_refinement(spark, sf_dir):
    ff = part_features(spark, sf_dir)
    start = group_moments(ff.withColumn("cluster", (F.col("row_id") % 3).cast("int"))).select("cluster", "center")
    fit = soft.dec_refine(ff, start, rounds=3, lr=5.0)
    return fit.labels.select("row_id", "cluster", rnd(F.array_max("q"), 4).alias("membership"))


@query()
def deep_embedding(spark, sf_dir):
    fit = soft.deep_embedding(embedding_features(spark, sf_dir), 5, latent_dim=4)
    return fit.labels.select("row_id", "cluster")


@query(f"""WITH RECURSIVE {S.PART}, {S.dbscan(DBSCAN_EPS, DBSCAN_MIN)}, kept AS MATERIALIZED (SELECT * FROM lab WHERE cluster >= 0),
{S.silhouette('kept', 2)}, {S.dispersion('kept', 2)}
SELECT (SELECT count(*) FROM lab) AS n_samples, (SELECT count(DISTINCT cluster) FROM kept) AS n_clusters,
       (SELECT count(*) FROM lab WHERE cluster < 0) AS n_noise, {S.r('(SELECT avg(silhouette) FROM sil)')} AS silhouette,
       {S.r('ch', 4)} AS calinski_harabasz, {S.r('db')} AS davies_bouldin FROM disp""")
def full_run(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", *PART_COLUMNS)
    store = Store(spark, scratch_path(spark, "store"))
    m = run(part, "dbscan", id_col="p_partkey", eps=DBSCAN_EPS, min_samples=DBSCAN_MIN, store=store).metrics
    out = one_row(
        spark, n_samples=m["n_samples"], n_clusters=m["n_clusters"], n_noise=m["n_noise"], silhouette=m["silhouette_score"],
        calinski_harabasz=m["calinski_harabasz_score"], davies_bouldin=m["davies_bouldin_score"],
    )
    return out.withColumns({"silhouette": rnd("silhouette"), "calinski_harabasz": rnd("calinski_harabasz", 4), "davies_bouldin": rnd("davies_bouldin")})


@query(f"""WITH RECURSIVE {S.PART}, {S.dbscan(DBSCAN_EPS, DBSCAN_MIN)}, kept AS MATERIALIZED (SELECT * FROM lab WHERE cluster >= 0), {S.silhouette('kept', 2)}
SELECT 'part' AS dataset, 'dbscan' AS algorithm, {S.r('avg(silhouette)', 4)} AS silhouette, NULL::VARCHAR AS error FROM sil
UNION ALL SELECT 'part', 'unheard_of', NULL, 'Unknown algorithm: unheard_of'
UNION ALL SELECT 'names', 'dbscan', NULL, 'No numeric columns found in the dataset'
UNION ALL SELECT 'names', 'unheard_of', NULL, 'Unknown algorithm: unheard_of'""")
def batch_cells(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", *PART_COLUMNS)
    names = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    options = {"dbscan": {"eps": DBSCAN_EPS, "min_samples": DBSCAN_MIN}}
    summary = run_batch({"part": part, "names": names}, ["dbscan", "unheard_of"], options=options, id_col="p_partkey")
    silhouette = rnd(F.try_element_at("metrics", F.lit("silhouette_score")), 4)
    return summary.select("dataset", "algorithm", silhouette.alias("silhouette"), "error")


@query()
def batch_run(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", *PART_COLUMNS)
    supplier = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("p_partkey"), "s_nationkey", "s_acctbal")
    options = {"kmeans": {"n_clusters": 3}, "hierarchical": {"n_clusters": 3}}
    summary = run_batch({"part": part, "supplier": supplier}, ["kmeans", "hierarchical", "unheard_of"], options=options, id_col="p_partkey")
    return summary.select(
        "dataset", "algorithm", rnd(F.try_element_at("metrics", F.lit("silhouette_score")), 4).alias("silhouette"), "error"
    )


EVENT_FEATURES = (
    "raw AS (SELECT event_id AS row_id, user_id::DOUBLE AS f0, value AS f1, event_type FROM events), "
    "ff AS MATERIALIZED (SELECT row_id, event_type, (f0 - (SELECT avg(f0) FROM raw)) / (SELECT stddev_pop(f0) FROM raw) AS f0, "
    "(f1 - (SELECT avg(f1) FROM raw)) / (SELECT stddev_pop(f1) FROM raw) AS f1 FROM raw)"
)


def event_model(spark: SparkSession, sf_dir: str) -> CenterModel:
    """Centres by event type over the scaled events."""
    events = table(spark, sf_dir, "events").withColumn("cluster", (F.col("event_id") % 3).cast("int"))
    scaler = scale.fit_scaler(events, ["user_id", "value"])
    ff = prepare.to_features(scaler.transform(events), ["user_id", "value"], "event_id", keep=["cluster"])
    return CenterModel(scaler, group_moments(ff).select("cluster", "center"))


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


EVENT_CENTERS = "c AS (SELECT (row_id % 3)::INT AS cluster, avg(f0) AS f0, avg(f1) AS f1 FROM ff GROUP BY 1)"


@query(f"WITH {EVENT_FEATURES}, {EVENT_CENTERS}, {S.nearest('c', 'a', 2)} SELECT row_id, best.c AS cluster, {S.r('sqrt(best.d)')} AS distance FROM a")
def stream_scoring(spark, sf_dir):
    path = scratch_path(spark, "scored")
    scored = score_stream(event_stream(spark, sf_dir), event_model(spark, sf_dir), "event_id")
    write_stream(scored, path, scratch_path(spark, "progress"), available_now=True).awaitTermination()
    return spark.read.parquet(path).withColumn("distance", rnd("distance"))


@query(f"""WITH {EVENT_FEATURES}, {EVENT_CENTERS}, {S.nearest('c', 'a', 2)}
SELECT best.c AS cluster, {S.r('avg(f0)')} AS center_0, {S.r('avg(f1)')} AS center_1, count(*) AS n FROM a GROUP BY 1""")
def stream_minibatch_kmeans(spark, sf_dir):
    model = event_model(spark, sf_dir)
    running, state = minibatch_kmeans_stream(
        event_stream(spark, sf_dir), lambda batch: model.features(batch, "event_id"), model.centers,
        scratch_path(spark, "centers"), scratch_path(spark, "progress"), available_now=True,
    )
    running.awaitTermination()
    c = F.col("center")
    return state.latest().select("cluster", rnd(c[0]).alias("center_0"), rnd(c[1]).alias("center_1"), "n")


# ---------------------------------------------------------------- evaluation


@query(f"WITH {S.PART}, {S.LABELLED}, {S.silhouette('lab', 2)} SELECT {S.r('avg(silhouette)')} AS silhouette FROM sil")
def silhouette(spark, sf_dir):
    return one_row(spark, silhouette=evaluate.silhouette(labelled_part(spark, sf_dir))).withColumn("silhouette", rnd("silhouette"))


@query(f"WITH {S.PART}, {S.LABELLED}, {S.silhouette('lab', 2)} SELECT row_id, cluster, {S.r('a')} AS a, {S.r('b')} AS b, {S.r('silhouette')} AS silhouette FROM sil")
def silhouette_rows(spark, sf_dir):
    out = evaluate.silhouette_rows(labelled_part(spark, sf_dir))
    return out.select("row_id", "cluster", *[rnd(c).alias(c) for c in ("a", "b", "silhouette")])


@query()
def silhouette_sampled(spark, sf_dir):
    score = evaluate.silhouette(labelled_orders(spark, sf_dir), "sampled", 200)
    return one_row(spark, silhouette=score).withColumn("silhouette", rnd("silhouette"))


@query(f"WITH {S.ORDERS}, {S.LABELLED}, {S.dispersion('lab', 4)} SELECT {S.r('ch')} AS calinski_harabasz FROM disp")
def calinski_harabasz(spark, sf_dir):
    score = evaluate.calinski_harabasz(labelled_orders(spark, sf_dir))
    return one_row(spark, calinski_harabasz=score).withColumn("calinski_harabasz", rnd("calinski_harabasz"))


@query(f"WITH {S.ORDERS}, {S.LABELLED}, {S.dispersion('lab', 4)} SELECT {S.r('db', 4)} AS davies_bouldin FROM disp")
def davies_bouldin(spark, sf_dir):
    score = evaluate.davies_bouldin(labelled_orders(spark, sf_dir))
    return one_row(spark, davies_bouldin=score).withColumn("davies_bouldin", rnd("davies_bouldin", 4))


@query(S.agreement("SELECT l_returnflag AS t, l_suppkey % 5 AS p FROM lineitem"))
def label_agreement(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_returnflag", (F.col("l_suppkey") % 5).alias("supplier_group"))
    out = evaluate.label_agreement(lines, "l_returnflag", "supplier_group")
    return out.select(*[rnd(c).alias(c) for c in out.columns])


@query("""WITH lab AS (SELECT user_id % 7 - 1 AS cluster FROM events)
SELECT count(*) AS n_samples, count(DISTINCT cluster) FILTER (cluster <> -1) AS n_clusters, count(DISTINCT cluster) AS n_labels,
count(*) FILTER (cluster = -1) AS n_noise, """ + S.r("count(*) FILTER (cluster = -1) / count(*)") + " AS noise_ratio FROM lab")
def label_counts(spark, sf_dir):
    labels = table(spark, sf_dir, "events").select((F.col("user_id") % 7 - 1).alias("cluster"))
    return evaluate.label_counts(labels).withColumn("noise_ratio", rnd("noise_ratio"))


def _metrics_sql() -> str:
    counts = "SELECT count(*) AS n, count(*) FILTER (cluster = -1) AS noise FROM lab"
    row = lambda policy, sil, disp: (
        f"SELECT '{policy}' AS noise, n AS n_samples, noise AS n_noise, {S.r(f'(SELECT avg(silhouette) FROM {sil})')} AS silhouette, "
        f"{S.r(f'(SELECT ch FROM {disp})')} AS calinski_harabasz, {S.r(f'(SELECT db FROM {disp})', 4)} AS davies_bouldin FROM counts"
    )
    return (
        f"WITH {S.PART}, {S.NOISY}, kept AS MATERIALIZED (SELECT * FROM lab WHERE cluster <> -1), counts AS ({counts}), "
        f"{S.silhouette('kept', 2, 's1')}, {S.dispersion('kept', 2, 'd1')}, {S.silhouette('lab', 2, 's2')}, {S.dispersion('lab', 2, 'd2')} "
        + row("drop", "s1", "d1") + " UNION ALL " + row("as_cluster", "s2", "d2")
        + " UNION ALL SELECT 'skip', n, noise, NULL, NULL, NULL FROM counts"
    )


@query(_metrics_sql())
def metrics_by_noise_policy(spark, sf_dir):
    rows = []
    for policy in evaluate.NOISE_POLICIES:
        m = evaluate.calculate_metrics(noisy_part(spark, sf_dir), policy)
        rows.append((policy, m["n_samples"], m["n_noise"], m["silhouette_score"], m["calinski_harabasz_score"], m["davies_bouldin_score"]))
    out = spark.createDataFrame(rows, "noise string, n_samples long, n_noise long, silhouette double, calinski_harabasz double, davies_bouldin double")
    return out.withColumns({"silhouette": rnd("silhouette"), "calinski_harabasz": rnd("calinski_harabasz"), "davies_bouldin": rnd("davies_bouldin", 4)})


def _evaluate_sql() -> str:
    inner = (
        f"WITH {S.PART}, {S.LABELLED}, c AS (SELECT cluster, avg(f0) AS f0, avg(f1) AS f1 FROM lab GROUP BY cluster), {S.nearest('c', 'a', 2)}, "
        f"placed AS MATERIALIZED (SELECT row_id, f0, f1, best.c AS cluster FROM a), {S.silhouette('placed', 2)} "
    )
    agree = S.agreement("SELECT row_id % 4 AS t, cluster AS p FROM placed").strip()
    return (
        inner + f", agree AS ({agree}) SELECT (SELECT count(DISTINCT cluster) FROM placed) AS n_clusters, {S.r('(SELECT avg(silhouette) FROM sil)')} AS silhouette, "
        "adjusted_rand, normalized_mutual_info FROM agree"
    )


@query(_evaluate_sql())
def model_evaluation(spark, sf_dir):
    labelled = labelled_part(spark, sf_dir)
    centers = group_moments(labelled).select("cluster", "center")
    m = evaluate.evaluate_model(labelled.withColumnRenamed("cluster", "truth"), centers, "truth")
    out = one_row(
        spark, n_clusters=m["n_clusters"], silhouette=m["silhouette_score"], adjusted_rand=m["adjusted_rand_score"],
        normalized_mutual_info=m["normalized_mutual_info"],
    )
    return out.select("n_clusters", *[rnd(c).alias(c) for c in ("silhouette", "adjusted_rand", "normalized_mutual_info")])


@query(f"""WITH e AS (SELECT vec_id, (row_number() OVER (ORDER BY vec_id) - 1) // 128 AS batch_id, list_transform(embedding, lambda x: x::DOUBLE) AS z FROM embeddings),
v AS MATERIALIZED (SELECT vec_id, batch_id, 1 AS side, z FROM e UNION ALL
  SELECT vec_id, batch_id, 2, list_transform(z, lambda x, i: x + CASE WHEN i % 2 = 0 THEN 0.05 ELSE -0.05 END) FROM e),
u AS MATERIALIZED (SELECT vec_id, batch_id, side, list_transform(z, lambda x: x / sqrt(list_inner_product(z, z))) AS z FROM v),
s AS (SELECT a.batch_id, a.vec_id, a.side, b.vec_id AS other, b.side AS other_side, list_inner_product(a.z, b.z) / 0.07 AS sim
  FROM u a JOIN u b ON a.batch_id = b.batch_id AND (a.vec_id <> b.vec_id OR a.side <> b.side)),
l AS (SELECT batch_id, vec_id, side, ln(sum(exp(sim))) - max(sim) FILTER (other = vec_id) AS loss FROM s GROUP BY ALL)
SELECT batch_id, count(*) // 2 AS n_pairs, {S.r('avg(loss)')} AS loss FROM l GROUP BY batch_id""")
def contrastive_loss(spark, sf_dir):
    shifted = F.transform("features", lambda x, i: x + F.when(i % 2 == 1, 0.05).otherwise(-0.05))
    views = embedding_features(spark, sf_dir).select("row_id", F.col("features").alias("z1"), shifted.alias("z2"))
    return evaluate.nt_xent(views).withColumn("loss", rnd("loss"))


# ---------------------------------------------------------------- reports


@query("""SELECT cluster, CASE WHEN cluster = -1 THEN 'Noise' ELSE 'Cluster ' || cluster END AS name, count(*) AS size
FROM (SELECT user_id % 7 - 1 AS cluster FROM events) GROUP BY cluster""")
def size_distribution(spark, sf_dir):
    return report.size_distribution(table(spark, sf_dir, "events").select((F.col("user_id") % 7 - 1).alias("cluster")))


def _report_sql() -> str:
    return f"WITH {S.PART}, {S.NOISY} " + " UNION ALL ".join(
        f"SELECT CASE WHEN cluster = -1 THEN 'noise' ELSE 'cluster_' || cluster END AS name, count(*) AS size, "
        f"{S.r('count(*) * 100.0 / (SELECT count(*) FROM lab)')} AS percent, '{c}' AS feature, {S.r(f'avg(f{j})')} AS center, {S.r(f'stddev_pop(f{j})')} AS std "
        "FROM lab GROUP BY cluster" for j, c in enumerate(PART_COLUMNS)
    )


@query(_report_sql())
def cluster_report(spark, sf_dir):
    out = report.report_long(report.cluster_report(noisy_part(spark, sf_dir)), PART_COLUMNS)
    return out.select("name", "size", rnd("percent").alias("percent"), "feature", rnd("center").alias("center"), rnd("std").alias("std"))


@query(f"""WITH {S.EMBEDDING_CELLS}, c AS (SELECT label - 1 AS cluster, position, avg(value) AS value FROM cells WHERE label <> 0 GROUP BY ALL),
top AS (SELECT position FROM c GROUP BY position ORDER BY var_pop(value) DESC, position DESC LIMIT 50)
SELECT 'Cluster ' || cluster AS name, 'feature_' || position AS feature, {S.r('value')} AS value FROM c WHERE position IN (FROM top)""")
def centroid_heatmap(spark, sf_dir):
    labelled = embedding_features(spark, sf_dir).withColumn("cluster", F.col("label") - 1)
    out = report.centroid_heatmap(labelled, [f"feature_{j}" for j in range(64)])
    return out.select("name", "feature", rnd("value").alias("value"))


@query(f"""WITH m AS (SELECT event_type AS algorithm, avg(value) AS mean_value, count(*) AS n FROM events GROUP BY 1)
SELECT algorithm, {S.r("CASE WHEN algorithm = 'error' THEN 0.0 ELSE mean_value END")} AS silhouette_score FROM m""")
def algorithm_comparison(spark, sf_dir):
    per_type = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("algorithm")).agg(F.avg("value").alias("v"), F.count("*").alias("n"))
    size = F.create_map(F.lit("n"), F.col("n").cast("double"))
    metrics = F.when(F.col("algorithm") == "error", size).otherwise(F.map_concat(size, F.create_map(F.lit("silhouette_score"), F.col("v"))))
    out = report.compare_algorithms(per_type.select("algorithm", metrics.alias("metrics")), "silhouette_score")
    return out.withColumn("silhouette_score", rnd("silhouette_score"))


@query(f"""WITH {S.EMBEDDING_CELLS}, c AS (SELECT label, position, count(*) AS n, avg(value) AS m, var_pop(value) AS v FROM cells GROUP BY ALL),
g AS (SELECT position, avg(value) AS g FROM cells GROUP BY position),
i AS (SELECT position, sum(n * (m - g) * (m - g)) / (sum(n * (m - g) * (m - g)) + sum(n * v)) AS importance FROM c JOIN g USING (position) GROUP BY position)
SELECT 'feature_' || position AS feature, {S.r('importance')} AS importance FROM i ORDER BY i.importance DESC, feature LIMIT 20""")
def feature_importance(spark, sf_dir):
    labelled = embedding_features(spark, sf_dir).withColumnRenamed("label", "cluster")
    out = report.top_importance(report.feature_importance(labelled, [f"feature_{j}" for j in range(64)]))
    return out.withColumn("importance", rnd("importance"))


@query(f"WITH {S.PART}, {S.LABELLED} SELECT row_id, {S.r('f0')} AS x, {S.r('f1')} AS y, cluster FROM lab")
def scatter_frame(spark, sf_dir):
    out = report.scatter_frame(labelled_part(spark, sf_dir))
    return out.select("row_id", rnd("x").alias("x"), rnd("y").alias("y"), "cluster")


@query(f"""WITH {S.PART}, {S.LABELLED}, {S.silhouette('lab', 2)}, {S.dispersion('lab', 2)}
SELECT 'rule' AS algorithm, (SELECT count(DISTINCT cluster) FROM lab) AS n_clusters, (SELECT count(*) FROM lab) AS n_rows,
{S.r('(SELECT avg(silhouette) FROM sil)')} AS silhouette_score, {S.r('ch')} AS calinski_harabasz_score FROM disp""")
def result_summary(spark, sf_dir):
    labelled = labelled_part(spark, sf_dir)
    store = Store(spark, scratch_path(spark, "store"))
    saved = store.save_results(labelled, algorithm="rule", experiment_id="e", metrics=evaluate.calculate_metrics(labelled), n_features=2)
    return store.results_summary(saved).select(
        "algorithm", "n_clusters", "n_rows", rnd("silhouette_score").alias("silhouette_score"), rnd("calinski_harabasz_score").alias("calinski_harabasz_score")
    )


@query(f"""WITH {LEDGER_SQL} SELECT id, CASE WHEN id % 2 = 0 THEN 'kmeans' ELSE 'unknown' END AS algorithm, status,
CASE WHEN status = 'completed' THEN id % 9 END AS clusters, CASE WHEN status = 'completed' THEN {S.r('value / 1000', 3)} END AS score,
strftime(ts, '%Y-%m-%d %H:%M') AS date FROM last""")
def experiment_history(spark, sf_dir):
    last = latest(event_ledger(spark, sf_dir), order=("ts", "event_id"))
    metrics = F.create_map(F.lit("n_clusters"), (F.col("id") % 9).cast("double"), F.lit("silhouette_score"), F.col("value") / 1000)
    return report.experiment_history(last.select(
        "id", F.when(F.col("id") % 2 == 0, "kmeans").alias("algorithm"), "status", metrics.alias("metrics"), F.col("ts").alias("started_at")
    ))


@query(f"""WITH {LEDGER_SQL} SELECT count(*) AS total, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed,
count(*) FILTER (status = 'running') AS running FROM last""")
def status_counts(spark, sf_dir):
    return report.status_counts(latest(event_ledger(spark, sf_dir), order=("ts", "event_id")))


@query("SELECT event_id, user_id, event_type, (SELECT count(*) FROM events) AS total FROM events ORDER BY ts DESC, event_id LIMIT 10 OFFSET 20")
def newest_page(spark, sf_dir):
    rows, total = report.page(table(spark, sf_dir, "events"), [F.desc("ts"), "event_id"], limit=10, offset=20)
    return rows.select("event_id", "user_id", "event_type", F.lit(total).cast("long").alias("total"))
