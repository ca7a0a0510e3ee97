"""Model jobs: P3 training_window, P5 assemble_features, F5 predict, M1 train_rpc,
M3 explain_clicks, M4 parse_attributions, W4 top_features.

Training and scoring stay on the executors: the frame is binned and fitted by
``boosting``, which returns Spark ML's gradient-boosted trees behind a
``VectorAssembler``; explanations are one ``model.transform`` over an exploded frame.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlens.functions.columns import is_finite
from revlens.operators import boosting
from revlens.schemas import FEATURE_ORDER

# Boosted-tree hyper-parameters of the production model: fixed values.
GBT_DEPTH = 6
GBT_ROUNDS = 400
GBT_LEARNING_RATE = 0.05
GBT_BINS = 256
# How the rounds run; no part of the model.
CHECKPOINT_ROUNDS = 10
PARTITION_ROWS = 250_000    # a task's rows at least: below, a round is little but its tasks' start


def training_window(frame: DataFrame, start_ms: int, end_ms: int, check_empty: bool = True) -> DataFrame:
    """Rows with start_ms <= click_ts_ms <= end_ms; an empty window is an error
    (checked with a one-row probe, not a count)."""
    out = frame.where(F.col("click_ts_ms").between(start_ms, end_ms))
    if check_empty and out.isEmpty():
        raise ValueError(f"no training rows in [{start_ms}, {end_ms}]")
    return out


def feature_columns(df: DataFrame) -> list[Column]:
    return [F.col(c).cast("double").alias(c) for c in FEATURE_ORDER]


def assemble_features(df: DataFrame, out: str = "features") -> DataFrame:
    """P5: the 8 model inputs, in the fixed order, as one vector (bool -> 0/1)."""
    cols = [c for c in df.columns if c not in FEATURE_ORDER]
    wide = df.select(*cols, *feature_columns(df))
    return VectorAssembler(inputCols=FEATURE_ORDER, outputCol=out, handleInvalid="keep").transform(wide)


class LinearRpcModel(Transformer):
    """Deterministic stand-in model: prediction = intercept + sum(w_i * x_i) over the
    feature vector. A plain column expression (whole-stage codegen), used where an
    exact SQL twin of the model is needed."""

    def __init__(self, intercept: float, weights: dict[str, float],
                 featuresCol: str = "features", predictionCol: str = "prediction"):
        super().__init__()
        self.intercept = float(intercept)
        self.weights = [float(weights.get(f, 0.0)) for f in FEATURE_ORDER]
        self.featuresCol, self.predictionCol = featuresCol, predictionCol

    def expression(self, arr: Column) -> Column:
        out = F.lit(self.intercept)
        for i, w in enumerate(self.weights):
            out = out + arr[i] * w
        return out

    def _transform(self, df: DataFrame) -> DataFrame:
        if self.featuresCol in df.columns:
            arr = vector_to_array(F.col(self.featuresCol))
            return df.withColumn(self.predictionCol, self.expression(arr))
        # raw feature columns: no vector round trip
        return df.withColumn(self.predictionCol, self.expression(
            F.array(*[F.col(c).cast("double") for c in FEATURE_ORDER])))


# Stand-in weights (fixed values, in FEATURE_ORDER): base 0.5, quality and recent
# RPC dominate, as in the synthetic seed's revenue function.
STAND_IN = LinearRpcModel(0.5, {"hour_of_day": 0.0, "cerberus_score": 10.0, "rpc_7d": 2.0,
                                "rpc_14d": 0.5, "rpc_30d": 0.25, "is_payday_week": 0.5,
                                "auction_pressure": 1.0, "visits_prev_30d": 0.1})


def in_full_partitions(frame: DataFrame, rows: int | None = None) -> DataFrame:
    """frame in no more partitions than PARTITION_ROWS rows each need, without a shuffle."""
    own = frame.rdd.getNumPartitions()
    if own == 1:
        return frame
    rows = frame.count() if rows is None else rows
    return frame.coalesce(min(own, max(1, -(-rows // PARTITION_ROWS))))


def for_all_cores(frame: DataFrame, rows: int) -> DataFrame:
    """frame dealt out again if its partitions are fewer than the cores and than PARTITION_ROWS rows each need."""
    wanted = min(frame.sparkSession.sparkContext.defaultParallelism, -(-rows // PARTITION_ROWS))
    return frame.repartition(wanted) if frame.rdd.getNumPartitions() < wanted else frame


def train_rpc(frame: DataFrame, start_ms: int | None = None, end_ms: int | None = None,
              label: str = "target_revenue", max_depth: int = GBT_DEPTH,
              rounds: int = GBT_ROUNDS, learning_rate: float = GBT_LEARNING_RATE,
              max_bins: int = GBT_BINS, seed: int = 42) -> PipelineModel:
    """M1: boosted regression trees on the training window (squared error,
    histogram splits with ``max_bins`` bins). ``frame`` should be a stored table: it is
    counted, read for the bin edges and read again for the bins, which are kept for all rounds.
    A feature or label that is null, NaN or infinite is an error.

    A tree level is one pass and one job, so a small frame's time is that of 400 x 6 jobs."""
    if start_ms is not None and end_ms is not None:
        frame = training_window(frame, start_ms, end_ms)

    def finite(c: Column, name: str) -> Column:
        return F.when(is_finite(c), c).otherwise(F.raise_error(F.lit(f"{name} MUST NOT be null, NaN or infinite"))).alias(name)
    data = frame.select(*feature_columns(frame), F.col(label).cast("double").alias("label"))
    rows = data.count()
    if not rows:
        raise ValueError("no training rows")
    data = for_all_cores(in_full_partitions(data, rows), rows).select(*[finite(F.col(c), c) for c in data.columns])
    gbt = GBTRegressor(featuresCol="features", labelCol="label", maxDepth=max_depth, maxIter=rounds,
                       stepSize=learning_rate, maxBins=max_bins, lossType="squared", seed=seed,
                       subsamplingRate=1.0, cacheNodeIds=False, checkpointInterval=CHECKPOINT_ROUNDS)
    return PipelineModel([VectorAssembler(inputCols=FEATURE_ORDER, outputCol="features", handleInvalid="keep"),
                          boosting.fit(data, "label", rows, gbt)])


def model_version_row(frame: DataFrame, model_id: str, version: str, trained_at_ms: int) -> DataFrame:
    """Registry row appended after training: ``id@version`` and the training time."""
    if trained_at_ms < 0:
        raise ValueError("trained_at_ms must be >= 0")
    return frame.limit(1).select(F.lit(f"{model_id}@{version}").alias("model"),
                                 F.lit(version).alias("model_version"),
                                 F.lit(trained_at_ms).cast("long").alias("trained_at_ms"))


def train_and_register(frame: DataFrame, model_path: str, registry_path: str, model_id: str,
                       version: str, trained_at_ms: int, **params) -> PipelineModel:
    """M1 job: train, save the fitted pipeline under ``model_path/version`` and append
    one registry row (``id@version``, training time) to the registry table."""
    model = train_rpc(frame, **params)
    model.write().overwrite().save(f"{model_path.rstrip('/')}/{version}")
    (model_version_row(frame, model_id, version, trained_at_ms)
     .withColumn("path", F.lit(f"{model_path.rstrip('/')}/{version}"))
     .write.mode("append").parquet(registry_path))
    return model


def _score(df: DataFrame, model) -> DataFrame:
    """Run a fitted model: a PipelineModel from :func:`train_rpc` assembles its own
    vector; a bare model gets the assembled ``features`` column."""
    if isinstance(model, PipelineModel):
        return model.transform(df)
    if isinstance(model, LinearRpcModel) and set(FEATURE_ORDER) <= set(df.columns):
        return model.transform(df)
    return model.transform(assemble_features(df) if "features" not in df.columns else df)


def predict(df: DataFrame, model, out: str = "rpc_raw") -> DataFrame:
    """model output clamped at 0; a non-finite output is a model error (tested
    before the clamp: greatest(NaN, 0) would be NaN)."""
    scored = _score(df, model)
    pred = F.col("prediction")
    return (scored.withColumn("model_error", ~is_finite(pred))
                  .withColumn(out, F.when(is_finite(pred), F.greatest(pred, F.lit(0.0))))
                  .drop("prediction", "features"))


# ------------------------------------------------------------------ explanations
def _perm(seed: int, path: Column, n: int) -> Column:
    """Seeded permutation of 0..n-1 per (click, path): order feature indices by
    xxhash64(click_id, seed, path, index). Partition-independent, so a re-run or a
    retried task draws the same paths."""
    keyed = F.transform(F.sequence(F.lit(0), F.lit(n - 1)),
                        lambda i: F.struct(F.xxhash64(F.col("click_id"), F.lit(seed), path, i).alias("h"),
                                           i.alias("i")))
    return F.transform(F.array_sort(keyed), lambda s: s["i"])


def explain_clicks(df: DataFrame, model, paths: int = 10, seed: int = 42,
                   baseline: dict[str, float] | None = None, partitions: int | None = None) -> DataFrame:
    """M3: sampled-Shapley attributions of the 8 features for every click.

    For each click and each of ``paths`` seeded permutations, the features are
    switched from the baseline (default all zeros) to the click's values one at a
    time; a feature's contribution on a path is the change in the model output
    when it is switched. The all-baseline and all-click rows are shared by the
    paths, so the model sees 2 + paths * 7 rows per click in one ``transform``.
    Every model row emits signed terms for the two features it separates; one
    aggregation per click (collapsed map-side, since a click's rows stay in the
    partition they were exploded in) yields base + sum(contributions) = prediction
    exactly per path (telescoping).
    """
    n = len(FEATURE_ORDER)
    base = [float((baseline or {}).get(f, 0.0)) for f in FEATURE_ORDER]
    spark = df.sparkSession
    parts = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")),
                              spark.sparkContext.defaultParallelism)
    # Spread the clicks before the 2 + paths * (n - 1) fan-out: the narrow frame is
    # hash-partitioned on click_id, which is also the key of the final aggregation,
    # so that aggregation needs no further exchange.
    x = df.select("click_id", *feature_columns(df)).repartition(parts, "click_id")
    x = x.withColumn("_perms", F.array(*[_perm(seed, F.lit(p), n) for p in range(paths)]))
    x = x.withColumn("_pos", F.transform(F.col("_perms"), lambda pm: F.transform(
        F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.array_position(pm, i) - 1)))
    # per feature, the paths that it is the first (last) of
    def ends(at: int) -> Column:
        at_end = F.transform("_perms", lambda q: q[at])
        return F.array(*[F.size(F.array_compact(F.transform(at_end, lambda f: F.when(f == F.lit(i), f)))) for i in range(n)])

    x = x.withColumns({"_firsts": ends(0), "_lasts": ends(n - 1)})
    specs = F.array(
        F.struct(F.lit(-1).alias("p"), F.lit(0).alias("k")),
        F.struct(F.lit(-1).alias("p"), F.lit(n).alias("k")),
        *[F.struct(F.lit(p).alias("p"), F.lit(k).alias("k")) for p in range(paths) for k in range(1, n)])
    rows = x.withColumn("_s", F.explode(specs))
    p_, k_ = F.col("_s.p"), F.col("_s.k")
    pos = F.col("_pos")[p_]

    def on(i: int) -> Column:   # feature i switched to the click's value?
        return F.when(k_ == n, F.lit(True)).when(k_ == 0, F.lit(False)).otherwise(pos[i] < k_)

    # A model row counts for the feature that it switches on and against the one switched on
    # next; the shared rows, for (against) the last (first) feature of every path. Its signed
    # terms are added where it is scored, so that no row is repeated per term.
    pm = F.col("_perms")[p_]
    model_in = rows.select("click_id", p_.alias("p"), k_.alias("k"), F.when(p_ >= 0, pm[k_ - 1]).alias("on"),
                           F.when(p_ >= 0, pm[k_]).alias("off"),
                           F.when(p_ < 0, F.when(k_ == 0, F.col("_firsts")).otherwise(F.col("_lasts"))).alias("ends"),
                           *[F.when(on(i), F.col(f)).otherwise(F.lit(base[i])).alias(f)
                             for i, f in enumerate(FEATURE_ORDER)])
    scored = _score(model_in, model).select("click_id", "k", "p", "prediction", "on", "off", "ends")
    out, shared = F.col("prediction"), F.col("p") < 0

    def term(i: int) -> Column:
        m = F.col("ends")[i]
        ends = F.when(m == 0, 0.0).when(F.col("k") == 0, -m * out).otherwise(m * out)
        return F.when(shared, ends).when(F.col("on") == i, out).when(F.col("off") == i, -out).otherwise(0.0)
    agg = scored.groupBy("click_id").agg(
        F.max(F.when(shared & (F.col("k") == 0), out)).alias("base_value"),
        F.max(F.when(shared & (F.col("k") == n), out)).alias("prediction"),
        *[(F.sum(term(i)) / paths).alias(f) for i, f in enumerate(FEATURE_ORDER)])
    return agg.select("click_id", "base_value", "prediction",
                      F.map_from_arrays(F.array(*[F.lit(f) for f in FEATURE_ORDER]),
                                        F.array(*[F.col(f) for f in FEATURE_ORDER])).alias("attributions"))


# Attribution array order of the explanation service (index -> name): fixed values.
EXPLANATION_ORDER = FEATURE_ORDER
_NUMBER = r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][-+]?[0-9]+)?$"


def parse_attributions(df: DataFrame, json_col: str = "explanation") -> DataFrame:
    """M4: explanation response JSON -> base_value and a feature -> contribution map.
    Shape A: ``featureAttributions`` maps names to numbers. Shape B: its first entry
    (in key order) is an array, zipped with the explanation order. Non-numeric values
    are dropped; the base defaults to 0.0; a response without attributions is
    flagged ``valid = false``."""
    own = df.columns
    # every step leaves through a generator, whose outputs are plain columns: as expressions the
    # optimizer would put the parse into each of its uses, and the explode's filter below it again
    df = _once(df, _attr=F.get_json_object(F.col(json_col), "$.explanations[0].attributions[0]"))
    df = _once(df, _base=F.get_json_object("_attr", "$.baselineOutputValue"), _text=F.get_json_object("_attr", "$.featureAttributions"))
    df = _once(df, _feats=F.from_json("_text", "map<string,string>"), valid=F.json_object_keys("_text").isNotNull())
    feats, arr, base_txt = F.col("_feats"), F.col("_arr"), F.col("_base")
    df = _once(df, _first=feats[F.array_min(F.map_keys(feats))])
    df = _once(df, _arr=F.when(F.json_array_length("_first").isNotNull(), F.from_json("_first", "array<string>")))
    names = F.array(*[F.lit(x) for x in EXPLANATION_ORDER])
    zipped = F.filter(F.arrays_zip(names.alias("n"), arr.alias("v")),
                      lambda e: e["n"].isNotNull() & e["v"].rlike(_NUMBER))
    shape_b = F.map_from_entries(F.transform(zipped, lambda e: F.struct(e["n"], e["v"].cast("double"))))
    shape_a = F.transform_values(F.map_filter(feats, lambda k, v: v.rlike(_NUMBER)),
                                 lambda k, v: v.cast("double"))
    df = _once(df, base_value=F.coalesce(F.when(base_txt.rlike(_NUMBER), base_txt.cast("double")), F.lit(0.0)),
               contributions=F.when(arr.isNotNull(), shape_b).otherwise(shape_a))
    return df.select(*own, "base_value", "contributions", "valid")


def _once(df: DataFrame, **cols: Column) -> DataFrame:
    """df with columns that are evaluated once a row, however often they are used."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in cols.items()]))))


def top_features(attr: DataFrame, k: int, col: str = "attributions") -> DataFrame:
    """Per click the k features with the largest |contribution| (ties keep the
    feature order), as rows (click_id, rank, feature, contribution). Row-local array
    sort: no shuffle."""
    if k < 0:
        raise ValueError("k must be non-negative")
    order = F.array(*[F.lit(f) for f in FEATURE_ORDER])
    entries = F.transform(F.map_entries(F.col(col)), lambda e: F.struct(
        (-F.abs(e["value"])).alias("neg_abs"),
        F.coalesce(F.array_position(order, e["key"]), F.lit(1 << 30)).alias("ord"),
        e["key"].alias("feature"), e["value"].alias("contribution")))
    top = F.slice(F.array_sort(entries), 1, k) if k > 0 else F.array_remove(F.array(F.lit(None)), None)
    return (attr.select("click_id", F.posexplode(top).alias("pos", "e"))
                .select("click_id", (F.col("pos") + 1).cast("long").alias("rank"),
                        F.col("e.feature").alias("feature"), F.col("e.contribution").alias("contribution")))


def linear_attributions(df: DataFrame, model: LinearRpcModel = STAND_IN) -> DataFrame:
    """Exact attributions of a linear model against a zero baseline: w_i * x_i."""
    feats = feature_columns(df)
    contrib = [(F.col(f) * w) for f, w in zip(FEATURE_ORDER, model.weights)]
    return (df.select("click_id", *feats)
              .select("click_id", F.lit(model.intercept).alias("base_value"),
                      F.map_from_arrays(F.array(*[F.lit(f) for f in FEATURE_ORDER]),
                                        F.array(*contrib)).alias("attributions")))
