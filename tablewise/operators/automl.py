"""Automated model choice: preprocessing, baselines, tuning, importances, clustering, scoring."""

from __future__ import annotations

import math
import random
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    OneVsRest,
)
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator, Evaluator
from pyspark.ml.feature import FeatureHasher, OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.frequency import modes
from ..functions.parse import text_to_number
from ..functions.quantiles import exact_quantiles
from ..functions.staging import shared_folder, stage_table, use_checkpoint_dir
from ..schema import as_double, col, column_roles
from .describe import column_options, numeric_ranges
from .features import detect_task_type, judge_features
from .forest import ForestClassifier
from .metrics import classification_metrics, regression_metrics, roc_auc

# Fixed values.
SEED = 42
TEST_PERCENT = 20
N_TREES = 100
BOOST_ROUNDS = 100
BOOST_DEPTH = 3
BOOST_STEP = 0.1
LOGISTIC_ITERATIONS = 1_000
FOLDS = 3
CANDIDATES = 4
MAX_CLUSTERS = 6
GRIDS = {
    "Random Forest": {"trees": [50, 100, 200], "depth": [None, 10, 20], "split": [2, 5]},
    "Gradient Boosting": {"rounds": [50, 100], "step": [0.05, 0.1, 0.2], "depth": [3, 5]},
    "Logistic Regression": {"c": [0.1, 1.0, 10.0]},
}

# Limits of this implementation.
HASH_SIZE = 1 << 14
MAX_DEPTH = 30  # of forests whose depth is not tuned: the deepest that Spark grows
PARALLEL_FITS = 6
# Estimators hold a row in about this many bytes and more for each feature. Files of vectors are far smaller, so their
# number is set by the bytes held: a task that scans small files takes about 32 of them (128 MB at 4 MB to open one).
ROW_BYTES, FEATURE_BYTES = 500, 4
FILE_BYTES = 2 << 20
TASK_FILES = 32


@dataclass
class Preprocessor:
    """Fills, centring and scaling as expressions, then fitted encoders for the categories."""

    numeric: list[str]
    categorical: list[str]
    hashed: list[str]
    medians: dict[str, float]
    centre: dict[str, float]
    scale: dict[str, float]
    common: dict[str, str]
    encoder: PipelineModel | None = None
    names: list[str] = field(default_factory=list)

    def inputs(self, df: DataFrame) -> dict[str, Column]:
        """Input expressions; columns the table lacks are read as missing."""
        out: dict[str, Column] = {}
        for i, c in enumerate(self.numeric):
            if c not in df.columns:
                x = F.lit(None).cast("double")
            elif column_roles(df)[c] == "numeric":
                x = as_double(df, c)
            else:
                x = text_to_number(col(c))
            x = F.coalesce(x, F.lit(float(self.medians[c])))
            out[f"_n{i}"] = (x - self.centre[c]) / self.scale[c]
        for i, c in enumerate([*self.categorical, *self.hashed]):
            x = col(c).cast("string") if c in df.columns else F.lit(None).cast("string")
            out[f"_c{i}"] = F.coalesce(x, F.lit(self.common[c]))
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        inputs = self.inputs(df)
        return self.encoder.transform(df.withColumns(inputs)).drop(
            *inputs, *[f"_i{i}" for i in range(len(self.categorical))],
            *[f"_o{i}" for i in range(len(self.categorical))], "_hashed",
        )


def fit_preprocessor(
    df: DataFrame, numeric: list[str], texts: list[str], hash_columns: list[str] | None = None
) -> Preprocessor:
    """Median fill and standardising for numbers, mode fill and one-hot encoding for categories.

    Unseen categories encode as all zeros. The index of a column's levels is held by the driver; text columns of too
    many levels for that can be named in ``hash_columns``, which are hashed to ``HASH_SIZE`` features instead.
    """
    quantiles = exact_quantiles(df, {c: as_double(df, c) for c in numeric}, [0.5])
    medians = {c: quantiles[c][0] or 0.0 for c in numeric}
    centre, scale = {}, {}
    if numeric:
        exprs = []
        for c in numeric:
            x = F.coalesce(as_double(df, c), F.lit(float(medians[c])))
            exprs += [F.avg(x), F.stddev_pop(x)]
        row = df.agg(*[e.alias(f"m{i}") for i, e in enumerate(exprs)]).first()
        for i, c in enumerate(numeric):
            centre[c], scale[c] = row[2 * i] or 0.0, row[2 * i + 1] or 1.0
    hashed = [c for c in texts if c in (hash_columns or [])]
    categorical = [c for c in texts if c not in hashed]
    common = {c: v if v is not None else "" for c, v in modes(df, [*categorical, *hashed]).items()}
    p = Preprocessor(numeric, categorical, hashed, medians, centre, scale, common)

    stages, parts = [], [f"_n{i}" for i in range(len(numeric))]
    if categorical:
        indexed = [f"_i{i}" for i in range(len(categorical))]
        onehot = [f"_o{i}" for i in range(len(categorical))]
        stages += [
            StringIndexer(
                inputCols=[f"_c{i}" for i in range(len(categorical))],
                outputCols=indexed,
                handleInvalid="keep",
                stringOrderType="alphabetAsc",
            ),
            # The level reserved for unseen values is the one left out.
            OneHotEncoder(inputCols=indexed, outputCols=onehot, dropLast=True),
        ]
        parts += onehot
    if hashed:
        columns = [f"_c{len(categorical) + i}" for i in range(len(hashed))]
        stages.append(FeatureHasher(inputCols=columns, outputCol="_hashed", numFeatures=HASH_SIZE))
        parts.append("_hashed")
    stages.append(VectorAssembler(inputCols=parts, outputCol="features"))
    prepared = df.withColumns(p.inputs(df))
    p.encoder = Pipeline(stages=stages).fit(prepared)
    p.names = list(numeric)
    if categorical:
        for c, labels in zip(categorical, p.encoder.stages[0].labelsArray):
            p.names += [f"{c}_{label}" for label in labels]
    if hashed:
        p.names += [f"hash_{i}" for i in range(HASH_SIZE)]
    return p


def stage_vectors(vectors: DataFrame, rows: int, width: int) -> DataFrame:
    """Write the table once, evenly over tasks by its rows and features, however few files or bytes the source has."""
    spark = vectors.sparkSession
    parts = math.ceil(rows * (ROW_BYTES + FEATURE_BYTES * width) / FILE_BYTES)
    if shared_folder(spark) is None:  # a persisted partition is a task of its own
        parts = max(min(parts, spark.sparkContext.defaultParallelism), math.ceil(parts / TASK_FILES))
    return stage_table(vectors.repartition(max(parts, 1)))


class MacroF1(Evaluator):
    """Unweighted mean of the classes' F1, for cross-validation."""

    def _evaluate(self, dataset: DataFrame) -> float:
        return classification_metrics(dataset, "label", "prediction").first()["f1"] or 0.0

    def isLargerBetter(self) -> bool:
        return True


class RSquared(Evaluator):
    def _evaluate(self, dataset: DataFrame) -> float:
        r2 = regression_metrics(dataset, "label", "prediction").first()["r2"]
        return float("-inf") if r2 is None else r2

    def isLargerBetter(self) -> bool:
        return True


@dataclass
class AutoMLModel:
    """A chosen model with what is needed to score tables and explain it."""

    task_type: str
    target: str | None
    model_name: str
    model: object
    preprocessor: Preprocessor
    labels: list[str]
    metrics: dict[str, float]
    leaderboard_rows: list[tuple[str, str, str, float]]
    training: DataFrame

    @property
    def feature_columns(self) -> list[str]:
        p = self.preprocessor
        return [*p.numeric, *p.categorical, *p.hashed]

    @property
    def _spark(self):
        return self.training.sparkSession

    def metrics_df(self) -> DataFrame:
        rows = [(k, float(v)) for k, v in self.metrics.items()]
        return self._spark.createDataFrame(rows, "metric string, value double")

    def leaderboard(self) -> DataFrame:
        return self._spark.createDataFrame(
            self.leaderboard_rows, "model string, stage string, metric string, value double"
        )

    def category_options(self) -> DataFrame:
        """(column, option) of the categorical features."""
        return column_options(self.training, self.preprocessor.categorical)

    def numeric_bounds(self) -> DataFrame:
        """(column, min, max, median) of the numeric features."""
        return numeric_ranges(self.training, self.preprocessor.numeric)

    def feature_importance(self, k: int | None = None) -> DataFrame:
        """(feature, importance), normalised to sum to 1, strongest first."""
        values = _importances(self.model)
        total = sum(values)
        rows = [
            (n, v / total if total > 0 else v) for n, v in zip(self.preprocessor.names, values)
        ]
        out = self._spark.createDataFrame(rows, "feature string, importance double").orderBy(
            F.desc("importance"), "feature"
        )
        return out.limit(k) if k else out

    def score(self, df: DataFrame) -> DataFrame:
        """Add ``prediction`` and, for classifiers, ``probabilities`` in label order.

        Features the table lacks are read as missing, numbers given as text are parsed.
        """
        ready = self.preprocessor.transform(df.drop("prediction", "probabilities"))
        scored = self.model.transform(ready)
        extra = ["features", "rawPrediction", "probability"]
        if self.task_type == "clustering":
            name = F.concat(F.lit("Cluster "), F.col("prediction"))
            return scored.withColumn("cluster", name).drop(*extra)
        if self.task_type == "regression":
            return scored.drop(*extra)
        labels = F.array(*[F.lit(v) for v in self.labels])
        return (
            scored.withColumn("probabilities", _probabilities(self.model))
            .withColumn("prediction", F.get(labels, F.col("prediction").cast("int")))
            .drop(*extra)
        )

    def predict(self, values: dict) -> tuple[object, list[float] | None]:
        """Prediction and class probabilities of one observation given as a dictionary."""
        p = self.preprocessor
        types = [(c, "string") for c in values if c in p.numeric or c in p.categorical or c in p.hashed]
        if types:
            row = [tuple(None if values[c] is None else str(values[c]) for c, _ in types)]
            df = self._spark.createDataFrame(row, ", ".join(f"`{c}` {t}" for c, t in types))
        else:
            df = self._spark.range(1).select(F.lit(None).cast("string").alias("_none"))
        out = self.score(df).first()
        return out["prediction"], out["probabilities"] if self.task_type == "classification" else None


def _probabilities(model) -> Column:
    """Class probabilities; one-against-rest margins are mapped to (0, 1) and normalised."""
    if hasattr(model, "models"):
        margins = vector_to_array("rawPrediction")
        each = F.transform(margins, lambda m: F.lit(1.0) / (F.exp(m * -2.0) + 1.0))
        total = F.aggregate(each, F.lit(0.0), lambda a, v: a + v)
        return F.transform(each, lambda v: v / total)
    return vector_to_array("probability")


def _importances(model) -> list[float]:
    """Tree importances, or mean absolute coefficients over the classes."""
    if hasattr(model, "models"):
        parts = [m.featureImportances.toArray() for m in model.models]
        return [float(v) for v in sum(parts) / len(parts)]
    if hasattr(model, "featureImportances"):
        return [float(v) for v in model.featureImportances.toArray()]
    if hasattr(model, "coefficientMatrix"):
        return [float(v) for v in abs(model.coefficientMatrix.toArray()).mean(axis=0)]
    return [float(v) for v in abs(model.coefficients.toArray())]


def _classifier(name: str, n: int, n_classes: int, params: dict, seed: int, max_depth: int = MAX_DEPTH):
    if name == "Logistic Regression":
        # An inverse strength C on the summed loss is 1 / (C n) on Spark's mean loss.
        return LogisticRegression(
            maxIter=LOGISTIC_ITERATIONS, regParam=1.0 / (params.get("c", 1.0) * n), standardization=False
        )
    if name == "Random Forest":
        forest = _forest_params(params, max_depth)
        return ForestClassifier(n_classes, forest["numTrees"], forest["maxDepth"], forest["minInstancesPerNode"], seed)
    boost = GBTClassifier(**_boost_params(params), seed=seed)
    return boost if n_classes == 2 else OneVsRest(classifier=boost, rawPredictionCol="rawPrediction")


def _regressor(name: str, params: dict, seed: int, max_depth: int = MAX_DEPTH):
    if name == "Linear Regression":
        return LinearRegression(regParam=0.0)
    if name == "Random Forest":
        return RandomForestRegressor(**_forest_params(params, max_depth), featureSubsetStrategy="all", seed=seed)
    return GBTRegressor(**_boost_params(params), seed=seed)


def _forest_params(params: dict, max_depth: int) -> dict:
    return {
        "numTrees": params.get("trees", N_TREES),
        "maxDepth": params.get("depth") or max_depth,
        "minInstancesPerNode": max(1, params.get("split", 2) // 2),
        "checkpointInterval": 10,
        "cacheNodeIds": True,
    }


def _boost_params(params: dict) -> dict:
    return {
        "maxIter": params.get("rounds", BOOST_ROUNDS),
        "maxDepth": params.get("depth", BOOST_DEPTH),
        "stepSize": params.get("step", BOOST_STEP),
        "checkpointInterval": 10,
    }


def _sampled_candidates(name: str, seed: int) -> list[dict]:
    """Up to four seeded grid points of the model, without repetition."""
    points: list[dict] = [{}]
    for key, values in GRIDS[name].items():
        points = [{**p, key: v} for p in points for v in values]
    return random.Random(seed).sample(points, min(CANDIDATES, len(points)))


def split_rows(df: DataFrame, keys: list[str] | None = None, seed: int = SEED) -> Column:
    """True for the test rows: a hash of the keys, the same however the rows are partitioned."""
    names = keys or [c for c, r in column_roles(df).items() if r != "complex"]
    return F.pmod(F.xxhash64(*[col(c) for c in names], F.lit(seed)), F.lit(100)) < TEST_PERCENT


def run_automl(
    df: DataFrame,
    target: str | None = None,
    keys: list[str] | None = None,
    seed: int = SEED,
    max_depth: int = MAX_DEPTH,
    hash_columns: list[str] | None = None,
) -> AutoMLModel:
    """Detect the task, prepare the features, compare baselines and tune the best one.

    ``keys`` name the columns that identify a row for the train/test split (default: all columns); they are not used as
    features when given. ``max_depth`` limits forests whose depth is not tuned, ``hash_columns`` names text columns to
    hash instead of one-hot encoding them. Baselines that cannot be fitted are on the leaderboard with the reason.
    """
    use_checkpoint_dir(df.sparkSession)
    task = detect_task_type(df, target)
    if target:
        df = df.where(col(target).isNotNull())
    roles = column_roles(df)
    candidates = [c for c in df.columns if c != target and c not in (keys or [])]
    kept = [v for v in judge_features(df, candidates) if v.reason is None]
    numeric = [v.column for v in kept if roles[v.column] == "numeric"]
    texts = [v.column for v in kept if roles[v.column] in ("string", "boolean")]
    if not numeric and not texts:
        raise ValueError("No usable feature is left after selection.")
    if task == "clustering":
        return _run_clustering(df, numeric, texts, seed, hash_columns)

    marked = df.withColumn("_test", split_rows(df, keys, seed))
    train = marked.where(~F.col("_test"))
    labels: list[str] = []
    if task == "classification":
        # A model has parameters for every class, so the driver holds their names.
        found = train.select(col(target).cast("string").alias("v")).distinct()
        labels = sorted(r["v"] for r in found.collect())
        if roles[target] == "numeric":
            labels.sort(key=float)
        if len(labels) < 2:
            raise ValueError(f"Target {target!r} has a single class among the training rows.")
        index = df.sparkSession.createDataFrame(list(zip(labels, map(float, range(len(labels))))), "_class string, label double")
        # The size of rows made by the driver is unknown to Spark, which would send all rows of a class to one task.
        marked = marked.join(F.broadcast(index), col(target).cast("string") == F.col("_class"), "left")
    else:
        marked = marked.withColumn("label", as_double(df, target))
    preprocessor = fit_preprocessor(train, numeric, texts, hash_columns)
    # Vectors are built once and written; every estimator below reads them.
    vectors = preprocessor.transform(marked).select("features", "label", "_test")
    ready = stage_vectors(vectors, df.count(), len(preprocessor.names))
    ready = ready.where("label IS NOT NULL")
    train, test = ready.where(~F.col("_test")), ready.where(F.col("_test"))
    n = train.count()

    if task == "classification":
        names, evaluator, stage_metric = (
            ["Logistic Regression", "Random Forest", "Gradient Boosting"], MacroF1(), "f1_macro",
        )
        build = lambda name, params: _classifier(name, n, len(labels), params, seed, max_depth)
    else:
        names, evaluator, stage_metric = (
            ["Linear Regression", "Random Forest", "Gradient Boosting"], RSquared(), "r2",
        )
        build = lambda name, params: _regressor(name, params, seed, max_depth)

    board: list[tuple[str, str, str, float]] = []
    fitted: dict[str, object] = {}
    failures: dict[str, BaseException] = {}

    def fit(name: str) -> tuple[object, float]:
        model = build(name, {}).fit(train)
        return model, float(evaluator.evaluate(model.transform(test)))

    # The baselines are independent jobs, so they share the cluster.
    with ThreadPoolExecutor(max_workers=len(names)) as pool:
        target_fit = inheritable_thread_target(df.sparkSession)(fit)
        running = {name: pool.submit(target_fit, name) for name in names}
    for name, task_ in running.items():
        if task_.exception() is not None:  # a baseline that cannot be fitted leaves the comparison
            failures[name] = task_.exception()
            reason = str(failures[name]).strip().splitlines()
            board.append((name, "baseline", f"failed: {reason[0] if reason else type(failures[name]).__name__}", float("nan")))
            continue
        fitted[name], value = task_.result()
        board.append((name, "baseline", stage_metric, value))
    if not fitted:
        raise ValueError(f"Every baseline failed: {failures}")
    best = max((r for r in board if r[0] in fitted), key=lambda r: r[3])[0]
    model = fitted[best]
    if best in GRIDS:
        model = _tune(best, build, train, evaluator, seed)
    scored = stage_table(_scored(model, test, task))
    if task == "classification":
        row = classification_metrics(scored, "label", "prediction").first()
        classes = [float(i) for i in range(len(labels))]
        auc = roc_auc(scored, "label", classes, "probabilities").first()["roc_auc"]
        metrics = {
            "Accuracy": row["accuracy"], "Precision": row["precision"], "Recall": row["recall"],
            "F1-Score": row["f1"], "ROC-AUC": auc,
        }
    else:
        row = regression_metrics(scored, "label", "prediction").first()
        metrics = {"R-squared": row["r2"], "MAE": row["mae"], "RMSE": row["rmse"]}
    name = f"Tuned {best}"
    metrics = {k: float("nan") if v is None else v for k, v in metrics.items()}
    board += [(name, "final", k, float(v)) for k, v in metrics.items()]
    return AutoMLModel(task, target, name, model, preprocessor, labels, metrics, board, df)


def _scored(model, test: DataFrame, task: str) -> DataFrame:
    out = model.transform(test)
    if task == "classification":
        return out.select("label", "prediction", _probabilities(model).alias("probabilities"))
    return out.select("label", "prediction")


def _tune(name: str, build, train: DataFrame, evaluator: Evaluator, seed: int):
    """Three-fold search over the sampled candidates; the winner is fitted on all training rows.

    Every candidate is an estimator of its own, so one-against-rest models tune like the others.
    """
    choices = _sampled_candidates(name, seed)
    estimator = Pipeline(stages=[])
    grid = [{estimator.stages: [build(name, params)]} for params in choices]
    search = CrossValidator(
        estimator=estimator,
        estimatorParamMaps=grid,
        evaluator=evaluator,
        numFolds=FOLDS,
        parallelism=PARALLEL_FITS,
        seed=seed,
    )
    return search.fit(train).bestModel.stages[0]


def _run_clustering(
    df: DataFrame, numeric: list[str], texts: list[str], seed: int, hash_columns: list[str] | None = None
) -> AutoMLModel:
    """K-means with the silhouette's best k from 2 to 6; the smallest k wins ties."""
    preprocessor = fit_preprocessor(df, numeric, texts, hash_columns)
    n = df.count()
    ready = stage_vectors(preprocessor.transform(df).select("features"), n, len(preprocessor.names))
    board: list[tuple[str, str, str, float]] = []
    best, best_score, best_k = None, -1.0, 2
    evaluator = ClusteringEvaluator(featuresCol="features", predictionCol="prediction")

    def fit(k: int) -> tuple[object, float | None]:
        model = KMeans(k=k, seed=seed, featuresCol="features").fit(ready)
        assigned = model.transform(ready)
        # Duplicates may leave a single cluster, for which no silhouette exists.
        if assigned.select("prediction").distinct().limit(2).count() < 2:
            return model, None
        return model, float(evaluator.evaluate(assigned))

    # The candidates are independent jobs, so they share the cluster.
    with ThreadPoolExecutor(max_workers=PARALLEL_FITS) as pool:
        target_fit = inheritable_thread_target(df.sparkSession)(fit)
        candidates = range(2, min(MAX_CLUSTERS, n - 1) + 1)
        running = {k: pool.submit(target_fit, k) for k in candidates}
    for k, task_ in running.items():
        model, score = task_.result()
        if score is None:
            continue
        board.append((f"K-Means (k={k})", "baseline", "silhouette", score))
        if score > best_score:
            best, best_score, best_k = model, score, k
    if best is None:
        best, best_score = KMeans(k=2, seed=seed, featuresCol="features").fit(ready), 0.0
    metrics = {"Silhouette Score": best_score, "Clusters": float(best_k)}
    name = f"K-Means Clustering (k={best_k})"
    return AutoMLModel("clustering", None, name, best, preprocessor, [], metrics, board, df)


def cluster_sizes(model: AutoMLModel, df: DataFrame) -> DataFrame:
    """(cluster, count), largest first."""
    return (
        model.score(df)
        .groupBy("cluster")
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.desc("count"), "cluster")
    )
