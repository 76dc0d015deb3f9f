"""Models that carry what scoring needs: features, trees and weights, the last day they learned from, calibration and scales.

A model is one JSON text.  Trees are fitted by MLlib, read from its stored nodes and averaged over
seeds by setting their leaves down, so that scoring needs no MLlib.  Scoring refuses rows of days
that a model has learned from, inside the plan, where no caller can forget it.
"""

from __future__ import annotations

import hashlib
import json
import math
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import c
from ..sources.staging import shared_path, staged
from .models import fit_ridge, linear_score, score_trees
from .quantiles import quantiles

FAMILIES = ("trees", "ridge", "hybrid")
#: What a score stands for: a return, a return in units of the row's risk, or a rank of it.
REWARDS = ("absolute_return", "relative_return", "return_per_risk", "relative_return_per_risk", "relative_rank")
PER_RISK = ("return_per_risk", "relative_return_per_risk")


@dataclass(frozen=True)
class Model:
    """One fitted model; ``trained_through`` is a day as text, the last one of its rows."""

    family: str
    features: list[str]
    trained_through: str
    reward: str = "absolute_return"
    trees: list[dict] = field(default_factory=list)
    #: Weights by feature, and the intercept last.
    weights: list[float] = field(default_factory=list)
    tree_weight: float = 1.0
    slope: float = 1.0
    offset: float = 0.0
    reward_scale: float = 1.0
    #: Spread of the model's own predictions over its rows; a direction score is a prediction over it.
    score_scale: float | None = None
    clip: list[float] | None = None
    rows: int = 0
    seeds: list[int] = field(default_factory=list)

    def __post_init__(self) -> None:
        numbers = [self.tree_weight, self.slope, self.offset, self.reward_scale, *self.weights]
        wrong = self.family not in FAMILIES or self.reward not in REWARDS or not all(map(math.isfinite, numbers)) or not 0 <= self.tree_weight <= 1
        if wrong or (self.family != "ridge" and not self.trees) or (self.family != "trees" and len(self.weights) != len(self.features) + 1):
            raise ValueError("not a whole model")

    @property
    def id(self) -> str:
        return hashlib.sha256(self.to_json().encode()).hexdigest()[:16]

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @staticmethod
    def from_json(text: str) -> "Model":
        return Model(**json.loads(text))


def save(spark: SparkSession, model: Model, path: str) -> None:
    spark.createDataFrame([(model.to_json(),)], "value string").coalesce(1).write.text(path)


def load(spark: SparkSession, path: str) -> Model:
    return Model.from_json(spark.read.text(path).first().value)


def _through(df: DataFrame, day: str | Column, through: str) -> DataFrame:
    return df.where(c(day).cast("date") <= F.lit(through).cast("date"))


def fit_tree_model(df: DataFrame, features: list[str], label: str, day: str, through: str, *, order: list[str], seeds=(1, 2, 3), depth: int = 3, rounds: int = 10, subsample: float = 0.8, clip_quantile: float = 0.0, reward: str = "absolute_return") -> Model:
    """Boosted trees of rows up to the day ``through``, averaged over ``seeds``.

    Later rows are left out before anything is computed; rows without a label or a feature as well.
    ``clip_quantile`` winsorises the label at that quantile and its opposite (of the rows used).
    score_scale is the deviation of the model's predictions over its rows.  Rows are put in the order
    of ``order`` first, so that the same rows give the same model; no row raises.
    """
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    spark = df.sparkSession
    usual = _through(df, day, through).where(F.col(label).isNotNull()).dropna(subset=features).select(*dict.fromkeys([*order, *features, label]))
    rows = staged(usual, "fit-rows")
    n, clip = rows.count(), None
    if not n:
        raise ValueError(f"no rows up to {through}")
    if clip_quantile:
        ends = quantiles(rows, [], label, {"low": clip_quantile, "high": 1 - clip_quantile}).first()
        clip = [ends.low, ends.high]
        rows = rows.withColumn(label, F.greatest(F.lit(clip[0]), F.least(F.lit(clip[1]), F.col(label))))
    # Samples of rows are drawn by place: the same places whatever the input's files were.
    parts = max(1, -(-n // 1_000_000))
    data = VectorAssembler(inputCols=features, outputCol="x_vector").transform(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order))
    trees: list[dict] = []
    for seed in seeds:
        model = GBTRegressor(featuresCol="x_vector", labelCol=label, maxDepth=depth, maxIter=rounds, seed=seed, subsamplingRate=subsample).fit(data)
        trees += nested_trees(spark, model, len(seeds))
    out = Model("trees", features, through, reward, trees, clip=clip, rows=n, seeds=list(seeds))
    spread = score_trees(rows, features, json.dumps(trees)).agg(F.stddev_pop("score")).first()[0]
    return Model(**{**asdict(out), "score_scale": spread})


def nested_trees(spark: SparkSession, model, share: int) -> list[dict]:
    """MLlib's boosted trees as nested nodes, each leaf weighted as its tree is and divided by ``share``; their sum is the model over ``share``.

    The nodes come from the model's stored form: a table as large as the model.
    """
    path = shared_path(spark, "trees")
    model.write().save(path)
    nodes: dict[int, dict] = {}
    for r in spark.read.parquet(f"{path}/data").select("treeID", "nodeData.id", "nodeData.prediction", "nodeData.leftChild", "nodeData.rightChild", "nodeData.split.featureIndex", "nodeData.split.leftCategoriesOrThreshold").collect():
        nodes.setdefault(r.treeID, {})[r.id] = r

    def node(tree: int, at: int) -> dict:
        r = nodes[tree][at]
        if r.leftChild < 0:
            return {"leaf_value": r.prediction * model.treeWeights[tree] / share}
        return {"split_feature": r.featureIndex, "threshold": r.leftCategoriesOrThreshold[0], "default_left": False, "left_child": node(tree, r.leftChild), "right_child": node(tree, r.rightChild)}

    return [node(t, 0) for t in sorted(nodes)]


def fit_hybrid_model(df: DataFrame, features: list[str], label: str, day: str, through: str, *, order: list[str], tree_weight: float = 0.5, penalty: float = 1.0, **options) -> Model:
    """Trees and a ridge of the same rows, blended."""
    trees = fit_tree_model(df, features, label, day, through, order=order, **options)
    rows = _through(df, day, through).where(F.col(label).isNotNull()).dropna(subset=features).withColumn("fit_weight", F.lit(1.0))
    weights = fit_ridge(rows, features, label, "fit_weight", penalty)
    return Model(**{**asdict(trees), "family": "hybrid", "weights": [float(w) for w in weights], "tree_weight": tree_weight})


def score(df: DataFrame, model: Model, day: str, *, risk: str | None = None) -> DataFrame:
    """Add ``score`` (the predicted return) and ``model_id``; a row of a day up to trained_through, or of no day, is an error.

    The raw score is that of the trees, of the ridge, or their blend.  It is multiplied by the row's
    ``risk`` where the reward is per unit of risk, by reward_scale where it is a rank, and calibrated
    last.  A null feature of the ridge, or a null risk, gives a null score.
    """
    if model.reward in PER_RISK and risk is None:
        raise ValueError(f"reward {model.reward} needs the rows' risk")
    linear = linear_score(model.features, model.weights) if model.weights else None
    if model.family == "ridge":
        rows, raw = df, linear
    else:
        rows = score_trees(df.withColumnRenamed("score", "score_before"), model.features, json.dumps(model.trees))
        raw = F.col("score") if model.family == "trees" else model.tree_weight * F.col("score") + (1 - model.tree_weight) * linear
    value = raw * F.col(risk) if model.reward in PER_RISK else raw * model.reward_scale if model.reward == "relative_rank" else raw
    late = c(day).cast("date") > F.lit(model.trained_through).cast("date")
    refusal = F.raise_error(F.concat(F.lit(f"model trained through {model.trained_through} cannot score "), F.coalesce(c(day).cast("string"), F.lit("no day")))).cast("double")
    checked = F.when(late, model.offset + model.slope * value).otherwise(refusal)
    return rows.select(*(F.col(x) for x in df.columns if x != "score"), checked.alias("score"), F.lit(model.id).alias("model_id"))


def direction_score(score: str | Column, model: Model) -> Column:
    """A prediction over the model's own spread, within -1 and 1."""
    if not model.score_scale or not math.isfinite(model.score_scale) or model.score_scale <= 0:
        raise ValueError("the model's score scale is not positive")
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c(score) / model.score_scale))
