"""Random forest over the 28 features: trained on some vehicles, judged on the others.

Labelled rows carry the offline features (profile.labelled, then feature_vector.offline); points that come one by one the causal
ones. A model takes either: both have the same names and order.
"""

from __future__ import annotations

import json
import tempfile

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import IndexToString, StandardScaler, StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tankwise.operators.feature_vector import IN, NAMES, causal
from tankwise.operators.preparation import gradual_override
from tankwise.operators.profile import balanced
from tankwise.operators.windows import VEHICLE

# Labels that are repeated in training, and up to how many rows.
RARE, RARE_LEAST = ["UPWARD_SHIFT", "DOWNWARD_SHIFT"], 1500
def held_out(t: DataFrame, share: int = 4) -> DataFrame:
    """True for the vehicles, about one in share, that training never sees."""
    return t.withColumn("held_out", F.pmod(F.crc32("vehicle_id"), F.lit(share)) == 0)


def _weighted(rows: DataFrame, label: str) -> DataFrame:
    """rows with the column weight: all labels weigh alike in sum."""
    sizes = F.broadcast(rows.groupBy(label).agg(F.count("*").alias("size")))
    n, k = rows.count(), sizes.count()
    return rows.join(sizes, label).withColumn("weight", F.lit(float(n)) / (k * F.col("size"))).drop("size")


def training_rows(t: DataFrame, most: int) -> DataFrame:
    """At most `most` rows (label, weight and the 28 features) of each label, computed once: the bounded sample is checkpointed."""
    few = balanced(t.where("features is not null"), "label", most, rare=RARE, least=RARE_LEAST)
    few = few.select("vehicle_id", "seq", "label", "features.*")
    if t.sparkSession.sparkContext.getCheckpointDir() is None:
        set_checkpoint_dir(t.sparkSession)
    return _weighted(few.checkpoint(), "label")


def set_checkpoint_dir(spark: SparkSession) -> None:
    """The shared folder that spark.checkpoint.dir names; a temporary one of this machine only on a local master without it."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))


def train(t: DataFrame, most: int = 30_000, trees: int = 300, depth: int = 18, least: int = 3) -> PipelineModel:
    """A forest on at most `most` rows of each label (that bound is the parameter), labels weighed alike; seeded, so reruns agree."""
    rows = training_rows(t, most)
    names = StringIndexer(inputCol="label", outputCol="_y", stringOrderType="alphabetAsc").fit(rows)
    forest = RandomForestClassifier(labelCol="_y", featuresCol="_f", predictionCol="_p", weightCol="weight", numTrees=trees, maxDepth=depth, minInstancesPerNode=least, featureSubsetStrategy="sqrt", seed=42)
    return Pipeline(stages=[names.setHandleInvalid("keep"), VectorAssembler(inputCols=NAMES, outputCol="_f"), forest, IndexToString(inputCol="_p", outputCol="guess", labels=names.labels)]).fit(rows)


def train_boosted(t: DataFrame, most: int = 30_000, rounds: int = 300, rate: float = 0.05, depth: int = 5) -> PipelineModel:
    """The other model: scaled features and boosted trees of at most 2 ** depth leaves, one against the rest of the labels."""
    rows = training_rows(t, most)
    names = StringIndexer(inputCol="label", outputCol="_y", stringOrderType="alphabetAsc").fit(rows)
    one = GBTClassifier(maxIter=rounds, stepSize=rate, maxDepth=depth, seed=42)
    stages = [names.setHandleInvalid("keep"), VectorAssembler(inputCols=NAMES, outputCol="_v"), StandardScaler(inputCol="_v", outputCol="_f", withMean=True), OneVsRest(classifier=one, labelCol="_y", featuresCol="_f", predictionCol="_p")]
    return Pipeline(stages=[*stages, IndexToString(inputCol="_p", outputCol="guess", labels=names.labels)]).fit(rows)


def save(model: PipelineModel, path: str, **facts) -> None:
    """The model and facts about it (columns, labels, counts) as one line of JSON beside it."""
    model.write().overwrite().save(f"{path}/model")
    SparkSession.active().createDataFrame([(json.dumps(facts, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")


def load(spark: SparkSession, path: str) -> tuple[PipelineModel | None, dict]:
    """The model and its facts; (None, facts with the error) if it cannot be read, so that states fall back."""
    try:
        return PipelineModel.load(f"{path}/model"), json.loads(spark.read.text(f"{path}/metadata").first()[0])
    except Exception as broken:  # whatever a broken or missing model raises: JVM and Python errors alike
        return None, {"error": f"{type(broken).__name__}: {str(broken)[:200]}"}


def predict_causal(model: PipelineModel | None, t: DataFrame, keys: tuple[str, ...] = VEHICLE) -> DataFrame:
    """t with state, for each vehicle (or for each of other keys, such as vehicle and segment): what a model says as points come.

    UNINITIALIZED before the first valid level, INIT at it, the model's guess at later valid levels and STABLE_JITTER elsewhere; a
    steady fall that is called oscillation is a gradual change. Without a model all guesses are STABLE_JITTER.
    """
    own = [c for c in t.columns if c != "state"]
    known = causal(t, keys)
    if model is None:
        guessed = known.withColumn("guess", F.lit("STABLE_JITTER"))
    else:
        # rows without features get zeros and no guess; the model only adds columns, so a row stays a row
        filled = known.select("*", *[F.coalesce(F.col("features")[n], F.lit(0.0)).alias(f"{IN}{n}") for n in NAMES])
        guessed = with_inputs(model).transform(filled)
    state = F.when(F.col("epoch") == 0, "UNINITIALIZED").when(F.col("opens") & (F.col("epoch") == 1), "INIT").when(F.col("features").isNotNull(), F.col("guess")).otherwise("STABLE_JITTER")
    capacity = F.col("capacity") if "capacity" in own else F.lit(None).cast("double")
    guessed = guessed.withColumns({"_guessed": state, "capacity": capacity}).drop("state")
    return gradual_override(guessed, "_guessed", keys).select(*own, "features", "epoch", "state")


def with_inputs(model: PipelineModel) -> PipelineModel:
    """The model without its label indexer, reading the features from columns whose names begin with IN."""
    stages = [s.copy() for s in model.stages if not isinstance(s, StringIndexerModel)]
    assembler = next(s for s in stages if isinstance(s, VectorAssembler))
    assembler.setInputCols([IN + n for n in NAMES])
    return PipelineModel(stages)


def classify(model: PipelineModel, t: DataFrame) -> DataFrame:
    """Rows with features, and guess and the forest's confidence in it."""
    from pyspark.ml.functions import vector_to_array

    own = t.columns
    asked = t.where("features is not null").select("*", *[F.col("features")[n].alias(f"{IN}{n}") for n in NAMES])
    return with_inputs(model).transform(asked).withColumn("confidence", F.array_max(vector_to_array("probability"))).select(*own, "guess", "confidence")
