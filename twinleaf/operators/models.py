"""Models over assembled features, on Spark's own learners."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinleaf.operators import metrics
from twinleaf.operators.assemble import flipped
from twinleaf.operators.durable import durable
from twinleaf.operators.metrics import stratified_folds
from twinleaf.sources import files


#: Most features of a model with an absolute penalty that is fitted by Newton steps, whose sums have this many squared numbers.
NEWTON = 256


def assembled(df: DataFrame, features: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="x", handleInvalid="keep").transform(df.na.fill(0.0, subset=features))


def _weight_sum(df: DataFrame, weighted: bool) -> float:
    return df.agg(F.sum("w") if weighted else F.count("*")).first()[0] or 1


def _logistic(df: DataFrame, alpha: float, l1: float, weighted: bool):
    """Loss over the sum of weights, plus a penalty of 1 / alpha over it: the strength doesn't depend on the number of rows."""
    lr = LogisticRegression(featuresCol="x", labelCol="y", regParam=1 / (alpha * _weight_sum(df, weighted)), elasticNetParam=l1, standardization=False, maxIter=200, tol=1e-10, **({"weightCol": "w"} if weighted else {}))
    return lr.fit(df)


def _elastic_sums(df: DataFrame, b: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Loss, gradient and second derivatives of rows (y, w, x) at intercept and coefficients ``b``: a row from each task reaches the driver."""

    def each(batches):
        total = np.zeros(1 + len(b) + len(b) ** 2)
        for batch in batches:
            y, w, *x = (c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns)
            x = np.column_stack([np.ones(len(y)), *x])
            z = x @ b
            q = 0.5 * (1 + np.tanh(z / 2))
            total += np.concatenate([[(w * (np.logaddexp(0, z) - y * z)).sum()], x.T @ (w * (q - y)), ((x * (w * q * (1 - q))[:, None]).T @ x).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], names=["v"])

    got = sum((np.array(r.v) for r in df.mapInArrow(each, "v array<double>").collect()), np.zeros(1 + len(b) + len(b) ** 2))
    return got[0], got[1:1 + len(b)], got[1 + len(b):].reshape(len(b), -1)


def _elastic_net(df: DataFrame, features: list[str], alpha: float, l1: float, weighted: bool, most: int = 100) -> np.ndarray:
    """Intercept and coefficients with the least loss plus 1 / alpha times the mixed penalty, by Newton steps: a pass over the rows for each.

    The step minimises the penalised quadratic model, one coefficient after the other, and is halved until the loss falls as it should.
    """
    rows = df.na.fill(0.0, subset=features).select(F.col("y").cast("double"), (F.col("w") if weighted else F.lit(1.0)).cast("double").alias("w"), *[F.col(f).cast("double") for f in features])
    flat, steep = np.full(len(features) + 1, (1 - l1) / alpha), np.full(len(features) + 1, l1 / alpha)
    flat[0] = steep[0] = 0
    penalty = lambda b: float((steep * np.abs(b) + flat * b * b / 2).sum())
    b = np.zeros(len(features) + 1)
    loss, g, h = _elastic_sums(rows, b)
    if not np.isfinite(loss) or not h[0, 0] > 0:
        raise ValueError("labels and weights must be numbers, and some weight above 0")
    ones, whole = 2 * h[0, 0] - g[0], 4 * h[0, 0]  # weight of label 1, and of both
    if min(ones, whole - ones) <= 1e-12 * whole:  # one label alone
        return np.array([np.inf if ones > whole / 2 else -np.inf] + [0.0] * len(features))
    passes = 1
    while passes < most:
        d, hd = np.zeros(len(b)), np.zeros(len(b))
        for _ in range(10_000):
            moved = 0.0
            for j in range(len(b)):
                bend = h[j, j] + flat[j]
                if bend <= 0:
                    continue
                at = b[j] + d[j]
                pull = h[j, j] * at - g[j] - hd[j]
                step = np.sign(pull) * max(abs(pull) - steep[j], 0.0) / bend - at
                d[j] += step
                hd += step * h[:, j]
                moved = max(moved, abs(step))
            if moved <= 1e-13 * (1 + np.abs(b + d).max()):
                break
        if np.abs(d).max() <= 1e-9 * (1 + np.abs(b).max()):
            return b + d
        falls, t = g @ d + penalty(b + d) - penalty(b), 1.0
        while passes < most:
            new = _elastic_sums(rows, b + t * d)
            passes += 1
            if new[0] + penalty(b + t * d) <= loss + penalty(b) + 1e-4 * t * falls + 1e-14 * abs(loss):
                break
            t /= 2
        b, (loss, g, h) = b + t * d, new
    return b


def cross_fitted(df: DataFrame, test: DataFrame | None, features: list[str], folds: int = 10, alpha: float = 1.0, l1: float = 0.0, weighted: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """(id, y, fold, logit) from models that haven't seen the row's fold, and (id, logit): the models' mean for the rows of ``test``."""
    data = durable(stratified_folds(df, folds))
    if l1 > 0 and len(features) <= NEWTON:
        x, unseen, means, out = data.na.fill(0.0, subset=features), test and test.na.fill(0.0, subset=features), None, None
        for k in range(folds):
            b = _elastic_net(x.filter(F.col("fold") != k), features, alpha, l1, weighted)
            logit = sum((F.lit(float(c)) * F.col(f) for c, f in zip(b[1:], features)), F.lit(float(b[0]))).alias("logit")
            part = x.filter(F.col("fold") == k).select("id", "y", "fold", logit)
            out = part if out is None else out.unionByName(part)
            if unseen is not None:
                part = unseen.select("id", logit)
                means = part if means is None else means.unionByName(part)
        return out, means and means.groupBy("id").agg(F.avg("logit").alias("logit"))
    x, unseen, means, out = assembled(data, features), test and assembled(test, features), None, None
    for k in range(folds):  # as many models as folds
        model = _logistic(x.filter(F.col("fold") != k), alpha, l1, weighted)
        logit = vector_to_array("rawPrediction")[1].alias("logit")
        part = model.transform(x.filter(F.col("fold") == k)).select("id", "y", "fold", logit)
        out = part if out is None else out.unionByName(part)
        if unseen is not None:
            part = model.transform(unseen).select("id", logit)
            means = part if means is None else means.unionByName(part)
    return out, means and means.groupBy("id").agg(F.avg("logit").alias("logit"))


def out_of_fold(df: DataFrame, features: list[str], folds: int = 10, alpha: float = 1.0, l1: float = 0.0, weighted: bool = False) -> DataFrame:
    return cross_fitted(df, None, features, folds, alpha, l1, weighted)[0]


def elastic_net_search(df: DataFrame, features: list[str], settings: list[tuple[float, float]], folds: int = 10) -> DataFrame:
    """(alpha, l1, log_loss): the out-of-fold loss of each (alpha, share of the absolute penalty)."""
    df, out = durable(df), None
    for alpha, l1 in settings:
        p = cross_fitted(df, None, features, folds, alpha, l1)[0].withColumn("p", 1 / (1 + F.exp(-F.col("logit"))))
        row = metrics.log_loss(p).select(F.lit(alpha).alias("alpha"), F.lit(l1).alias("l1"), "log_loss")
        out = row if out is None else out.unionByName(row)
    return out


def boosted_trees(df: DataFrame, features: list[str], rounds: int = 10, depth: int = 3, step: float = 0.1, subsample: float = 0.6, weighted: bool = True):
    """A fitted boosted-tree model."""
    gbt = GBTClassifier(featuresCol="x", labelCol="y", maxIter=rounds, maxDepth=depth, stepSize=step, subsamplingRate=subsample, seed=31, **({"weightCol": "w"} if weighted else {}))
    return gbt.fit(assembled(df, features))


def predictions(model, df: DataFrame, features: list[str]) -> DataFrame:
    return model.transform(assembled(df, features)).select("id", "y", vector_to_array("probability")[1].alias("p"))


def _splits(node, into: dict[int, list[float]]) -> None:
    """Add (1, gain, rows) of each split below ``node``; a tree has at most 2 ** depth of them."""
    if node.subtreeDepth() == 0:
        return
    one = into[node.split().featureIndex()]
    for i, v in enumerate((1.0, node.gain(), float(node.impurityStats().count()))):
        one[i] += v
    _splits(node.leftChild(), into)
    _splits(node.rightChild(), into)


def feature_scores(spark, model, features: list[str]) -> DataFrame:
    """(feature, weight, gain, cover): share of the splits, and mean gain and rows of a feature's splits; as many rows as features."""
    found = {i: [0.0, 0.0, 0.0] for i in range(len(features))}
    for tree in model.trees:
        _splits(tree._java_obj.rootNode(), found)
    total = sum(n for n, _, _ in found.values()) or 1.0
    rows = [(f, found[i][0] / total, *(v / found[i][0] if found[i][0] else 0.0 for v in found[i][1:])) for i, f in enumerate(features)]
    return spark.createDataFrame(rows, "feature string, weight double, gain double, cover double")


def platt(scored: DataFrame) -> DataFrame:
    """Scores mapped through a logistic curve fitted on them."""
    model = LogisticRegression(featuresCol="x", labelCol="y", maxIter=200, tol=1e-10).fit(assembled(scored, ["p"]))
    return model.transform(assembled(scored, ["p"])).select("id", "y", vector_to_array("probability")[1].alias("p"))


def learning_curve(model, df: DataFrame, features: list[str]) -> DataFrame:
    """Loss after each round; as many rows as rounds."""
    losses = model.evaluateEachIteration(assembled(df, features))
    return df.sparkSession.createDataFrame([(i, float(v)) for i, v in enumerate(losses)], "round int, loss double")


def principal_parts(df: DataFrame, features: list[str], k: int) -> DataFrame:
    """Rows in the first ``k`` principal directions of the scaled features; signs are arbitrary."""
    scaled = StandardScaler(inputCol="x", outputCol="z", withMean=True).fit(assembled(df, features))
    data = scaled.transform(assembled(df, features))
    return PCA(k=k, inputCol="z", outputCol="u").fit(data).transform(data).select("id", vector_to_array("u").alias("factors"))


def feed_forward(df: DataFrame, features: list[str], hidden: tuple[int, ...] = (8,)) -> DataFrame:
    """Probabilities of a small feed-forward net on scaled features."""
    data = assembled(df, features)
    data = StandardScaler(inputCol="x", outputCol="z", withMean=True).fit(data).transform(data)
    net = MultilayerPerceptronClassifier(featuresCol="z", labelCol="y", layers=[len(features), *hidden, 2], maxIter=40, seed=31)
    return net.fit(data).transform(data).select("id", "y", vector_to_array("probability")[1].alias("p"))


def logistic(df: DataFrame, features: list[str], alpha: float = 1.0, weighted: bool = False):
    """A fitted logistic model with L2 penalty."""
    return _logistic(assembled(df, features), alpha, 0.0, weighted)


def logits(model, df: DataFrame, features: list[str]) -> DataFrame:
    return model.transform(assembled(df, features)).select("id", "y", vector_to_array("rawPrediction")[1].alias("logit"))


def final_model(train: DataFrame, test: DataFrame, features: list[str], flips: list[tuple[str, str]], weights: dict[int, float], folder: str, rounds: int = 10, depth: int = 3) -> dict[str, DataFrame]:
    """The whole course from joined features (id, y, question1, question2, features) to the submission.

    One row in a hundred, with its mirrored copy, is held out; the rest and its copies train weighted trees. Written to ``folder``:
    feature map, model, its dump, quality of both parts, worst errors with their texts, learning curve, feature scores and submission.
    """
    spark = train.sparkSession
    number = F.conv(F.substring(F.md5(F.col("id").cast("string").cast("binary")), 1, 8), 16, 10).cast("long")
    w = F.lit(None).cast("double")
    for k, v in weights.items():
        w = F.when(F.col("y") == k, F.lit(v)).otherwise(w)
    both = durable(flipped(train, flips).withColumns({"w": w, "part": F.when(number % 100 == 0, "valid").otherwise("train")}))
    files.write_feature_map(spark, features, f"{folder}/map")
    model = boosted_trees(both.filter("part = 'train'"), features, rounds, depth)
    files.save_model(model, f"{folder}/model")
    files.write_model_dump(spark, model, f"{folder}/dump")
    scored = durable(model.transform(assembled(both, features)).select("id", "y", "w", "part", "mirrored", "question1", "question2", vector_to_array("probability")[1].alias("p")))
    quality, errors = None, None
    for part in ("train", "valid"):
        rows = scored.filter(F.col("part") == part)
        one = metrics.log_loss(rows, "w").join(F.broadcast(metrics.auc(rows, "w"))).select(F.lit(part).alias("part"), "log_loss", "auc")
        worst = [metrics.top_errors(rows.filter("mirrored = 0"), label).withColumn("part", F.lit(part)) for label in (0, 1)]
        quality = one if quality is None else quality.unionByName(one)
        errors = worst[0].unionByName(worst[1]) if errors is None else errors.unionByName(worst[0]).unionByName(worst[1])
    out = {"quality": quality, "errors": errors.join(train.select("id", "question1", "question2"), "id"), "scores": feature_scores(spark, model, features), "progress": learning_curve(model, both.filter("part = 'train'"), features)}
    files.write_errors(out["errors"], f"{folder}/errors")
    for name in ("quality", "scores", "progress"):
        files.write_record(out[name], f"{folder}/{name}")
    out["submission"] = predictions(model, test, features).select(F.col("id").alias("test_id"), F.col("p").alias("is_duplicate"))
    files.write_submission(out["submission"], f"{folder}/submission", score="is_duplicate")
    return out
