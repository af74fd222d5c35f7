"""Text classifiers on Spark ML.

Every model is a ``pyspark.ml`` estimator trained where the data lives.  The
vocabulary is a table: texts are joined to it, and neither it nor the IDF is ever
collected or broadcast by this code.  What the driver holds is Spark ML's own: one
coefficient per term for a linear model, the trees of a forest, losses.
"""

from __future__ import annotations

import os
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel, MultilayerPerceptronClassifier
from pyspark.ml.feature import IDF, ElementwiseProduct, HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import array_to_vector, predict_batch_udf, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from ..functions.hashing import order_key
from ..session import cut_lineage
from . import features as fe
from . import forest
from . import metrics as me


@dataclass
class TextFeatures:
    """A fitted TF-IDF as a table (term, idx, df, idf)."""
    terms: DataFrame
    size: int
    text: str = "text"

    def transform(self, df: DataFrame, key: str = "doc_id", out_col: str = "features", columns=None) -> DataFrame:
        """``df`` (unique ``key``), or ``columns`` of it, plus the L2-normalised sparse vector of its text, materialised."""
        toks = df.select(key, tx.tfidf_tokens(F.col(self.text)).alias("_t"))
        return fe.with_vectors(df.select(*columns) if columns else df, fe.tfidf_rows(toks, [key], "_t", self.terms), [key], self.size, out_col)

    def save(self, path: str) -> None:
        self.terms.write.mode("overwrite").parquet(os.path.join(path, "terms"))

    @classmethod
    def load(cls, spark: SparkSession, path: str, text: str = "text") -> "TextFeatures":
        terms = spark.read.parquet(os.path.join(path, "terms"))
        return cls(terms, terms.count(), text)


def fit_tfidf(train: DataFrame, text: str = "text") -> TextFeatures:
    """X (ln((1+N)/(1+df)) + 1) -> L2 rows, fitted on ``train``; every term is kept."""
    terms = fe.fit_terms(train.select(tx.tfidf_tokens(F.col(text)).alias("_t")), "_t")
    return TextFeatures(terms, terms.count(), text)


@dataclass
class TextClassifier:
    """TF-IDF and a logistic regression over it.

    A text is scored by a join of its distinct words with (term, idf, coefficient) and
    two sums, so no task needs the vocabulary or the coefficients as a whole."""
    features: TextFeatures
    model: LogisticRegressionModel

    def weights(self) -> DataFrame:
        """(term, idx, idf, coef) of the terms with their coefficient."""
        spark = self.features.terms.sparkSession
        coef = np.asarray(self.model.coefficients.toArray(), dtype=np.float64)
        table = spark.createDataFrame(pd.DataFrame({"idx": np.arange(len(coef), dtype=np.int64), "coef": coef}),
                                      "idx long, coef double")
        return self.features.terms.select("term", "idx", "idf").join(table, "idx")

    def score(self, df: DataFrame, keys=("doc_id",)) -> DataFrame:
        """``df`` (unique ``keys``) plus p1 and the prediction (int)."""
        keys = list(keys)
        toks = df.select(*keys, tx.tfidf_tokens(F.col(self.features.text)).alias("_t"))
        w = fe.term_counts(toks, keys, "_t").join(self.weights(), "term").withColumn("_x", F.col("tf") * F.col("idf"))
        sums = w.groupBy(*keys).agg((F.sum(F.col("_x") * F.col("coef")) / F.sqrt(F.sum(F.col("_x") * F.col("_x")))).alias("_z"))
        z = F.coalesce(F.col("_z"), F.lit(0.0)) + F.lit(float(self.model.intercept))
        out = df.join(sums, keys, "left").withColumn("p1", 1 / (1 + F.exp(-z)))
        return out.withColumn("prediction", (F.col("p1") > 0.5).cast("int")).drop("_z")

    def save(self, path: str) -> str:
        """Persist the model (overwrite)."""
        self.features.save(path)
        self.model.write().overwrite().save(os.path.join(path, "model"))
        return path

    @classmethod
    def load(cls, spark: SparkSession, path: str, text: str = "text") -> "TextClassifier":
        """Reload a saved model; fails if nothing is there."""
        return cls(TextFeatures.load(spark, path, text), LogisticRegressionModel.load(os.path.join(path, "model")))


def fit_text_classifier(train: DataFrame, key: str = "doc_id", text: str = "text", label: str = "label") -> TextClassifier:
    """L1 + L2 on ``train``."""
    feats = fit_tfidf(train, text)
    return TextClassifier(feats, train_lr(feats.transform(train, key, columns=[key, label]), label=label))


def fit_hashed_tfidf(train: DataFrame, slots: int, text: str = "text", out_col: str = "features") -> PipelineModel:
    """L1 with a fixed width: the terms are folded into ``slots`` hashed columns (their
    counts add up, none is dropped), for models with a fixed input layer."""
    tok = RegexTokenizer(inputCol=text, outputCol="_tok", pattern=tx.TFIDF_TOKEN, gaps=False, toLowercase=True, minTokenLength=1)
    tf = HashingTF(inputCol="_tok", outputCol="_tf", numFeatures=slots)
    idf = IDF(inputCol="_tf", outputCol="_idf_unused").fit(tf.transform(tok.transform(train)))
    scale = ElementwiseProduct(scalingVec=Vectors.dense(idf.idf.toArray() + 1.0), inputCol="_tf", outputCol="_tfidf")
    return PipelineModel(stages=[tok, tf, scale, Normalizer(p=2.0, inputCol="_tfidf", outputCol=out_col)])


def train_lr(train: DataFrame, features: str = "features", label: str = "label", C: float = 1e5,
             max_iter: int = 100):
    """L2: weak-L2 logistic regression; sklearn's C maps to regParam = 1 / (C n)."""
    n = train.count()
    lr = LogisticRegression(featuresCol=features, labelCol=label, regParam=1.0 / (C * max(n, 1)),
                            elasticNetParam=0.0, standardization=False, maxIter=max_iter)
    return lr.fit(train)


def train_rf(train: DataFrame, features: str = "features", label: str = "label", num_trees: int = 100,
             max_depth: int = 30, seed: int = 42, key: str = "doc_id") -> forest.Forest:
    """L3: random forest, sqrt feature subsets; depth capped at 30, as Spark ML's."""
    return forest.grow(train, features, label, num_trees, max_depth, seed=seed, key=key)


def train_mlp(train: DataFrame, n_features: int, features: str = "features", label: str = "label",
              hidden: int = 100, max_iter: int = 200, seed: int = 42):
    """L4: one hidden layer of 100 units, two classes (and it is the MLP that is scored, N4)."""
    mlp = MultilayerPerceptronClassifier(featuresCol=features, labelCol=label,
                                         layers=[n_features, hidden, 2], maxIter=max_iter, seed=seed)
    return mlp.fit(train)


def pooled_vector(df: DataFrame, pooled: str = "pooled", out_col: str = "pooled_vec") -> DataFrame:
    """array<double> pooled features -> ml vector column."""
    return df.withColumn(out_col, array_to_vector(F.col(pooled)))


def train_embedding_classifier(train: DataFrame, features: str = "pooled_vec", label: str = "label",
                               max_iter: int = 100):
    """Mean-pooled word vectors -> linear layer -> class (multinomial LR)."""
    lr = LogisticRegression(featuresCol=features, labelCol=label, family="multinomial", maxIter=max_iter,
                            regParam=0.0)
    return lr.fit(train)


def score(model, df: DataFrame) -> DataFrame:
    """Prediction (int) and class-1 probability."""
    out = model.transform(df)
    return out.withColumn("prediction", F.col("prediction").cast("int")) \
        .withColumn("p1", vector_to_array(F.col("probability"))[1])


def fit_and_report(name: str, model, train: DataFrame, test: DataFrame, label: str = "label") -> DataFrame:
    """Accuracy and F1 on both sides -> (model, split, metric, value)."""
    parts = []
    for split, df in (("train", train), ("test", test)):
        s = me.binary_scores(score(model, df), label=label)
        parts.append(s.select(F.lit(name).alias("model"), F.lit(split).alias("split"),
                              F.explode(F.array(
                                  F.struct(F.lit("accuracy").alias("metric"), F.col("accuracy").alias("value")),
                                  F.struct(F.lit("f1").alias("metric"), F.col("f1").alias("value")))).alias("_m"))
                     .select("model", "split", "_m.metric", "_m.value"))
    return parts[0].unionByName(parts[1])


def objective_log(spark, model, run: str = "lr") -> DataFrame:
    """Loss per optimiser iteration, as a log table (small: one row per iteration)."""
    hist = list(model.summary.objectiveHistory)
    return spark.createDataFrame([(run, i, float(v)) for i, v in enumerate(hist)],
                                 "run string, iteration int, loss double")


def run(train: DataFrame | None, test: DataFrame, model_path: str | None = None, text: str = "text",
        label: str = "label", load: bool = False, key: str = "doc_id") -> DataFrame:
    """With ``load`` the saved model is loaded from ``model_path`` (any file
    system Spark reads; it fails if nothing is there) and scored; otherwise
    TF-IDF + LR are fitted on ``train`` and saved when a path is given."""
    if load:
        if not model_path:
            raise ValueError("load needs a model_path")
        model = TextClassifier.load(test.sparkSession, model_path, text)
    else:
        model = fit_text_classifier(train, key, text, label)
        if model_path:
            model.save(model_path)
    return model.score(test, [key])


# -- epochs, kept and reloaded ------------------------------------------------------
LOG = "run string, epoch long, split string, step long, loss double, correct long, n long"


def _sgd(batches, w: np.ndarray, b: float, lr: float):
    """One pass of logistic SGD: yields (loss, correct, rows) before each update, then the parameters."""
    for x, y in batches:
        z = np.clip(x @ w + b, -500, 500)
        p = 1 / (1 + np.exp(-z))
        yield float(np.mean(np.logaddexp(0, z) - y * z)), int(((p > 0.5) == y).sum()), len(y)
        w -= lr * (x.T @ (p - y)) / len(y)
        b -= lr * float((p - y).mean())
    yield w, b


def _epoch(rows: DataFrame, w: np.ndarray, b: float, lr: float, batch: int, split: str) -> DataFrame:
    """(part, step, loss, correct, n, w): the log rows of one pass over the parts of ``rows``;
    a part's last row carries its parameters.  Every part goes on from the same ones."""
    def work(it):
        x, y, part, step = [], [], None, 0
        state = [w.copy(), b]

        def flush():
            nonlocal step
            if not y:
                return None
            *logs, (state[0], state[1]) = _sgd([(np.stack(x), np.asarray(y, dtype=np.float64))], state[0], state[1], lr)
            x.clear()
            y.clear()
            step += 1
            return (part, step - 1, *logs[0], None)

        out, seen = [], 0
        for pdf in it:
            for v, label, p in zip(pdf["x"], pdf["y"], pdf["part"]):
                part = p
                x.append(np.asarray(v, dtype=np.float64))
                y.append(label)
                seen += 1
                if len(y) == batch:
                    out.append(flush())
        if y:
            out.append(flush())
        if out:
            part_row = (part, -1, 0.0, 0, seen, [*state[0].tolist(), state[1]])
            yield pd.DataFrame([*out, part_row], columns=["part", "step", "loss", "correct", "n", "w"])

    return rows.mapInPandas(work, "part int, step long, loss double, correct long, n long, w array<double>")


def train_epochs(train: DataFrame, valid: DataFrame, path: str, features: str = "pooled", label: str = "label",
                 key: str = "doc_id", epochs: int = 10, lr: float = 1e-3, batch: int = 64, parts: int = 4,
                 seed: int = 42, run: str = "run") -> DataFrame:
    """L5 + L11 + S9: a linear layer over dense vectors, trained for ``epochs`` passes that
    each go on from the last one's parameters, with a log row per batch and one saved
    version per epoch.

    The rows are dealt into ``parts`` by a hash of their key and shuffled by a hash of
    (key, epoch); every part runs mini-batch SGD on its own rows and the parts'
    parameters are averaged by rows, so reruns agree.  Returns the training log
    (run, epoch, split, step, loss, correct, n); versions are under ``path/epoch=k``.
    """
    spark = train.sparkSession

    def laid(df: DataFrame) -> DataFrame:
        part = F.pmod(F.xxhash64(F.col(key)), F.lit(parts)).cast("int")
        return cut_lineage(df.select(key, F.col(features).alias("x"), F.col(label).cast("double").alias("y"), part.alias("part")))

    train, valid = laid(train), laid(valid)
    first = train.first()
    width = len(first["x"]) if first else 0
    w, b = np.zeros(width), 0.0
    logs = []
    for epoch in range(1, epochs + 1):
        order = [F.col("part"), order_key(F.col(key), seed + epoch), F.col(key)]
        told = cut_lineage(_epoch(train.repartition(parts, "part").sortWithinPartitions(*order), w, b, lr, batch, "train"))
        mean = told.where("step < 0").select(array_to_vector("w").alias("w"), F.col("n").cast("double").alias("n")).agg(
            Summarizer.mean(F.col("w"), F.col("n")).alias("m")).select(vector_to_array("m").alias("m")).first()
        if mean is not None and mean["m"] is not None:         # one vector, whatever the number of parts
            w, b = np.array(mean["m"][:-1]), float(mean["m"][-1])
        ahead = cut_lineage(_epoch(valid.repartition(parts, "part").sortWithinPartitions(*order), w, b, 0.0, batch, "val"))
        for split, rows in (("train", told), ("val", ahead)):
            logs.append(rows.where("step >= 0").select(
                F.lit(run).alias("run"), F.lit(epoch).cast("long").alias("epoch"), F.lit(split).alias("split"),
                (F.col("step") * parts + F.col("part")).alias("step"), "loss", "correct", "n"))
        version = spark.createDataFrame([(epoch, w.tolist(), b)], "epoch long, w array<double>, b double")
        version.write.mode("overwrite").parquet(os.path.join(path, f"epoch={epoch}"))
    log = spark.createDataFrame([], LOG)
    for part in logs:
        log = log.unionByName(part)
    return cut_lineage(log)


def best_epoch(log: DataFrame, run: str = "run") -> int:
    """W4 over A8: the last epoch whose validation loss is below all earlier ones."""
    best = me.best_checkpoints(log.where(F.col("run") == run), loss="loss_mean").where("is_best")
    return best.agg(F.max("epoch")).first()[0]


def load_version(spark: SparkSession, path: str, epoch: int) -> tuple[np.ndarray, float]:
    """The parameters saved after an epoch; fails if there are none."""
    row = spark.read.parquet(os.path.join(path, f"epoch={epoch}")).first()
    return np.array(row["w"], dtype=np.float64), float(row["b"])


def binary_predict_fn(w: np.ndarray, b: float):
    """Factory for ``predict_batch_udf``: [P(0), P(1)] of a fitted linear layer or logistic
    regression.  The parameters are the artefact: they reach a worker once, with the function."""
    def make():
        def predict(x: np.ndarray) -> np.ndarray:
            p = 1 / (1 + np.exp(-(x @ w + b)))
            return np.stack([1 - p, p], axis=1)
        return predict
    return make


def fitted_predict_fn(model: LogisticRegressionModel):
    """The batch predictor of a fitted or loaded binary model of Spark ML over dense features."""
    if model.numClasses != 2:
        raise ValueError("a binary model is needed")
    if model.coefficientMatrix.numRows == 2:                   # multinomial form: one row per class
        m, c = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
        return binary_predict_fn(m[1] - m[0], float(c[1] - c[0]))
    return binary_predict_fn(model.coefficients.toArray(), float(model.intercept))


def make_linear_predict_fn(weights, bias):
    """Factory for ``predict_batch_udf``: softmax(W x + b) over a numpy batch."""
    w = np.asarray(weights, dtype=np.float64)
    b = np.asarray(bias, dtype=np.float64)

    def make():
        def predict(x: np.ndarray) -> np.ndarray:
            z = x @ w.T + b
            z = z - z.max(axis=1, keepdims=True)
            e = np.exp(z)
            return e / e.sum(axis=1, keepdims=True)
        return predict
    return make


def batch_score(df: DataFrame, vec_col: str, make_predict_fn, n_in: int, n_out: int,
                batch_size: int = 32) -> DataFrame:
    """Score a table in fixed-size Arrow batches with a loaded model; adds
    ``probs`` and ``prediction`` (arg-max)."""
    udf = predict_batch_udf(make_predict_fn, return_type=T.ArrayType(T.DoubleType()),
                            batch_size=batch_size, input_tensor_shapes=[[n_in]])
    out = df.withColumn("probs", udf(F.col(vec_col)))
    return out.withColumn("prediction", (F.array_position("probs", F.array_max("probs")) - 1).cast("int"))
