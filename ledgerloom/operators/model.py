"""Text classifier of narrations: TF-IDF of words and word pairs, logistic regression.

The vocabulary is bounded (5000 terms), so everything that is collected or broadcast here is
bounded as well, whatever the number of narrations.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression, NaiveBayes
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import normalize_narration
from ..session import stage
from .corpus import augment, seed_corpus, stratified_split

VOCABULARY = 5000
INVERSE_REGULARISATION = 2.5
ITERATIONS = 1000
NB_SMOOTHING = 0.1
TERMS_COLUMN, FEATURES, COPIES = "_terms", "_features", "_copies"
INFO = "position int, category string, accuracy double, total_samples long, train_samples long, test_samples long"
# The fit stops when a step gains less than this share of the loss.
TOLERANCE = 1e-8
INTERCEPT = "(intercept)"


def terms(description: Column) -> Column:
    """Words of two characters or more and pairs of neighbouring words."""
    words = F.regexp_extract_all(normalize_narration(description), F.lit(r"(?U)\b(\w\w+)\b"), F.lit(1))

    def grams(w: Column) -> Column:
        n = F.size(w)
        pairs = F.zip_with(F.slice(w, 1, n - 1), F.slice(w, 2, n - 1), lambda a, b: F.concat_ws(" ", a, b))
        return F.when(n >= 2, F.concat(w, pairs)).otherwise(w)

    return F.transform(F.array(words), grams)[0]


def distinct_texts(rows: DataFrame) -> DataFrame:
    """``(category, terms, copies)``: rows of one category with the same terms, once.

    Narrations repeat but for their references, which are no terms. Loss, sums and counts are
    those of all rows if each of these weighs as much as its copies.
    """
    texts = rows.select("category", terms(F.col("description")).alias(TERMS_COLUMN))
    return texts.groupBy("category", TERMS_COLUMN).agg(F.count(F.lit(1)).alias(COPIES))


def vocabulary(texts: DataFrame, size: int = VOCABULARY) -> DataFrame:
    """The ``size`` most frequent terms with total and document counts (ties by name)."""
    per_row = texts.select(COPIES, F.explode(F.array_distinct(TERMS_COLUMN)).alias("term")).groupBy("term").agg(
        F.sum(COPIES).alias("docs")
    )
    total = texts.select(COPIES, F.explode(TERMS_COLUMN).alias("term")).groupBy("term").agg(
        F.sum(COPIES).alias("total")
    )
    return total.join(per_row, "term").orderBy(F.desc("total"), "term").limit(size)


def idf(docs: Column, n: Column) -> Column:
    return F.log((n + 1) / (docs + 1)) + 1


def tfidf(texts: DataFrame, key: str, size: int = VOCABULARY) -> DataFrame:
    """TF-IDF weights in long form: ``(key, term, weight)``, each row of unit length.

    Term counts of a text are combined before they leave its task; the vocabulary is broadcast
    (at most ``size`` rows). ``texts`` are descriptions, or ``distinct_texts`` with a key.
    """
    once = COPIES in texts.columns
    tokens = texts if once else texts.select(key, terms(F.col("description")).alias(TERMS_COLUMN))
    by, copies = ([key, COPIES], F.col(COPIES)) if once else ([key], F.lit(1))
    counts = tokens.select(*by, F.explode(TERMS_COLUMN).alias("term")).groupBy(*by, "term").agg(
        F.count(F.lit(1)).alias("tf")
    )
    counts = stage(counts, "term-counts")  # read for the vocabulary and for the weights
    known = counts.groupBy("term").agg(F.sum(F.col("tf") * copies).alias("total"), F.sum(copies).alias("docs"))
    known = known.orderBy(F.desc("total"), "term").limit(size).select("term", "docs")
    n = texts.agg(F.sum(copies)).scalar()
    known = known.select("term", idf(F.col("docs"), n).alias("idf"))
    weighted = counts.join(F.broadcast(known), "term").select(
        key, "term", ((1 + F.log("tf")) * F.col("idf")).alias("raw")
    )
    # one text has at most ``size`` different known terms
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy(key)))
    return weighted.select(key, "term", (F.col("raw") / norm).alias("weight"))


def naive_bayes_table(weights: DataFrame, labels: DataFrame, key: str, *, smoothing: float = NB_SMOOTHING) -> DataFrame:
    """Multinomial naive Bayes as a table: ``(category, term, log_prob, log_prior)``.

    Feature sums per (category, term) are partial aggregates; the result has at most
    categories x vocabulary rows.
    """
    sums = weights.join(labels, key).groupBy("category", "term").agg(F.sum("weight").alias("s"))
    prior = labels.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    everything = prior.agg(F.sum("n")).scalar()
    size = sums.agg(F.count_distinct("term")).scalar()
    # every term meets every category: the categories are one short array
    classes = prior.agg(F.collect_list(F.struct("category", "n"))).scalar()
    grid = sums.select("term").distinct().select("term", F.explode(classes).alias("c"))
    grid = grid.select("term", "c.category", "c.n")
    per_class = sums.groupBy("category").agg(F.sum("s").alias("class_sum"))
    filled = grid.join(sums, ["category", "term"], "left").join(per_class, "category")
    log_prob = F.log((F.coalesce("s", F.lit(0.0)) + smoothing) / (F.col("class_sum") + smoothing * size))
    return filled.select(
        "category", "term", log_prob.alias("log_prob"), F.log(F.col("n") / everything).alias("log_prior")
    )


def _sublinear(vector: str) -> Column:
    """1 + ln(count) on the stored entries of a sparse vector.

    Spark has no expression that makes a sparse vector of arrays, so it reads one from JSON, on
    the JVM. Margins as sums over literal tables of the model were no faster.
    """
    parts = F.unwrap_udt(vector)

    def scaled(p: Column) -> Column:
        return F.struct(
            p["type"].alias("type"),
            p["size"].alias("size"),
            p["indices"].alias("indices"),
            F.transform(p["values"], lambda x: 1 + F.log(x)).alias("values"),
        )

    json = F.to_json(F.struct(F.transform(F.array(parts), scaled)[0].alias("v")))
    return F.from_json(json, T.StructType([T.StructField("v", VectorUDT())]))["v"]


@dataclass
class NarrationModel:
    """A trained classifier: term counter, scaling and classifier, and its class names."""

    counter: CountVectorizerModel
    stages: PipelineModel
    classes: list[str]
    accuracy: float = 0.0
    train_samples: int = 0
    test_samples: int = 0

    def features(self, df: DataFrame) -> DataFrame:
        """Vectors of ``description``, or of the terms if ``df`` has them."""
        counted = df if TERMS_COLUMN in df.columns else df.withColumn(TERMS_COLUMN, terms(F.col("description")))
        return self.counter.transform(counted).withColumn("_tf", _sublinear("_counts"))

    def score(self, df: DataFrame) -> DataFrame:
        """Add ``ml_category`` and ``ml_confidence`` (three decimals); one pass, no shuffle."""
        scored = self.stages.transform(self.features(df))
        names = F.array(*[F.lit(c) for c in self.classes])
        return scored.select(
            *[F.col(f"`{c}`") for c in df.columns],
            F.element_at(names, F.col("prediction").cast("int") + 1).alias("ml_category"),
            F.round(F.array_max(vector_to_array("probability")), 3).alias("ml_confidence"),
        )

    def save(self, path: str) -> None:
        self.counter.write().overwrite().save(f"{path}/terms")
        self.stages.write().overwrite().save(f"{path}/stages")
        spark = SparkSession.active()
        counts = self.train_samples + self.test_samples, self.train_samples, self.test_samples
        info = [(i, c, self.accuracy, *counts) for i, c in enumerate(self.classes)]
        spark.createDataFrame(info, INFO).coalesce(1).write.mode("overwrite").parquet(f"{path}/info")


def load_model(spark: SparkSession, path: str) -> NarrationModel:
    info = model_info(spark, path).orderBy("position").collect()  # one row for each class
    return NarrationModel(
        CountVectorizerModel.load(f"{path}/terms"),
        PipelineModel.load(f"{path}/stages"),
        [r["category"] for r in info],
        info[0]["accuracy"],
        info[0]["train_samples"],
        info[0]["test_samples"],
    )


def model_info(spark: SparkSession, path: str) -> DataFrame:
    """Classes, accuracy and numbers of samples of a saved model; an older one has no numbers (0)."""
    return spark.read.schema(INFO).parquet(f"{path}/info").na.fill(0, ["total_samples", "train_samples", "test_samples"])


def fit(train: DataFrame, *, kind: str = "logistic_regression") -> NarrationModel:
    """Fit on ``description`` and ``category``.

    Rows of rare categories weigh more, so that every category has the same total weight; the
    penalty is the mean-loss form of C = 2.5. ``kind="naive_bayes"`` is the alternative (Spark
    smooths the class priors too). Equal texts are one row that weighs as much as all of them.
    """
    texts = stage(distinct_texts(train), "training-texts")
    known = vocabulary(texts).collect()  # at most VOCABULARY rows
    per_class = {r["category"]: r["n"] for r in texts.groupBy("category").agg(F.sum(COPIES).alias("n")).collect()}
    classes = sorted(per_class)
    n = sum(per_class.values())
    counter = CountVectorizerModel.from_vocabulary(
        [r["term"] for r in known], inputCol=TERMS_COLUMN, outputCol="_counts"
    )
    scale = [float(v) for v in _idf_values([r["docs"] for r in known], n)]
    product = ElementwiseProduct(scalingVec=Vectors.dense(scale), inputCol="_tf", outputCol="_scaled")
    unit = Normalizer(p=2.0, inputCol="_scaled", outputCol=FEATURES)
    names = F.array(*[F.lit(c) for c in classes])
    weights = F.create_map(
        *[x for c in classes for x in (F.lit(c), F.lit(n / (len(classes) * per_class[c])))]
    )
    model = NarrationModel(counter, PipelineModel([product, unit]), classes, train_samples=n)
    rows = unit.transform(product.transform(model.features(texts))).select(
        FEATURES,
        (F.array_position(names, F.col("category")) - 1).cast("double").alias("label"),
        F.col(COPIES).cast("double").alias("copies"),
        (F.element_at(weights, F.col("category")) * F.col(COPIES)).alias("weight"),
    )
    rows = stage(rows, "training-features")  # read once per iteration
    if kind == "naive_bayes":
        fitted = NaiveBayes(smoothing=NB_SMOOTHING, featuresCol=FEATURES, weightCol="copies").fit(rows)
    else:
        fitted = LogisticRegression(
            family="multinomial",
            featuresCol=FEATURES,
            weightCol="weight",
            maxIter=ITERATIONS,
            tol=TOLERANCE,
            regParam=1.0 / (INVERSE_REGULARISATION * n),
            standardization=False,
        ).fit(rows)
    model.stages = PipelineModel([product, unit, fitted])
    return model


def coefficients(spark: SparkSession, model: NarrationModel) -> DataFrame:
    """(term, weights): what a term adds to the margin of each class, in the order of ``classes``.

    At most VOCABULARY rows and one for the intercepts.
    """
    fitted = model.stages.stages[-1]
    table = fitted.coefficientMatrix.toArray().T
    rows = [(t, [float(x) for x in w]) for t, w in zip(model.counter.vocabulary, table, strict=True)]
    rows.append((INTERCEPT, [float(x) for x in fitted.interceptVector.toArray()]))
    return spark.createDataFrame(rows, "term string, weights array<double>")


def gradient(model: NarrationModel, train: DataFrame, key: str = "text_no") -> DataFrame:
    """(category, term, gradient) of the loss of ``fit`` at the fitted coefficients.

    The loss is convex, so a gradient near zero everywhere shows that no other coefficients are
    better: a proof of the fit that needs neither the optimiser nor its vectors. ``train`` are the
    rows that were fitted; their distinct texts are numbered in a column ``key``. Terms and margins
    are long rows built by ``tfidf``; a text's terms meet once by key, the sums by term are partial
    aggregates.
    """
    spark = train.sparkSession
    train = stage(distinct_texts(train).withColumn(key, F.monotonically_increasing_id()), "distinct-texts")
    known = coefficients(spark, model)
    intercepts = known.where(F.col("term") == INTERCEPT).first()["weights"]
    size, classes = len(model.classes), F.array(*[F.lit(c) for c in model.classes])
    per_class = train.groupBy("category").agg(F.sum(COPIES).alias("n"))
    counts = {r["category"]: r["n"] for r in per_class.collect()}  # one row for each class
    n = sum(counts.values())
    balance = F.create_map(*[x for c in model.classes for x in (F.lit(c), F.lit(n / (size * counts[c])))])

    terms_of = tfidf(train, key).join(F.broadcast(known), "term")
    margins = [F.sum(F.col("weights")[i] * F.col("weight")).alias(f"_m{i}") for i in range(size)]
    texts = terms_of.groupBy(key).agg(F.collect_list(F.struct("term", "weight")).alias("held"), *margins)
    rows = train.select(key, "category", COPIES).join(texts, key, "left")
    margin = F.array(*[F.coalesce(F.col(f"_m{i}"), F.lit(0.0)) + F.lit(float(b)) for i, b in enumerate(intercepts)])
    balanced = F.element_at(balance, F.col("category")) * F.col(COPIES)
    rows = rows.select("category", "held", margin.alias("margin"), balanced.alias("_w"))
    rows = rows.withColumn("odds", F.transform("margin", lambda m: F.exp(m - F.array_max("margin"))))
    total = F.aggregate("odds", F.lit(0.0), lambda a, x: a + x)
    off = F.zip_with(
        F.col("odds"), classes, lambda p, c: F.col("_w") * (p / F.col("total") - (c == F.col("category")).cast("double"))
    )
    one = F.array(F.struct(F.lit(INTERCEPT).alias("term"), F.lit(1.0).alias("weight")))
    rows = rows.withColumn("total", total).select("_w", off.alias("off"), F.concat(F.coalesce("held", F.array().cast(T.ArrayType(_HELD))), one).alias("held"))
    moved = rows.select("off", "_w", F.explode("held").alias("h")).groupBy("h.term").agg(
        *[F.sum(F.col("off")[i] * F.col("h.weight")).alias(f"_g{i}") for i in range(size)]
    )
    # class weights make the weights of all rows sum to their number
    held = moved.join(F.broadcast(known), "term", "right")
    penalty = F.when(F.col("term") == INTERCEPT, F.lit(0.0)).otherwise(F.lit(1.0 / (INVERSE_REGULARISATION * n)))
    sums = F.array(*[F.coalesce(F.col(f"_g{i}"), F.lit(0.0)) / n for i in range(size)])
    slopes = F.arrays_zip(classes.alias("category"), F.zip_with(sums, "weights", lambda g, b: g + penalty * b).alias("gradient"))
    return held.select("term", F.explode(slopes).alias("s")).select("s.category", "term", "s.gradient")


_HELD = T.StructType([T.StructField("term", T.StringType()), T.StructField("weight", T.DoubleType())])


def _idf_values(docs: list[int], n: int) -> list[float]:
    return [log((1 + n) / (1 + d)) + 1 for d in docs]


def class_report(predictions: DataFrame, label: str = "category", predicted: str = "ml_category") -> DataFrame:
    """Precision, recall, F1 and support per class, and the overall accuracy.

    One partial aggregate over the rows gives the confusion table; the rest is tiny. Rows of
    ``distinct_texts`` count as often as they have copies.
    """
    rows = F.sum(COPIES) if COPIES in predictions.columns else F.count(F.lit(1))
    confusion = predictions.groupBy(F.col(label).alias("label"), F.col(predicted).alias("predicted")).agg(rows.alias("n"))
    hit = F.col("label") == F.col("predicted")
    sides = confusion.select(
        F.explode(
            F.array(
                F.struct(F.col("label").alias("class"), F.col("n").alias("actual"), F.lit(0).cast("long").alias("claimed"), F.when(hit, F.col("n")).otherwise(0).alias("hits")),
                F.struct(F.col("predicted").alias("class"), F.lit(0).cast("long").alias("actual"), F.col("n").alias("claimed"), F.lit(0).cast("long").alias("hits")),
            )
        ).alias("s")
    ).select("s.*")
    per_class = sides.groupBy("class").agg(
        F.sum("actual").alias("support"), F.sum("claimed").alias("claimed"), F.sum("hits").alias("hits")
    )
    overall = confusion.agg(F.sum(F.when(hit, F.col("n")).otherwise(0)) / F.sum("n")).scalar()
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    precision, recall = ratio(F.col("hits"), F.col("claimed")), ratio(F.col("hits"), F.col("support"))
    return (
        per_class.withColumn("precision", precision)
        .withColumn("recall", recall)
        .withColumn(
            "f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
        )
        .select("class", "precision", "recall", "f1", "support", overall.alias("accuracy"))
    )


def train(rows: DataFrame | None = None, *, spark: SparkSession | None = None, key: str = "key", kind: str = "logistic_regression"):
    """Fit on four fifths of the rows and report on the rest: ``(model, report)``.

    Without rows the seed narrations and their variants are the corpus.
    """
    if rows is None:
        rows = augment(seed_corpus(spark)).withColumn(key, F.concat_ws("|", "category", "description", "variant"))
    rows = stage(stratified_split(rows, "category", key).select("category", "description", "is_test"), "corpus")
    model = fit(rows.where("NOT is_test"), kind=kind)
    report = stage(class_report(model.score(distinct_texts(rows.where("is_test")))), "report")
    facts = report.agg(F.max("accuracy").alias("accuracy"), F.sum("support").alias("n")).first()
    model.accuracy, model.test_samples = round(facts["accuracy"] or 0.0, 4), facts["n"] or 0
    return model, report
