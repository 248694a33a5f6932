"""Question classifiers: text to cluster."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF, IndexToString, NGram, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripleloom.functions.syntax import bind
from tripleloom.functions.text import tokenize_question
from tripleloom.session import cut_lineage

# Every task holds the weights of the tokens that are at least one in so many words; there are no more than that.
FREQUENT = 1000


@dataclass
class CountModel:
    """Add-one naive Bayes as two tables.

    ``tokens``: per token its (label, weight) entries, at most one per label, and its count ``n``.
    ``labels``: one row per label with its log prior and log denominator.
    """

    tokens: DataFrame
    labels: DataFrame


def row_and_words(text: Column) -> Column:
    return F.array_append(tokenize_question(text), F.lit(None).cast("string"))


def train_counts(train: DataFrame, text: str = "question", label: str = "label") -> CountModel:
    """Counts by (label, token), one pass over the data and written once; the rest reads only those.

    Tasks add up their words before the shuffle, so no text is ever sent. The null token counts the rows
    of a label, and it never takes part in a join.
    """
    return count_model(word_counts(train.select(F.col(label).alias("label"), text), "label", text))


def word_counts(train: DataFrame, by: str, text: str) -> DataFrame:
    """Rows by (``by``, token)."""
    words = train.select(by, F.explode(row_and_words(F.col(text))).alias("token"))
    return words.groupBy(by, "token").agg(F.count("*").alias("c"))


def count_model(found: DataFrame) -> CountModel:
    """The model from its counts (label, token, c)."""
    counts = cut_lineage(found, "counts")
    is_word = F.col("token").isNotNull()
    vocabulary = counts.where(is_word).select("token").distinct().agg(F.count("*")).scalar()
    everything = counts.where(~is_word).agg(F.sum("c")).scalar()
    sizes = counts.groupBy("label").agg(
        F.sum(F.when(is_word, F.col("c")).otherwise(0)).alias("total"),
        F.sum(F.when(~is_word, F.col("c"))).alias("rows"),
    )
    labels = sizes.select("*", vocabulary.alias("v"), everything.alias("n")).select(
        "label",
        F.log(F.col("rows") / F.col("n")).alias("prior"),
        F.log((F.col("total") + F.col("v")).cast("double")).alias("denominator"),
    )
    entry = F.struct("label", F.log(F.col("c") + 1.0).alias("weight"))
    tokens = counts.where(is_word).groupBy("token").agg(F.collect_list(entry).alias("entries"), F.sum("c").alias("n"))
    return CountModel(tokens, labels)


def predict_counts(model: CountModel, df: DataFrame, text: str = "question") -> DataFrame:
    """Scores of all labels for every different text: ``(text, scores)``, best first."""
    return _label_scores(model, df, text).withColumn("scores", F.array_sort("scores"))


def _label_scores(model: CountModel, df: DataFrame, text: str) -> DataFrame:
    """Scores of all labels for every different text, in no order.

    All labels share a base score that depends on the label and the number of known tokens. The weights of the
    frequent tokens are a small map that every task holds, so words that are in most texts never meet
    them in a join; the other tokens do, and one shuffle gathers what each text found. A text is sent once, to its own
    digest; its tokens and what they found travel under the digest alone. A text without a known token
    keeps the priors.
    """
    base = model.labels.agg(F.array_sort(F.collect_list(F.struct("label", "prior", "denominator")))).scalar()

    def by_label(entries: Column) -> Column:
        """Weights in the order of the labels, 0 for a label the token was not seen with."""
        known = F.map_from_entries(F.filter(entries, lambda e: e["label"].isNotNull()))
        return bind(known, lambda m: F.transform("_base", lambda b: F.coalesce(F.try_element_at(m, b["label"]), F.lit(0.0))))

    total = model.tokens.agg(F.sum("n")).scalar()
    top = model.tokens.select("*", total.alias("_total")).where(F.col("n") * FREQUENT >= F.col("_total"))
    frequent = top.select("token", "entries", base.alias("_base")).agg(
        F.map_from_entries(F.collect_list(F.struct("token", by_label(F.col("entries")).alias("weights"))))
    ).scalar()
    words = F.coalesce(tokenize_question(F.col("_t")), F.array().cast("array<string>"))
    digest = F.unhex(F.md5(F.coalesce(F.concat(F.lit("t"), F.col(text).cast("string")), F.lit(""))))
    texts = df.select(digest.alias("_id"), F.col(text).alias("_t")).groupBy("_id").agg(F.any_value("_t").alias("_t"))
    rare = texts.select("_id", "_t", frequent.alias("_frequent")).select(
        "_id", F.explode(F.filter(words, lambda w: ~F.map_contains_key("_frequent", w))).alias("token")
    )
    met = rare.join(model.tokens.hint("merge"), "token").select("_id", "entries")
    found_by = met.groupBy("_id").agg(F.collect_list("entries").alias("_rare"))
    nothing = F.array().cast(found_by.schema["_rare"].dataType)
    gathered = texts.join(found_by.hint("merge"), "_id", "left").withColumn("_rare", F.coalesce("_rare", nothing))
    often = F.filter(F.transform(words, lambda w: F.try_element_at("_frequent", w)), lambda v: v.isNotNull())

    def scores(found: Column) -> Column:
        zeros = F.transform("_base", lambda _: F.lit(0.0))
        total = F.aggregate(found, zeros, lambda acc, v: F.zip_with(acc, v, lambda a, x: a + x))
        score = lambda b, x: F.round(b["prior"] - F.size(found) * b["denominator"] + x, 9)
        return F.zip_with("_base", total, lambda b, x: F.struct((-score(b, x)).alias("cost"), b["label"].alias("label")))

    return gathered.select("_t", "_rare", base.alias("_base"), frequent.alias("_frequent")).select(
        F.col("_t").alias(text), bind(F.concat(often, F.transform("_rare", by_label)), scores).alias("scores")
    )


def question_classifier_nb(model: CountModel, df: DataFrame, text: str = "question") -> DataFrame:
    """Best label per text; the smallest label wins a tie."""
    best = F.array_min("scores")
    return _label_scores(model, df, text).select(
        text, best["label"].alias("pred"), (-best["cost"]).alias("score")
    )


def predict_top_k(model: CountModel, df: DataFrame, k: int = 5, text: str = "question") -> DataFrame:
    """The k best labels per text with normalised probabilities, one row each."""
    scored = predict_counts(model, df, text).withColumn("_top", F.get("scores", F.lit(0))["cost"])
    total = F.aggregate(
        "scores", F.lit(0.0), lambda acc, s: acc + F.exp(F.col("_top") - s["cost"])
    )
    kept = scored.withColumn("_total", total).select(
        text, "_top", "_total", F.posexplode(F.slice("scores", 1, k)).alias("_i", "s")
    )
    return kept.select(
        text,
        (F.col("_i") + 1).alias("rank"),
        F.col("s.label").alias("label"),
        (F.exp(F.col("_top") - F.col("s.cost")) / F.col("_total")).alias("proba"),
    )


def train_multilabel(train: DataFrame, text: str = "question", labels: str = "labels") -> CountModel:
    """Space-separated labels, one training row per label: rows are counted under their list, the counts then go to its labels."""
    lists = word_counts(train, labels, text)
    single = lists.select("token", "c", F.explode(F.split(labels, " ")).alias("label")).where("label <> ''")
    by_label = single.groupBy(F.col("label").cast("int").alias("label"), "token")
    return count_model(by_label.agg(F.sum("c").alias("c")))


def question_classifier(
    train: DataFrame, valid: DataFrame, text: str = "question", label: str = "label",
    features: int = 1 << 14, grid: tuple[float, ...] = (0.0, 0.01), max_iter: int = 30,
) -> PipelineModel:
    """Unigrams and bigrams into a multinomial regression, tuned on the validation split."""
    front = [
        NGram(n=2, inputCol="tokens", outputCol="bigrams"),
        HashingTF(numFeatures=features, inputCol="tokens", outputCol="tf1"),
        HashingTF(numFeatures=features, inputCol="bigrams", outputCol="tf2"),
        VectorAssembler(inputCols=["tf1", "tf2"], outputCol="features"),
    ]

    def counted(df: DataFrame, part: str) -> DataFrame:
        """Labels and counts of words, written once: all fits and passes read these instead of the texts."""
        labels = df.select(F.col(label).cast("string").alias("label"), tokenize_question(F.col(text)).alias("tokens"))
        return cut_lineage(PipelineModel(front).transform(labels).select("label", "features"), part)

    fit_on, tune_on = counted(train, "fit_on"), counted(valid, "tune_on")
    indexer = StringIndexer(inputCol="label", outputCol="index", handleInvalid="keep").fit(fit_on)
    names = IndexToString(inputCol="prediction", outputCol="pred", labels=[*indexer.labels, "-1"])

    def fit(reg: float) -> LogisticRegressionModel:
        return LogisticRegression(labelCol="index", regParam=reg, maxIter=max_iter).fit(indexer.transform(fit_on))

    def accuracy(model: LogisticRegressionModel) -> float:
        right = (F.col("pred") == F.col("label")).cast("double")
        return names.transform(model.transform(tune_on)).agg(F.coalesce(F.avg(right), F.lit(0.0))).first()[0]

    return PipelineModel([indexer, *front, max((fit(reg) for reg in grid), key=accuracy), names])


def classify(model: PipelineModel, df: DataFrame, text: str = "question") -> DataFrame:
    """Adds the predicted label and its probability."""
    # The fitted indexer wants a label column; any value does for new text.
    ready = df.withColumn("tokens", tokenize_question(F.col(text)))
    if "label" not in df.columns:
        ready = ready.withColumn("label", F.lit("-1"))
    out = model.transform(ready)
    return out.select(
        *df.columns, F.col("pred"), F.array_max(vector_to_array("probability")).alias("proba")
    )


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
