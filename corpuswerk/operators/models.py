"""Topic and embedding models over tokens, with Spark's own estimators.

Defined cases: documents without tokens have an empty vector; a word out of the vocabulary has no
vector and is left out of a query, and so is a vector of zeros; ties of similarity go to the smaller word. Fits see all
documents; only the reports are top lists.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.clustering import LDA, LDAModel
from pyspark.ml.feature import PCA, CountVectorizer, RegexTokenizer, StopWordsRemover, Word2Vec, Word2VecModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuswerk.functions.text import GERMAN


def vectorizer(stop: list[str] | None = None, min_df: float = 100, shortest: int = 3) -> Pipeline:
    """text to tokens, filtered and count vectors (features)."""
    words = StopWordsRemover.loadDefaultStopWords("german") + list(stop or [])
    return Pipeline(
        stages=[
            RegexTokenizer(pattern=f"[^{GERMAN}_-]+", minTokenLength=shortest, inputCol="text", outputCol="tokens"),
            StopWordsRemover(stopWords=words, inputCol="tokens", outputCol="filtered"),
            CountVectorizer(inputCol="filtered", outputCol="features", minDF=min_df),
        ]
    )


def count_vectors(docs: DataFrame, **options: object) -> tuple[DataFrame, PipelineModel]:
    """(id, features) of (id, text), and the fitted pipeline."""
    own = docs.select("id", F.coalesce("text", F.lit("")).alias("text"))
    model = vectorizer(**options).fit(own)
    return model.transform(own).select("id", "features"), model


def topics(vectors: DataFrame, k: int = 10, optimizer: str = "em", max_iter: int = 20, seed: int = 1) -> LDAModel:
    return LDA(k=k, optimizer=optimizer, seed=seed, maxIter=max_iter, featuresCol="features").fit(vectors)


def topic_terms(model: LDAModel, vocabulary: list[str], n: int = 20) -> DataFrame:
    """(topic, place, term, weight) of the n heaviest terms of each topic."""
    spark = model.describeTopics(1).sparkSession
    words = spark.createDataFrame(list(enumerate(vocabulary)), "term_ix int, term string")
    each = model.describeTopics(n).select("topic", F.posexplode(F.arrays_zip("termIndices", "termWeights")).alias("place", "t"))
    return each.select("topic", "place", F.col("t.termIndices").alias("term_ix"), F.col("t.termWeights").alias("weight")).join(words, "term_ix").select("topic", "place", "term", "weight")


def word_vectors(sentences: DataFrame, size: int = 100, min_count: int = 20, window: int = 10, step: float = 0.05, iterations: int = 1, seed: int = 1, parts: int = 1) -> Word2VecModel:
    """sentences: (words array<string>)."""
    return Word2Vec(vectorSize=size, minCount=min_count, windowSize=window, stepSize=step, maxIter=iterations, seed=seed, numPartitions=parts, inputCol="words", outputCol="vector").fit(sentences)


def updated_word_vectors(before: DataFrame, batch: DataFrame, **options: object) -> tuple[Word2VecModel, DataFrame]:
    """A model of all sentences so far, and these: Spark's estimator starts anew, so nothing of the earlier ones is lost."""
    whole = before.select("words").unionByName(batch.select("words"))
    return word_vectors(whole, **options), whole


def vector_table(model: Word2VecModel) -> DataFrame:
    return model.getVectors().select("word", vector_to_array("vector").alias("vector"))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def most_similar(vectors: DataFrame, query: DataFrame, n: int = 50, leave_out: list | None = None, key: str = "word") -> DataFrame:
    """(key, similarity): the n rows of greatest cosine to the one row (vector) of query.

    The query's one vector is broadcast; the vectors are scanned once, without a shuffle but for the n best.
    """
    one = F.broadcast(query.select(F.col("vector").alias("q")).limit(1))
    out = vectors.filter(~F.col(key).isin(leave_out)) if leave_out else vectors
    out = out.join(one)  # one row
    cosine = F.try_divide(_dot(F.col("vector"), F.col("q")), F.sqrt(_dot(F.col("vector"), F.col("vector"))) * F.sqrt(_dot(F.col("q"), F.col("q"))))
    return out.select(key, F.round(cosine, 6).alias("similarity")).filter("similarity is not null").orderBy(F.desc("similarity"), key).limit(n)


def combined(vectors: DataFrame, plus: list, minus: list, key: str = "word") -> DataFrame:
    """One row (vector): the sum of some vectors less others."""
    sign = F.when(F.col(key).isin(plus), 1.0).otherwise(-1.0)
    each = vectors.filter(F.col(key).isin(plus + minus)).select(F.posexplode("vector").alias("at", "x"), sign.alias("sign"))
    parts = each.groupBy("at").agg(F.sum(F.col("x").cast("double") * F.col("sign")).alias("x"))
    return parts.agg(F.sort_array(F.collect_list(F.struct("at", "x")))["x"].alias("vector"))


def analogies(vectors: DataFrame, words: list, n: int = 50, drop_first: bool = True, key: str = "word") -> DataFrame:
    """Words nearest to second + third - first of words; these are left out, and of what remains the first if drop_first."""
    first, second, third = words
    found = most_similar(vectors, combined(vectors, [second, third], [first], key), n + (1 if drop_first else 0), words, key)
    if not drop_first:
        return found
    best = found.agg(F.min(F.struct((-F.col("similarity")).alias("s"), key)).alias("b")).select(F.col(f"b.{key}").alias(key))
    return found.join(F.broadcast(best), key, "left_anti")


def reduced(vectors: DataFrame, k: int = 10) -> DataFrame:
    """(word, reduced) by principal components."""
    own = vectors.select("*", array_to_vector(F.col("vector").cast("array<double>")).alias("v"))
    return PCA(k=k, inputCol="v", outputCol="r").fit(own).transform(own).withColumn("reduced", vector_to_array("r")).drop("v", "r")


def gram_vectors(words: DataFrame, size: int = 64, shortest: int = 3, longest: int = 5, word: str = "word") -> DataFrame:
    """(word, vector): signed hashing of the character grams of a padded word, of length 1; a vector for any word, without a fit."""
    padded = F.concat(F.lit("<"), F.lower(word), F.lit(">"))
    starts = F.sequence(F.lit(1), F.length(padded))
    grams = F.flatten(F.array(*[F.transform(F.filter(starts, lambda i, n=n: i + n - 1 <= F.length(padded)), lambda i, n=n: F.substring(padded, i, F.lit(n))) for n in range(shortest, longest + 1)]))
    each = words.select(word).distinct().select(word, F.explode(grams).alias("g"))
    h = F.xxhash64("g")
    sums = each.groupBy(word, F.pmod(h, F.lit(size)).cast("int").alias("at")).agg(F.sum(F.when(F.pmod(F.shiftright(h, 32), F.lit(2)) == 0, 1.0).otherwise(-1.0)).alias("x"))
    vectors = sums.groupBy(word).agg(F.map_from_entries(F.collect_list(F.struct("at", "x"))).alias("m"), F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.try_divide(F.try_element_at("m", i), F.col("norm")), F.lit(0.0)))
    return vectors.select(word, dense.alias("vector"))
