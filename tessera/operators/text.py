"""Free text to TF-IDF features (F9–F14), scikit-learn's weighting re-expressed.

Tokenise (lower case, accents stripped, runs of >= 2 word characters), remove
stop words, add bigrams of the kept tokens, keep the ``max_features`` terms with
the highest total count on the training rows (ties by term), weight
``(1 + ln tf) · (ln((1 + n) / (1 + df)) + 1)`` and L2-normalise per row.

Fit shuffles only ``term`` partial counts (combined map-side, so a term present
in a third of all rows is one partial count per task); applying the model is a
per-row projection with no shuffle.  The vocabulary is at most
``max_features`` rows, held as literal arrays.
"""

from __future__ import annotations

from pyspark.ml.feature import CountVectorizerModel, NGram, Normalizer, StopWordsRemover
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as TX

# 300 terms, unigrams + bigrams, sublinear tf, smooth idf, L2 norm.
MAX_FEATURES = 300
NGRAM_MAX = 2


# Spark's built-in English stop-word list (public Spark data, 181 words),
# the default list (decision S8; the list is a parameter).
SPARK_ENGLISH_STOP_WORDS = (
    'i', 'me', 'my', 'myself', 'we', 'our', 'ours', 'ourselves', 'you', 'your', 'yours',
    'yourself', 'yourselves', 'he', 'him', 'his', 'himself', 'she', 'her', 'hers', 'herself',
    'it', 'its', 'itself', 'they', 'them', 'their', 'theirs', 'themselves', 'what', 'which',
    'who', 'whom', 'this', 'that', 'these', 'those', 'am', 'is', 'are', 'was', 'were', 'be',
    'been', 'being', 'have', 'has', 'had', 'having', 'do', 'does', 'did', 'doing', 'a', 'an',
    'the', 'and', 'but', 'if', 'or', 'because', 'as', 'until', 'while', 'of', 'at', 'by',
    'for', 'with', 'about', 'against', 'between', 'into', 'through', 'during', 'before',
    'after', 'above', 'below', 'to', 'from', 'up', 'down', 'in', 'out', 'on', 'off', 'over',
    'under', 'again', 'further', 'then', 'once', 'here', 'there', 'when', 'where', 'why',
    'how', 'all', 'any', 'both', 'each', 'few', 'more', 'most', 'other', 'some', 'such', 'no',
    'nor', 'not', 'only', 'own', 'same', 'so', 'than', 'too', 'very', 's', 't', 'can', 'will',
    'just', 'don', 'should', 'now', "i'll", "you'll", "he'll", "she'll", "we'll", "they'll",
    "i'd", "you'd", "he'd", "she'd", "we'd", "they'd", "i'm", "you're", "he's", "she's",
    "it's", "we're", "they're", "i've", "we've", "you've", "they've", "isn't", "aren't",
    "wasn't", "weren't", "haven't", "hasn't", "hadn't", "don't", "doesn't", "didn't", "won't",
    "wouldn't", "shan't", "shouldn't", "mustn't", "can't", "couldn't", 'cannot', 'could',
    "here's", "how's", "let's", 'ought', "that's", "there's", "what's", "when's", "where's",
    "who's", "why's", 'would',
)


def default_stop_words() -> list[str]:
    """Spark's English stop-word list (decision S8: the list is a parameter)."""
    return list(SPARK_ENGLISH_STOP_WORDS)


def words(c) -> Column:
    """Lower-cased, accent-stripped runs of >= 2 word characters (NULL text → empty)."""
    txt = F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))
    return F.regexp_extract_all(TX.strip_accents(F.lower(txt)), F.lit(TX.WORD_RUN_2), 0)


def tokenize(df: DataFrame, c: str, out_col: str = "terms", stop_words: list[str] | None = None,
             ngram_max: int = NGRAM_MAX) -> DataFrame:
    """Add ``out_col``: unigrams (+ bigrams of the kept tokens).  Stop words are removed
    by ``StopWordsRemover`` (a JVM hash set) and bigrams built by ``NGram``."""
    out = df.withColumn("__w", words(c))
    if stop_words:
        out = StopWordsRemover(inputCol="__w", outputCol="__k", stopWords=list(stop_words),
                               caseSensitive=True).transform(out).drop("__w") \
            .withColumnRenamed("__k", "__w")
    if ngram_max >= 2:
        out = NGram(n=2, inputCol="__w", outputCol="__b").transform(out)
        out = out.withColumn(out_col, F.concat("__w", "__b")).drop("__w", "__b")
    else:
        out = out.withColumnRenamed("__w", out_col)
    return out


def term_counts(df: DataFrame, row_id: str, c: str, stop_words=None) -> DataFrame:
    """``(row_id, term, tf)``.

    ``explode_outer`` + a NULL filter instead of ``explode``: for ``explode`` the
    optimizer infers ``size(tokens) > 0`` and pushes it under the repartition
    into the scan, which would tokenise every text twice, once single-threaded.
    """
    tok = tokenize(df.select(row_id, c), c, "__terms", stop_words)
    return (tok.select(row_id, F.explode_outer("__terms").alias("term"))
            .where(F.col("term").isNotNull())
            .groupBy(row_id, "term").agg(F.count(F.lit(1)).alias("tf")))


class TfidfModel:
    """Fitted vocabulary ``(term, idx, df, idf)`` — at most ``max_features`` rows.

    ``transform`` and ``weights`` are per-row projections (no shuffle, no join):
    ``CountVectorizerModel.from_vocabulary`` counts the vocabulary terms of each
    row in the JVM, then sublinear tf × idf and the L2 norm are array expressions.
    """

    def __init__(self, vocab: DataFrame, column: str, stop_words: list[str] | None):
        self.vocab = vocab
        self.column = column
        self.stop_words = stop_words
        rows = vocab.orderBy("idx").collect()                 # bounded: <= max_features rows
        self.terms = [r["term"] for r in rows]
        self.idf = [float(r["idf"]) for r in rows]

    def size(self) -> int:
        return len(self.terms)

    def vector(self, df: DataFrame, out_col: str = "text_features") -> DataFrame:
        """Dense ``array<double>`` of vocabulary width per row (all-zero for no terms)."""
        k = self.size()
        if k == 0:
            return df.withColumn(out_col, F.array().cast("array<double>"))
        tok = tokenize(df, self.column, "__terms", self.stop_words)
        cv = CountVectorizerModel.from_vocabulary(self.terms, inputCol="__terms", outputCol="__tf")
        out = cv.transform(tok).drop("__terms")
        idf = F.array(*[F.lit(v) for v in self.idf])
        # lambdas reference only their own variables: a computed column captured in a
        # lambda would be inlined by CollapseProject and re-evaluated per element
        w = F.zip_with(vector_to_array(F.col("__tf")), idf,
                       lambda t, i: F.when(t > 0, (F.lit(1.0) + F.log(t)) * i).otherwise(F.lit(0.0)))
        out = out.withColumn("__wv", array_to_vector(w)).drop("__tf")
        out = Normalizer(inputCol="__wv", outputCol="__nv", p=2.0).transform(out).drop("__wv")
        return out.withColumn(out_col, vector_to_array(F.col("__nv"))).drop("__nv")

    def transform(self, df: DataFrame, row_id: str | None = None, out_col: str = "text_features") -> DataFrame:
        return self.vector(df, out_col)

    def weights(self, df: DataFrame, row_id: str) -> DataFrame:
        """Long output ``(row_id, term, idx, weight)`` of the non-zero weights.

        ``posexplode_outer`` (its NULL rows fail ``weight > 0``): for ``posexplode`` the
        optimizer infers ``size(__v) > 0`` and pushes it under the repartition into the
        scan, which would compute every row's weights twice, once single-threaded."""
        terms = F.array(*[F.lit(t) for t in self.terms])
        v = self.vector(df.select(row_id, self.column), "__v")
        return (v.select(row_id, F.posexplode_outer("__v").alias("idx", "weight"))
                .where(F.col("weight") > 0)
                .select(row_id, F.element_at(terms, F.col("idx") + 1).alias("term"),
                        F.col("idx").cast("int").alias("idx"), "weight"))


def term_stats(df: DataFrame, c: str, stop_words=None) -> DataFrame:
    """``(term, total, df)`` over the rows: one explode per row emits every token
    (total) and every distinct token (document frequency); ``groupBy(term)``
    combines map-side, so only partial counts of distinct terms are shuffled.
    ``explode_outer`` + NULL filter: with ``explode`` the optimizer would infer
    ``size(tokens) > 0`` and push it under a repartition into the scan."""
    tok = tokenize(df.select(c), c, "__terms", stop_words)
    each = tok.select(F.size("__terms").alias("n"), F.posexplode_outer(
        F.concat("__terms", F.array_distinct("__terms"))).alias("i", "term"))      # all, then the distinct ones
    return (each.where(F.col("term").isNotNull()).groupBy("term")
            .agg(F.count_if(F.col("i") < F.col("n")).alias("total"), F.count_if(F.col("i") >= F.col("n")).alias("df")))


def fit_tfidf(train: DataFrame, row_id: str | None, c: str, max_features: int = MAX_FEATURES,
              stop_words: list[str] | None = None) -> TfidfModel:
    """vocabulary (top ``max_features`` by total count, ties by term) and idf
    ``ln((1 + n) / (1 + df)) + 1`` from the training rows."""
    if stop_words is None:
        stop_words = default_stop_words()
    n_docs = train.agg(F.count(F.lit(1)).alias("n")).scalar()
    top = term_stats(train, c, stop_words).orderBy(F.desc("total"), F.asc("term")).limit(max_features)
    vocab = (top.select("term", "df",
                        (F.log((F.lit(1.0) + n_docs) / (F.lit(1.0) + F.col("df"))) + F.lit(1.0))
                        .alias("idf"))
             .withColumn("idx", F.row_number().over(Window.orderBy("term")) - 1)   # <= 300 rows
             .select("term", F.col("idx").cast("int").alias("idx"), "df", "idf"))
    rows = vocab.collect()   # bounded: at most max_features rows
    fixed = train.sparkSession.createDataFrame(
        [(r["term"], r["idx"], r["df"], r["idf"]) for r in rows],
        "term string, idx int, df long, idf double")
    return TfidfModel(fixed, c, stop_words)


def fit_weights(df: DataFrame, row_id: str, c: str, max_features: int = MAX_FEATURES,
                stop_words: list[str] | None = None) -> tuple[TfidfModel, DataFrame]:
    """Fit on ``df`` and weight the same rows."""
    model = fit_tfidf(df, row_id, c, max_features, stop_words)
    return model, model.weights(df, row_id)
