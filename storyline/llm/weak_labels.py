"""Quality classifier from weak labels: overlapping heuristic labellers, their accuracies by expectation-maximisation, a hashed linear scorer.

Each labeller votes good, bad, or not at all, from simple measures of a text. How often each combination of votes occurs, over all documents, is
all that the label model needs: at most 3 ** 7 counts, however many documents there are. Expectation-maximisation finds each labeller's vote
probabilities for good and for bad documents, and so the posterior of each combination. The scorer is a logistic regression over hashed
words and the same measures; it is fitted on a bounded sample with the posteriors as weights, and scores every document.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF, Normalizer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, words

#: Frequent words of the corpus's languages.
STOP_WORDS = (
    "the of and to in a is that for it on as with by at from this be are or an was not "
    "der die das und in zu den von ist mit auf für ein eine im dem nicht sich des "
    "le la les de des et en un une que dans pour est sur pas qui au du "
    "el los las de que y en un una por con para del se es no su al"
).split()
#: Documents that the scorer is fitted on, about; buckets of hashed words; documents of a lower score are rejected.
SAMPLE, BUCKETS, THRESHOLD = 20_000, 1 << 15, 0.3
GOOD, BAD, NONE = 2, 1, 0


def measures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, words, and the measures that labellers look at) of each row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    held = docs.select(F.col(id_col).alias("id"), words(F.lower(F.col(text_col))).alias("w"), lines.alias("l"), text.alias("t"))
    n, n_chars = F.greatest(F.lit(1), F.size("w")), F.greatest(F.lit(1), F.length("t"))
    stop = list(dict.fromkeys(STOP_WORDS))
    one = lambda x: x.cast("double")
    return held.select(
        "id",
        F.col("w").alias("words"),
        one(F.size("w")).alias("n_words"),
        (one(F.length(F.array_join("w", ""))) / n).alias("word_chars"),
        (one(F.size(F.regexp_extract_all("t", F.lit("[#*$%&|<>{}]"), F.lit(0)))) / n).alias("symbols"),
        (one(F.size(F.filter("w", lambda x: x.isin(stop)))) / n).alias("stops"),
        (one(F.size("l") - F.size(F.array_distinct("l"))) / F.greatest(F.lit(1), F.size("l"))).alias("dup_lines"),
        (one(F.length(F.regexp_replace("t", r"\P{L}+", ""))) / n_chars).alias("letters"),
        (one(F.size(F.filter("l", lambda x: x.rlike(r'[.!?…:;"»)]\s*$')))) / F.greatest(F.lit(1), F.size("l"))).alias("ends"),
        (one(F.size(F.array_distinct("w"))) / n).alias("distinct"),
    )


MEASURES = ["n_words", "word_chars", "symbols", "stops", "dup_lines", "letters", "ends", "distinct"]


def labellers() -> list[Column]:
    """Votes. Limits are plain rules of thumb; the label model finds how far each can be trusted."""
    vote = lambda bad, good: F.when(bad, BAD).when(good, GOOD).otherwise(NONE)
    c = F.col
    return [
        vote(c("n_words") < 8, c("n_words") > 40),
        vote(c("symbols") > 0.1, c("symbols") < 0.02),
        vote((c("word_chars") < 2.5) | (c("word_chars") > 14), c("word_chars").between(3.5, 9)),
        vote(c("stops") < 0.02, c("stops") > 0.08),
        vote(c("dup_lines") > 0.3, c("dup_lines") == 0),
        vote(c("letters") < 0.65, c("letters") > 0.75),
        vote(c("distinct") < 0.25, c("distinct") > 0.45),
    ]


def coded(measured: DataFrame) -> DataFrame:
    """With ``votes``: the labellers' votes as one number."""
    code = F.lit(0)
    for v in labellers():
        code = code * 3 + v
    return measured.withColumn("votes", code)


def label_model(counts: dict[int, int], labellers: int, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, float]:
    """(posterior of each combination of votes, vote probabilities [labeller, class, vote], share of good documents).

    Starts from votes counted as they are, so that class 1 stays what labellers call good. Counts are smoothed by one.
    """
    code = np.arange(3**labellers)
    votes = np.stack([code // 3 ** (labellers - 1 - k) % 3 for k in range(labellers)], 1)
    n = np.zeros(len(code))
    for k, v in counts.items():
        n[k] = v
    more = (votes == GOOD).sum(1) - (votes == BAD).sum(1)
    post = 1 / (1 + np.exp(-more.astype(float)))
    prob, share = np.full((labellers, 2, 3), 1 / 3), 0.5
    for _ in range(rounds):
        share = (n @ post + 1) / (n.sum() + 2)
        for y, w in ((0, n * (1 - post)), (1, n * post)):
            prob[:, y] = np.stack([np.bincount(votes[:, k], w, 3) + 1 for k in range(labellers)])
        prob /= prob.sum(2, keepdims=True)
        logs = np.log(prob)
        score = np.log(share / (1 - share)) + sum(logs[k, 1, votes[:, k]] - logs[k, 0, votes[:, k]] for k in range(labellers))
        before, post = post, 1 / (1 + np.exp(-np.clip(score, -30, 30)))
        if np.abs(post - before).max() < 1e-9:
            break
    return post, prob, float(share)


def _features(measured: DataFrame, buckets: int) -> DataFrame:
    """Hashed words at unit length, and the measures brought to about the same range."""
    hashed = HashingTF(inputCol="words", outputCol="_tf", numFeatures=buckets).transform(measured)
    scale = {"n_words": F.log1p("n_words") / 8, "word_chars": F.least(F.lit(3.0), F.col("word_chars") / 8)}
    hashed = hashed.withColumn("_dense", array_to_vector(F.array(*[scale.get(m, F.least(F.lit(3.0), F.col(m))) for m in MEASURES])))
    hashed = Normalizer(inputCol="_tf", outputCol="_unit").transform(hashed)
    return VectorAssembler(inputCols=["_unit", "_dense"], outputCol="features").transform(hashed).drop("_tf", "_unit", "_dense", "words")


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, buckets: int = BUCKETS) -> tuple[np.ndarray, LogisticRegressionModel | None]:
    """Posteriors by combination of votes, and the scorer; None if there are no documents.

    The sample has the distinct documents whose hash of id and text falls below ``sample`` in as many rows as there are: about ``sample`` at most,
    of any number, and however many rows repeat a document or have no id.
    """
    measured = coded(measures(docs, id_col, text_col))
    counts = {r.votes: r["count"] for r in measured.groupBy("votes").count().collect()}  # 3 ** 7 rows at most
    post, _, _ = label_model(counts, len(labellers()))
    n = sum(counts.values())
    if not n:
        return post, None
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("h"))
    part = own.where(F.pmod("h", F.lit(n)) < sample).dropDuplicates(["h"])
    posterior = F.get(F.array(*[F.lit(float(x)) for x in post]), F.col("votes"))
    held = _features(coded(measures(part, "id", "text")), buckets).select("features", posterior.alias("p"))
    both = held.select("features", F.explode(F.array(F.struct(F.lit(1.0).alias("label"), F.col("p").alias("weight")), F.struct(F.lit(0.0).alias("label"), (1 - F.col("p")).alias("weight")))).alias("x"))
    train = checkpointed(both.select("features", "x.label", "x.weight")).coalesce(8)
    if train.isEmpty():
        return post, None
    return post, LogisticRegression(weightCol="weight", regParam=1e-3, maxIter=40).fit(train)


def scored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, sample: int = SAMPLE, buckets: int = BUCKETS) -> DataFrame:
    """(id, votes, posterior, score, kept) of each row; kept if the scorer gives ``threshold`` or more.

    A null text is an empty one. Equal texts of one id get the same score; repeated rows come out as often as they came in, null ids as well. Long
    texts are measured whole. Other columns, whatever their names, are left out. No rows: no rows.
    """
    post, model = fit(docs, id_col, text_col, sample, buckets)
    measured = coded(measures(docs, id_col, text_col))
    posterior = F.get(F.array(*[F.lit(float(x)) for x in post]), F.col("votes"))
    if model is None:
        return measured.select(F.col("id").alias(id_col), "votes", posterior.alias("posterior"), posterior.alias("score"), (posterior >= threshold).alias("kept"))
    out = model.transform(_features(measured, buckets)).withColumn("score", F.get(vector_to_array("probability"), F.lit(1)))
    return out.select(F.col("id").alias(id_col), "votes", posterior.alias("posterior"), "score", (F.col("score") >= threshold).alias("kept"))
