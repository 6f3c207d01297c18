"""URL filter: exact host and path rules first, then a logistic regression on hashed character n-grams.

The model learns from a small labelled URL table. Each n-gram of ``host`` and of ``path`` (told apart by a
mark) is hashed into one of ``buckets`` features; the fitted weights score every URL inside the JVM.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofloom.llm.tables import ASCII_UPPER

MOST_RULES = 10_000


class Rule(NamedTuple):
    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


def rules_from(lines: dict[str, str]) -> list[Rule]:
    """From ``host/path`` to its verdict."""
    return [Rule(text[: text.index("/")], text[text.index("/") :], verdict) for text, verdict in lines.items()]


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(rest, F.lit("")), ASCII_UPPER, ASCII_UPPER.lower())


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*(/?[^?#]*)", 1), F.lit(""))


def ruled(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The longest rule (text, verdict) that fits the host or a domain above it, or null.

    The rules are few and part of the plan; a rule fits where the path starts with the rule's."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    out = F.lit(None).cast("struct<text:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: (len(r.text), r.text)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        out = F.when(fits, F.struct(F.lit(rule.text).alias("text"), F.lit(rule.verdict).alias("verdict"))).otherwise(out)
    return out


def grams(host: Column, path: Column, sizes: tuple[int, ...] = (3, 4)) -> Column:
    """Character n-grams of both parts, each part between marks."""

    def of(mark: str, part: Column, n: int) -> Column:
        padded = F.concat(F.lit("^"), part, F.lit("$"))
        starts = F.sequence(F.lit(1), F.greatest(F.length(padded) - (n - 1), F.lit(1)))
        return F.transform(starts, lambda k: F.concat(F.lit(mark), F.substring(padded, k, F.lit(n))))

    return F.concat(*[of(mark, part, n) for mark, part in (("h", host), ("p", path)) for n in sizes])


class UrlModel:
    """Hashed character n-grams and a fitted logistic regression."""

    def __init__(self, buckets: int = 1 << 14, sizes: tuple[int, ...] = (3, 4), rounds: int = 20):
        self.buckets, self.sizes, self.rounds = buckets, sizes, rounds
        self.hashing = HashingTF(numFeatures=buckets, inputCol="__grams", outputCol="__hashed")
        self.model: LogisticRegressionModel | None = None
        self.constant = 0.5

    def _hashed(self, df: DataFrame, host: str, path: str) -> DataFrame:
        return self.hashing.transform(df.withColumn("__grams", grams(F.col(host), F.col(path), self.sizes)))

    def fit(self, labelled: DataFrame, most: int = 20_000, host: str = "host", path: str = "path", label: str = "label") -> UrlModel:
        """Learns from at most ``most`` distinct labelled URLs, those of the smallest hash, each with its number of rows
        as weight; rows without a label take no part.

        With no row, or one label only, the score is constant: 0.5, or that label."""
        known = labelled.select(F.col(host), F.col(path), F.col(label).cast("double").alias("__label")).where(F.col("__label").isNotNull())
        counted = known.groupBy(host, path, "__label").agg(F.count(F.lit(1)).cast("double").alias("__weight"))
        few = counted.orderBy(F.xxhash64(host, path), host, path, "__label").limit(most)
        rows = self._hashed(few, host, path).select("__hashed", "__label", "__weight").cache()
        ones, total = rows.agg(F.sum(F.col("__label") * F.col("__weight")), F.sum("__weight")).first()
        if total and 0 < ones < total:
            self.model = LogisticRegression(featuresCol="__hashed", labelCol="__label", weightCol="__weight", maxIter=self.rounds, regParam=1e-3).fit(rows)
        elif total:
            self.constant = ones / total
        rows.unpersist()
        return self

    def score(self, df: DataFrame, host: str = "host", path: str = "path", out: str = "score") -> DataFrame:
        """``df`` with the probability of label 1."""
        if self.model is None:
            return df.withColumn(out, F.lit(float(self.constant)))
        self.model.setPredictionCol("").setRawPredictionCol("").setProbabilityCol("__probability")
        found = self.model.transform(self._hashed(df, host, path))
        return found.withColumn(out, vector_to_array("__probability")[1]).drop("__grams", "__hashed", "__probability")


def judged(urls: DataFrame, rules: list[Rule], model: UrlModel | None = None, labelled: DataFrame | None = None, url: str = "url", threshold: float = 0.5) -> DataFrame:
    """``urls`` with host, path, rule, verdict and score (the chance of being blocked).

    Null URLs and those without ``://`` have an empty host and path and are judged by the model like any
    other; columns of these names are replaced. ``labelled`` (host, path, label 1 for block) trains a new
    model; without a model or labels the URLs that a rule decides are the labelled table."""
    found = urls.withColumn("host", host_of(F.col(url))).withColumn("path", path_of(F.col(url)))
    found = found.withColumn("__rule", ruled(F.col("host"), F.col("path"), rules))
    if model is None:
        known = found.where("__rule IS NOT NULL").select("host", "path", (F.col("__rule.verdict") == "block").cast("int").alias("label"))
        model = UrlModel().fit(labelled if labelled is not None else known)
    scored = model.score(found)
    by_model = F.when(F.col("score") >= threshold, "block").otherwise("allow")
    return scored.withColumn("rule", F.col("__rule.text")).withColumn("verdict", F.coalesce("__rule.verdict", by_model)).drop("__rule")
