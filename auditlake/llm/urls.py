"""URL filter: rules first, boosted trees on lexical features for the rest."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.lineage import cut

from .common import rows


@dataclass(frozen=True)
class Rule:
    """``verdict`` for URLs of ``host`` and its subdomains whose path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


# fixed values
RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)
#: The trees are fitted on that many distinct labelled URLs at most, of each kind the first by digest.
SAMPLE = 8000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = ["url_length", "host_length", "path_length", "depth", "labels", "digit_ratio", "dash_count", "entropy", "parameters", "has_fragment", "secure", "tld_rate", "domain_rate"]


def host(url: Column) -> Column:
    after = F.regexp_extract(F.coalesce(url, F.lit("")), r"\A(?s:.*?)://([^/?#]*)", 1)
    return F.translate(after, UPPER, LOWER)


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"\A(?s:.*?)://[^/?#]*([^?#]*)", 1)


def longest_rule(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """The longest rule that fits, as ``text, verdict``; null where none does.

    Rules are a closed list of a configuration and part of the expression.
    """
    fits = [
        F.when(((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path), F.struct(F.lit(r.text).alias("text"), F.lit(r.verdict).alias("verdict")))
        for r in sorted(rules, key=lambda r: (-len(r.text), r.text))
    ]
    return F.coalesce(*fits)


def entropy(text: Column) -> Column:
    """Bits per character of a text by its own character frequencies."""
    n = F.length(text)
    each = F.array_distinct(F.split(text, ""))
    share = F.transform(each, lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n)
    return F.when(n > 0, F.aggregate(F.filter(share, lambda p: p > 0), F.lit(0.0), lambda total, p: total - p * F.log2(p))).otherwise(0.0)


def lexical(d: DataFrame) -> DataFrame:
    """``d`` with the features that need nothing but ``url``, ``host`` and ``path``."""
    url = F.coalesce("url", F.lit(""))
    count = lambda text, pattern: F.regexp_count(text, F.lit(pattern)).cast("double")
    return d.withColumns({
        "url_length": F.length(url).cast("double"),
        "host_length": F.length("host").cast("double"),
        "path_length": F.length("path").cast("double"),
        "depth": count(F.col("path"), "/[^/]"),
        "labels": count(F.col("host"), r"\."),
        "digit_ratio": count(url, "[0-9]") / F.greatest(F.length(url), F.lit(1)),
        "dash_count": count(F.col("host"), "-"),
        "entropy": entropy(url),
        "parameters": count(url, "[?&][^=&#]*="),
        "has_fragment": F.contains(url, F.lit("#")).cast("double"),
        "secure": url.startswith("https").cast("double"),
        "tld": F.substring_index("host", ".", -1),
        "domain": F.substring_index("host", ".", -2),
    })


def _rates(labelled: DataFrame, suffix: str) -> DataFrame:
    """Smoothed share of blocked URLs per host suffix, over all labelled rows."""
    return labelled.groupBy(suffix).agg(((F.sum("label") + 1) / (F.count(F.lit(1)) + 2)).alias(f"{suffix}_rate"))


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, sample: int = SAMPLE, rounds: int = 12, depth: int = 3) -> DataFrame:
    """Every row of ``pages`` with the verdict on its URL.

    Returns ``row`` (the whole input row), ``page_id, host, path, rule,
    verdict``. A URL that a rule fits has the verdict of the longest one. These
    URLs are also the labels: gradient-boosted trees are fitted on at most
    ``sample`` distinct ones, by length, depth, digit ratio, entropy, parameter
    counts and statistics of host suffixes over all labelled rows, and judge all
    others. A kind has half of the sample, or what the other leaves, and weighs
    as much as its distinct URLs are. Without labels of both kinds the one kind
    there is decides, and without any, all are allowed.

    A null URL or one without ``://`` has an empty host and path, fits no rule
    and is judged like the rest. Repeated rows have equal results.
    """
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    d = rows(pages, page_id="page_id", url=F.col("url").cast("string"))
    d = d.withColumns({"host": host(F.col("url")), "path": path(F.col("url"))})
    d = d.withColumn("fits", longest_rule(F.col("host"), F.col("path"), rules))

    labelled = d.filter("fits IS NOT NULL").select("url", "host", "path", (F.col("fits.verdict") == "block").cast("double").alias("label"))
    # a URL has one label: rules see nothing else
    distinct = labelled.distinct()
    # two rows at most
    counts = {r["label"]: r["count"] for r in distinct.groupBy("label").count().collect()}
    if len(counts) < 2:
        method = F.lit("block" if 1.0 in counts else "allow")
        judged = d
    else:
        share = {kind: min(n, max(sample // 2, sample - counts[1.0 - kind])) for kind, n in counts.items()}
        taken = [
            distinct.filter(F.col("label") == kind).orderBy(F.md5("url"), "url").limit(n).withColumn("weight", F.lit(counts[kind] / n))
            for kind, n in sorted(share.items())
        ]
        # the sample is small by its bound, and one partition keeps the fit the same in every run
        train = cut(lexical(taken[0].unionByName(taken[1])).coalesce(1))
        suffixed = lexical(labelled)
        tld, domain = cut(_rates(suffixed, "tld")), cut(_rates(suffixed, "domain"))

        def features(frame: DataFrame) -> DataFrame:
            # as many rows as there are labelled suffixes: Spark's size check decides how to join
            frame = frame.join(tld, "tld", "left").join(domain, "domain", "left")
            frame = frame.fillna(0.5, ["tld_rate", "domain_rate"])
            return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(frame)

        trees = GBTClassifier(labelCol="label", weightCol="weight", maxIter=rounds, maxDepth=depth, seed=7, maxMemoryInMB=64)
        fitted = features(train).select("url", "features", "label", "weight").coalesce(1).sortWithinPartitions("url")
        model = trees.fit(fitted)
        judged = model.transform(features(lexical(d)))
        method = F.when(F.col("prediction") == 1, "block").otherwise("allow")
    return judged.select("row", "page_id", "host", "path", F.col("fits.text").alias("rule"), F.coalesce(F.col("fits.verdict"), method).alias("verdict"))
