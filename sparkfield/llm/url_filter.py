"""URL filtering: host rules, then gradient-boosted trees on lexical features.

Everything on the data's path is a column expression. Trees are symmetric (one test per
level), so a tree is a three-bit index into an array of leaf values; they are fitted on the
driver over a labelled URL set of fixed size and compiled into one expression.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import ascii_lower

#: The default rules: (verdict, host, path prefix).
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("block", "example.net", "/de/8"),
    ("allow", "net", "/de/"),
    ("block", "org", "/es/"),
)
#: Size of the generated labelled URL set on which the trees are fitted.
TRAINING_URLS = 3000
FEATURES = ("length", "host_length", "depth", "labels", "digit_ratio", "host_digits", "hyphens", "entropy", "host_entropy", "parameters", "longest_label", "consonants", "suffix_rate")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: then up to ``?``, ``#`` or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _entropy(s: Column) -> Column:
    """Bits a character of ``s``; 0 if empty."""
    n = F.length(s).cast("double")
    of = F.transform(F.array_distinct(F.filter(F.split(s, ""), lambda c: c != "")), lambda c: (n - F.length(F.replace(s, c, F.lit("")))) / n)
    return F.when(n > 0, F.aggregate(of, F.lit(0.0), lambda a, p: a - p * F.log2(p))).otherwise(0.0)


def _count(s: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(s, f"[^{pattern}]", "")).cast("double")


def features(df: DataFrame, suffixes: dict[str, float]) -> DataFrame:
    """``df(url, host, path)`` with one double column ``x_<name>`` for each of FEATURES."""
    url, host, path = F.coalesce("url", F.lit("")), F.col("host"), F.col("path")
    length = F.length(url).cast("double")
    rate = F.lit(0.5)
    for s, r in sorted(suffixes.items()):
        rate = F.when(F.substring_index(host, ".", -1) == s, F.lit(float(r))).otherwise(rate)
    x = {
        "length": length,
        "host_length": F.length(host).cast("double"),
        "depth": _count(path, "/"),
        "labels": F.size(F.split(host, r"\.")).cast("double"),
        "digit_ratio": F.when(length > 0, _count(url, "0-9") / length).otherwise(0.0),
        "host_digits": _count(host, "0-9"),
        "hyphens": _count(host, r"\-"),
        "entropy": _entropy(url),
        "host_entropy": _entropy(host),
        "parameters": F.when(F.instr(url, "?") > 0, _count(url, "&") + 1).otherwise(0.0),
        "longest_label": F.array_max(F.transform(F.split(host, r"\."), lambda p: F.length(p))).cast("double"),
        "consonants": F.when(F.length(host) > 0, _count(host, "b-df-hj-np-tv-z") / F.length(host)).otherwise(0.0),
        "suffix_rate": rate,
    }
    return df.withColumns({f"x_{k}": x[k].cast("double") for k in FEATURES})


def labelled_urls(spark: SparkSession, n: int = TRAINING_URLS, start: int = 0) -> DataFrame:
    """A generated labelled set (url, bad) of the numbers from ``start`` up to ``n``: invented syllable hosts against hosts named as adverts, betting and the like."""
    pick = lambda salt, words: f"element_at(array({', '.join(repr(w) for w in words)}), cast(pmod(xxhash64(id, {salt}), {len(words)}) + 1 as int))"
    syllables = ("th", "an", "re", "tion", "er", "on", "ing", "st", "nd", "ha", "lo", "vi", "mar", "tel", "sun", "ke")
    bad_a = ("ads", "free", "cheap", "spam", "casino", "adult", "win", "hot", "click", "bet", "xxx", "loan", "best", "prize", "poker", "dating", "pills", "promo")
    bad_b = ("track", "bets", "pills", "farm", "win", "x", "offers", "money", "now", "girls", "deal4u", "cash", "bonus", "24", "tracker", "slots", "seo", "link")
    return spark.sql(f"""
        SELECT concat({pick(1, ('http://', 'https://'))}, {pick(2, ('', '', 'www.', 'm.', 'blog.', 'news.'))},
                      if(bad = 1, concat({pick(3, bad_a)}, '-', {pick(4, bad_b)}, {pick(5, ('', '', '', '1', '77'))}),
                                  concat({pick(6, syllables)}, if(pmod(xxhash64(id, 14), 16) = 0, '-', ''), {pick(7, syllables)}, {pick(8, ('', *syllables))})),
                      {pick(9, ('.example', '.example', '.site', ''))}, '.', {pick(10, ('com', 'net', 'org'))},
                      '/', {pick(11, ('en', 'de', 'fr', 'es', 'it'))}, '/', cast(pmod(xxhash64(id, 12), 1000) as string),
                      {pick(13, ('', '/', '.html', '#top', '?page=2&ref=x', '?utm_source=feed', '/a/b', '?id=7'))}) AS url, bad
        FROM (SELECT id, cast(pmod(xxhash64(id, 0), 3) = 0 AS int) AS bad FROM range({start}, {n}))""")


def _sigmoid(z):
    return 1 / (1 + np.exp(-z))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 20, depth: int = 3, bins: int = 24, rate: float = 0.3, penalty: float = 1.0):
    """Boosted symmetric trees for logistic loss: (start, [(((feature, cut), ...), leaf values), ...])."""
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for j in range(x.shape[1])]
    mean = min(max(y.mean(), 1e-3), 1 - 1e-3)
    start = math.log(mean / (1 - mean))
    score, model = np.full(len(y), start), []
    for _ in range(trees):
        p = _sigmoid(score)
        g, h = y - p, p * (1 - p)
        leaf, tests = np.zeros(len(y), int), []
        for _ in range(depth):
            best = (-1.0, 0, 0.0)
            for j, cs in enumerate(cuts):
                for c in cs:
                    at = leaf * 2 + (x[:, j] > c)
                    gs, hs = np.bincount(at, g, 2 << depth), np.bincount(at, h, 2 << depth)
                    gain = float((gs * gs / (hs + penalty)).sum())
                    if gain > best[0] + 1e-9:
                        best = (gain, j, float(c))
            tests.append(best[1:])
            leaf = leaf * 2 + (x[:, best[1]] > best[2])
        gs, hs = np.bincount(leaf, g, 1 << depth), np.bincount(leaf, h, 1 << depth)
        values = rate * gs / (hs + penalty)
        score += values[leaf]
        model.append((tuple(tests), values.tolist()))
    return start, model


def score(model) -> Column:
    """The model's probability of a bad URL as one expression over the feature columns."""
    start, trees = model
    z = F.lit(start)
    for tests, values in trees:
        at = F.lit(1)
        for level, (j, cut) in enumerate(tests):
            at = at + F.when(F.col(f"x_{FEATURES[j]}") > cut, 1 << (len(tests) - 1 - level)).otherwise(0)
        z = z + F.element_at(F.array(*(F.lit(float(v)) for v in values)), at)
    return 1 / (1 + F.exp(-z))


def train(spark: SparkSession, n: int = TRAINING_URLS):
    """(suffix rates, trees) fitted on the generated labelled set, whose size is fixed by ``n``."""
    urls = labelled_urls(spark, n)
    host, path = host_and_path(F.col("url"))
    urls = urls.withColumns({"host": host, "path": path})
    rates = urls.groupBy(F.substring_index("host", ".", -1).alias("s")).agg(((F.sum("bad") + 5) / (F.count(F.lit(1)) + 10)).alias("r"))
    suffixes = {r.s: r.r for r in rates.collect()}
    rows = features(urls, suffixes).select("bad", *(f"x_{f}" for f in FEATURES)).collect()
    data = np.array([tuple(r) for r in rows], float)
    return suffixes, fit(data[:, 1:], data[:, 0])


def judge(pages: DataFrame, rules=RULES, threshold: float = 0.5, training_urls: int = TRAINING_URLS) -> DataFrame:
    """Every row of ``pages(page_id, url)`` with host, path, the deciding rule and a verdict.

    A rule fits its host and all subdomains if the path starts with the rule's; the longest
    wins and a page without one is blocked if the trees' probability reaches ``threshold``.
    Null urls and urls without ``://`` have an empty host and path. Repeated rows get equal
    verdicts; further columns are ignored.
    """
    suffixes, model = train(pages.sparkSession, training_urls)
    host, path = host_and_path(F.col("url"))
    df = pages.select("page_id", "url").withColumns({"host": host, "path": path})
    rule, decided = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r)):
        fits = ((F.col("host") == h) | F.endswith("host", F.lit("." + h))) & F.startswith("path", F.lit(p))
        rule, decided = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(verdict)).otherwise(decided)
    df = features(df, suffixes).withColumn("score", score(model))
    own = F.when(F.col("score") >= threshold, F.lit("block")).otherwise(F.lit("allow"))
    return df.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(decided, own).alias("verdict"), "score")
