"""URL filter: host and path rules first, then a hashed character n-gram classifier.

``judge_urls`` splits each url into host and path, applies the longest fitting
rule, and lets a logistic regression over hashed character n-grams of host and
path decide the rest.  The model is trained from a small table of labelled urls.

Defined results: a null url, or one without ``://``, has an empty host and path,
fits no rule, and is judged by the model's bias alone.  Repeated rows are judged
alike, an empty table gives an empty one, and other columns pass through unless
their name is one of the five that are added, which then replaces it.  Rules of
equal length that fit (there are none by default) tie in favour of the later one.
Very long urls are judged whole; a batch's n-grams take some 100 bytes a character.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import lower_ascii, read

#: (host and path, verdict)
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))

BUCKETS = 1 << 14
ORDERS = (3, 4, 5)
BLOCK_FROM = 0.55
#: Wrongly blocking counts as much as wrongly allowing this many times.
WANTED_WEIGHT = 3.0

#: Words that mark hosts or paths of the labelled examples: 1 is unwanted, 0 is wanted.
UNWANTED = "casino betting bets poker slots jackpot pills pharma viagra adult xxx porn escort spam ads adserver tracker track clickbait payday-loans replica warez".split()
WANTED = "news library museum science weather garden history cooking school travel music river mountain theatre reading letters stone tools poetry archive journal forum recipes maps atlas radio paper wood roads beads adventure essays".split()

SHAPES = ("{w}", "{w}", "{w}-{a}", "{a}-{w}", "{w}{a}", "{a}{w}", "best-{w}", "my{w}", "{w}s", "{w}{n}")
HOSTS = ("{m}.{top}", "www.{m}.{top}", "m.{m}.{top}", "blog.{m}.{top}", "shop.{m}.{top}", "{m}.{a}.{top}", "www.{m}.{a}.{top}", "en.{a}.{m}.{top}")
TOPS = ("com", "net", "org", "info", "co.uk", "de", "fr", "io", "biz", "eu")
PATHS = ("/{m}", "/{m}/", "/{m}/{n}", "/{n}/{m}.html", "/{a}/{m}", "/{a}/{m}/{n}", "/{m}/{a}.php", "/2019/{n}/{m}-{a}/", "/category/{m}/page/{n}", "/{b}/{a}/{m}")
PLAIN = ("", "/", "/{n}", "/en/{n}", "/fr/{n}.html", "/{a}", "/{a}/{n}/", "/{a}/{b}.html", "/index.php", "/2019/{n}/{a}-{b}/", "/page/{n}", "/{a}{n}.htm")
#: Urls of an unwanted and a wanted word for each place of its mark: host, path or both.
PER_WORD = {1: 28, 0: 14}


def labelled_urls() -> pd.DataFrame:
    """The default training table: marking words in hosts, in paths and in both, among made-up names, and urls without any.

    An unwanted word in either place makes a url unwanted, whatever stands in the other.
    """
    r = random.Random(3)
    name = lambda: "".join(r.choice("bcdfghklmnprstvwz") + r.choice(("a", "e", "i", "o", "u", "er", "an", "th")) for _ in range(r.randint(2, 4)))
    fill = lambda shape, **given: shape.format(**{"a": name(), "b": name(), "n": r.randint(1, 2000), "top": r.choice(TOPS), **given})
    host = lambda word: fill(r.choice(HOSTS), m=fill(r.choice(SHAPES), w=word))
    path = lambda word: fill(r.choice(PATHS), m=fill(r.choice(SHAPES), w=word))
    plain = lambda: fill(r.choice(PLAIN))
    rows = []
    for label, words in ((1, UNWANTED), (0, WANTED)):
        for word in words:
            for _ in range(PER_WORD[label]):
                rows += [(host(word) + plain(), label), (host(name()) + path(word), label)]
                other = r.choice(WANTED)
                rows.append((host(word) + path(other) if r.random() < 0.5 else host(other) + path(word), label))
    rows += [(host(name()) + plain(), 0) for _ in range(PER_WORD[0] * len(WANTED))]
    return pd.DataFrame([("https://" + url, label) for url, label in rows], columns=["url", "label"])


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url column."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    host = lower_ascii(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1))
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def fitting_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule whose host is the url's or a parent of it, and whose path starts the url's."""
    chain = F.lit(None).cast("string")
    for text, _ in sorted(rules, key=lambda r: len(r[0])):
        rule_host, slash, rule_path = text.partition("/")
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(slash + rule_path)
        chain = F.when(fits, F.lit(text)).otherwise(chain)
    return chain


def grams(texts: list[str], salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Text number and bucket of every character n-gram of many texts, with their ends marked."""
    marked = [f"^{t}$" for t in texts]
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    lengths = np.fromiter(map(len, marked), dtype=np.int64, count=len(marked))
    of = np.repeat(np.arange(len(marked)), lengths)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(codes))  # characters to the text's end
    rows, buckets = [], []
    for n in ORDERS:
        m = max(0, len(codes) - n + 1)
        h = np.full(m, salt * 31 + n, dtype=np.uint64)
        for k in range(n):
            h = (h ^ codes[k : k + m]) * np.uint64(0x100000001B3)
            h ^= h >> np.uint64(29)
        inside = left[:m] >= n
        rows.append(of[:m][inside])
        buckets.append((h[inside] % np.uint64(BUCKETS)).astype(np.int64))
    return np.concatenate(rows), np.concatenate(buckets)


def features(hosts: list[str], paths: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Url number and bucket of the different n-grams of each url, in order; none for a url without host and path."""
    (a, x), (b, y) = grams(hosts, 1), grams(paths, 2)
    both = np.unique(np.concatenate((a, b)) * BUCKETS + np.concatenate((x, y)))
    some = np.fromiter((bool(h or p) for h, p in zip(hosts, paths, strict=True)), dtype=bool, count=len(hosts))
    both = both[some[both // BUCKETS]] if len(both) else both
    return both // BUCKETS, both % BUCKETS


@dataclass
class UrlModel:
    """Weights of the hashed n-grams; ``BUCKETS`` floats whatever the input's size."""

    weights: np.ndarray
    bias: float

    def unwanted(self, hosts: list[str], paths: list[str]) -> np.ndarray:
        """Probabilities of many urls at once."""
        of, f = features(hosts, paths)
        n = np.bincount(of, minlength=len(hosts))
        z = self.bias + np.bincount(of, weights=self.weights[f], minlength=len(hosts)) / np.sqrt(np.maximum(1, n))
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def train(labelled: pd.DataFrame, epochs: int = 60, rate: float = 0.5, decay: float = 1e-4) -> UrlModel:
    """Fit by stochastic gradient descent in a fixed order, so that results repeat."""
    model = UrlModel(np.zeros(BUCKETS), 0.0)
    hosts, paths = [], []
    for url in labelled["url"]:
        rest = url.partition("://")[2]
        cut = min([i for i in (rest.find(c) for c in "/?#") if i >= 0], default=len(rest))
        host = rest[:cut].translate({c: c + 32 for c in range(65, 91)})
        path = rest[cut:]
        path = path[: min([i for i in (path.find(c) for c in "?#") if i >= 0], default=len(path))]
        hosts.append(host)
        paths.append(path)
    of, found = features(hosts, paths)
    edges = np.searchsorted(of, np.arange(len(hosts) + 1))
    rows = [(found[a:z], float(y)) for a, z, y in zip(edges[:-1], edges[1:], labelled["label"], strict=True)]
    order = np.random.default_rng(7)
    for epoch in range(epochs):
        step = rate / WANTED_WEIGHT / (1 + epoch / 5)
        for i in order.permutation(len(rows)):
            f, y = rows[i]
            if not len(f):
                continue
            scale = 1 / np.sqrt(len(f))
            z = model.bias + model.weights[f].sum() * scale
            g = (1 / (1 + np.exp(-z)) - y) * (1.0 if y else WANTED_WEIGHT)
            model.weights[f] -= step * (g * scale + decay * model.weights[f])
            model.bias -= 0.1 * step * g
    return model


def judge_urls(pages: DataFrame, rules=RULES, labelled: pd.DataFrame | None = None, threshold: float = BLOCK_FROM) -> DataFrame:
    """Add host, path, rule, p_unwanted and verdict to a table with a url column."""
    host, path = split_url(F.col("url"))
    model = train(labelled_urls() if labelled is None else labelled)

    @F.pandas_udf("double")
    def p_unwanted(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for hosts, paths in parts:
            yield pd.Series(model.unwanted(list(hosts), list(paths)), dtype="float64")

    split = pages.withColumns({"host": host, "path": path})
    ruled = split.withColumn("rule", fitting_rule(F.col("host"), F.col("path"), rules)).withColumn("p_unwanted", p_unwanted("host", "path"))
    given = F.lit(None).cast("string")
    for text, verdict in rules:
        given = F.when(F.col("rule") == text, F.lit(verdict)).otherwise(given)
    return ruled.withColumn("verdict", F.coalesce(given, F.when(F.col("p_unwanted") >= threshold, "block").otherwise("allow")))


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages).select("page_id", "host", "path", "rule", "verdict", "p_unwanted")
