"""URL filters: host and path rules, and a logistic regression on hashed character n-grams.

The model is trained on the driver from a small labelled URL table (at most ``max_labelled`` rows),
by full-batch gradient descent from zero, so the same table gives the same weights.  It reads the
3- to 5-grams of ``^host$`` and of the path without its digits, hashed into ``2**BITS`` weights.

Defined cases: null, or no ``://``: empty host and path, which the model passes (allow); repeated
rows are judged alike; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .url_labels import BAD, GOOD, SPAM

BITS = 16
GRAMS = (3, 4, 5)
EPOCHS, RATE, DECAY = 300, 4.0, 1e-4

#: (verdict, host, path)
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)

#: Where the labelled hosts are read, alike for both classes: only the host tells them apart.
_PAGES = (("", "/"), ("www.", "/about"), ("m.", "/en/"), ("blog.", "/fr/"), ("", "/de/"), ("www.", "/es/"))


def default_labels() -> list[tuple[str, int]]:
    """The labelled table: the hosts of ``url_labels``, with some common pages of each; bad is 1."""
    hosts = [(h, 1) for h in BAD + SPAM] + [(h, 0) for h in GOOD]
    return [(f"https://{head}{host}{path}", label) for host, label in hosts for head, path in _PAGES]


def host_of(url: Column) -> Column:
    tail = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(tail, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def features(host: str, path: str) -> np.ndarray:
    """Distinct hashed n-grams of host and path."""
    texts = ("^" + host + "$", "/" + re.sub("[0-9]+", "", path))
    grams = {f"{i}{t[j : j + n]}" for i, t in enumerate(texts) for n in GRAMS for j in range(len(t) - n + 1)}
    return np.unique(np.array([zlib.crc32(g.encode()) & ((1 << BITS) - 1) for g in sorted(grams)], np.int64))


def split_url(url: str | None) -> tuple[str, str]:
    if not url or "://" not in url:
        return "", ""
    host, path = re.match(r"(?s)([^/?#]*)([^?#]*)", url.split("://", 1)[1]).groups()
    return "".join(c.lower() if c.isascii() else c for c in host), path


def train(labelled: list[tuple[str, int]]) -> tuple[np.ndarray, float]:
    """Weights and bias; both classes weigh the same."""
    rows = [features(*split_url(url)) for url, _ in labelled]
    y = np.array([label for _, label in labelled], float)
    flat = np.concatenate(rows)
    row = np.repeat(np.arange(len(rows)), [len(x) for x in rows])
    scale = 1 / np.sqrt(np.maximum([len(x) for x in rows], 1))
    share = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    weights, bias = np.zeros(1 << BITS), 0.0
    for _ in range(EPOCHS):
        z = np.bincount(row, weights[flat], len(rows)) * scale + bias
        error = (1 / (1 + np.exp(-z)) - y) * share
        weights -= RATE * (np.bincount(flat, (error * scale)[row], 1 << BITS) + DECAY * weights)
        bias -= RATE * error.sum()
    return weights, bias


def score(urls, model: tuple[np.ndarray, float]) -> np.ndarray:
    weights, bias = model
    out = []
    for host, path in urls:
        at = features(host, path) if host else np.zeros(0, np.int64)
        out.append(1 / (1 + np.exp(-(weights[at].sum() / np.sqrt(len(at)) + bias))) if len(at) else 0.0)
    return np.array(out)


def labelled_rows(labelled: DataFrame, max_labelled: int = 10_000) -> list[tuple[str, int]]:
    """At most ``max_labelled`` rows of (url, label), by a hash of the url."""
    rows = labelled.select("url", F.col("label").cast("int").alias("label")).where("url IS NOT NULL AND label IS NOT NULL")
    return [tuple(r) for r in rows.orderBy(F.xxhash64("url"), "url", "label").limit(max_labelled).collect()]


def judge(pages: DataFrame, labelled: DataFrame | None = None, url: str = "url", rules=RULES, threshold: float = 0.5) -> DataFrame:
    """``pages`` with host, path, rule, score and verdict added (replacing columns of these names)."""
    model = train(default_labels() if labelled is None else labelled_rows(labelled))

    @F.pandas_udf("double")
    def blocked(host: pd.Series, path: pd.Series) -> pd.Series:
        pairs = list(zip(host, path, strict=True))
        known = dict.fromkeys(pairs)
        known = dict(zip(known, score(known, model), strict=True))
        return pd.Series([float(known[p]) for p in pairs], dtype="float64")

    added = ("host", "path", "rule", "score", "verdict")
    own = [c for c in pages.columns if c not in added]
    out = pages.select(*[F.col(f"`{c}`") for c in own], host_of(F.col(f"`{url}`")).alias("host"), path_of(F.col(f"`{url}`")).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    out = out.withColumns({"rule": rule, "_verdict": verdict}).withColumn("score", blocked("host", "path"))
    method = F.when(F.col("score") >= threshold, "block").otherwise("allow")
    return out.withColumn("verdict", F.coalesce("_verdict", method)).drop("_verdict")


def url_report(pages: DataFrame) -> DataFrame:
    return judge(pages.select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")
