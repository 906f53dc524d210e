"""URL filter: path rules by host, and for the rest a logistic regression on hashed character n-grams.

The model is trained from a small table of labelled URLs (columns url, bad), by default the one below. Rows of the judged table are
independent: no shuffle, and only the url column is read.

A null url, or one without "://", has an empty host and path, meets no rule, and is allowed. Repeated rows are judged alike. Other
columns pass through; those named like a result are replaced by it. An empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from permspark.llm.text import LOWER, UPPER

#: Verdict, host and path of each rule.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]

BUCKETS = 2**14
GRAMS = (3, 4, 5)

#: The labelled URLs: words of unwanted and of ordinary sites, put into the same few host and path forms. Names of the test tables are kept out.
BAD_WORDS = (
    "buy-pills big-casino online-casino sports-bets best-bets adult-cam xxx-videos porn-tube "
    "link-farm click-track ad-server payday-loan fast-loans warez-crack crack-keygen replica-watches viagra-shop "
    "poker-win slots-win hot-singles sex-chat torrent-pirate lottery-win bonus-casino"
).split()
GOOD_WORDS = (
    "weather garden library science history museum kitchen travel school physics music radio theatre market village river forest "
    "economy health teacher language recipes football cycling mountain harbour gallery archive journal university news sports articles "
    "courses notes others wishes themes classes houses stories photos maps papers essays studies series species roses horses theses "
    "atlas address business princess congress chess process guides tables notions nations stations answers letters numbers writers "
    "north south earth truth depth month thistle thread nation ration election section action question mention fiction lesson reason season person "
    "encyclopedia wiki dictionary forum weblog software research office council museum-shop trade-union open-data sea-shore red-house old-town new-city well-read time-line "
    "book-shop path-finder north-star weather-map farm-shop track-record water-works"
).split()
HOSTS = ["{}.example.com", "www.{}.example.net", "blog.{}.example.org", "m.{}.example.com"]
PATHS = ["", "/", "/en/{n}", "/fr/{n}/", "/de/{n}.html", "/es/{n}"]


def default_urls() -> list[tuple[str, int]]:
    """Each word in two host forms and two path forms, which both kinds share."""
    out = []
    for bad, words in ((1, BAD_WORDS), (0, GOOD_WORDS)):
        for k, word in enumerate(words):
            for j in range(2):
                host, path = HOSTS[(k + j) % len(HOSTS)].format(word), PATHS[(k + 3 * j) % len(PATHS)].format(n=37 * k + j)
                out.append((f"http://{host}{path}", bad))
    return out


def split_url(url: str | None) -> tuple[str, str]:
    """Host with A-Z lower-cased, and path."""
    _, mark, rest = (url or "").partition("://")
    host = re.split(r"[/?#]", rest, maxsplit=1)[0]
    path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
    return host.translate(str.maketrans(UPPER, LOWER)), path


def buckets_of(host: str, path: str) -> np.ndarray:
    """Distinct hashed n-grams; host and path are told apart."""
    found = set()
    for mark, text in ((b"h", f"^{host}$"), (b"p", f"^{path}$")):
        data = text.encode("utf-8", "surrogatepass")
        for n in GRAMS:
            found.update(zlib.crc32(mark + data[i : i + n]) % BUCKETS for i in range(len(data) - n + 1))
    return np.fromiter(sorted(found), dtype=np.int64)


def train(urls: Iterable[tuple[str | None, int]], epochs: int = 60, rate: float = 0.5, l2: float = 1e-4) -> np.ndarray:
    """Weights by full-batch gradient descent; the last one is the bias. Each row's features are scaled to unit length."""
    rows = [(buckets_of(*split_url(u)), int(y)) for u, y in urls if y is not None]
    weight = np.zeros(BUCKETS + 1)
    if not rows:
        return weight
    y = np.array([r[1] for r in rows], dtype=np.float64)
    size = np.array([max(len(r[0]), 1) for r in rows])
    at, line = np.concatenate([r[0] for r in rows]), np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    scale = 1 / np.sqrt(size)
    balance = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max(len(y) - y.sum(), 1)) * len(y)
    for _ in range(epochs * 10):
        z = np.bincount(line, weight[at], len(rows)) * scale + weight[-1]
        err = (1 / (1 + np.exp(-z)) - y) * balance
        step = np.bincount(at, (err * scale)[line], BUCKETS) / len(rows) * 20
        weight[:-1] -= rate * (step + l2 * weight[:-1])
        weight[-1] -= rate * err.mean()
    return weight


def bad_score(weight: np.ndarray, host: str, path: str) -> float:
    at = buckets_of(host, path)
    return float(1 / (1 + np.exp(-(weight[at].sum() / np.sqrt(max(len(at), 1)) + weight[-1]))))


def rule_column(host: F.Column, path: F.Column, rules=RULES) -> F.Column:
    """Number of the longest rule that fits, else null. A rule fits its host and all subdomains."""
    longest = sorted(range(len(rules)), key=lambda k: -len(rules[k][1] + rules[k][2]))
    out = F.lit(None).cast("int")
    for k in reversed(longest):
        fits = ((host == rules[k][1]) | host.endswith(f".{rules[k][1]}")) & path.startswith(rules[k][2])
        out = F.when(fits, F.lit(k)).otherwise(out)
    return out


def judge_urls(pages: DataFrame, labelled: Iterable[tuple[str | None, int]] | None = None, rules=RULES, limit: float = 0.5) -> DataFrame:
    """Pages with host, path, rule, verdict and `bad_score` (null where a rule decides)."""
    weight = train(default_urls() if labelled is None else labelled)

    @F.pandas_udf("double")
    def scored(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for hosts, paths, ruled in parts:
            yield pd.Series([None if r or not h else bad_score(weight, h, p) for h, p, r in zip(hosts, paths, ruled)], dtype="float64")

    rest = F.when(F.instr("url", "://") > 0, F.regexp_extract("url", r"(?s)^.*?://(.*)$", 1)).otherwise(F.lit(""))
    raw = F.regexp_extract("_rest", r"(?s)^([^/?#]*)", 1)
    names = ["host", "path", "rule", "verdict", "bad_score"]
    others = [c for c in pages.columns if c not in names]
    parts = pages.select(F.struct(*[F.col(c) for c in others]).alias("_row"), rest.alias("_rest"))
    path = F.regexp_extract("_rest", r"(?s)^[^/?#]*([^?#]*)", 1)
    parts = parts.select("_row", F.translate(raw, UPPER, LOWER).alias("host"), path.alias("path"))
    parts = parts.withColumn("_rule", rule_column(F.col("host"), F.col("path"), rules))
    parts = parts.withColumn("bad_score", scored("host", "path", F.col("_rule").isNotNull()))
    text = F.array(*[F.lit(h + p) for _, h, p in rules])
    verdict = F.array(*[F.lit(v) for v, _, _ in rules])
    own = F.when(F.col("bad_score") >= limit, "block").otherwise("allow")
    return parts.select(
        "_row.*", "host", "path", F.get(text, "_rule").alias("rule"), F.coalesce(F.get(verdict, "_rule"), own).alias("verdict"), "bad_score"
    )
