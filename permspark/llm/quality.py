"""Quality rules: document statistics, fixed limits, and boosted trees over the statistics.

The forest is trained on a bounded sample of labelled documents (the SAMPLE_ROWS smallest hashes of doc_id) and shipped to the
tasks as a few flat arrays. Every document is scored from its whole text in the pass that reads it: no shuffle.

Nulls and empty texts have no words and fail the fixed rules. A null label, or a label without its document, is not used;
if a document has several labels, the lowest counts. Without labels of both kinds, the fixed rules alone decide. Repeated rows
are scored alike. Other columns of the input pass through; those named like a statistic are replaced by it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from permspark.llm import gbt
from permspark.llm.text import row_type, utf8

#: Documented bound of the training sample.
SAMPLE_ROWS = 20_000
#: Share of the held-out good documents that the threshold must let through.
KEEP_GOOD = 0.998
WINDOW = 5
SYMBOLS = b"#*$%&|<>"

STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Feature and the direction in which the score may move with it (0: either).
FEATURES = {
    "log_words": 0, "mean_word": 0, "symbols_per_word": -1, "dup_line_share": -1, "repeat_share": -1, "upper_share": 0,
    "digit_share": 0, "distinct_share": 0, "bang_share": -1, "words_per_line": 0, "long_word_share": 0,
}

STATS_TYPE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, features array<double>"
RESULT_TYPE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, score double"

CONTINUATION = bytes(range(0x80, 0xC0))
SPACES = b" \t\n\x0b\x0c\r"
NOT_UPPER = bytes(b for b in range(256) if not 65 <= b <= 90)
NOT_DIGIT = bytes(b for b in range(256) if not 48 <= b <= 57)
NOT_SYMBOL = bytes(b for b in range(256) if b not in SYMBOLS)
NOT_BANG = bytes(b for b in range(256) if b not in b"!?")


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window of consecutive words found at two or more places, the first place included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    code = np.fromiter((ids.setdefault(w, len(ids)) for w in words), dtype=np.int64, count=len(words))
    if len(ids) == len(words):
        return 0
    key, span = code[:n].copy(), len(ids)
    top = span
    for k in range(1, window):
        if top > 2**62 // span:  # number the keys anew, so that they stay exact
            key = np.unique(key, return_inverse=True)[1].astype(np.int64)
            top = n
        key = key * span + code[k : k + n]
        top *= span
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    again = np.zeros(n, dtype=bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    cover = np.zeros(len(words) + 1, dtype=np.int64)
    at = np.flatnonzero(again)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + window, -1)
    return int((cover.cumsum()[:-1] > 0).sum())


def repeated_lines(data: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [line for line in data.split(b"\n") if line.strip(SPACES)]
    return len(lines) - len(set(lines))


def document_stats(text: str | None) -> tuple[int, int, int, int, int, list[float]]:
    data = utf8(text)
    words = data.split()
    n = len(words)
    letters = len(data.translate(None, SPACES + CONTINUATION))
    symbols = len(data.translate(None, NOT_SYMBOL))
    lines = repeated_lines(data) if b"\n" in data else 0
    repeats = repeated_words(words)
    each, chars = max(n, 1), max(letters, 1)
    features = [
        float(np.log1p(n)), letters / each, symbols / each, lines / each, repeats / each, len(data.translate(None, NOT_UPPER)) / chars,
        len(data.translate(None, NOT_DIGIT)) / chars, len(set(words)) / each, len(data.translate(None, NOT_BANG)) / each,
        n / (data.count(b"\n") + 1), sum(len(w) > 24 for w in words) / each,
    ]
    return n, letters, symbols, lines, repeats, features


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < 10 or 100 * n_repeat_words > 20 * n_words


@F.pandas_udf(row_type(STATS_TYPE))
def stats_of(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    names = [*STATS, "features"]
    for batch in texts:
        yield pd.DataFrame([document_stats(t) for t in batch], columns=names)


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the sample. At most `rows` ids are sent to the tasks, as many feature rows come back."""
    known = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("_quality"))
    sample = known.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(rows)
    found = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    got = found.select("doc_id", "_quality", stats_of("text").alias("s")).select("doc_id", "_quality", "s.features").toPandas()
    got = got.assign(key=[tuple(f) for f in got["features"]]).sort_values(["doc_id", "key"]).drop_duplicates("doc_id")
    x = np.array(got["features"].tolist(), dtype=np.float64).reshape(len(got), len(FEATURES))
    return x, got["_quality"].to_numpy(dtype=np.float64)


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> tuple[gbt.Forest, float] | None:
    """Forest and threshold, or None if the labels aren't of both kinds.

    Every fifth row is held out; the threshold is the highest, up to one half, that lets KEEP_GOOD of the held-out good ones through.
    """
    x, y = training_rows(docs, labels, rows)
    held = np.arange(len(y)) % 5 == 4
    if min((y[~held] == 0).sum(), (y[~held] == 1).sum()) < 5:
        return None
    forest = gbt.train(x[~held], y[~held], list(FEATURES.values()))
    good = np.sort(forest.probability(x[held & (y == 1)]))
    threshold = min(0.5, float(good[int(len(good) * (1 - KEEP_GOOD))]) if len(good) else 0.5)
    return forest, threshold


def judge(docs: DataFrame, model: tuple[gbt.Forest, float] | None) -> DataFrame:
    """Documents with their statistics, `base_failed`, `kept` and the model's `score` (null without a model)."""
    names = [*STATS, "base_failed", "kept", "score"]

    @F.pandas_udf(row_type(RESULT_TYPE))
    def judged(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            rows = [document_stats(t) for t in batch]
            failed = np.array([base_failed(r[0], r[4]) for r in rows], dtype=bool)
            score = None
            if model is not None and rows:
                score = model[0].probability(np.array([r[5] for r in rows]))
            kept = ~failed if score is None else ~failed & (score >= model[1])
            out = pd.DataFrame([r[:5] for r in rows], columns=STATS)
            yield out.assign(base_failed=failed, kept=kept, score=score)[names]

    others = [c for c in docs.columns if c not in names]
    row = F.struct(*[F.col(c) for c in others])
    return docs.select(row.alias("_row"), judged("text").alias("_judged")).select("_row.*", "_judged.*")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that pass, with their own columns."""
    inner = docs.select("doc_id", "text", F.struct(*[F.col(c) for c in docs.columns]).alias("_row"))
    return judge(inner, fit(docs, labels)).filter("kept").select("_row.*")
