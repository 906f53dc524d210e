"""Phrase collocations and spelling variants."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from permspark.llm import cells, collocations as C, spelling as S
from tests.llm import brute

LANGS = ["en", "de", None, "und"]


def phrase_docs(seed=3, n=160):
    r = random.Random(seed)
    vocabulary = ["alpha", "Beta", "c", "dé", "\U0001f600x", "e1", "New", "york", "city", "of"]
    docs = []
    for k in range(n):
        words = [r.choice(vocabulary[: 4 + k % 7]) + r.choice(["", "", "", ",", ".", "!\n", "\t", "  "]) for _ in range(r.randint(0, 60))]
        docs.append((LANGS[k % 4], " ".join(words).replace("New", "New York City of")))
    docs += [("en", None), ("en", ""), ("de", " \t\n., "), (None, "one"), docs[0], docs[0], ("en", "a\x0bb\x0cc\rd a b " * 40), ("en", "York " * 3000)]
    return docs


def phrase_table(spark, docs):
    clash = [F.lit(7).alias(c) for c in ("n", "a", "chunk", "body", "phrase", "rank", "one", "m")]
    return spark.createDataFrame(docs, "lang string, text string").select("*", *clash)


def phrase_rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("least, top", [(12, 2000), (30, 5)])
def test_collocations_equal_brute_force(spark, least, top):
    docs = phrase_docs()
    found = C.collocations(phrase_table(spark, docs).repartition(3), least, top)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert phrase_rows(found) == brute.collocations(docs, least, top)


def test_phrases_of_a_chunk_in_small_blocks(monkeypatch):
    monkeypatch.setattr(C, "BLOCK", 64)
    body = C.pieces(b"A b, a B a  b c\td. " * 30 + b"x" * 500 + b" a b")
    words, hashes = C.Words(body), {}
    for m in (1, 2, 3):
        at = words.phrases(m)
        texts = [body[words.starts[k] : words.ends[k + m - 1]] for k in at]
        assert all(b"\n" not in t and t.count(b" ") == m - 1 for t in texts)
        for text, *pair in zip(texts, *words.named(at, m, "en", 64)):
            assert hashes.setdefault(text, pair) == pair
            for row, (modulus, base), salt in zip(pair, C.BASES, (C.xxhash.xxh64_intdigest(b"en", m), 0)):
                whole = sum((x + 1) * pow(base, k, modulus) for k, x in enumerate(text)) % modulus ^ salt
                assert whole % 2**64 == int(row) % 2**64 if modulus == 1 << 64 else whole & C.CHECK == row
    assert len({tuple(map(int, h)) for h in hashes.values()}) == len(hashes)
    runs = C.longer_runs(words, body, at := words.phrases(1), np.array([body[a:b] != b"d" for a, b in zip(words.starts, words.ends)]), 1)
    assert runs == C.pieces(b"A b, a B a  b c\n" * 30 + b"x" * 500 + b" a b")


def test_colliding_fingerprints_are_told_apart_by_text(spark):
    """A fingerprint of 5 bits is shared by many phrases."""
    docs = phrase_docs(n=80)
    assert phrase_rows(C.collocations(phrase_table(spark, docs), 12, 50, bits=5)) == brute.collocations(docs, 12, 50)


def test_collocations_of_a_long_text_and_of_nothing(spark):
    long = "word one two " * 400_000  # one piece of 5 MB, more than a chunk
    got = phrase_rows(C.collocations(phrase_table(spark, [("en", long), ("en", "two, word")]), 100, 50))
    assert ("two word one two word", 399_998) in [(r[2], r[3]) for r in got] and {r[6] for r in got} == {1_200_002}
    assert phrase_rows(C.collocations(phrase_table(spark, docs=[("en", None)]).limit(0))) == []
    assert phrase_rows(C.collocations(phrase_table(spark, [(None, None), ("x", " ")]), 1)) == []


def word_docs(seed=4):
    r = random.Random(seed)
    base = ["".join(r.choice("eortaisnléßh") for _ in range(r.randint(6, 11))) for _ in range(60)]
    docs = []
    for k in range(500):
        words = []
        for _ in range(40):
            w = base[min(int(r.expovariate(0.1)), 59)]
            if r.random() < 0.15:
                at = r.randrange(len(w))
                w = r.choice([w[:at] + w[at + 1 :], w[:at] + r.choice("eortxyqÿ") + w[at + 1 :], w[:at] + r.choice("eozx") + w[at:]])
            words.append(r.choice([w, w, w.upper(), w.title()]))
        docs.append((k if k % 9 else None, r.choice([" ", "-", "1"]).join(words)))
    return docs + [(7, None), (8, ""), docs[3], (9, "q" * 3000 + " " + "q" * 3000 + " " + "q" * 3001 + "," + "q" * 3001)]


def test_vocabulary_equals_brute_force(spark):
    docs = word_docs()
    clash = [F.lit(1).alias(c) for c in ("word", "n", "_run2")]
    got = S.vocabulary(spark.createDataFrame(docs, "doc_id long, text string").select("*", *clash))
    assert {r.word: r.n for r in got.collect()} == brute.vocabulary(docs)


@pytest.mark.parametrize("block", [S.BLOCK, 7])
def test_variants_equal_brute_force(spark, block):
    words = brute.vocabulary(word_docs())
    words |= {"x" * 100: 50, "x" * 101: 5, "x" * 99 + "y": 2, "x" * 48 + "z": 3, "x" * 49 + "z": 40, "x" * 49: 400, "\U0001f600" * 7: 9, "\U0001f600" * 8: 100, "": 4, "a": 40}
    table = spark.createDataFrame([*words.items(), (None, 3), *list(words.items())[:5]], "word string, n long")
    found = S.variants(table.select("*", F.lit(1).alias("form"), F.lit(2).alias("cell")), block=block)
    assert sorted((tuple(r) for r in found.collect()), key=lambda r: r[0]) == brute.variants(words)
    assert sum(r[1] is not None for r in brute.variants(words)) > 50


def test_roots_follow_long_chains(spark):
    chain = spark.createDataFrame([(str(k), str(k + 1)) for k in range(30)], "word string, form string")
    assert {r.root for r in S.roots(chain).collect()} == {"30"}
    assert S.variants(spark.createDataFrame([], "word string, n long")).collect() == []


def test_cells_meet_once_and_in_small_parts(spark):
    left = spark.createDataFrame([("hot" if k < 900 else f"c{k % 7}", k) for k in range(1000)], "cell string, key long")
    right = spark.createDataFrame([("hot" if k < 300 else f"c{k % 9}", k) for k in range(400)], "cell string, key long")
    parts = cells.meet(left, right, ["key"], 50).groupBy("cell", "i", "j").agg(
        F.collect_list(F.when(F.col("kind") == 0, F.col("key"))).alias("l"), F.collect_list(F.when(F.col("kind") == 1, F.col("key"))).alias("r")
    )
    parts = parts.collect()
    seen = [(a, b) for p in parts for a in p.l for b in p.r]
    want = {(a.key, b.key) for a in left.collect() for b in right.collect() if a.cell == b.cell}
    assert len(seen) == len(want) and set(seen) == want
    assert max(len(p.l) for p in parts) < 110
