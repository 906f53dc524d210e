"""Mixing sources to target weights by hash-random order and distributed prefix sums.

Every source has a budget of words. Its documents get a random key (a hash of the seed and doc_id), are range-sorted by it, and
running totals of their sizes tell which of them lie before the budget; a source whose budget exceeds its size is repeated in whole
epochs first. The last document is cut, so that the budget is met exactly.

Sources in order of code points, null last, weigh 3, 1, 2 in turn and share SHARE of all words; no target exceeds MOST times the
source's size, and the excess is shared anew among the others until none does. Budgets are targets rounded to words.

A null text has size 0 and takes 0; an empty table gives an empty result; a null source is a source of its own. Rows with equal ids
keep a fixed order by text hash; identical rows are interchangeable and each has its own take. Extra columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from permspark.llm.ordered import prefix_sums
from permspark.llm.text import KINDS, text_key, word_count
from permspark.sources.writers import staged

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
SEED = 20


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    With sources in ascending order of cap by weight, the final level is the first one at which the next source isn't capped:
    what is left after the caps before it, by the weights from it on. Later sources give lower levels.
    """
    ranked = sizes.select("source", "source_size", F.col("source").isNull().alias("_last"), F.lit(1).alias("_one"))
    ranked = prefix_sums(ranked, [], ["_last", "source"], {"_one": "_rank"})
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_rank") % len(weights)).cast("int"))
    capped = ranked.select("source", "source_size", "_rank", weight.alias("_weight"), (most * F.col("source_size")).alias("_cap"))
    capped = prefix_sums(
        capped.withColumn("_ratio", F.col("_cap") / F.col("_weight")), [], ["_ratio", "_rank"], {"_cap": "_caps", "_weight": "_weights"}
    )
    capped = staged(capped)
    whole, weight_sum = capped.agg(share * F.sum("source_size"), F.sum("_weight")).first()  # one row
    if whole is None:
        return sizes.select("source", "source_size", F.lit(0.0).alias("target"))
    level = (F.lit(whole) - F.col("_caps")) / (F.lit(weight_sum) - F.col("_weights"))
    final = capped.filter(level <= F.col("_ratio")).agg(F.max(level)).first()[0]  # one row
    target = F.col("_cap") if final is None else F.least(F.col("_cap"), F.lit(final) * F.col("_weight"))
    return capped.select("source", "source_size", target.alias("target"))


def plan_mix(docs: DataFrame, seed: int = SEED, **shares) -> DataFrame:
    """(doc_id, source, _h, size, source_size, target, taken) for every document; _h is the hash of its text."""
    slim = staged(docs.select("doc_id", "source", text_key(F.col("text")).alias("_h"), word_count(F.col("text")).alias("size")))
    goals = targets(slim.groupBy("source").agg(F.sum("size").alias("source_size")), **shares)
    goals = staged(goals).withColumnRenamed("source", "_source")
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    keyed = slim.withColumn("_key", key)
    run = prefix_sums(keyed, ["source"], ["_key", "doc_id", "size", "_h"], {"size": "_before"})
    run = run.join(goals, F.col("source").eqNullSafe(F.col("_source")))
    whole = F.col("source_size")
    budget = F.round("target").cast("long")
    epochs = F.when(whole > 0, F.floor(budget / whole)).otherwise(F.lit(0)).cast("long")
    part = F.least(F.greatest(budget - epochs * whole - F.col("_before"), F.lit(0)), F.col("size"))
    return run.select("doc_id", "source", "_h", "size", "source_size", "target", (epochs * F.col("size") + part).cast("long").alias("taken"))


@F.pandas_udf(KINDS["string"])
def first_words(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """The text up to the end of its n-th word; null for a null text."""
    for texts, counts in parts:
        out = []
        for text, n in zip(texts, counts):
            if text is None:
                out.append(None)
                continue
            data = text.encode("utf-8", "surrogatepass")
            rest = data.split(None, int(n))
            end = len(data) - len(rest[-1]) if len(rest) > n else len(data)
            out.append(data[:end].rstrip().decode("utf-8", "surrogatepass"))
        yield pd.Series(out, dtype=object)


def mix(docs: DataFrame, seed: int = SEED, **shares) -> DataFrame:
    """The mixed documents with their own columns: one row for each epoch, and the cut document of each source.

    Rows with equal id, source and text are one document here: what they take is added up.
    """
    names = [F.col(c) for c in docs.columns]
    plan = plan_mix(docs, seed, **shares).groupBy("doc_id", "source", "_h").agg(F.sum("taken").alias("_taken"), F.max("size").alias("_size"))
    plan = plan.filter(F.col("_taken") > 0).select(
        F.col("doc_id").alias("_d"), F.col("source").alias("_s"), F.col("_h").alias("_g"), "_taken", "_size"
    )
    rows = docs.select(F.struct(*names).alias("_row"), F.col("doc_id").alias("_id"), F.col("source").alias("_src"), text_key(F.col("text")).alias("_h"))
    rows = rows.dropDuplicates(["_id", "_src", "_h"])
    same = F.col("_id").eqNullSafe(F.col("_d")) & F.col("_src").eqNullSafe(F.col("_s")) & (F.col("_h") == F.col("_g"))
    taken = rows.join(plan, same)
    whole, cut = F.floor(F.col("_taken") / F.col("_size")).cast("int"), F.col("_taken") % F.col("_size")
    # the number of words of each copy: all of them, or those before the cut, which one document of a source has at most
    lengths = F.concat(F.array_repeat(F.col("_size"), whole), F.when(cut > 0, F.array(cut)).otherwise(F.array().cast("array<bigint>")))
    copies = taken.select("_row", "_size", F.explode(lengths).alias("_words"))
    shorter = first_words(F.when(F.col("_words") < F.col("_size"), F.col("_row.text")), F.col("_words"))  # only those texts go to Python
    return copies.select(F.col("_row").withField("text", F.coalesce(shorter, F.col("_row.text"))).alias("_row")).select("_row.*")
