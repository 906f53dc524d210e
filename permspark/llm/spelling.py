"""Spelling variants: words one edit apart, found in a frequency-vector trie.

Letters are dealt to groups. A word's place in the trie is its length and the list of its numbers of letters of each group, one level for each. An
inserted letter raises one number by one, a replaced one raises one and lowers another or changes none. So the search from a word goes
down level by level with a budget of one surplus and one deficit, depth-first, many words at a time; a node with few words is a leaf, whose
words are compared letter by letter. A pair of words is kept once, from the shorter one or, of two equally long ones, from the one whose
first change is the surplus.

Above the trie are cells, the numbers of letters of a few larger groups, by which Spark deals the words: as many groups as the vocabulary
needs; a word is sent to the cells that its budget reaches, and large cells are cut into blocks. Each task holds the trie of one block at a time. Nothing
but the spread of the work depends on the number of these groups.

A word's form is its near word of largest count (ties: the smallest), if it has at least TIMES the word's count; forms lead to a root.
The vocabulary takes runs of Latin letters from whole texts; null texts have none, a null id counts as an empty string, repeated rows count again. In
`near_words` null words are left out and of repeated words the largest count holds. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from permspark.llm.cells import meet, runs
from permspark.llm.text import LOWER, UPPER
from permspark.sources.writers import staged

#: Letters, and the least length of a word.
LETTERS, SHORTEST = "A-Za-zÀ-ÿ", 7
#: A run loses a letter if the hash of its document and text is divisible by this.
DIVISOR = 31
LEAST, TIMES = 2, 10
#: Groups of letters that may make cells.
CELLS = ("eo", "rt", "ai", "nl", "su", "dh", "cm", "gp", "bf")
#: Groups of letters of the trie, and the number of further groups, to which the other letters belong by code point.
GROUPS = ("e", "t", "a", "o", "i", "n", "s", "r", "h", "l", "d", "u", "cm", "gp", "bf", "wyvk", "jqxz")
OTHERS = 4
#: Words of a block, and of a leaf.
BLOCK, LEAF = 50_000, 4
#: Words up to this length are compared as rows of a matrix, longer ones one by one.
WIDE = 48
#: Places in the trie, or pairs of words, that are looked at together.
AT_ONCE = 200_000


def vocabulary(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(word, n): words of SHORTEST letters or more that occur `least` times, after some runs have lost a letter."""
    found = F.regexp_extract_all("text", F.lit(f"[{LETTERS}]{{{SHORTEST},}}"), F.lit(0))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id"), F.explode(found).alias("_run"))
    rows = rows.select("_id", F.translate("_run", UPPER, LOWER).alias("_run"))
    rows = rows.select("_run", F.crc32(F.concat("_id", F.lit(":"), "_run")).alias("_h"))
    at = F.pmod("_h", F.length("_run")).cast("int")
    shorter = F.concat(F.substring("_run", F.lit(1), at), F.substring("_run", at + 2, F.length("_run")))
    word = F.when(F.col("_h") % DIVISOR == 0, shorter).otherwise(F.col("_run"))
    words = rows.select(word.alias("word")).filter(F.length("word") >= SHORTEST)
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def visited(counts: list[Column]) -> Column:
    """The cells that the search from a word visits, each with the budget spent: 0 none, 1 the surplus, 2 the deficit as well."""

    def cell(spent: int, up: int = -1, down: int = -1) -> Column:
        parts = [c + F.lit((k == up) - (k == down)) for k, c in enumerate(counts)]
        place = F.struct(F.lit(spent).alias("spent"), F.concat_ws(",", *[p.cast("string") for p in parts]).alias("cell"))
        return place if down < 0 else F.when(counts[down] > 0, place)

    n = range(len(counts))
    return F.array_compact(F.array(cell(0), *[cell(1, a) for a in n], *[cell(2, a, b) for a in n for b in n if a < b]))


@cache
def group_table() -> np.ndarray:
    """Level of the trie for each code point; level 0 is the length."""
    table = (np.arange(0x110000) % OTHERS + len(GROUPS) + 1).astype(np.int16)
    for k, letters in enumerate(GROUPS, 1):
        table[[ord(c) for c in letters]] = k
    return table


class Spelled:
    """Words as numbers: their code points, lengths and places in the trie."""

    def __init__(self, words: list[str]):
        self.words = words
        n, levels = len(words), 1 + len(GROUPS) + OTHERS
        self.lengths = np.fromiter(map(len, words), dtype=np.int64, count=n)
        flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        row = np.repeat(np.arange(n), self.lengths)
        place = np.arange(len(flat)) - np.repeat(np.cumsum(self.lengths) - self.lengths, self.lengths)
        self.vectors = np.bincount(row * levels + group_table()[flat], minlength=n * levels).reshape(n, levels)
        self.vectors[:, 0] = self.lengths
        self.codes = np.zeros((n, WIDE + 1), dtype=np.uint8 if not len(flat) or flat.max() < 256 else np.uint32)
        fits = place <= WIDE
        self.codes[row[fits], place[fits]] = flat[fits]


class Trie:
    """Words by their vectors: for each level the sorted numbers (node above, count) of its nodes, and where their words begin."""

    def __init__(self, words: Spelled):
        self.words = words
        self.order = np.lexsort(words.vectors.T[::-1])
        node, self.levels, self.first = np.zeros(len(self.order), dtype=np.int64), [], []
        for counts in words.vectors[self.order].T:
            keys, first, node = np.unique(node << 32 | counts, return_index=True, return_inverse=True)
            self.levels.append(keys)
            self.first.append(np.concatenate((first, [len(node)])))

    def search(self, asked: Spelled, spent: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(numbers of asked words, numbers of own words) that are one edit apart."""
        everyone = np.arange(len(spent))
        # a longer word has a surplus alone, one of the same length may have both
        stack = [self.below(0, np.tile(everyone, 2), asked.lengths[np.tile(everyone, 2)] + np.repeat([0, 1], len(spent)), np.repeat([3, 1], len(spent)), 0)]
        while stack:
            level, word, node, left = stack.pop()
            if len(word) > AT_ONCE:
                half = len(word) // 2
                stack += [(level, word[part], node[part], left[part]) for part in (slice(half), slice(half, None))]
                continue
            first = self.first[level - 1]
            leaf = (first[node + 1] - first[node] <= LEAF) | (level == len(self.levels))
            yield from self.leaves(asked, word[leaf], node[leaf], level - 1, spent)
            word, node, left = word[~leaf], node[~leaf], left[~leaf]
            if not len(word):
                continue
            count = asked.vectors[word, level]
            up = np.flatnonzero(left & 1)
            # in one cell, the first change is the surplus
            down = np.flatnonzero((left & 2 != 0) & (count > 0) & ((left & 1 == 0) | (spent[word] > 0)))
            chosen = np.concatenate((np.arange(len(word)), up, down))
            change = np.repeat([0, 1, -1], [len(word), len(up), len(down)])
            stack.append(self.below(level, word[chosen], count[chosen] + change, left[chosen] - np.array([0, 1, 2])[change], node[chosen]))

    def below(self, level: int, word: np.ndarray, count: np.ndarray, left: np.ndarray, node: np.ndarray | int) -> tuple:
        """Places (next level, word, node, budget left) of the children with these counts, where there are any."""
        keys, own = np.asarray(node) << 32 | count, self.levels[level]
        place = np.minimum(np.searchsorted(own, keys), len(own) - 1)
        there = own[place] == keys
        return level + 1, word[there], place[there], left[there]

    def leaves(self, asked: Spelled, word: np.ndarray, node: np.ndarray, level: int, spent: np.ndarray):
        first = self.first[level]
        sizes = first[node + 1] - first[node]
        total = np.cumsum(sizes)
        for start in range(0, int(total[-1]) if len(total) else 0, AT_ONCE):
            pair = np.arange(start, min(start + AT_ONCE, int(total[-1])))
            entry = np.searchsorted(total, pair, side="right")
            own = self.order[first[node[entry]] + pair - (total[entry] - sizes[entry])]
            good = one_edit(asked, word[entry], self.words, own)
            a, b = word[entry][good], own[good]
            kept = once(asked, a, self.words, b, spent)
            yield a[kept], b[kept]


def one_edit(asked: Spelled, a: np.ndarray, words: Spelled, b: np.ndarray) -> np.ndarray:
    """Whether one letter is inserted into word a, or one replaced, to make word b."""
    n, m = asked.lengths[a], words.lengths[b]
    good = np.zeros(len(a), dtype=bool)
    wide = (n > WIDE) | (m > WIDE)
    for k in np.flatnonzero(wide):
        good[k] = plain_edit(asked.words[a[k]], words.words[b[k]])
    for chosen, inserted in ((np.flatnonzero(~wide & (m == n)), False), (np.flatnonzero(~wide & (m == n + 1)), True)):
        if not len(chosen):
            continue
        width = int(m[chosen].max()) + 1
        x, y = asked.codes[a[chosen], :width], words.codes[b[chosen], :width]
        if inserted:
            # the letters before the first difference are the same, and so are those after it, moved by one
            ahead, behind = x[:, :-1] != y[:, :-1], x[:, :-1] != y[:, 1:]
            first = np.where(ahead.any(axis=1), ahead.argmax(axis=1), width)
            last = np.where(behind.any(axis=1), width - 2 - behind[:, ::-1].argmax(axis=1), -1)
            good[chosen] = last < first
        else:
            good[chosen] = np.count_nonzero(x != y, axis=1) == 1
    return good


def once(asked: Spelled, a: np.ndarray, words: Spelled, b: np.ndarray, spent: np.ndarray) -> np.ndarray:
    """Whether near words a and b are kept as this pair, not as (b, a), which is met in the same cell."""
    change = words.vectors[b] - asked.vectors[a]
    first = change[np.arange(len(a)), (change != 0).argmax(axis=1)]
    kept = (spent[a] > 0) | (first > 0)
    for k in np.flatnonzero(~kept & (first == 0)):
        kept[k] = asked.words[a[k]] < words.words[b[k]]
    return kept


def plain_edit(a: str, b: str) -> bool:
    """Whether one letter is inserted into a, or one replaced, to make b."""
    k = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[k:] == b[k + 1 :] if len(b) == len(a) + 1 else len(a) == len(b) and k < len(a) and a[k + 1 :] == b[k + 1 :]


PAIRS = pa.schema([("a", pa.string()), ("n_a", pa.int64()), ("b", pa.string()), ("n_b", pa.int64())])


def pair_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near words, from rows (cell, i, j, kind, word, n, spent) of meet()."""
    held, trie = [], None
    for new, kind, rows in runs(batches):
        if new:
            held, trie = [], None
        words, n = rows.column(4), rows.column(5)
        if kind == 0:
            held.append((words, n))
            continue
        if not held:
            continue
        if trie is None:
            own_words, own_n = (pa.concat_arrays([h[k] for h in held]) for k in range(2))
            trie = Trie(Spelled(own_words.to_pylist()))
        for a, b in trie.search(Spelled(words.to_pylist()), rows.column(6).to_numpy().astype(np.int64)):
            yield pa.RecordBatch.from_arrays([words.take(pa.array(a)), n.take(pa.array(a)), own_words.take(pa.array(b)), own_n.take(pa.array(b))], schema=PAIRS)


def near_words(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """(a, n_a, b, n_b): every two words of (word, n) that are one inserted or replaced letter apart, once."""
    words = staged(words.filter("word IS NOT NULL").groupBy("word").agg(F.max("n").alias("n")))
    groups = CELLS[: max(math.ceil(math.log(max(words.count(), 1) / block, 4)), 1)]
    counts = [F.length("word") - F.length(F.translate("word", g, "")) for g in groups]
    own = words.select(F.concat_ws(",", *[c.cast("string") for c in counts]).alias("cell"), "word", "n", F.lit(0).alias("spent"))
    asked = words.select("word", "n", F.explode(visited(counts)).alias("_v")).select("_v.cell", "word", "n", "_v.spent")
    return meet(own, asked, ["word"], block).mapInArrow(pair_rows, "a string, n_a long, b string, n_b long")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form), forms not null: every step doubles the way that is known, so few are needed."""
    known = staged(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = known.select(F.col("word").alias("_word"), F.col("root").alias("_root"))
        stepped = known.join(ahead, F.col("root") == F.col("_word"), "left")
        known = staged(stepped.select("word", F.coalesce("_root", "root").alias("root"), F.col("_root").isNotNull().alias("_moved")))
        if not known.filter("_moved").head(1):
            return known.select("word", "root")
        known = known.drop("_moved")


def variants(words: DataFrame, times: int = TIMES, block: int = BLOCK) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of (word, n)."""
    words = staged(words.filter("word IS NOT NULL").groupBy("word").agg(F.max("n").alias("n")))
    pairs = near_words(words, block)
    sides = F.array(*[F.struct(F.col(x).alias("_word"), F.col(y).alias("other"), F.col(f"n_{y}").alias("n_other")) for x, y in ("ab", "ba")])
    near = pairs.select(F.explode(sides).alias("s")).select("s.*")
    near = staged(near.groupBy("_word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n_other")).alias("by"), "other")).alias("best")))
    met = words.join(near, F.col("word") == F.col("_word"), "left")
    best_n = -F.col("best.by")
    formed = F.coalesce(best_n >= F.col("n") * times, F.lit(False))
    found = staged(
        met.select(
            "word", F.when(formed, F.col("best.other")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(formed, best_n).alias("form_n")
        )
    )
    ends = roots(found.filter("form IS NOT NULL")).withColumnRenamed("word", "_word")
    out = found.join(ends, F.col("word") == F.col("_word"), "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
