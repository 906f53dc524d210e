"""Benchmark decontamination with spaced seeds, in DataFrame functions only.

Rule: a document leaks an item if WINDOW consecutive words of the item stand in the document with at most SUBSTITUTIONS of them
replaced. Shorter items are searched as a whole: with at most one word replaced from TOLERANT words on, else unchanged. Words are runs of letters
and digits, lower-cased. Of items below TOLERANT words a document may hold the words by chance, so `without_leaks` leaves them out.

Method: each mask keeps some positions and ignores the others. The masks are chosen such that, wherever SUBSTITUTIONS words of
a window are replaced, one mask in one place meets kept words only (a test tries all cases); a short item has masks of its own length, each of which ignores every third word. So hashes of kept words, joined between
windows and documents, find every overlap. Each hit is verified word by word in the same pass over the documents: nothing but verified
overlaps is shuffled. This broadcasts the hashes of BLOCK windows at most. Of a larger benchmark only a bitmap of the hashes is broadcast (32 MB at
most): the places in documents that pass it, with the words around them, meet the places in items in a merge join and are verified there. The
documents are read once for any benchmark.

A hit takes on only the words around its place: Spark holds all hits of a document at once, which with all words of a long document each fill the memory.

Nulls and empty texts have no words and leak nothing; an item with a null id is reported with null. Repeated rows count once.
Either table may be empty and may have more columns, of any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

WINDOW = 13
SUBSTITUTIONS = 2
#: Words from which a short item may have one replaced.
TOLERANT = 5
#: Positions that each mask keeps.
MASKS = [(0, 1, 2, 4, 5, 8), (0, 1, 5, 6, 7, 8), (0, 2, 4, 5, 6, 8)]
SPAN = max(map(max, MASKS)) + 1
#: Most windows whose hashes are broadcast (about 15 hashes of 60 bytes each).
BLOCK = 50_000
#: Powers of two: numbers of 64 bits in a row of the bitmap, and the most that it has in all. Up to there a window has four at least.
ROW, MOST = 10, 22


def words_of(text: Column) -> Column:
    folded = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " ")
    return F.split(F.btrim(folded), " ")


def allowed(n: int) -> int:
    """Words of a window of n words that may be replaced."""
    return SUBSTITUTIONS if n == WINDOW else int(n >= TOLERANT)


def item_windows(items: DataFrame, least: int = 1) -> DataFrame:
    """(item_id, n, window): each distinct window of an item, n words long."""
    w = items.select("item_id", words_of(F.col("text")).alias("words")).withColumn("n", F.least(F.size("words"), F.lit(WINDOW)))
    w = w.filter((F.col("n") >= least) & (F.get("words", F.lit(0)) != "")).withColumn("at", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("n") + 1)))
    return w.select("item_id", "n", F.slice("words", F.col("at"), F.col("n")).alias("window")).distinct()


def patterns(short: list[int]) -> list[tuple[int, tuple[int, ...]]]:
    """(window length, kept positions): the masks, and for each length of short items three, or one without gaps if no word may be replaced."""
    out = [(WINDOW, m) for m in MASKS]
    for n in short:
        out += [(n, tuple(p for p in range(n) if p % 3 != r)) for r in range(3)] if allowed(n) else [(n, tuple(range(n)))]
    return out


def seed(number: int, words: Column, first: Column, kept: tuple[int, ...]) -> Column:
    return F.xxhash64(F.lit(number), *[F.get(words, first + F.lit(o)) for o in kept])


def window_seeds(windows: DataFrame, chosen: list[tuple[int, tuple[int, ...]]]) -> DataFrame:
    """(seed, at, window_id): the hash of each pattern in each place of each window."""
    each = [
        F.when(F.col("n") == n, F.struct(seed(k, F.col("window"), F.lit(at), kept).alias("seed"), F.lit(at).alias("at")))
        for k, (n, kept) in enumerate(chosen)
        for at in (range(n - max(kept)) if n == WINDOW else (0,))
    ]
    found = windows.select("window_id", F.explode(F.array_compact(F.array(*each))).alias("s"))
    return found.select("s.seed", "s.at", "window_id").distinct()


def spare(n: Column) -> Column:
    """`allowed` of a column."""
    return F.when(n == WINDOW, F.lit(SUBSTITUTIONS)).when(n >= TOLERANT, F.lit(1)).otherwise(F.lit(0))


def equal_words(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda x, y: x + y)


def search(at: DataFrame, windows: DataFrame, chosen: list[tuple[int, tuple[int, ...]]], named: list[str]) -> DataFrame:
    """(named, window_id, start): overlaps of the places `at` with broadcast windows."""
    hits = at.join(F.broadcast(window_seeds(windows, chosen)), "seed").withColumn("start", F.col("pos") - F.col("at")).filter(F.col("start") >= 0)
    hits = hits.select(*named, "start", "window_id", F.slice("words", F.col("start") + 1, F.lit(WINDOW)).alias("part")).join(F.broadcast(windows), "window_id")
    equal = equal_words(F.slice("part", F.lit(1), F.col("n")), F.col("window"))
    return hits.filter((F.size("part") >= F.col("n")) & (equal >= F.col("n") - spare(F.col("n")))).select(*named, "window_id", "start")


def around(words: Column, pos: Column) -> tuple[Column, Column]:
    """How many words before `pos` a window with a mask there may begin, and the words from there to the last one that such a window may have."""
    before = F.least(pos, F.lit(WINDOW - SPAN))
    return before, F.slice(words, pos - before + 1, before + WINDOW)


def item_seeds(items: DataFrame, chosen: list[tuple[int, tuple[int, ...]]], least: int) -> DataFrame:
    """(seed, n, before, part): the hash of each pattern in each place of each item, and the words around the place. Rows may repeat."""
    w = items.select(words_of(F.col("text")).alias("words")).distinct().withColumn("n", F.least(F.size("words"), F.lit(WINDOW)))
    w = w.filter((F.col("n") >= least) & (F.get("words", F.lit(0)) != ""))
    w = w.withColumn("pos", F.explode(F.sequence(F.lit(0), F.when(F.col("n") == WINDOW, F.size("words") - SPAN).otherwise(0))))
    each = [F.when(F.col("n") == n, seed(k, F.col("words"), F.col("pos"), kept)) for k, (n, kept) in enumerate(chosen)]
    before, part = around(F.col("words"), F.col("pos"))
    return w.select(F.explode(F.array_compact(F.array(*each))).alias("seed"), "n", before.alias("before"), part.alias("part"))


def bitmap(seeds: DataFrame, power: int) -> DataFrame:
    """(row, bits): three bits of each seed in one of 2 ** power numbers, 2 ** ROW to a row."""
    numbers = seeds.select(number(power).alias("number"), three_bits().alias("bits"))
    numbers = numbers.unionAll(seeds.sparkSession.range(2**power).select(F.col("id").alias("number"), F.lit(0).cast("long").alias("bits")))
    numbers = numbers.groupBy("number").agg(F.bit_or("bits").alias("bits"))
    rows = numbers.groupBy(F.shiftright("number", ROW).alias("row")).agg(F.array_sort(F.collect_list(F.struct("number", "bits"))).alias("all"))
    return rows.select("row", F.col("all.bits").alias("bits"))


def number(power: int) -> Column:
    return F.shiftrightunsigned("seed", 64 - power)


def three_bits() -> Column:
    return F.expr("shiftleft(1L, int(seed & 63)) | shiftleft(1L, int(shiftright(seed, 6) & 63)) | shiftleft(1L, int(shiftright(seed, 12) & 63))")


def search_many(at: DataFrame, items: DataFrame, chosen: list[tuple[int, tuple[int, ...]]], named: list[str], least: int, windows: int) -> DataFrame:
    """(named, window_id, start): overlaps of the places `at` with any number of items."""
    seeds = item_seeds(items, chosen, least)
    power = min(MOST, max(ROW, (4 * windows).bit_length()))
    known = bitmap(seeds, power)
    at = at.withColumn("number", number(power)).join(F.broadcast(known), F.shiftright("number", ROW) == F.col("row"))
    at = at.filter(F.get("bits", (F.col("number") % 2**ROW).cast("int")).bitwiseAND(three_bits()) == three_bits())
    before, part = around(F.col("words"), F.col("pos"))
    at = at.select(*named, "seed", "pos", before.alias("doc_before"), part.alias("doc_part"))
    hits = at.join(seeds.distinct().hint("merge"), "seed")
    cut = lambda part, before, k: F.slice(part, F.greatest(before - k + 1, F.lit(1)), F.col("n"))
    found = []
    for k in range(WINDOW - SPAN + 1):
        a, b = cut(F.col("part"), F.col("before"), k), cut(F.col("doc_part"), F.col("doc_before"), k)
        fits = (F.least("before", "doc_before") >= k) & (F.size(a) == F.col("n")) & (F.size(b) == F.col("n"))
        good = fits & (equal_words(a, b) >= F.col("n") - spare(F.col("n")))
        found.append(F.when(good, F.struct(window_key(a).alias("window_id"), (F.col("pos") - k).alias("start"))))
    return hits.select(*named, F.explode(F.array_compact(F.array(*found))).alias("found")).select(*named, "found.window_id", "found.start")


def window_key(window: Column) -> Column:
    return F.md5(F.array_join(window, " "))


def find_leaks(docs: DataFrame, items: DataFrame, keys: list[str] | None = None, block: int = BLOCK, least: int = 1) -> DataFrame:
    """(keys, item_id, n_places, first_word, last_word): the document's words, from 0, at which an overlap with the item starts.

    Items of fewer than `least` words are left out.
    """
    keys = keys or ["doc_id"]
    named = [f"_k{i}" for i in range(len(keys))]
    of_items = item_windows(items, least).withColumn("window_id", window_key(F.col("window")))
    windows = of_items.select("window_id", "n", "window").distinct()
    sizes = {r["n"]: r["c"] for r in windows.groupBy("n").agg(F.count("*").alias("c")).collect()}  # at most WINDOW rows
    chosen = patterns(sorted(n for n in sizes if n < WINDOW))

    texts = docs.select(*[F.col(k).alias(n) for k, n in zip(keys, named)], words_of(F.col("text")).alias("words"))
    last = F.size("words") - min([SPAN, *sizes])
    at = texts.select("*", F.explode_outer(F.when(last >= 0, F.sequence(F.lit(0), last))).alias("pos"))
    hashes = F.array(*[seed(k, F.col("words"), F.col("pos"), kept) for k, (_, kept) in enumerate(chosen)])
    at = at.select(*named, "words", "pos", F.explode(hashes).alias("seed"))

    if (many := sum(sizes.values())) > block:
        overlaps = search_many(at, items, chosen, named, least, many)
        of_items = of_items.hint("merge")  # Spark takes the windows for as small as the items and would broadcast them
    else:
        overlaps = search(at, windows, chosen, named)
    pairs = overlaps.distinct().join(of_items.select("window_id", "item_id"), "window_id").groupBy(*named, "item_id").agg(
        F.countDistinct("start").alias("n_places"), F.min("start").alias("first_word"), F.max("start").alias("last_word")
    )
    return pairs.select(*[F.col(n).alias(k) for k, n in zip(keys, named)], "item_id", "n_places", "first_word", "last_word")


def without_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that leak no item of TOLERANT words or more, with their own columns. Rows are told apart by id and text, so null ids are safe."""
    key = F.xxhash64(F.coalesce("text", F.lit("")))
    named = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("_row"), "doc_id", "text", key.alias("_h"))
    leaky = find_leaks(named.select("doc_id", "text", "_h"), items, ["doc_id", "_h"], least=TOLERANT).select(F.col("doc_id").alias("_d"), F.col("_h").alias("_g"))
    kept = named.join(leaky.distinct(), F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_h") == F.col("_g")), "left_anti")
    return kept.select("_row.*")
