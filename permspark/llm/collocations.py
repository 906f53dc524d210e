"""Phrase collocations by Rabin-Karp fingerprints.

Texts are lower-cased (A-Z), cut into pieces at punctuation and line ends, and packed into chunks of one language; words of a piece are
parted by one space. Within a chunk, prefix polynomials over the bytes give the fingerprint of any run of words by two look-ups: one
modulo 2**64 that names the run, and a short one modulo a prime to check it by. Every chunk reports each distinct fingerprint with its count and a
pointer to its first occurrence. The shuffle adds counts and checks, and keeps one pointer, drawn by the fingerprint so that pointers spread over
the chunks. Frequent fingerprints alone are looked up: the text at the pointer is written out, and its own check, times the count, must
be the sum of checks. Where it isn't, two phrases share the fingerprint, and the phrases under it are counted anew by their texts.

Lengths 1 and 2 are counted for the whole corpus; then, length by length, only parts of a chunk in which all shorter phrases may be
frequent are read on, for no other phrase can be. A bitmap of limited size tells them; a full one only lets more through.

A phrase is scored at its weakest cut: floor(1000 * a * n / (l * r)) with its own count a, the counts l and r of both parts and all
words n of its language, in exact decimals. A phrase goes if one that is longer by words around it occurs as often.

Null texts are empty; a null language is `und`. Repeated rows count again. Order of rows, chunks and partitions doesn't matter. Texts without
words add nothing; an empty table gives an empty result. Other columns are ignored. A piece longer than a chunk makes a chunk of its own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from permspark.llm.ordered import prefix_sums
from permspark.llm.shared_files import partition
from permspark.llm.text import LOWER, UPPER
from permspark.sources.writers import staged

LONGEST = 5
LEAST = 100
TOP = 2000
#: Bytes of a chunk, and of all chunks a task fills at a time.
CHUNK, HELD = 5 << 19, 20 << 20
#: Bytes whose prefix polynomials are held at a time.
BLOCK = 1 << 17
#: Modulus and base of the polynomials: odd and below the prime, so that powers can be divided by; bits of the check that are kept.
BASES = ((1 << 64, 0x9E3779B97F4A7C15), ((1 << 31) - 1, 1_103_515_245))
CHECK = (1 << 18) - 1
#: Bits of a pointer for the word; the others number the chunk, of which some count within a task.
WORD_BITS, TASK_BITS = 28, 16
#: Bits of a bitmap for each phrase, and the least and most of a bitmap, as powers of two: 32 MB.
SPARSE, SMALL, LARGE = 16, 20, 28

#: Lower-cases A-Z; tabs become spaces, punctuation and line ends that end a piece become line feeds.
CLEAN = bytes.maketrans(f"{UPPER}\t.,;:!?\x0b\x0c\r".encode(), f"{LOWER} {chr(10) * 9}".encode())
PIECE_END, SPACES = re.compile(rb" *\n[ \n]*"), re.compile(rb" {2,}")


def pieces(text: bytes) -> bytes:
    """Pieces ended by line feeds, words parted by one space; the last piece without its line feed."""
    return SPACES.sub(b" ", PIECE_END.sub(b"\n", text.translate(CLEAN))).strip(b" \n")


def packed(body: bytes) -> bytes:
    return len(body).to_bytes(8, "little") + pa.compress(body, "zstd", asbytes=True)


def unpacked(body: bytes) -> bytes:
    return pa.decompress(body[8:], int.from_bytes(body[:8], "little"), "zstd", asbytes=True)


CHUNKS = pa.schema([("chunk", pa.int64()), ("lang", pa.string()), ("n_words", pa.int64()), ("body", pa.binary())])


def chunks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks from rows (lang, text)."""
    held: dict[str, list[bytes]] = {}
    sizes: dict[str, int] = {}
    number, last = (partition() << TASK_BITS), (partition() + 1) << TASK_BITS
    if last >= 1 << (63 - WORD_BITS):
        raise OverflowError("more tasks than pointers can tell apart")

    def chunk(lang: str) -> pa.RecordBatch:
        nonlocal number
        body = b"\n".join(held.pop(lang))
        del sizes[lang]
        number += 1
        words = body.count(b" ") + body.count(b"\n") + 1
        if number >= last or words >= 1 << WORD_BITS:
            raise OverflowError("more chunks in a task, or words in a piece, than pointers can tell apart")
        return pa.RecordBatch.from_pylist([{"chunk": number, "lang": lang, "n_words": words, "body": packed(body)}], schema=CHUNKS)

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            if not (text := pieces(text.as_buffer().to_pybytes()) if text.is_valid else b""):
                continue
            held.setdefault(lang, []).append(text)
            sizes[lang] = sizes.get(lang, 0) + len(text)
            if sizes[lang] >= CHUNK:
                yield chunk(lang)
            elif sum(sizes.values()) >= HELD:
                yield chunk(max(sizes, key=sizes.get))
    for lang in list(held):
        yield chunk(lang)


_powers: dict[int, list[np.ndarray]] = {}


def powers(modulus: int, base: int, n: int) -> list[np.ndarray]:
    """Powers 0 to n - 1 of the base and of its inverse."""
    if modulus not in _powers or len(_powers[modulus][0]) < n:
        found = []
        for step in (base, pow(base, -1, modulus)):
            row = np.ones(1, dtype=np.uint64)
            while len(row) < n:
                more = row * np.uint64(pow(step, len(row), modulus))
                row = np.concatenate((row, more if modulus == 1 << 64 else more % np.uint64(modulus)))
            found.append(row)
        _powers[modulus] = found
    return _powers[modulus]


class Words:
    """The words of a chunk."""

    def __init__(self, body: bytes):
        self.bytes = np.frombuffer(body, dtype=np.uint8)
        parted = np.flatnonzero((self.bytes == 32) | (self.bytes == 10))
        self.starts = np.concatenate(([0], parted + 1))
        self.ends = np.concatenate((parted, [len(body)]))
        self.last = np.concatenate((self.bytes[parted] == 10, [True]))
        self.piece = np.concatenate(([0], np.cumsum(self.last[:-1])))

    def phrases(self, m: int) -> np.ndarray:
        """Numbers of the words at which m words of one piece start."""
        if len(self.starts) < m:
            return np.empty(0, dtype=np.int64)
        return np.flatnonzero(self.piece[: len(self.piece) - m + 1] == self.piece[m - 1 :])

    def prints(self, at: np.ndarray, m: int) -> list[np.ndarray]:
        """For each of BASES, the polynomials of the m words that start at each of `at` (ascending)."""
        first, last, k = self.starts[at], self.ends[at + m - 1], 0
        out = [np.empty(len(at), dtype=np.uint64) for _ in BASES]
        while k < len(at):
            start = int(first[k])
            j = int(np.searchsorted(first, start + BLOCK))
            size = int(last[j - 1]) - start
            letters = self.bytes[start : start + size].astype(np.uint64) + np.uint64(1)
            low, high = first[k:j] - start, last[k:j] - start
            for row, (modulus, base) in zip(out, BASES):
                power, inverse = powers(modulus, base, max(size, BLOCK) + 1)
                sums = np.zeros(size + 1, dtype=np.uint64)
                if modulus == 1 << 64:
                    np.cumsum(letters * power[:size], out=sums[1:])
                    row[k:j] = (sums[high] - sums[low]) * inverse[low]
                else:
                    np.cumsum(letters * power[:size] % np.uint64(modulus), out=sums[1:])
                    row[k:j] = (sums[high] - sums[low]) % np.uint64(modulus) * inverse[low] % np.uint64(modulus)
            k = j
        return out

    def named(self, at: np.ndarray, m: int, lang: str, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Fingerprints (the lowest `bits`; language and length tell, too) and checks."""
        salt = np.uint64(xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass"), m))
        prints, checks = self.prints(at, m)
        prints = (prints ^ salt) & np.uint64((1 << bits) - 1)
        return prints.view(np.int64), (checks & np.uint64(CHECK)).astype(np.int64)


def filled(bitmap: np.ndarray, prints: np.ndarray) -> np.ndarray:
    """Whether the fingerprints' bits are set."""
    slot = prints & (8 * len(bitmap) - 1)
    return (bitmap[slot >> 3] >> (slot & 7).astype(np.uint8) & 1).astype(bool)


ROWS = pa.schema([("m", pa.int32()), ("fp", pa.int64()), ("n", pa.int64()), ("checks", pa.int64()), ("at", pa.int64())])


def each_chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(chunk, lang, body, further columns) of rows (chunk, lang, packed body, ...)."""
    for batch in batches:
        for chunk, lang, body, *rest in zip(*batch.columns):
            yield chunk.as_py(), lang.as_py(), unpacked(body.as_py()), *rest


def print_rows(lengths: tuple, bits: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every distinct fingerprint of each chunk, its count, its checks in all, and a pointer to its first occurrence."""
    for chunk, lang, body in each_chunk(batches):
        words = Words(body)
        for m in lengths:
            at = words.phrases(m)
            prints, checks = words.named(at, m, lang, bits)
            found, first, n = np.unique(prints, return_index=True, return_counts=True)
            # with short fingerprints, as in tests, one chunk may hold two phrases of one fingerprint
            total = n * checks[first] if bits == 64 else np.bincount(np.searchsorted(found, prints), checks, len(found)).astype(np.int64)
            pointer = (np.int64(chunk) << WORD_BITS | at[first]) ^ (found & np.int64(2**63 - 1))
            columns = np.full(len(found), m, dtype=np.int32), found, n, total, pointer
            for k in range(0, len(found), BLOCK):
                yield pa.RecordBatch.from_arrays([pa.array(c[k : k + BLOCK]) for c in columns], schema=ROWS)


LOOKED_UP = pa.schema([("lang", pa.string()), ("m", pa.int32()), ("phrase", pa.string()), ("f", pa.int64()), ("fp", pa.int64()), ("whole", pa.bool_())])


def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts at the pointers, from rows (chunk, lang, body, pointers); whole if the checks tell of no other phrase."""
    for _, lang, body, pointers in each_chunk(batches):
        words, rows = Words(body), pa.RecordBatch.from_struct_array(pointers.values)
        m, fp, at, f, total = (rows.column(k).to_numpy() for k in range(5))
        order, check = np.lexsort((at, m)), np.empty(len(at), dtype=np.int64)
        for length in np.unique(m):
            own = order[m[order] == length]
            check[own] = words.named(at[own], int(length), lang, 64)[1]
        texts = [body[a:b].decode("utf-8", "surrogatepass") for a, b in zip(words.starts[at].tolist(), words.ends[at + m - 1].tolist())]
        columns = [[lang] * len(at), m, texts, f, fp, total == f * check]
        yield pa.RecordBatch.from_arrays([pa.array(c, type=t.type) for c, t in zip(columns, LOOKED_UP)], schema=LOOKED_UP)


COUNTED = pa.schema([("lang", pa.string()), ("m", pa.int32()), ("phrase", pa.string()), ("n", pa.int64()), ("fp", pa.int64())])


def text_rows(lengths: tuple, bits: int, bitmap: bytes, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Phrases whose fingerprints may be in the bitmap, by their texts."""
    bitmap = np.frombuffer(bitmap, dtype=np.uint8)
    for _, lang, body in each_chunk(batches):
        words = Words(body)
        for m in lengths:
            at = words.phrases(m)
            prints = words.named(at, m, lang, bits)[0]
            counts: dict = {}
            for k in np.flatnonzero(filled(bitmap, prints)).tolist():
                key = body[words.starts[at[k]] : words.ends[at[k] + m - 1]].decode("utf-8", "surrogatepass"), int(prints[k])
                counts[key] = counts.get(key, 0) + 1
            columns = [[lang] * len(counts), [m] * len(counts), [t for t, _ in counts], list(counts.values()), [f for _, f in counts]]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t.type) for c, t in zip(columns, COUNTED)], schema=COUNTED)


def longer_runs(words: Words, body: bytes, at: np.ndarray, frequent: np.ndarray, m: int) -> bytes:
    """Pieces in which every m words are frequent, of at least m + 1 words."""
    # m + 1 words start where these m and the next are frequent and the piece goes on
    longer = frequent[:-1] & frequent[1:] & (at[1:] == at[:-1] + 1) & ~words.last[at[:-1] + m - 1]
    starts = at[:-1][longer]
    if not len(starts):
        return b""
    cut = np.flatnonzero(np.diff(starts) != 1) + 1
    first, last = starts[np.concatenate(([0], cut))], starts[np.concatenate((cut - 1, [-1]))] + m
    return b"\n".join(body[a:b] for a, b in zip(words.starts[first].tolist(), words.ends[last].tolist()))


SHORTER = pa.schema([("chunk", pa.int64()), ("lang", pa.string()), ("body", pa.binary())])


def shortened(m: int, bits: int, bitmap: bytes, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is left of each chunk for phrases of m + 1 words."""
    bitmap = np.frombuffer(bitmap, dtype=np.uint8)
    for chunk, lang, body in each_chunk(batches):
        words = Words(body)
        at = words.phrases(m)
        if rest := longer_runs(words, body, at, filled(bitmap, words.named(at, m, lang, bits)[0]), m):
            yield pa.RecordBatch.from_arrays([pa.array([x], type=t.type) for x, t in zip((chunk, lang, packed(rest)), SHORTER)], schema=SHORTER)


def bitmap_of(prints: DataFrame) -> bytes:
    """A bitmap of the fingerprints (fp), of a size between two bounds; it is put together by Spark."""
    size = 1 << min(max((SPARSE * prints.count()).bit_length(), SMALL), LARGE)
    slot = F.col("fp").bitwiseAND(F.lit(size - 1)) + 1
    rows = prints.select(slot.alias("slot")).groupBy(F.bitmap_bucket_number("slot").alias("bucket"))
    out = np.zeros(size // 8, dtype=np.uint8)
    for r in rows.agg(F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits")).collect():
        part = np.frombuffer(r.bits, dtype=np.uint8)
        out[(r.bucket - 1) * len(part) : r.bucket * len(part)] = part
    return out.tobytes()


def length_step(chunks: DataFrame, lengths: tuple[int, ...], least: int, bits: int) -> tuple[DataFrame, DataFrame | None]:
    """Frequent phrases of these lengths (lang, phrase, f, m), and the chunks (chunk, lang, body) for the next length."""
    rows = chunks.mapInArrow(partial(print_rows, lengths, bits), "m int, fp long, n long, checks long, at long")
    sums = rows.groupBy("m", "fp").agg(F.sum("n").alias("f"), F.sum("checks").alias("checks"), F.min("at").alias("at"))
    frequent = staged(sums.filter(F.col("f") >= least))
    pointer = F.col("at").bitwiseXOR(F.col("fp").bitwiseAND(F.lit(2**63 - 1)))
    place = F.struct("m", "fp", pointer.bitwiseAND(F.lit((1 << WORD_BITS) - 1)).alias("at"), "f", "checks")
    pointers = frequent.groupBy(F.shiftright(pointer, WORD_BITS).alias("_chunk")).agg(F.collect_list(place).alias("pointers"))
    met = chunks.join(pointers, F.col("chunk") == F.col("_chunk")).select("chunk", "lang", "body", "pointers")
    found = staged(met.mapInArrow(look_up, "lang string, m int, phrase string, f long, fp long, whole boolean"))
    phrases = found.filter("whole").select("lang", "phrase", "f", "m")
    mixed = found.filter("NOT whole").select(F.col("m").alias("_m"), "fp")
    if mixed.head(1):
        texts = chunks.mapInArrow(partial(text_rows, lengths, bits, bitmap_of(mixed)), "lang string, m int, phrase string, n long, fp long")
        own = texts.join(mixed.withColumnRenamed("fp", "_fp"), (F.col("m") == F.col("_m")) & (F.col("fp") == F.col("_fp")), "left_semi")
        anew = own.groupBy("lang", "phrase", "m").agg(F.sum("n").alias("f")).filter(F.col("f") >= least)
        phrases = staged(phrases.unionByName(anew.select("lang", "phrase", "f", "m")))
    if lengths[-1] == LONGEST:
        return phrases, None
    bitmap = bitmap_of(frequent.filter(F.col("m") == lengths[-1]))
    return phrases, staged(chunks.mapInArrow(partial(shortened, lengths[-1], bits, bitmap), "chunk long, lang string, body binary"))


def frequent_phrases(docs: DataFrame, least: int = LEAST, bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, f, m) for every phrase of up to LONGEST words that occurs `least` times, and (lang, n) with all words."""
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.col("text").alias("text"))
    stored = staged(rows.mapInArrow(chunks_of, "chunk long, lang string, n_words long, body binary"))
    totals = staged(stored.groupBy("lang").agg(F.sum("n_words").alias("n")))
    tables, chunks = [], stored.select("chunk", "lang", "body")
    for lengths in ((1, 2), *((m,) for m in range(3, LONGEST + 1))):
        table, chunks = length_step(chunks, lengths, least, bits)
        tables.append(table)
    return reduce(DataFrame.unionAll, tables), totals


def scored(phrases: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, phrase, m, a, l, r, n, score) of every phrase of two words or more at its weakest cut."""
    words = F.split("phrase", " ", -1)
    cuts = phrases.filter("m > 1").select("lang", "phrase", "m", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("m") - 1)).alias("k"))
    cuts = cuts.select("*", F.array_join(F.slice(words, F.lit(1), F.col("k")), " ").alias("first"), F.array_join(F.slice(words, F.col("k") + 1, F.col("m") - F.col("k")), " ").alias("rest"))

    def count_of(part: str, name: str) -> DataFrame:
        return phrases.select(F.col("lang").alias("_lang"), F.col("phrase").alias("_part"), F.col("f").alias(name))

    for part, name in (("first", "l"), ("rest", "r")):
        found = count_of(part, name)
        cuts = cuts.join(found, (F.col("lang") == F.col("_lang")) & (F.col(part) == F.col("_part"))).drop("_lang", "_part")
    cuts = cuts.join(totals.withColumnRenamed("lang", "_lang"), F.col("lang") == F.col("_lang")).drop("_lang")
    cuts = cuts.withColumn("score", F.expr("(1000 * cast(a as decimal(19,0)) * cast(n as decimal(19,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))"))
    least = F.min(F.struct("score", "k", "l", "r")).alias("s")
    return cuts.groupBy("lang", "phrase", "m", "a", "n").agg(least).select("lang", "phrase", "m", "a", "s.l", "s.r", "n", "s.score")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, bits: int = 64) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the `top` best phrases of every language."""
    phrases, totals = frequent_phrases(docs, least, bits)
    found = staged(scored(phrases, totals))
    # a longer phrase that occurs as often holds one that is longer by a single word and occurs as often, too
    words = F.split("phrase", " ", -1)
    inner = F.array(*[F.array_join(F.slice(words, F.lit(k), F.col("m") - 1), " ") for k in (1, 2)])
    longer = found.filter("m > 2").select("lang", F.explode(inner).alias("phrase"), "a")
    longer = staged(longer.groupBy(F.col("lang").alias("_lang"), F.col("phrase").alias("_phrase")).agg(F.max("a").alias("_a")))
    met = found.join(longer, (F.col("lang") == F.col("_lang")) & (F.col("phrase") == F.col("_phrase")) & (F.col("a") <= F.col("_a")), "left_anti")
    keyed = met.select("lang", "phrase", "a", "l", "r", "n", "score", (-F.col("score")).alias("by_score"), (-F.col("a")).alias("by_count"), F.lit(1).alias("one"))
    ranked = prefix_sums(keyed, ["lang"], ["by_score", "by_count", "phrase"], {"one": "earlier"}).filter(F.col("earlier") < top)
    return ranked.select("lang", (F.col("earlier") + 1).cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
