"""License scan: fixed phrases, and short notices found in spite of a few wrong characters.

A notice with at most k errors, cut into k + 1 pieces, holds one piece unchanged. One pass of an automaton finds the pieces of all
notices. Around each hit, a window that has too few letter groups in common with the notice to hold it with k errors is dropped; in the others
the regex library matches the whole notice with bounded errors, few first, and reports its span and errors. A match begins and ends where words do,
and words that name a license or its version must stand unchanged. Of overlapping matches the longest notice stays, an error counting against it
like ERRORS_PER characters. Texts are scanned whole, each by itself: no shuffle.

A null text counts as empty: no words, no labels, score 0. Repeated rows are scanned alike. Other columns pass through; those named
like a result are replaced by it. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pandas as pd
import regex
from pyspark.sql import DataFrame, functions as F

from permspark.llm.text import row_type, utf8

#: Phrases and their labels.
PHRASES = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]

#: Names of licenses in lower-case words, with their labels.
NAMES = [
    ("mit", "mit"), ("apache", "apache"), ("apache 2 0", "apache"), ("bsd", "bsd"), ("bsd 2 clause", "bsd"), ("bsd 3 clause", "bsd"), ("new bsd", "bsd"), ("isc", "isc"),
    ("zlib", "zlib"), ("boost software", "bsl"), ("artistic", "artistic"), ("eclipse public", "epl"), ("epl", "epl"), ("mozilla public", "mpl"), ("mpl", "mpl"),
    ("gnu general public", "gpl"), ("gpl", "gpl"), ("gnu lesser general public", "lgpl"), ("lgpl", "lgpl"), ("gnu affero general public", "agpl"), ("agpl", "agpl"),
    ("sil open font", "ofl"), ("microsoft public", "ms-pl"), ("european union public", "eupl"), ("postgresql", "postgresql"), ("python software foundation", "psf"),
    ("common development and distribution", "cddl"), ("academic free", "afl"), ("open database", "odbl"), ("creative commons attribution", "cc-by"),
    ("creative commons attribution sharealike", "cc-by-sa"), ("creative commons attribution share alike", "cc-by-sa"), ("creative commons attribution noncommercial", "cc-by-nc"),
]
#: Sentences around a name; versions and kinds of the short Creative Commons notices.
SENTENCES = ("licensed under the {} license", "released under the {} license", "distributed under the {} license", "subject to the terms of the {} license")
COMMONS, VERSIONS = ("by", "by sa", "by nc", "by nd", "by nc sa", "by nc nd"), ("2 0", "2 5", "3 0", "4 0")
#: Other notices, with their labels. One error is allowed for every ERRORS_PER characters.
NOTICES = [
    *[(sentence.format(name), label) for name, label in NAMES for sentence in SENTENCES],
    *[(f"{before}cc {kind} {version}", f"cc-{kind.replace(' ', '-')}") for before in ("", "licensed under ") for kind in COMMONS for version in VERSIONS],
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    ("licensed under the apache license version 2 0", "apache"),
    ("licensed under the gnu general public license version 2", "gpl"),
    ("licensed under the gnu general public license version 3", "gpl"),
    ("redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("redistribute it and or modify it under the terms of the gnu lesser general public license", "lgpl"),
    ("redistribute it and or modify it under the terms of the gnu affero general public license", "agpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl"),
    ("this program and the accompanying materials are made available under the terms of the eclipse public license", "epl"),
    ("permission to use copy modify and or distribute this software for any purpose", "isc"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("to the extent possible under law the author has dedicated all copyright", "cc0"),
    ("cc0 1 0 universal", "cc0"),
    ("distributed under the boost software license version 1 0", "bsl"),
    ("all rights reserved", "reserved"),
]
ERRORS_PER = 12
#: Words that must stand unchanged: those of names and versions.
NAMING = {w for name, _ in NAMES for w in name.split()} - {"and"} | set("cc cc0 by sa nc nd reserved 0 1 2 3 5".split())
#: Letters of the groups that a window must share with a notice.
GROUP = 4

#: Byte table: A-Z to a-z, ASCII characters outside words to a space, all others as they are.
FOLD = bytes(
    b if b >= 128 or chr(b) in "0123456789abcdefghijklmnopqrstuvwxyz" else b + 32 if 65 <= b <= 90 else 32 for b in range(256)
)
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def errors_allowed(notice: str) -> int:
    return max(1, len(notice) // ERRORS_PER)


def pieces(notice: str) -> list[tuple[int, str]]:
    """Offsets and texts of one piece more than there may be errors."""
    n = errors_allowed(notice) + 1
    cuts = [len(notice) * k // n for k in range(n + 1)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:])]


def pattern(notice: str, errors: int) -> str:
    """The notice between word ends, with errors between the naming words; their sum is checked by the caller."""
    parts, loose = [], []

    def close():
        if loose:
            parts.append(f"(?:{regex.escape(' '.join(loose))}){{e<={errors}}}")
            loose.clear()

    for word in notice.split(" "):
        if word in NAMING:
            close()
            parts.append(regex.escape(word))
        else:
            loose.append(word)
    close()
    return f"(?b)(?<![^ ])(?:{' '.join(parts)})(?![^ ])"


def groups_of(text: str) -> Counter:
    return Counter(text[k : k + GROUP] for k in range(len(text) - GROUP + 1))


@lru_cache(maxsize=4)
def matchers(notices: tuple[tuple[str, str], ...]):
    """Automaton over all pieces; for each notice its letter groups and its patterns, few errors first."""
    seeds: dict[str, list[tuple[int, int]]] = {}
    for k, (notice, _) in enumerate(notices):
        for offset, piece in pieces(notice):
            seeds.setdefault(piece, []).append((k, offset))
    automaton = ahocorasick.Automaton()
    for piece, where in seeds.items():
        automaton.add_word(piece, (len(piece), where))
    automaton.make_automaton()
    return automaton, [groups_of(n) for n, _ in notices], {}


def compiled(cache: dict, notice: str, k: int, errors: int):
    if (k, errors) not in cache:
        cache[k, errors] = regex.compile(pattern(notice, errors))
    return cache[k, errors]


def match_in(folded: str, start: int, k: int, notice: str, groups: Counter, cache: dict) -> tuple[int, int, int, int] | None:
    """(start, end, notice, errors) of a notice in the window around a place, if it is there."""
    end, most = start + len(notice), errors_allowed(notice)
    if start >= 0 and folded.startswith(notice, start):
        return (start, end, k, 0) if folded[end : end + 1] in ("", " ") and (start == 0 or folded[start - 1] == " ") else None
    low, high = max(0, start - most), max(0, end + most)
    window = folded[low:high]
    if not all(w in window for w in notice.split(" ") if w in NAMING):
        return None
    near = groups_of(window)
    # an error spoils GROUP letter groups at most
    if sum(min(n, near[g]) for g, n in groups.items() if g in near) < len(notice) - GROUP + 1 - GROUP * most:
        return None
    tried = 1
    while True:
        m = compiled(cache, notice, k, tried).search(folded, low, min(high, len(folded)))
        if m and sum(m.fuzzy_counts) <= most:
            return m.start(), m.end(), k, sum(m.fuzzy_counts)
        if tried == most:
            return None
        tried = min(2 * tried, most)


def fuzzy_spans(folded: str, notices=tuple(NOTICES)) -> list[tuple[int, int, int, int]]:
    """(start, end, notice, errors) in the folded text, in order, not overlapping."""
    automaton, groups, cache = matchers(notices)
    windows = set()
    for last, (size, where) in automaton.iter(folded):
        for k, offset in where:
            windows.add((k, last + 1 - size - offset))
    found = {match_in(folded, start, k, notices[k][0], groups[k], cache) for k, start in windows} - {None}
    out: list[tuple[int, int, int, int]] = []  # in order and not overlapping, so only the neighbours matter
    for span in sorted(found, key=lambda x: (ERRORS_PER * x[3] - len(notices[x[2]][0]), *x)):
        at = bisect_left(out, span)
        if (at == 0 or out[at - 1][1] <= span[0]) and (at == len(out) or span[1] <= out[at][0]):
            insort(out, span)
    return out


def spaces_before(text, space, places: list[int]) -> list[int]:
    """Number of spaces before each of the ascending places, counted in one pass over the text."""
    out, total, last = [], 0, 0
    for at in places:
        total, last = total + text.count(space, last, at), at
        out.append(total)
    return out


def phrase_places(folded: bytes) -> list[tuple[int, str]]:
    """Word index and label of each place of a phrase; `folded` has one space around every word."""
    found = []
    for phrase, label in PHRASES:
        wanted, at = f" {phrase} ".encode(), -1
        while (at := folded.find(wanted, at + 1)) >= 0:
            found.append((at, label))
    found.sort()
    return list(zip(spaces_before(folded, b" ", [at for at, _ in found]), (label for _, label in found)))


def scan(text: str | None, notices=tuple(NOTICES)) -> tuple:
    """One result row; spans of notices are label:start:end:errors in code points of the text."""
    words = utf8(text).translate(FOLD).split()
    folded = b" %b " % b" ".join(words)
    base = phrase_places(folded)
    clear = folded[1:-1].decode("utf-8", "surrogatepass")
    fuzzy = fuzzy_spans(clear, notices)
    base_labels = {label for _, label in base}
    spans = []
    if fuzzy:
        where = [m.span() for m in WORD.finditer(text)]
        for (start, end, k, errors), before in zip(fuzzy, spaces_before(clear, " ", [f[0] for f in fuzzy])):
            inside = clear[start:end].strip()
            first = before + (clear[start] == " ")
            last = first + inside.count(" ")
            spans.append(f"{notices[k][1]}:{where[first][0]}:{where[last][1]}:{errors}")
    score = 1.0 if base else max((1 - errors / len(notices[k][0]) for _, _, k, errors in fuzzy), default=0.0)
    labels = base_labels | {notices[k][1] for _, _, k, _ in fuzzy}
    return (
        len(words), len(base), base[0][0] if base else None, base[-1][0] if base else None, ",".join(sorted(base_labels)),
        ",".join(sorted(labels)), score, ",".join(spans),
    )


RESULT = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]


@F.pandas_udf(
    row_type("n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans string")
)
def scanned(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in texts:
        out = pd.DataFrame([scan(t) for t in batch], columns=RESULT)
        yield out.astype({"first_word": "Int64", "last_word": "Int64"})


def find_licenses(docs: DataFrame) -> DataFrame:
    """Documents with their license labels, the places of the phrases, and the spans of the notices."""
    others = [c for c in docs.columns if c not in RESULT and c != "text"]
    return docs.select(F.struct(*[F.col(c) for c in others]).alias("_row"), scanned("text").alias("_found")).select("_row.*", "_found.*")
