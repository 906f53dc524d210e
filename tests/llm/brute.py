"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from functools import cache

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def leaks(docs, items, window=13, subs=2, tolerant=5, least=1):
    """{(doc_id, item_id): sorted starts} by trying every alignment."""
    cut = lambda t: tuple(w for w in re.sub(r"[\W_]+", " ", (t or "").lower()).split(" ") if w)
    out = defaultdict(set)
    for d, text in docs:
        w = cut(text)
        known = set(w)
        for i, item in items:
            v = cut(item)
            n = min(window, len(v))
            spare = subs if n == window else int(n >= tolerant)
            if n < least:
                continue
            for a in range(len(v) - n + 1):
                if sum(x not in known for x in v[a : a + n]) > spare:
                    continue
                for p in range(len(w) - n + 1):
                    if sum(x != y for x, y in zip(v[a : a + n], w[p : p + n])) <= spare:
                        out[d, i].add(p)
    return {k: sorted(v) for k, v in out.items()}


def fingerprint(text):
    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    ones = Counter(b for s in shingles for b, bit in enumerate(f"{xxhash.xxh64_intdigest(s.encode(), 42):064b}"[::-1]) if bit == "1")
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def groups(docs, distance=3):
    """{row number: smallest doc_id reachable}"""
    prints = [fingerprint(t) for _, t in docs]
    group = list(range(len(docs)))
    for a in range(len(docs)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= distance and group[a] != group[b]:
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    least = {}
    for (d, _), g in zip(docs, group):
        if d is not None:
            least[g] = min(least.get(g, d), d)
    return [least.get(g) for g in group]


def targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    """{source: target} by sharing the excess again and again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    out, open_, left = {}, set(order), share * sum(sizes.values())
    while open_:
        total = sum(weight[s] for s in open_)
        full = {s for s in open_ if left * weight[s] / total >= most * sizes[s]}
        if not full:
            return out | {s: left * weight[s] / total for s in open_}
        for s in full:
            out[s] = most * sizes[s]
        left, open_ = left - sum(out[s] for s in full), open_ - full
    return out


def mix(docs, seed=20):
    """(doc_id, source, size, taken) per row (doc_id, source, text)."""
    sizes = Counter()
    for _, s, t in docs:
        sizes[s] += len(words(t))
    goal, out = targets(sizes), []
    for s in sizes:
        rows = [(hashlib.md5(f"{seed}:{'' if d is None else d}".encode()).hexdigest(), d is not None, d or 0, len(words(t)), d) for d, x, t in docs if x == s]
        epochs, left = divmod(round(goal[s]), sizes[s]) if sizes[s] else (0, 0)
        for _, _, _, n, d in sorted(rows, key=lambda r: r[:4]):
            part = min(left, n)
            left -= part
            out.append((d, s, n, epochs * n + part))
    return out


def quality_stats(text):
    w = words(text)
    grams = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    cover = {j for k in range(len(w) - 4) if grams[tuple(w[k : k + 5])] > 1 for j in range(k, k + 5)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(cover)


def collocations(docs, least, top, longest=5):
    """Rows (lang, rank, phrase, a, l, r, n, score) from docs (lang, text), phrase by phrase."""
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in docs:
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[lang or "und"] += len(w)
            for m in range(1, longest + 1):
                counts[lang or "und"].update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, f in counts.items():
        good = {p for p, a in f.items() if len(p) > 1 and a >= least}
        rows = []
        for p in good:
            inside = any(len(q) > len(p) and f[q] >= f[p] and any(q[i : i + len(p)] == p for i in range(len(q))) for q in good)
            if not inside:
                n = totals[lang]
                score, _, l, r = min((1000 * f[p] * n // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                rows.append((-score, -f[p], " ".join(p).encode(), l, r, n))
        out += [(lang, k + 1, p.decode(), -a, l, r, n, -s) for k, (s, a, p, l, r, n) in enumerate(sorted(rows)[:top])]
    return sorted(out)


def vocabulary(docs, shortest=7, least=2):
    """{word: n} from docs (doc_id, text)."""
    n = Counter()
    for d, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += len(run) >= shortest
    return {w: k for w, k in n.items() if k >= least}


def one_edit(a, b):
    """Whether the edit distance is one, by its table."""
    if abs(len(a) - len(b)) > 1:
        return False
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1] == 1


def variants(words, times=10):
    """Rows (word, form, root, n, n_near, form_n) by comparing all words."""
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, others in near.items():
        if others:
            best = min(others, key=lambda v: (-words[v], v))
            if words[best] >= times * words[w]:
                form[w] = best

    def root(w):
        return root(form[w]) if w in form else w

    return sorted((w, form.get(w), root(w), words[w], len(near[w]), words.get(form.get(w))) for w in words)
