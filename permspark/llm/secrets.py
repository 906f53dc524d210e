"""Secret scan with multipart credential linking.

Strong findings (assignments, access identifiers, long hex runs) are reported by themselves. Weak candidates (names of
accounts, short or unlabelled secrets, endpoints) are reported only where a complementary part stands in the same scope: an interval
join of the parts of one document, over the bounds of their scopes. A scope is a run of lines without an empty line between them.
`scan` and `linked` can narrow that to a reach in characters; `find_secrets` doesn't. Each document is scanned whole, by itself: no shuffle.

An unlabelled secret is a run of at least 24 characters of base64 with upper and lower case and 3 digits. In the scope of an access identifier
length and entropy decide instead of case and digits.

A null text counts as empty and has no finding. Repeated rows are scanned alike. Other columns pass through; those named like a
result are replaced by it. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from math import log2

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from permspark.llm.text import row_type

#: Farthest gap, in characters, between linked parts, unless another is given; None: the whole scope.
REACH = 160
#: Least entropy, in bits a character, of an unlabelled secret beside an access identifier.
ENTROPY = 3.0

#: The base patterns.
ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")

_LABELLED = r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9@+/_.=-]%s)"""
WEAK_ID = re.compile(r"(?ai)(?<![a-z0-9])(access_?key_?id|client_?id|user_?name|user_?id|user|login|account_?id|account)" + _LABELLED % "+")
WEAK_SECRET = re.compile(r"(?ai)(?<![a-z0-9])(passphrase|pass|pwd|private_?key|access_?key|auth_?key|auth|credential)" + _LABELLED % "{4,}")
BARE_SECRET = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{24,}={0,2}")
ENDPOINT = re.compile(
    r"""(?ai)(?<![a-z0-9])(?:[a-z][a-z0-9+.-]{1,20}://[^\s"'<>]{3,}|(?:host|server|endpoint|database_?url|database)["']?\x20*[:=]\x20*["']?[a-z0-9][a-z0-9.:/_-]{3,}"""
    r"""|[0-9]{1,3}(?:\.[0-9]{1,3}){3}:[0-9]{2,5}(?![0-9]))"""
)
BREAK = re.compile(r"\n[ \t\r]*(?=\n)")

BASE = ["assign", "access", "hex"]
#: A labelled secret of letters alone may be a word of the sentence: it is reported, as weak_secret, beside an account or access identifier only.
KINDS = [*BASE, "weak_id", "weak_secret", "endpoint", "plain_secret"]
#: For each weak kind, the kinds of which one must be near.
NEEDS = {
    "weak_id": ["assign", "hex", "weak_secret", "plain_secret"],
    "weak_secret": ["access", "weak_id", "endpoint"],
    "plain_secret": ["access", "weak_id"],
    "endpoint": ["assign", "access", "hex", "weak_secret"],
}

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """Strong findings, leftmost and not overlapping within a kind."""
    out: list[Span] = []
    if "=" in text or ":" in text:
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    return out + [("hex", m.start(), m.end()) for m in HEX.finditer(text)]


def _mixed(value: str) -> bool:
    return any(c.islower() for c in value) and any(c.isupper() for c in value) and sum(c.isdigit() for c in value) >= 3


def _entropy(value: str) -> float:
    n = len(value)
    return -sum(k / n * log2(k / n) for k in Counter(value).values())


def scopes_of(text: str) -> list[int]:
    """Where scopes end, but for the last."""
    return [m.start() for m in BREAK.finditer(text)]


def bare_spans(text: str, strong: list[Span]) -> Iterator[Span]:
    """Unlabelled secrets."""
    breaks = scopes_of(text)
    beside = {bisect_right(breaks, s) for kind, s, _ in strong if kind == "access"}
    for m in BARE_SECRET.finditer(text):
        if _mixed(m[0]) or (beside and bisect_right(breaks, m.start()) in beside and _entropy(m[0]) >= ENTROPY):
            yield "weak_secret", m.start(), m.end()


def weak_spans(text: str, strong: list[Span]) -> list[Span]:
    """Candidates outside the strong findings; of overlapping ones the first kind listed stays."""
    found: list[Span] = []
    if "=" in text or ":" in text:
        found += [("weak_id", m.start(), m.end()) for m in WEAK_ID.finditer(text)]
        found += [("plain_secret" if m[2].isalpha() else "weak_secret", m.start(), m.end()) for m in WEAK_SECRET.finditer(text)]
        found += [("endpoint", m.start(), m.end()) for m in ENDPOINT.finditer(text)]
    if not strong and not found:
        return []  # a bare secret needs another part
    found += bare_spans(text, strong)
    taken = sorted((s, e) for _, s, e in strong)
    out = []
    for span in found:
        at = bisect_left(taken, (span[1], span[1]))
        if (at and taken[at - 1][1] > span[1]) or (at < len(taken) and taken[at][0] < span[2]):
            continue
        taken.insert(at, span[1:])
        out.append(span)
    return out


def linked(text: str, strong: list[Span], weak: list[Span], reach: int | None = REACH) -> list[Span]:
    """Weak candidates with a complementary part in their scope, within reach if there is one."""
    if not weak:
        return []
    breaks, reach = scopes_of(text), len(text) if reach is None else reach
    parts: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    for kind, s, e in strong + weak:
        parts[kind].append((s, e))
    starts = {k: [s for s, _ in v] for k, v in parts.items() if v.sort() is None}
    out = []
    for kind, s, e in weak:
        scope = bisect_right(breaks, s)
        low = max(s - reach, breaks[scope - 1] if scope else 0)
        high = min(e + reach, breaks[scope] if scope < len(breaks) else len(text))
        for other in NEEDS[kind]:
            at = bisect_left(starts[other], high)
            # parts of a kind don't overlap: among those that begin before the end, the last one reaches farthest
            if at and parts[other][at - 1][1] > low:
                out.append(("weak_secret" if kind == "plain_secret" else kind, s, e))
                break
    return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2])))


def scan(text: str | None, reach: int | None = REACH) -> tuple[list[Span], list[Span]]:
    """Strong findings and linked weak ones."""
    text = text or ""
    strong = base_spans(text)
    return strong, linked(text, strong, weak_spans(text, strong), reach)


RESULT = ["n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_linked"]


@F.pandas_udf(row_type("n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_linked long"))
def scanned(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in texts:
        rows = []
        for text in batch:
            strong, weak = scan(text, None)
            counts = [sum(k == kind for k, _, _ in strong) for kind in BASE]
            digest = hashlib.sha256(joined(strong).encode()).hexdigest()
            rows.append((*counts, digest, joined(strong + weak), len(weak)))
        yield pd.DataFrame(rows, columns=RESULT)


def find_secrets(docs: DataFrame) -> DataFrame:
    """Documents with counts of strong findings, their digest, and all spans as kind:start:end in code points."""
    others = [c for c in docs.columns if c not in RESULT and c != "text"]
    return docs.select(F.struct(*[F.col(c) for c in others]).alias("_row"), scanned("text").alias("_found")).select("_row.*", "_found.*")
