"""Main text of web pages: markup rules, and differencing of each page against the page with the nearest URL on its host.

A page is cut into lines, one for each block of its markup. Pages of a host are put in order of their URL paths; each is paired with the
neighbour that shares the longer path prefix. Their lines are aligned by longest common subsequence, and shared lines are deleted:
they come from the site's template. Markup decides first: what stands in menus, headers, footers, sidebars, notices, adverts, forms or
comments goes in any case, and where a page marks its article, lines outside of it go, too. Within a marked article a shared line may as well be a
sentence that two articles have in common. There it goes only if the neighbour on the other side (if there is one) shares it, too, and it stands on at
least half of the host's different pages, and on PROVEN of them.
Copies share it all, so they are told by the text that markup lets through: where nearly all of both pages is shared, the neighbour is
a copy and its lines stay; where a smaller part, but most of the page is shared, it may be an edited copy. In both cases the page is
aligned with its neighbour on the other side, too, and what that one shares goes: all of it if it isn't a copy itself, and beside an edited
copy the lines shared with both.

An element that its tag, role or class would drop stays if it holds the article: an <article> or <main> where no other place has one (and,
but for a form, longer than what stands outside of dropped elements); a form, class or id also if it holds most of the page's text. Comments go in any case. Class names and ids count whole.
Scripts, styles, form controls, titles, frames, vector graphics and what stands in for scripts, audio or video are no text.

Null or empty html has no text. A url that is null or has no "://" has an empty host and path; such pages are neighbours of each other
only. Pages of one host and path have the same neighbour. Identical rows give identical results. Other columns pass through; those
named like a result are replaced by it. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import html as entities
import re
import zlib
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from permspark.llm.ordered import neighbours
from permspark.llm.text import KINDS, LOWER, UPPER, row_type
from permspark.sources.writers import staged

#: Share of the text of both pages that shared lines must reach to count as a copy.
COPY_SHARE = 0.9
#: Share of a page's text from which the neighbour may be an edited copy.
EDITED_SHARE = 0.6
#: Different pages of a host on which a line of a marked article must stand to be one of the template.
PROVEN = 3

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)
      | <(script|style|textarea|iframe|title)\b[^>]*+>.*?(?:</\1\s*>|\Z)
      | <(/?)([a-z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)(?:>|\Z)
      | <[/!?a-z][^>]*+>?""",
    re.S | re.I | re.X,
)
#: Elements without text of the page, if they are closed; else only the tag is dropped.
SILENT = {name: re.compile(rf"</{name}\s*>", re.I) for name in ("noscript", "template", "svg", "select", "audio", "video")}
ATTRIBUTE = re.compile(r"""([a-z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: An element that starts ends an open one of these kinds first, inside the nearest container.
IMPLIED = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
CLOSES_P = BLOCKS - {"li", "td", "th", "tr", "caption", "body", "html", "head", "summary", "option"}
DROPPED = set("nav footer aside menu dialog button fieldset".split())
ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: Class names and ids of what isn't the article.
MARKS = set(
    "ad ads adbox adslot advert adverts advertisement advertising banner sponsor sponsored promo promos promotion sidebar sidenav menu nav "
    "navbar navigation breadcrumb breadcrumbs footer masthead topbar cookie cookies consent gdpr notice notices popup modal overlay "
    "newsletter subscribe subscription signup share sharing social related recommended recommendations widget widgets toolbar pagination "
    "pager copyright login searchbox ad-container ad-wrapper ad-slot ad-banner ad-unit ads-container sponsored-content sidebar-left "
    "sidebar-right left-sidebar right-sidebar site-sidebar site-header site-footer page-footer main-footer main-menu main-nav "
    "main-navigation site-nav site-navigation nav-menu nav-links post-navigation top-nav top-bar side-bar cookie-banner cookie-notice "
    "cookie-consent newsletter-signup newsletter-form subscribe-form share-buttons share-links social-share social-links social-icons "
    "social-media related-posts related-articles related-links related-content recommended-posts widget-area".split()
)
#: Those of readers' comments, which may be longer than the article.
DISCUSSION = set(
    "comment comments disqus disqus_thread replies respond comments-area comments-section comment-list comment-body comment-content "
    "comment-respond comment-form".split()
)
KEPT_ROOTS = {"html", "body", "main"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
STOPS = {"li": {"ul", "ol", "menu"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "dt": {"dl"}, "dd": {"dl"}}

DROP, PLAIN, MAIN, ARTICLE = range(4)
#: How firmly an element is dropped. A form stays if it holds the page's article, others only if that is longer than what stands outside of
#: dropped elements; a form or class also if it holds most of the page's text; comments never.
FORM, CLASS, FIRM, FINAL = range(4)
Line = tuple[str, int]


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(text)}


def _zone(name: str, attributes: str, zone: int) -> tuple[int, int | None]:
    """Zone of an element's content, from the zone around it, and how firmly the element is dropped, if it is."""
    inner = ARTICLE if name == "article" else max(zone, MAIN) if name == "main" else zone
    dropped = FORM if name == "form" else FIRM if name in DROPPED or (name == "header" and zone < MAIN) else None
    if attributes and name not in KEPT_ROOTS:
        given = _attributes(attributes)
        role = given.get("role", "").lower()
        words = set(f"{given.get('class', '')} {given.get('id', '')}".lower().split())
        hidden = "display:none" in given.get("style", "").replace(" ", "").lower() or given.get("aria-hidden", "").lower() == "true"
        if role == "main":
            inner = max(inner, MAIN)
        if words & DISCUSSION and name not in HEADINGS:
            dropped = FINAL
        elif dropped is None and role in ROLES:
            dropped = FORM if role == "form" else FIRM
        elif dropped is None and hidden:
            dropped = FIRM
        elif dropped is None and name not in HEADINGS and (words & MARKS or ("header" in words and zone < MAIN)):
            dropped = CLASS
    return inner, dropped


class Wrappers:
    """The dropped elements of a page, each after the one around it, with the sizes of the text in them."""

    def __init__(self):
        self.outer: list[int] = []
        self.kind: list[int] = []
        self.around: list[int] = []

    def add(self, outer: int, kind: int, zone: int) -> int:
        self.outer.append(outer)
        self.kind.append(kind)
        self.around.append(zone)
        return len(self.kind) - 1

    def reopened(self, lines: list[tuple[str, int, int]]) -> set[int]:
        """Those that hold the article, from lines (text, zone, innermost wrapper or -1)."""
        n = len(self.kind)
        size, marked, top, inside = [0] * n, [0] * n, [PLAIN] * n, [[] for _ in range(n)]
        best, kept = DROP, 0
        own: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for text, zone, at in lines:
            if at < 0:
                best, kept = max(best, zone), kept + len(text)
                continue
            own[at].append((len(text), zone))
            size[at] += len(text)
            if zone > max(self.around[at], PLAIN):
                top[at], marked[at] = max(top[at], zone), marked[at] + len(text)
        for k in range(n - 1, -1, -1):
            outer = self.outer[k]
            if outer < 0 or self.kind[k] == FINAL:
                continue
            inside[outer].append(k)
            size[outer] += size[k]
            if self.around[k] > self.around[outer]:  # all of it stands in an article of the outer one
                top[outer] = max(top[outer], top[k], self.around[k] if size[k] else PLAIN)
                marked[outer] += size[k]
            else:
                top[outer] = max(top[outer], top[k])
                marked[outer] += marked[k]
        total = kept + sum(size[k] for k in range(n) if self.outer[k] < 0 and self.kind[k] != FINAL)
        queue = [(self.kind[k], k) for k in range(n) if self.outer[k] < 0]
        heapq.heapify(queue)
        out = set()
        while queue:
            kind, k = heapq.heappop(queue)
            article = top[k] > PLAIN and best < MAIN and (kind == FORM or marked[k] > kept)
            most = kind <= CLASS and 2 * size[k] > total
            if kind == FINAL or not (article or most):
                continue
            out.add(k)
            for length, zone in own[k]:
                best, kept = max(best, zone), kept + length
            for inner in inside[k]:
                heapq.heappush(queue, (self.kind[inner], inner))
        return out


def lines_of(page: str | None) -> list[Line]:
    """Every block with text, in order: (text, zone)."""
    if not page:
        return []
    out: list[tuple[str, int, int]] = []
    stack: list[tuple[str, int, int]] = []
    places: dict[str, list[int]] = {}  # of the open elements of each name, so that nothing is searched for in a deep stack
    wrappers, unclosed = Wrappers(), set()
    zone, wrapper, held, at = PLAIN, -1, [], 0

    def flush():
        text = " ".join(entities.unescape("".join(held)).split())
        held.clear()
        if text:
            out.append((text, zone, wrapper))

    def close(name: str, stops=frozenset()):
        nonlocal zone, wrapper
        if not places.get(name):
            return
        k = places[name][-1]
        if any(places[stop][-1] > k for stop in stops if places.get(stop)):
            return
        after = stack[k - 1][1:] if k else (PLAIN, -1)
        if after != (zone, wrapper) or any(x[0] in BLOCKS for x in stack[k:]):  # an inline element doesn't end the line
            flush()
        for other, *_ in stack[k:]:
            places[other].pop()
        del stack[k:]
        zone, wrapper = after

    while m := TOKEN.search(page, at):
        if m.start() > at:
            held.append(page[at : m.start()])
        at = m.end()
        name = m[3] and m[3].lower()
        if not name:
            continue
        if m[2]:
            if name in BLOCKS:
                flush()
            close(name)
            continue
        if name in SILENT:
            if name not in unclosed and not m[4].endswith("/"):
                if end := SILENT[name].search(page, at):
                    at = end.end()
                else:
                    unclosed.add(name)
            continue
        if name in BLOCKS or name == "br":
            if name == "br":
                held.append(" ")
                continue
            flush()
            if name in CLOSES_P:
                close("p", {"td", "th", "button", "li"})
            for other in IMPLIED.get(name, ()):
                if other != "p":
                    close(other, STOPS.get(name, frozenset()))
        if name not in VOID and not m[4].endswith("/"):
            inner, dropped = _zone(name, m[4], zone)
            if inner != zone or dropped is not None:
                flush()
            if dropped is not None:
                wrapper = wrappers.add(wrapper, dropped, zone)
            places.setdefault(name, []).append(len(stack))
            stack.append((name, inner, wrapper))
            zone = inner
    held.append(page[at:])
    flush()
    stays = wrappers.reopened(out) | {-1}
    return [(text, zone if at in stays else DROP) for text, zone, at in out]


def line_keys(lines: list[Line]) -> list[int]:
    return [xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - 2**63 for text, _ in lines]


def _rows(a: list[int], b: list[int]) -> Iterator[int]:
    """Bit-parallel longest common subsequence: after each line of a, zero bits mark where the length grows along b."""
    where: dict[int, int] = {}
    for j, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    v = full
    for x in a:
        u = v & where.get(x, 0)
        v = ((v + u) | (v - u)) & full
        yield v


def _align(a: list[int], b: list[int], offset: int, most: int) -> list[int]:
    """Indices of a in a longest common subsequence with b; halves a until its rows fit `most` bits."""
    if not a or not b:
        return []
    if len(a) == 1:
        return [offset] if a[0] in b else []
    if len(a) * len(b) <= most:
        rows, out, j = list(_rows(a, b)), [], len(b)
        for i in range(len(a) - 1, -1, -1):
            if not j:
                break
            length = j - (rows[i] & ((1 << j) - 1)).bit_count()
            above = j - (rows[i - 1] & ((1 << j) - 1)).bit_count() if i else 0
            if length > above:
                out.append(offset + i)
                # the match lies where the length of this row grows to `length`
                grown = [k for k in range(j) if not rows[i] >> k & 1] if j < 64 else None
                if grown is None:
                    low, high = 0, j
                    while low < high:
                        mid = (low + high) // 2
                        if mid + 1 - (rows[i] & ((1 << (mid + 1)) - 1)).bit_count() >= length:
                            high = mid
                        else:
                            low = mid + 1
                    j = low
                else:
                    j = grown[length - 1]
        return out[::-1]
    half = len(a) // 2
    head = tail = 0
    for head in _rows(a[:half], b):
        pass
    for tail in _rows(a[:half - 1 : -1] if half else a[::-1], b[::-1]):
        pass
    n, best, cut = len(b), -1, 0
    grown_head = [0]
    for k in range(n):
        grown_head.append(grown_head[-1] + (not head >> k & 1))
    grown_tail = [0]
    for k in range(n):
        grown_tail.append(grown_tail[-1] + (not tail >> k & 1))
    for k in range(n + 1):
        if grown_head[k] + grown_tail[n - k] > best:
            best, cut = grown_head[k] + grown_tail[n - k], k
    return _align(a[:half], b[:cut], offset, most) + _align(a[half:], b[cut:], offset + half, most)


def shared_lines(a: list[int], b: list[int], most: int = 1 << 26) -> list[int]:
    """Indices of the lines of a in a longest common subsequence with b. Memory stays within `most` bits."""
    known = set(b)
    if known.isdisjoint(a):
        return []
    start = 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    end = 0
    while end < min(len(a), len(b)) - start and a[-1 - end] == b[-1 - end]:
        end += 1
    own = set(a)
    middle = [(i, x) for i, x in enumerate(a[start : len(a) - end], start) if x in known]
    other = [x for x in b[start : len(b) - end] if x in own]
    found = _align([x for _, x in middle], other, 0, most)
    return [*range(start), *[middle[k][0] for k in found], *range(len(a) - end, len(a))]


def wanted_lines(lines: list[Line]) -> tuple[bool, list[int]]:
    """Whether the page marks its article, and the numbers of the lines that markup lets through."""
    best = max((zone for _, zone in lines), default=DROP)
    return best > PLAIN, [k for k, (_, zone) in enumerate(lines) if zone == best and zone != DROP]


def candidates(page: str | None) -> tuple[bool, list[int], list[str]]:
    """Whether the page marks its article, and numbers and texts of the lines that markup lets through."""
    lines = lines_of(page)
    marked, wanted = wanted_lines(lines)
    return marked, wanted, [lines[k][0] for k in wanted]


def line_sizes(lines: list[Line]) -> list[int]:
    """Length of each line that markup lets through, 0 for the others."""
    wanted = set(wanted_lines(lines)[1])
    return [len(text) if k in wanted else 0 for k, (text, _) in enumerate(lines)]


def _shares(keys: list[int], sizes: list[int], other: list[int], others: list[int]) -> tuple[list[int], float, bool]:
    """Shared lines with another page, their share of the page's text, and whether the other one is a copy."""
    shared = shared_lines(keys, other)
    own = sum(sizes[k] for k in shared) / max(sum(sizes), 1)
    if own < COPY_SHARE:
        return shared, own, False
    return shared, own, sum(others[k] for k in shared_lines(other, keys)) >= COPY_SHARE * sum(others)


def template_of(keys: list[int], sizes: list[int], marked: bool, near: tuple | None, far: tuple | None) -> tuple[list[int], list[int]]:
    """(shared, gone): lines shared with the nearest page, and those that come from the template; near and far are (keys, sizes).

    On a marked page, those that may come from it.
    """
    if near is None:
        return [], []
    shared, share, copy = _shares(keys, sizes, *near)
    if not copy and share < EDITED_SHARE and (far is None or not marked):
        return shared, shared
    if far is None:
        return shared, []
    beyond, _, again = _shares(keys, sizes, *far)
    if again and (copy or share >= EDITED_SHARE):
        return shared, []
    return shared, beyond if copy else sorted(set(shared) & set(beyond))


def main_text(numbers: list[int], texts: list[str], gone: list[int]) -> str:
    """Text of the candidates that stay."""
    dropped = set(gone)
    return "\n\n".join(t for k, t in zip(numbers, texts) if k not in dropped)


LINES = row_type("keys array<long>, sizes array<long>, marked boolean")


@F.pandas_udf(LINES)
def keys_of(pages: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in pages:
        found = [lines_of(p) for p in batch]
        yield pd.DataFrame({"keys": [line_keys(x) for x in found], "sizes": [line_sizes(x) for x in found], "marked": [wanted_lines(x)[0] for x in found]})


@F.pandas_udf(row_type("shared array<long>, gone array<long>"))
def template_in(pairs: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
    for columns in pairs:
        rows = []
        for row in zip(*columns):
            own, near, far = ([None if x is None else x.tolist() for x in row[k : k + 2]] for k in (1, 3, 5))
            rows.append(template_of(*own, row[0], *(None if x[0] is None else tuple(x) for x in (near, far))))
        yield pd.DataFrame({"shared": [r[0] for r in rows], "gone": [r[1] for r in rows]})


CANDIDATES = row_type("numbers array<long>, packed binary")


@F.pandas_udf(CANDIDATES)
def candidates_of(pages: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Candidates with their texts packed, so that the shuffle moves less."""
    for batch in pages:
        rows = [candidates(p) for p in batch]
        packed = [zlib.compress("\n".join(texts).encode("utf-8", "surrogatepass"), 1) for _, _, texts in rows]
        yield pd.DataFrame({"numbers": [r[1] for r in rows], "packed": packed})


@F.pandas_udf(KINDS["string"])
def text_of(parts: Iterator[tuple[pd.DataFrame, pd.Series]]) -> Iterator[pd.Series]:
    for found, template in parts:
        out = []
        for numbers, packed, gone in zip(found["numbers"], found["packed"], template):
            texts = zlib.decompress(packed).decode("utf-8", "surrogatepass").split("\n") if len(numbers) else []
            out.append(main_text(numbers.tolist(), texts, [] if gone is None else gone.tolist()))
        yield pd.Series(out, dtype=object)


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def common_prefix(a: Column, b: Column) -> Column:
    """Number of leading path parts that both have."""
    same = F.zip_with(F.split(a, "/"), F.split(b, "/"), lambda x, y: x.eqNullSafe(y))
    first = F.array_position(same, F.lit(False))
    return F.when(first > 0, first - 1).otherwise(F.size(same))


def template_lines(pages: DataFrame) -> DataFrame:
    """(page_id, _h, shared, gone, neighbour): lines of each page that its neighbour shares, and those of the template; _h is a hash of url and html."""
    host, path = host_and_path(F.col("url"))
    slim = pages.select("page_id", F.xxhash64("url", "html").alias("_h"), host.alias("host"), path.alias("path"), keys_of("html").alias("lines"))
    slim = staged(slim.distinct())
    paths = slim.groupBy("host", "path").agg(F.min_by("lines", F.struct("page_id", "_h")).alias("lines"))
    beside = neighbours(paths, ["host"], ["path"], "lines")
    before, after = F.col("before"), F.col("after")
    nearer = F.coalesce(common_prefix(F.col("path"), after["path"]), F.lit(-1)) > F.coalesce(common_prefix(F.col("path"), before["path"]), F.lit(-1))
    near, far = F.when(nearer, after).otherwise(before), F.when(nearer, before).otherwise(after)
    paired = staged(beside.select(F.col("host").alias("_host"), F.col("path").alias("_path"), near.alias("near"), far["lines"].alias("far")))
    met = slim.join(paired, (F.col("host") == F.col("_host")) & (F.col("path") == F.col("_path")), "left")
    sides = [F.col(f"{side}.{part}") for side in ("lines", "near.lines", "far") for part in ("keys", "sizes")]
    found = met.select("page_id", "_h", "host", "lines", template_in("lines.marked", *sides).alias("_t"), F.col("near.path").alias("neighbour"))
    at_gone = F.transform("_t.gone", lambda k: F.get("lines.keys", k.cast("int")))
    found = staged(found.select("page_id", "_h", "host", "lines.marked", "_t.shared", "_t.gone", at_gone.alias("gone_keys"), "neighbour"))
    proven = template_keys(slim, found).select(F.col("host").alias("_host"), "proven")
    pairs = F.arrays_zip(F.col("gone").alias("gone"), F.col("gone_keys").alias("key"))
    sure = F.transform(F.filter(pairs, lambda p: F.array_contains(F.coalesce("proven", F.array().cast("array<long>")), p["key"])), lambda p: p["gone"])
    out = found.join(proven, F.col("host") == F.col("_host"), "left")
    return out.select("page_id", "_h", "shared", F.when(F.col("marked"), sure).otherwise(F.col("gone")).alias("gone"), "neighbour")


def template_keys(slim: DataFrame, found: DataFrame) -> DataFrame:
    """(host, proven): of the lines that may go from marked articles, those on at least half of the host's different pages; few for each host."""
    asked = staged(found.filter("marked").select("host", F.explode("gone_keys").alias("key")).distinct())
    own = F.col("lines.keys")
    content = slim.select("host", F.xxhash64(own).alias("content"), own.alias("keys"))
    totals = content.join(asked, "host", "left_semi").groupBy("host").agg(F.count_distinct("content").alias("total"))
    rows = content.select("host", "content", F.explode(F.array_distinct("keys")).alias("key")).join(asked, ["host", "key"], "left_semi")
    counts = rows.groupBy("host", "key").agg(F.count_distinct("content").alias("n"))
    enough = counts.join(totals, "host").filter((F.col("n") >= PROVEN) & (2 * F.col("n") >= F.col("total")))
    return staged(enough.groupBy("host").agg(F.collect_list("key").alias("proven")))


def extract(pages: DataFrame) -> DataFrame:
    """Pages with their main `text` and its length `n_chars` in code points."""
    found = template_lines(pages).select(F.col("page_id").alias("_p"), F.col("_h").alias("_g"), "shared", "gone", "neighbour")
    others = [c for c in pages.columns if c not in ("html", "text", "n_chars", "n_shared", "neighbour")]
    row = pages.select(F.struct(*[F.col(c) for c in others]).alias("_row"), F.col("page_id").alias("_id"), candidates_of("html").alias("_c"), F.xxhash64("url", "html").alias("_h"))
    met = row.join(found, F.col("_id").eqNullSafe(F.col("_p")) & (F.col("_h") == F.col("_g")))
    out = met.select("_row", text_of("_c", "gone").alias("text"), F.size("shared").cast("long").alias("n_shared"), "neighbour")
    return out.select("_row.*", "text", F.char_length("text").cast("long").alias("n_chars"), "n_shared", "neighbour")
