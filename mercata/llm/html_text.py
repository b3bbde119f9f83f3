"""HTML extraction by nearest-URL page differencing."""

from __future__ import annotations

import html as entities
import json
import math
import re
import zlib
from bisect import bisect_left, bisect_right
from collections import deque
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .url_filter import url_host, url_path

# Fixed sets of HTML element names, by what they do to text.
BLOCK = set(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html li main menu nav ol optgroup option p pre section summary table tbody tfoot thead tr ul caption".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = set("script style template noscript svg math head title iframe object canvas audio video select textarea button".split())
RAW = set("script style textarea title iframe noscript".split())
CHROME = set("nav footer aside form dialog menu".split())
SPACED = set("td th br".split())
#: Elements whose class, id or role can mark a whole block; those of paragraphs, headings and inline text say nothing about the page's frame.
CONTAINERS = set("div section ul ol dl table header details figure fieldset center".split())
# Words in class, id or role that hint at what is not the article.
MARKS = set(
    "ad ads advert adverts advertisement sponsor sponsored promo banner cookie cookies consent gdpr notice alert sidebar menu nav navbar navigation "
    "breadcrumb breadcrumbs footer masthead comment comments commentlist disqus share sharing social related recommended newsletter subscribe signup login "
    "search popup modal overlay widget toolbar pagination contentinfo complementary skip print".split()
)
# Of these, what needs no second opinion: adverts, cookie notices, sidebars and reader comments.
ADVERTS = set("ad ads advert adverts advertisement sponsor sponsored promo".split())
COMMENTS = set("comment comments commentlist disqus".split())
CERTAIN = ADVERTS | COMMENTS | set("cookie cookies consent gdpr sidebar".split())
# Whole class or id names of an element that is the article; no hint word beside them counts.
ARTICLES = set("post article entry story hentry article-body article-content entry-content post-body post-content story-body main-content".split())
NAME = re.compile(r"[A-Za-z][^\s/>]*")
ATTRIBUTE = re.compile(r"([^\s=\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s]+)))?")
QUOTE_OR_END = re.compile(r"=\s*[\"']|>")
PARTS = re.compile(r"[\s_-]+")


def _tags(html: str) -> Iterator[tuple[int, int, bool, str, str]]:
    """(start, end, closing, name, attributes) of every tag and comment; comments and declarations have an empty name.

    A quote opens a value only behind an equals sign and only if it closes somewhere; a ``<`` that no ``>`` follows is text. Each search that
    fails once is not made again, so the time is linear in the page.
    """
    at, missing = 0, set()

    def find(what: str, start: int) -> int:
        if what in missing:
            return -1
        got = html.find(what, start)
        if got < 0:
            missing.add(what)
        return got

    while (start := html.find("<", at)) >= 0:
        if html.startswith("<!--", start):
            end = find("-->", start + 4)
            at = len(html) if end < 0 else end + 3
            yield start, at, False, "", ""
            continue
        after = html[start + 1 : start + 2]
        closing = after == "/"
        name = NAME.match(html, start + 1 + closing)
        if not name:
            end = find(">", start) if after and after in "!?/" else -1
            if end < 0:
                at = start + 1
                continue
            at = end + 1
            yield start, at, False, "", ""
            continue
        end = name.end()
        while True:
            m = QUOTE_OR_END.search(html, end) if ">" not in missing else None
            if not m:
                missing.add(">")
                end = -1
                break
            if m[0] == ">":
                end = m.end()
                break
            close = find(m[0][-1], m.end())
            end = m.end() if close < 0 else close + 1
        if end < 0:
            at = start + 1
            continue
        at = end
        yield start, end, closing, name[0].lower(), html[name.end() : end - 1]


def _attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(text):
        out.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return out


def _marks(found: dict[str, str], name: str) -> str:
    """The hint words of an element, in order, after ``a:`` if one of them is certain and ``x:`` otherwise; empty for none.

    Any block can be named an advert; other hints count on containers only.
    """
    names = {t for k in ("class", "id", "role") for t in found.get(k, "").lower().split()}
    if names & ARTICLES:
        return ""
    words = {w for t in names for w in PARTS.split(t)} & MARKS if name in CONTAINERS else names & ADVERTS if name in BLOCK else set()
    return f"{'a' if words & CERTAIN else 'x'}:{name}.{'.'.join(sorted(words))}" if words else ""


def _invisible(found: dict[str, str]) -> bool:
    return "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()


def lines_of(html: str | None) -> list[tuple[str, str, str]]:
    """Text lines (kind, text, place) of a page in order, a line for each block.

    kind: ``s`` within a menu, header, footer, form or invisible element, ``a`` within an advert, cookie notice, sidebar or reader comments by class, id
    or role, ``x`` within an element whose class, id or role hints at another frame, ``c`` within an article or main element, ``o`` elsewhere. place:
    for ``s``, ``a`` and ``x`` the element that makes it so. No hint counts for an article or main element, nor for what holds the first of the page; later ones
    may be reader comments. Scripts, styles, controls, comments and the head have no lines.
    """
    out: list[tuple[str, str, str]] = []
    stack: list[tuple[str, bool, str, bool]] = []  # name, unseen, place of the frame element, content
    open_names: dict[str, int] = {}
    held: list[str] = []
    none = ("", False, "", False)
    met = False  # an article or main element

    def flush() -> None:
        if held:
            text = " ".join(entities.unescape("".join(held)).split())
            held.clear()
            if text:
                _, _, place, content = stack[-1] if stack else none
                out.append((place[0] if place else "c" if content else "o", text, place))

    def close(k: int) -> None:
        if any(s[0] in BLOCK for s in stack[k:]):
            flush()
        for s in stack[k:]:
            open_names[s[0]] -= 1
        del stack[k:]

    html = html or ""
    at, skip = 0, ""
    for start, end, closing, name, attributes in _tags(html):
        if skip and not (closing and name == skip):
            continue
        if start > at and not skip and not (stack and stack[-1][1]):
            held.append(html[at:start])
        at, skip = end, ""
        if not name:
            continue
        if closing:
            inline = name not in BLOCK and name not in UNSEEN
            if open_names.get(name):
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == name:
                        close(k)
                        break
                    if (inline or name == "p") and stack[k][0] in BLOCK and stack[k][0] != "p":
                        break
            if name in BLOCK:
                flush()
            continue
        if name in SPACED:
            held.append(" ")
        if name in VOID:
            if name in BLOCK:
                flush()
            continue
        if name in BLOCK:
            for k in range(len(stack) - 1, -1, -1):  # an open paragraph, or item before an item, ends here
                if stack[k][0] == "p" or stack[k][0] == name and name in ("li", "dt", "dd", "option", "tr"):
                    close(k)
                    break
                if stack[k][0] in BLOCK:
                    break
            flush()
        _, unseen, place, content = stack[-1] if stack else none
        unseen = unseen or name in UNSEEN
        if not place and not unseen:
            found = _attributes(attributes) if attributes.strip() else {}
            if name in CHROME or name == "header" and not content or found and name != "body" and _invisible(found):
                place = f"s:{name}"
            elif found:
                place = _marks(found, name)
        if name in ("article", "main") and not unseen:
            if place[:1] in ("a", "x") and not (met and place[0] == "a"):
                place = ""
            met = met or not place
        stack.append((name, unseen, place, content or name in ("article", "main")))
        open_names[name] = open_names.get(name, 0) + 1
        if name in RAW:
            skip = name
    if not skip and at < len(html) and not (stack and stack[-1][1]):
        held.append(html[at:])
    flush()
    return out


def shared_lines(a: list, b: list, cells: int = 1 << 31) -> list[int]:
    """Places in ``a`` of a longest common subsequence with ``b``: bit-parallel rows, split in halves beyond ``cells`` bits."""
    start = 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    end = 0
    while end < min(len(a), len(b)) - start and a[-1 - end] == b[-1 - end]:
        end += 1
    fixed = list(range(start)) + list(range(len(a) - end, len(a)))
    a, b = a[start : len(a) - end], b[start : len(b) - end]
    if not a or not b:
        return fixed

    def rows(a: list, b: list, all_rows: bool) -> list[int]:
        full, at = (1 << len(b)) - 1, {}
        for j, y in enumerate(b):
            at[y] = at.get(y, 0) | 1 << j
        v, out = full, []
        for x in a:
            u = v & at.get(x, 0)
            v = ((v + u) | (v - u)) & full
            if all_rows:
                out.append(v)
        return out if all_rows else [v]

    if len(a) * len(b) > cells and len(a) > 1:
        half = len(a) // 2
        zeros = lambda v: [0] + [int(c == "0") for c in reversed(f"{v:0{len(b)}b}")]
        left, right = zeros(rows(a[:half], b, False)[0]), zeros(rows(a[half:][::-1], b[::-1], False)[0])
        for s in (left, right):
            for j in range(1, len(s)):
                s[j] += s[j - 1]
        k = max(range(len(b) + 1), key=lambda j: left[j] + right[len(b) - j])
        inner = shared_lines(a[:half], b[:k], cells) + [half + i for i in shared_lines(a[half:], b[k:], cells)]
    else:
        v, inner = rows(a, b, True), []
        i, j = len(a), len(b)
        while i and j:
            if v[i - 1] >> (j - 1) & 1:
                j -= 1
            else:
                i -= 1
                if i and not v[i - 1] >> (j - 1) & 1:
                    continue
                inner.append(i)
                j -= 1
    return sorted(fixed + [start + i for i in inner])


def outline(lines: list) -> list[tuple[str, list[int]]]:
    """(key, line numbers) of what differencing aligns: each line outside an article by its text, each run of lines of one frame element by its place.

    The words of menus, adverts and the like change from page to page; that a near page has such an element at the same place tells the frame.
    """
    rows = [(n, place or text) for n, (kind, text, place) in enumerate(lines) if kind != "c"]
    return [(key, [n for n, _ in run]) for key, run in groupby(rows, key=lambda r: r[1])]


def main_text(lines: list, near: list[list[str]], alone: bool = False) -> tuple[str, int]:
    """(text, lines deleted by differencing) of a page's ``lines`` against the outline keys of its ``near`` pages.

    The outline is aligned with that of every near page by longest common subsequence, and what is shared goes: elements that a class word only
    hints at, and plain lines outside an article. A near page that shares over 80 % of the plain text is a copy; its plain lines count for nothing. Lines within
    an article or main element are never compared, since two articles that share lines are copies; menus, footers, forms, adverts, reader comments and
    invisible elements go in any case. Where an article or main element has text, plain lines outside it go too. ``alone``: with no page to
    compare with, hinted elements go unseen, unless nothing else has text: then they hold the article.
    """
    mine = outline(lines)
    keys = [k for k, _ in mine]
    gone: set[int] = set()
    plain = sum(len(t) for k, t, _ in lines if k == "o")
    for theirs in near:
        shared = {n for at in shared_lines(keys, theirs) for n in mine[at][1]}
        if sum(len(lines[n][1]) for n in shared if lines[n][0] == "o") > 0.8 * plain:
            shared = {n for n in shared if lines[n][0] != "o"}
        gone |= shared
    open_lines = [(n, k, t) for n, (k, t, _) in enumerate(lines) if k not in "sa"]
    left = [(k, t) for n, k, t in open_lines if n not in gone and not (alone and k == "x")]
    if any(k == "c" for k, _ in left):
        left = [(k, t) for k, t in left if k != "o"]
    elif not left:
        left = [(k, t) for _, k, t in open_lines if k == "x"]
    return "\n\n".join(t for _, t in left), len(gone)


def _reversed_host(host: Column) -> Column:
    """Labels from the last to the first, so that hosts of one domain stand together."""
    return F.array_join(F.reverse(F.split(host, r"\.")), ".")


def _common(a: str, b: str) -> int:
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    return k


def _edges(keys: DataFrame, k: int) -> list[dict]:
    """For every partition of sorted ``keys``: its number of rows and its first and last ``k`` rows."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, last, n = [], deque(maxlen=k), 0
        for batch in batches:
            rows = [json.dumps(r) for r in batch.slice(0, k - len(first)).to_pylist()] if len(first) < k else []
            first += rows
            last.extend(json.dumps(r) for r in batch.slice(max(0, batch.num_rows - k)).to_pylist())
            n += batch.num_rows
        if n:
            yield pa.RecordBatch.from_pydict({"n": [n], "first": [first], "last": [list(last)]})

    found = keys.mapInArrow(work, "n long, first array<string>, last array<string>").collect()
    load = lambda rows: [json.loads(r) for r in rows]
    return [{"n": r["n"], "first": load(r["first"]), "last": load(r["last"])} for r in found]


def extract_text(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    neighbours: int = 4,
    bucket_chars: int = 8 << 20,
    most_buckets: int = 20_000,
) -> DataFrame:
    """(page_id, url, text, n_chars, n_deleted) for every row.

    Pages are sorted by host (last label first), path and id over all machines. Each is compared with the ``neighbours`` pages on either side
    of it that lie in its host, and ``main_text`` says what goes; a page that is alone in its host takes the one page beside it
    whose host and path have the longer part in common. Buckets of the sort hold about ``bucket_chars`` characters, and tasks about four of them; their
    bounds, at most ``most_buckets``, come to the driver, and the outlines of pages near a bound are copied to the other side, so hosts
    of any size are split and yet paired exactly. A page's lines travel compressed.

    Null and empty pages have empty text; null urls stand in an empty host; repeated rows come back each; an empty table gives none. The
    only page of a table is left to structure alone. Other columns are not read. Batches are as the session sets them.
    """
    id_kind = pages.schema[id_col].dataType.simpleString()
    slim = pages.select(
        F.col(id_col).alias("page_id"),
        F.col(url_col).alias("url"),
        _reversed_host(url_host(F.col(url_col))).alias("host"),
        url_path(F.col(url_col)).alias("path"),
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("name"),
        F.xxhash64(url_col, html_col).alias("digest"),
        F.col(html_col).alias("html"),
    )
    order = ("host", "path", "name", "digest")
    size = slim.agg(F.count("*").alias("rows"), F.sum(F.length("html")).alias("chars")).first()
    n = min(most_buckets, max(1, math.ceil((size["chars"] or 0) / bucket_chars)), max(1, size["rows"]))
    sort_key = lambda r: tuple(r[c] for c in order)
    edges = _edges(slim.select(*order).repartitionByRange(n, *order).sortWithinPartitions(*order), neighbours)
    edges.sort(key=lambda e: sort_key(e["first"][0]))
    counts = [e["n"] for e in edges]
    firsts, lasts = [[sort_key(r) for r in e["first"]] for e in edges], [[sort_key(r) for r in e["last"]] for e in edges]
    lows = [f[0] for f in firsts]

    def places(key: tuple) -> tuple[int, list[int]]:
        """The bucket of a page, and the others to which it is near."""
        home = max(0, bisect_right(lows, key) - 1)
        near, gap, b = [], bisect_left(firsts[home], key), home - 1
        while b >= 0 and gap < neighbours:
            near.append(b)
            gap, b = gap + counts[b], b - 1
        gap, b = len(lasts[home]) - bisect_right(lasts[home], key), home + 1
        while b < len(counts) and gap < neighbours:
            near.append(b)
            gap, b = gap + counts[b], b + 1
        return home, near

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            take, bucket, payload, keys = [], [], [], []
            own = list(zip(*(batch.column(c).to_pylist() for c in order)))
            for k, key in enumerate(own):
                lines = lines_of(batch.column("html")[k].as_py())
                home, near = places(key)
                take.append(k)
                bucket.append(home)
                payload.append(_pack(lines))
                keys.append(None)
                for b in near:
                    take.append(k)
                    bucket.append(b)
                    payload.append(None)
                    keys.append(_pack([key for key, _ in outline(lines)]))
            rows = batch.select(["page_id", "url", *order]).take(pa.array(take, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [*rows.columns, pa.array(bucket, pa.int32()), pa.array(payload, pa.binary()), pa.array(keys, pa.binary())],
                ["page_id", "url", *order, "bucket", "lines", "keys"],
            )

    sent = f"page_id {id_kind}, url string, host string, path string, name string, digest long, bucket int, lines binary, keys binary"
    dealt = slim.mapInArrow(read, sent).repartition(math.ceil(n / 4), "bucket").sortWithinPartitions("bucket", *order)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None
        out: list[tuple] = []
        #: the page in turn, those before it and those after it; a page is (id, url, host, path, lines or null, outline keys)
        before, ahead = deque(maxlen=neighbours), deque()

        def finish() -> None:
            page = ahead.popleft()
            if page[4] is not None:
                after = list(ahead)[:neighbours]
                near = [p for p in [*reversed(before), *after] if p[2] == page[2]]
                if not near:
                    beside = ([before[-1]] if before else []) + after[:1]
                    near = [max(beside, key=lambda p: _common(f"{p[2]}/{p[3]}", f"{page[2]}/{page[3]}"))] if beside else []
                text, deleted = main_text(page[4], [p[5] for p in near], alone=not near)
                out.append((page[0], page[1], text, len(text), deleted))
            before.append(page)

        def batch_of() -> pa.RecordBatch:
            cols = [pa.array(c, t) for c, t in zip(zip(*out), (schema.field(0).type, pa.string(), pa.string(), pa.int64(), pa.int32()))]
            out.clear()
            return pa.RecordBatch.from_arrays(cols, ["page_id", "url", "text", "n_chars", "n_deleted"])

        now = None
        for batch in batches:
            schema = batch.schema
            for row in batch.to_pylist():
                if row["bucket"] != now:
                    while ahead:
                        finish()
                    before.clear()
                    now = row["bucket"]
                lines = None if row["lines"] is None else _unpack(row["lines"])
                keys = _unpack(row["keys"]) if lines is None else [key for key, _ in outline(lines)]
                ahead.append((row["page_id"], row["url"], row["host"], row["path"], lines, keys))
                if len(ahead) > neighbours:
                    finish()
                if len(out) >= 200:
                    yield batch_of()
        while ahead:
            finish()
        if out:
            yield batch_of()

    return dealt.mapInArrow(compare, f"page_id {id_kind}, url string, text string, n_chars long, n_deleted int")


def _pack(value) -> bytes:
    return zlib.compress(json.dumps(value, ensure_ascii=False).encode("utf-8", "replace"), 1)


def _unpack(data: bytes):
    return json.loads(zlib.decompress(data))
