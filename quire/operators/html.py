"""Blocks of HTML chapters and HTML reports of line differences."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.entities import html5
from html.parser import HTMLParser
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import escape_html

# How tags bear on blocks.
SKIPPED = frozenset("script style head title noscript".split())
BLOCKS = frozenset("p div section article blockquote pre figcaption td th".split())
HEADINGS = {f"h{i}": i for i in range(1, 7)}
#: Scripts are handed on once they hold so many bytes; a line counts as its characters and so many more.
SCRIPT_BYTES, LINE_BYTES = 4 << 20, 160
REFERENCE = r"&(#[0-9]+;|#[xX][0-9A-Fa-f]+;|[A-Za-z][A-Za-z0-9]*;)?"


class _Blocks(HTMLParser):
    """Collects (kind, level, text, href, cut); text between block borders is one block.

    Runs of text longer than most, if it is given, are cut, and their block says so.
    """

    def __init__(self, most: int | None = None) -> None:
        super().__init__(convert_charrefs=True)
        self.most, self.cut = most, False
        self.found: list[tuple] = []
        self.buffer: list[str] = []
        self.skipping = 0

    def flush(self, kind: str = "paragraph", level: int | None = None) -> None:
        text = " ".join("".join(self.buffer).split())
        self.buffer.clear()
        if text:
            self.found.append((kind, level, text, None, self.cut))
        self.cut = False

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag in SKIPPED:
            self.skipping += 1
        elif self.skipping:
            return
        elif tag == "br":
            self.buffer.append(" ")
        elif tag in ("img", "image"):
            self.flush()
            named = dict(attrs)
            source = named.get("src") or named.get("xlink:href") or named.get("href")
            if source:
                self.found.append(("image", None, None, source, False))
        elif tag in BLOCKS or tag in HEADINGS or tag == "li":
            self.flush()

    def handle_startendtag(self, tag: str, attrs) -> None:
        if tag not in SKIPPED:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in SKIPPED:
            self.skipping = max(0, self.skipping - 1)
        elif self.skipping:
            return
        elif tag in HEADINGS:
            self.flush("heading", HEADINGS[tag])
        elif tag == "li":
            self.flush("listitem")
        elif tag in BLOCKS:
            self.flush()

    def handle_data(self, data: str) -> None:
        if not self.skipping:
            self.buffer.append(data[: self.most])
            self.cut |= self.most is not None and len(data) > self.most


def _ended_references(page: str) -> str:
    """The page with every & escaped that begins no reference ended by a semicolon."""
    known = lambda m: m[1] and (m[1][0] == "#" or m[1] in html5)
    return re.sub(REFERENCE, lambda m: m[0] if known(m) else "&amp;" + m[0][1:], page)


def blocks_of(page: str | None, most: int | None = None, ended: bool = False) -> list[tuple]:
    parser = _Blocks(most)
    parser.feed(_ended_references(page or "") if ended else page or "")
    parser.close()
    parser.flush()
    return parser.found


def html_blocks(pages: DataFrame, key: str, html: str = "html", most: int | None = None, ended: bool = False) -> DataFrame:
    """key, block, kind (heading, paragraph, listitem, image), level, text, href and cut of every block of every page.

    cut tells of blocks that lost text because most, a limit to the characters of a run of
    text, is given; without it nothing is cut. HTML also reads old references that no semicolon
    ends, such as &amp before a tag; ended leaves those as they are written, as in XML.
    """
    kind = pages.schema[key].dataType.simpleString()

    def run(batches: Iterator):
        import pyarrow as pa

        schema = pa.schema([("block", pa.int32()), ("kind", pa.string()), ("level", pa.int32()), ("text", pa.string()), ("href", pa.string()), ("cut", pa.bool_())])
        for batch in batches:
            rows, owners = [], []
            for i, page in enumerate(batch.column("html")):
                own = blocks_of(page.as_py(), most, ended)
                rows += [(b, *x) for b, x in enumerate(own)]
                owners += [i] * len(own)
            if rows:
                columns = [pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(owners)), *columns], names=["key", *schema.names])

    found = pages.select(F.col(key).alias("key"), F.col(html).alias("html")).mapInArrow(
        run, f"key {kind}, block int, kind string, level int, text string, href string, cut boolean"
    )
    return found.withColumnRenamed("key", key)


def _meeting(a: list, b: list) -> tuple[int, int, int, int, int]:
    """A run of equal lines in the middle of a shortest edit script (x, y, its end) and the script's length.

    Searches from both ends at once keep only how far each diagonal has been reached.
    """
    n, m = len(a), len(b)
    delta = n - m
    ahead, back = {1: 0}, {1: 0}
    for d in range((n + m + 1) // 2 + 1):
        for k in range(-d, d + 1, 2):
            x = ahead[k + 1] if k == -d or (k != d and ahead[k - 1] < ahead[k + 1]) else ahead[k - 1] + 1
            start = x
            while x < n and x - k < m and a[x] == b[x - k]:
                x += 1
            ahead[k] = x
            if delta % 2 and -d < delta - k < d and x + back[delta - k] >= n:
                return start, start - k, x, x - k, 2 * d - 1
        for k in range(-d, d + 1, 2):
            x = back[k + 1] if k == -d or (k != d and back[k - 1] < back[k + 1]) else back[k - 1] + 1
            start = x
            while x < n and x - k < m and a[n - 1 - x] == b[m - 1 - x + k]:
                x += 1
            back[k] = x
            if delta % 2 == 0 and -d <= delta - k <= d and x + ahead[delta - k] >= n:
                return n - x, m - x + k, n - start, m - start + k, 2 * d
    raise AssertionError("searches from both ends meet")


def edit_script(a: list[str], b: list[str]) -> list[tuple[str, str]]:
    """(op, line) of a shortest edit script, op one of " ", "-" and "+" (Myers, 1986, in linear space)."""
    script: list[tuple[str, str]] = []
    waiting = [(a, b)]
    while waiting:
        a, b = waiting.pop()
        same = 0
        while same < min(len(a), len(b)) and a[same] == b[same]:
            same += 1
        script += [(" ", x) for x in a[:same]]
        a, b = a[same:], b[same:]
        if not a or not b:
            script += [("-", x) for x in a] + [("+", x) for x in b]
            continue
        x, y, u, v, length = _meeting(a, b)
        if length > 1:
            waiting += [(a[u:], b[v:]), (a[x:u], b[y:v]), (a[:x], b[:y])]
        else:  # one line more on one side, after the common ones
            longer = len(a) > len(b)
            script.append(("-", a[0]) if longer else ("+", b[0]))
            waiting.append((a[longer:], b[not longer :]))
    return script


def lines_of(text: str | None, blank: bool = False) -> list[str]:
    """The lines of a text; a line end at its end opens no further one. A null has none; an empty text one if blank, else none."""
    if not text:
        return [""] if blank and text is not None else []
    return text.removesuffix("\n").split("\n")


def _scripts(batches: Iterator, blank: bool = False):
    """key and diff of batches of key, a and b, handed on in parts of SCRIPT_BYTES or one pair."""
    import pyarrow as pa

    shape = pa.list_(pa.struct([("op", pa.string()), ("line", pa.string())]))
    def packed(keys, scripts: list):
        lines = [pa.array([x[i] for script in scripts for x in script], pa.string()) for i in (0, 1)]
        ends = pa.array(accumulate(map(len, scripts), initial=0), pa.int32())
        diff = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(lines, fields=list(shape.value_type)))
        return pa.RecordBatch.from_arrays([keys, diff], names=["key", "diff"])

    for batch in batches:
        first, size, scripts = 0, 0, []
        for i, (x, y) in enumerate(zip(batch.column("a"), batch.column("b"), strict=True)):
            scripts.append(edit_script(lines_of(x.as_py(), blank), lines_of(y.as_py(), blank)))
            size += sum(len(line) + LINE_BYTES for _, line in scripts[-1])
            if size > SCRIPT_BYTES:
                yield packed(batch.column("key").slice(first, len(scripts)), scripts)
                first, size, scripts = i + 1, 0, []
        if scripts:
            yield packed(batch.column("key").slice(first), scripts)


def line_diff(pairs: DataFrame, key: str, a: str = "a", b: str = "b", blank: bool = False) -> DataFrame:
    """key and diff, array<struct<op, line>>, of each pair of texts; a pair is compared in its row.

    Texts that are null or empty have no lines; with blank, an empty one has an empty line. A Python worker holds a batch of texts and scripts of SCRIPT_BYTES or one pair, not those of the whole batch.
    """
    kind = pairs.schema[key].dataType.simpleString()

    narrow = pairs.select(F.col(key).alias("key"), F.col(a).alias("a"), F.col(b).alias("b"))
    found = narrow.mapInArrow(lambda batches: _scripts(batches, blank), f"key {kind}, diff array<struct<op: string, line: string>>")
    return found.withColumnRenamed("key", key)


def count_op(diff: Column, op: str) -> Column:
    return F.size(F.filter(diff, lambda x: x["op"] == op)).cast("long")


def diff_report(diff: Column, label_a: Column, label_b: Column) -> Column:
    """A self-contained HTML page of a diff, everything escaped."""
    row = lambda x: F.concat(
        F.lit("<tr class='"), F.when(x["op"] == "+", "added").when(x["op"] == "-", "removed").otherwise("same"),
        F.lit("'><td>"), x["op"], F.lit("</td><td>"), escape_html(x["line"]), F.lit("</td></tr>"),
    )
    added, removed = count_op(diff, "+"), count_op(diff, "-")
    rows = F.concat(F.lit("<table>"), F.array_join(F.transform(diff, row), ""), F.lit("</table>"))
    body = F.when(added + removed == 0, "<p>The texts are identical.</p>").otherwise(rows)
    return F.concat(
        F.lit("<!doctype html><meta charset='utf-8'><title>Comparison</title><h1>"), escape_html(label_a), F.lit(" / "),
        escape_html(label_b), F.lit("</h1><p>+"), added.cast("string"), F.lit(" -"), removed.cast("string"), F.lit("</p>"), body,
    )
