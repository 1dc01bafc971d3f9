"""Page sets, page orders and page runs in the notation "1-3, 5, 9-7"."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import as_number, trim_all


def _parts(expr: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(expr, F.lit("")), ","), trim_all), lambda p: p != "")


def _ends(part: Column) -> Column:
    """struct<single, a, b> of a part; a or b is null if it is no integer."""
    dash = F.instr(part, "-")
    whole = lambda x: F.when(as_number(x) == F.floor(as_number(x)), as_number(x))
    a = F.when(dash == 0, whole(part)).otherwise(whole(F.substring(part, F.lit(1), dash - 1)))
    b = F.when(dash == 0, whole(part)).otherwise(whole(F.substring(part, dash + 1, F.length(part))))
    return F.struct((dash == 0).alias("single"), a.alias("a"), b.alias("b"), part.alias("part"))


_NONE = "cast(array() as array<int>)"


def parse_pages(expr: Column, n_pages: Column) -> Column:
    """The pages of a lenient selection: sorted, unique, within 1 to n_pages; blank means all.

    Parts that are no numbers are skipped, ranges may run backwards and are cut to the
    document, a missing end of a range counts as 0.
    """

    def pages(e: Column) -> Column:
        low = F.greatest(F.lit(1), F.least(e["a"], e["b"]).cast("long"))
        high = F.least(n_pages.cast("long"), F.greatest(e["a"], e["b"]).cast("long"))
        outside = e["a"].isNull() | e["b"].isNull() | (low > high)
        return F.when(outside, F.expr(_NONE)).otherwise(F.sequence(low.cast("int"), high.cast("int")))

    listed = F.flatten(F.transform(F.transform(_parts(expr), _ends), pages))
    every = F.sequence(F.lit(1), n_pages.cast("int"))
    return (
        F.when(n_pages.isNull() | (n_pages < 1), F.expr(_NONE))
        .when(trim_all(F.coalesce(expr, F.lit(""))) == "", every)
        .otherwise(F.array_sort(F.array_distinct(listed)))
    )


def _strict(expr: Column, n_pages: Column | None, ordered: bool) -> Column:
    ends = F.transform(_parts(expr), _ends)
    good = lambda x: x.isNotNull() & (x >= 1)
    above = (lambda x: x > n_pages) if n_pages is not None else (lambda x: F.lit(False))

    def problem(e: Column) -> Column:
        kind = F.when(e["single"], "page number").otherwise("page range")
        invalid = F.concat(F.lit("not a valid "), kind, F.lit(": "), e["part"])
        beyond = F.concat(F.lit("out of range: "), e["part"])
        return F.when(~(good(e["a"]) & good(e["b"])), invalid).when(above(e["a"]) | above(e["b"]), beyond)

    message = F.get(F.filter(F.transform(ends, problem), lambda m: m.isNotNull()), 0)
    pages = F.flatten(F.transform(ends, lambda e: F.sequence(e["a"].cast("int"), e["b"].cast("int"))))
    unique = F.array_distinct(pages)
    found = F.when(message.isNotNull(), F.expr(_NONE)).otherwise(unique if ordered else F.array_sort(unique))
    return F.struct(found.alias("pages"), message.isNull().alias("valid"), message.alias("message"))


def parse_page_list(expr: Column, n_pages: Column | None = None) -> Column:
    """struct<pages, valid, message> of a strict selection: the first bad part makes all invalid; blank is empty."""
    return _strict(expr, n_pages, False)


def parse_order(expr: Column, n_pages: Column | None = None) -> Column:
    """Like parse_page_list(), in the order of mention; 3-1 counts down."""
    return _strict(expr, n_pages, True)


def append_missing(order: Column, n_pages: Column) -> Column:
    """The order without repeats, then the pages it leaves out."""
    every = F.when(n_pages >= 1, F.sequence(F.lit(1), n_pages.cast("int"))).otherwise(F.expr(_NONE))
    return F.concat(F.array_distinct(order), F.array_except(every, order))


def page_runs(pages: Column) -> Column:
    """array<struct<start, end>> of the runs of consecutive pages."""

    def step(s: Column, p: Column) -> Column:
        last = F.element_at(s, -1)
        longer = F.concat(
            F.slice(s, F.lit(1), F.size(s) - 1), F.array(F.struct(last["start"].alias("start"), p.alias("end")))
        )
        new = F.concat(s, F.array(F.struct(p.alias("start"), p.alias("end"))))
        return F.when((F.size(s) > 0) & (F.try_element_at(s, F.lit(-1))["end"] + 1 == p), longer).otherwise(new)

    none = F.expr("cast(array() as array<struct<start: int, end: int>>)")
    return F.aggregate(F.array_sort(F.array_distinct(pages)), none, step)


def format_run(start: Column, end: Column) -> Column:
    text = lambda x: x.cast("string")
    return (
        F.when(start == end, text(start))
        .when(start + 1 == end, F.concat_ws(", ", text(start), text(end)))
        .otherwise(F.concat_ws("-", text(start), text(end)))
    )


def format_pages(pages: Column) -> Column:
    """A page set in the notation that parse_pages() reads."""
    return F.array_join(F.transform(page_runs(pages), lambda r: format_run(r["start"], r["end"])), ", ")
