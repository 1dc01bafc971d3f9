"""EPUB books as relations: entries, package documents, chapters in reading order, blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import let
from ..functions.names import resolve_path
from ..functions.text import normalize_typography
from .html import html_blocks
from .prefix import with_sums_before

# Fixed values of the layout, in points: sizes of body and headings, line height, margins and gaps.
BODY_SIZE = 11.0
HEADING_SIZES = {1: 20.0, 2: 16.0, 3: 14.0, 4: 12.0, 5: 11.0, 6: 11.0}
LINE_HEIGHT = 1.45
MARGIN = 56.0
PARAGRAPH_GAP = 6.0


def _text(content: Column) -> Column:
    return F.decode(content, "utf-8")


def _all(xml: Column, element: str, attribute: str) -> Column:
    return F.xpath(xml, F.lit(f"//*[local-name()='{element}']/@{attribute}"))


def well_formed(xml: Column) -> Column:
    """Whether a text is XML that can be read; null and empty ones are not."""
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken", "rowTag": "ROW"}
    parsed = F.from_xml(xml, "broken string", options)
    return F.coalesce((F.trim(xml) != "") & parsed["broken"].isNull(), F.lit(False))


def package_errors(entries: DataFrame) -> DataFrame:
    """archive_id and error of each archive (archive_id, path, content): DECODE_FAILED where no package document can be read.

    One broken book is no trouble to the others.
    """
    read = packages(entries).select("archive_id").distinct().withColumn("__read", F.lit(True))
    every = entries.select("archive_id").distinct()
    return every.join(read, "archive_id", "left").select("archive_id", F.when(F.col("__read").isNull(), "DECODE_FAILED").alias("error"))


def is_protected(entries: DataFrame) -> DataFrame:
    """archive_id of books with encrypted content."""
    return entries.where(F.lower("path") == "meta-inf/encryption.xml").select("archive_id").distinct()


def packages(entries: DataFrame) -> DataFrame:
    """archive_id, folder and opf (the package document) of the books among archives (archive_id, path, content).

    Books whose container or package is no XML are left out: package_errors() names them.
    """
    container = entries.where(F.lower("path") == "meta-inf/container.xml").withColumn("__xml", _text(F.col("content")))
    path = F.when(well_formed(F.col("__xml")), F.get(_all(F.col("__xml"), "rootfile", "full-path"), 0))
    named = container.select("archive_id", path.alias("path"))
    folder = F.when(F.col("path").contains("/"), F.regexp_replace("path", "/[^/]*$", "")).otherwise("")
    found = entries.join(named, ["archive_id", "path"]).select("archive_id", folder.alias("folder"), _text(F.col("content")).alias("opf"))
    return found.where(well_formed(F.col("opf")))


def spine(books: DataFrame) -> DataFrame:
    """archive_id, chapter (from 0) and path in reading order; references to nothing drop out."""
    opf = F.col("opf")
    manifest = books.select("archive_id", "folder", F.inline(F.arrays_zip(_all(opf, "item", "id").alias("id"), _all(opf, "item", "href").alias("href"))))
    order = books.select("archive_id", F.posexplode(_all(opf, "itemref", "idref")).alias("ord", "id"))
    joined = order.join(manifest, ["archive_id", "id"])
    place = F.row_number().over(Window.partitionBy("archive_id").orderBy("ord")) - 1
    return joined.select("archive_id", place.alias("chapter"), resolve_path(F.col("folder"), F.col("href")).alias("path"))


def find_entries(wanted: DataFrame, entries: DataFrame) -> DataFrame:
    """wanted (archive_id, path, ...) with the content of its entry, null if there is none.

    Tried are the path as it is, with its escapes decoded, and without regard to case:
    one join on the decoded lower-case path, then the best of the few that share it.
    """
    decoded = lambda p: F.coalesce(F.try_url_decode(p), p)
    keyed = entries.select("archive_id", F.lower(decoded(F.col("path"))).alias("__key"), F.col("path").alias("__found"), "content")
    asked = wanted.withColumn("__key", F.lower(decoded(F.col("path"))))
    joined = asked.join(keyed, ["archive_id", "__key"], "left")
    rank = F.when(F.col("__found") == F.col("path"), 0).when(F.col("__found") == decoded(F.col("path")), 1).otherwise(2)
    best = Window.partitionBy("archive_id", *[c for c in wanted.columns if c != "archive_id"]).orderBy(rank, "__found")
    return joined.withColumn("__n", F.row_number().over(best)).where("__n = 1").drop("__key", "__found", "__n")


def blocks(entries: DataFrame) -> DataFrame:
    """archive_id, chapter, block, kind, level, text and href of the chapters of all books, protected ones left out."""
    open_ = entries.join(is_protected(entries), "archive_id", "left_anti")
    chapters = find_entries(spine(packages(open_)), open_).where("content is not null")
    pages = chapters.select(F.struct("archive_id", "chapter", "path").alias("at"), _text(F.col("content")).alias("html"))
    found = html_blocks(pages, "at")
    folder = F.when(F.col("at.path").contains("/"), F.regexp_replace("at.path", "/[^/]*$", "")).otherwise("")
    href = F.when(F.col("href").isNotNull(), resolve_path(folder, F.col("href")))
    return found.select("at.archive_id", "at.chapter", "block", "kind", "level", normalize_typography(F.col("text")).alias("text"), href.alias("href"))


def within_budget(found: DataFrame, doc: str, order: list[str], text: str, budget: int) -> DataFrame:
    """The rows of each document up to the one with which its characters pass the budget.

    A limit that the caller sets: nothing else in this module leaves anything out.
    """
    used = F.coalesce(F.length(text), F.lit(0)).cast("long")
    return with_sums_before(found, [doc], order, {"__used": used}).where(F.col("__used") < budget).drop("__used")


def within_count(found: DataFrame, doc: str, order: list[str], kind: str, most: int) -> DataFrame:
    """The rows of each document without those of a kind beyond the first so many, such as images."""
    place = F.row_number().over(Window.partitionBy(doc, "kind").orderBy(*order))
    return found.withColumn("__n", place).where((F.col("kind") != kind) | (F.col("__n") <= most)).drop("__n")


#: Half a line of air above a heading; a sum of heights may miss a border by this much.
AIR, HAIR = 0.5, 1e-9


def _sizes() -> Column:
    level = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in HEADING_SIZES.items() for x in pair]), F.col("level").cast("int")), F.lit(14.0))
    size = F.when(F.coalesce(F.col("level"), F.lit(0)) == 0, 16.0).otherwise(level)
    return F.when(F.col("kind") == "heading", size).otherwise(BODY_SIZE)


def lay_out(found: DataFrame, page_height: float = 841.89, most_pages: int | None = None) -> DataFrame:
    """doc_id, ord, page0, y and n_shown of blocks (doc_id, ord, kind, level, n_lines) set one below the other.

    page0 and y are those of the first line. A block fills the room that its page has left,
    then whole pages, of a line at least; headings keep half a line of air above, but not at
    the top. Beyond most_pages, if it is given, lines are left out: n_shown says how many
    stand. How far a block reaches is arithmetic; a document's blocks, a few numbers each,
    are folded in order, since each begins where the one before ends.
    """
    bottom = page_height - MARGIN
    least = F.lit(2**31 - 1 if most_pages is None else most_pages)
    block = F.struct("ord", _sizes().alias("size"), (F.col("kind") == "heading").alias("heading"), F.coalesce("n_lines", F.lit(0)).cast("long").alias("n"))
    shape = "struct<ord: int, page0: int, y: double, n_shown: int>"

    def step(s: Column, b: Column) -> Column:
        line = b["size"] * LINE_HEIGHT
        fits = lambda room: F.floor(room / line + HAIR)
        air = F.when(b["heading"] & (s["y"] > MARGIN) & ~s["full"], b["size"] * AIR).otherwise(0.0)

        def filled(v: Column) -> Column:
            each = F.greatest(fits(F.lit(bottom - MARGIN)), F.lit(1))
            here = F.least(b["n"], F.greatest(fits(bottom - v["y"]), F.lit(0)))
            shown = F.least(b["n"], here + F.greatest(v["left"], F.lit(0)) * each)
            return F.struct(v["y"].alias("y"), here.alias("here"), shown.alias("shown"), each.alias("each"), F.ceil((shown - here) / each).alias("turned"))

        def after(v: Column) -> Column:
            on_last = F.when(v["turned"] == 0, v["shown"]).otherwise(v["shown"] - v["here"] - (v["turned"] - 1) * v["each"])
            y = F.when(v["turned"] == 0, v["y"]).otherwise(MARGIN) + on_last * line
            begins = v["here"] > 0
            page = s["page"] + F.when(begins, 0).otherwise(1)
            placed = F.struct(
                b["ord"].cast("int").alias("ord"), F.when(v["shown"] > 0, page).cast("int").alias("page0"),
                F.when(v["shown"] > 0, F.when(begins, v["y"]).otherwise(MARGIN)).alias("y"), v["shown"].cast("int").alias("n_shown"),
            )
            return F.struct(
                (s["page"] + v["turned"]).cast("int").alias("page"), (y + PARAGRAPH_GAP).alias("y"),
                (s["full"] | (v["shown"] < b["n"])).alias("full"), F.concat(s["out"], F.array(placed)).alias("out"),
            )

        start = F.struct((s["y"] + air).alias("y"), (least - 1 - s["page"]).alias("left"))
        return let(let(start, filled), after)

    begin = F.struct(F.lit(0).alias("page"), F.lit(MARGIN).alias("y"), F.lit(False).alias("full"), F.expr(f"cast(array() as array<{shape}>)").alias("out"))
    listed = found.groupBy("doc_id").agg(F.array_sort(F.collect_list(block)).alias("blocks"))
    folded = F.aggregate("blocks", begin, step, lambda s: s["out"])
    return listed.select("doc_id", F.inline(folded))
