"""Themes taken from packages: what their styles, cell formats, theme parts and pages say, one row for each package.

Each function takes parts (keys, part, bytes) and returns (keys, theme): a struct of a theme's sections, whose fields are null
where the package says nothing; `to_json(theme)` is then the sparse theme that `functions.themes.resolve` completes.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import text as X
from ..functions import themes
from . import inheritance as I
from . import parts as P

LEVELS = range(1, 7)
#: Rows of a workbook's first sheet that its table style is taken from.
TABLE_ROWS = 6
_VAL = "struct<_val: string>"
_RUN = (
    "struct<rFonts: struct<_ascii: string, _hAnsi: string, _cs: string, _asciiTheme: string, _hAnsiTheme: string, _cstheme: string>, "
    f"sz: {_VAL}, color: {_VAL}, b: {_VAL}, i: {_VAL}>"
)
_PARAGRAPH = f"struct<spacing: struct<_before: string, _after: string, _line: string, _lineRule: string>, jc: {_VAL}, ind: struct<_firstLine: string>>"
_STYLES = (
    f"struct<docDefaults: struct<rPrDefault: struct<rPr: {_RUN}>, pPrDefault: struct<pPr: {_PARAGRAPH}>>, "
    f"style: array<struct<_type: string, _styleId: string, _default: string, name: {_VAL}, basedOn: {_VAL}, rPr: {_RUN}, pPr: {_PARAGRAPH}>>>"
)
_FONTS = "struct<themeElements: struct<fontScheme: struct<majorFont: struct<latin: struct<_typeface: string>>, minorFont: struct<latin: struct<_typeface: string>>>>>"
#: Columns that a style takes from its ancestors.
_TAKEN = ["font", "size", "color", "bold", "italic", "before", "after", "line", "align", "indent"]


def _default(section: str, field: str) -> Column:
    value = themes.FIELDS[section][field][1]
    return F.array(*map(F.lit, value)) if isinstance(value, list) else F.lit(value)


def _not_blank(*x: str | Column) -> Column:
    first = F.coalesce(*x)
    return F.when(F.trim(first) != "", first)


def _number(x: str | Column, least: float | None = None) -> Column:
    """A number above nought, or from `least` on; null for other text."""
    n = F.col(x).try_cast("double") if isinstance(x, str) else x.try_cast("double")
    return F.when(~F.isnan(n) & (n < float("inf")) & ((n > 0) if least is None else (n >= least)), n)


def _rgb(x: str | Column) -> Column:
    """#RRGGBB of six or, behind two of opacity, eight digits."""
    found = F.regexp_extract(F.coalesce(F.trim(x), F.lit("")), "^#?(?:[0-9A-Fa-f]{2})?([0-9A-Fa-f]{6})$", 1)
    return F.when(found != "", F.concat(F.lit("#"), F.upper(found)))


def _on(value: str | Column) -> Column:
    return ~F.lower(F.trim(value)).isin("0", "false", "off", "no")


def _flag(tag: str) -> Column:
    return F.when(F.col(tag).isNotNull(), F.coalesce(_on(f"{tag}._val"), F.lit(True)))


def _properties(run: str, paragraph: str) -> list[Column]:
    family = _not_blank(f"{run}.rFonts._ascii", f"{run}.rFonts._hAnsi", f"{run}.rFonts._cs")
    slot = _not_blank(f"{run}.rFonts._asciiTheme", f"{run}.rFonts._hAnsiTheme", f"{run}.rFonts._cstheme")
    font = F.struct(family.alias("family"), F.when(family.isNull(), slot).alias("slot"))
    jc = F.lower(f"{paragraph}.jc._val")
    line = _number(f"{paragraph}.spacing._line")
    indent = F.coalesce(_number(f"{paragraph}.ind._firstLine", 0) / 20, F.lit(0.0))
    return [
        F.when(family.isNotNull() | slot.isNotNull(), font).alias("font"),
        (_number(f"{run}.sz._val") / 2).alias("size"),
        _rgb(f"{run}.color._val").alias("color"),
        _flag(f"{run}.b").alias("bold"),
        _flag(f"{run}.i").alias("italic"),
        (_number(f"{paragraph}.spacing._before", 0) / 20).alias("before"),
        (_number(f"{paragraph}.spacing._after", 0) / 20).alias("after"),
        F.when(line.isNotNull(), F.struct(line.alias("line"), F.lower(f"{paragraph}.spacing._lineRule").alias("rule"))).alias("line"),
        F.when(jc.isin("left", "start"), "left").when(jc == "center", "center").when(jc.isin("right", "end"), "right").when(jc.isin("both", "distribute"), "justify").alias("align"),
        F.when(F.col(f"{paragraph}.ind").isNotNull(), indent).alias("indent"),
    ]


def _walked(styles: list[dict], columns: list[str]) -> list[dict]:
    """One package's styles (id, up, columns), each with what it takes from those above it; open: the chain comes back to itself."""
    own = {s["id"]: s for s in styles}
    done: dict[str, dict] = {}
    for first in own:
        path: dict[str, None] = {}
        at = first
        while at in own and at not in done and at not in path:
            path[at] = None
            at = own[at]["up"]
        way = list(path)
        taken = done.get(at) or {c: None for c in columns} | {"open": False}
        if at in path:  # twice around the ring, so that each has what all others say
            ring = way[way.index(at) :]
            way, taken = way[: -len(ring)], taken | {"open": True}
            for s in [*reversed(ring), *reversed(ring)]:
                taken = done[s] = taken | {c: own[s][c] for c in columns if own[s][c] is not None} | {"id": s}
        for s in reversed(way):
            taken = done[s] = taken | {c: own[s][c] for c in columns if own[s][c] is not None} | {"id": s}
    return list(done.values())


def _with_ancestors(styles: DataFrame, keys: list[str], columns: list[str], kept: tuple[str, ...] = (), merged: bool = False) -> DataFrame:
    """(keys, id, open, kept, columns) of styles (keys, at, id, up, kept, columns): what each has or takes from those it is based on.

    Of styles with one id the last by `at` holds; merged: the last that has a column holds for it. One
    without id is above no other. A package's styles come from one or two parts, which a task holds anyway, so
    their chains are walked where they lie, once for alike packages; chains over whole tables are `inheritance`'s.
    """
    kinds = {f.name: f.dataType for f in styles.schema}
    out = T.StructType([T.StructField("id", T.StringType()), T.StructField("open", T.BooleanType()), *[T.StructField(c, kinds[c]) for c in (*kept, *columns)]])
    # styles are few bytes where packages are alike, by which Spark would put most packages into few tasks
    spread = styles.repartition(int(styles.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
    packages = spread.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("at", "id", "up", *kept, *columns))).alias("s"))
    packages = packages.select(*keys, F.xxhash64("s").alias("hash"), "s")
    schema = T.StructType([*packages.select(*keys).schema, *out])
    into = [to_arrow_type(f.dataType) for f in out]

    def of(styles: list[dict]) -> Iterator[dict]:
        own: dict[str | None, dict] = {}
        for s in styles:
            own[s["id"]] = own.get(s["id"], s) | {c: v for c, v in s.items() if v is not None} if merged else s
        if None in own:
            yield own.pop(None) | {"open": False}
        for s in _walked(list(own.values()), columns):
            yield s | {c: own[s["id"]][c] for c in kept} if kept else s

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(k, 256) for k in range(0, whole.num_rows, 256)):
                all_styles = batch.column(batch.num_columns - 1)
                first: dict[int, int] = {}
                rows, place, made = [], {}, []
                for k, h in enumerate(batch.column(batch.num_columns - 2).to_pylist()):
                    alike = first.setdefault(h, k)
                    if alike not in place or not all_styles[k].equals(all_styles[alike]):
                        alike, found = k, list(of(all_styles[k].as_py()))
                        place[k] = range(len(made), len(made) + len(found))
                        made += found
                    rows.append(place[alike])
                owner, row = (pa.array([x for k, r in enumerate(rows) for x in pick(k, r)], pa.int32()) for pick in (lambda k, r: [k] * len(r), lambda k, r: r))
                yield pa.RecordBatch.from_arrays([*[c.take(owner) for c in batch.columns[:-2]], *[pa.array([s[f.name] for s in made], t).take(row) for f, t in zip(out, into)]], names=schema.names)

    return packages.mapInArrow(run, schema)


def word_styles(parts: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(keys, id, name, default, open, font, size, ...): paragraph styles with what they take from their ancestors, and (keys, d) of the defaults.

    Of styles with one id the last holds. open: the chain does not end, as it comes back to itself.
    """
    read = I.written(P.read_xml(parts.where(F.col("part") == "word/styles.xml"), keys, _STYLES))
    each = read.select(*keys, F.posexplode("x.style").alias("at", "s")).where("s._type = 'paragraph' and s._styleId <> ''")
    own = each.select(*keys, "at", F.col("s._styleId").alias("id"), F.col("s.name._val").alias("name"), F.coalesce(_on("s._default"), F.lit(False)).alias("default"), F.col("s.basedOn._val").alias("up"), *_properties("s.rPr", "s.pPr"))
    defaults = read.select(*keys, F.struct(*_properties("x.docDefaults.rPrDefault.rPr", "x.docDefaults.pPrDefault.pPr")).alias("d"))
    full = _with_ancestors(own, keys, _TAKEN, ("name", "default")).join(P.shuffled(defaults), keys)
    return full.select(*keys, "id", "name", "default", "open", *[F.coalesce(c, f"d.{c}").alias(c) for c in _TAKEN]), defaults


def theme_fonts(parts: DataFrame, keys: list[str], part: str) -> DataFrame:
    """(keys, major, minor): the fonts of a theme part."""
    read = P.read_xml(parts.where(F.col("part") == part), keys, _FONTS).select(*keys, F.col("x.themeElements.fontScheme").alias("f"))
    return read.select(*keys, _not_blank("f.majorFont.latin._typeface").alias("major"), _not_blank("f.minorFont.latin._typeface").alias("minor"))


def _pages(parts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, page): size, orientation and margins of each document's first section; margins that leave no room are dropped."""
    nodes = P.elements(parts.where(F.col("part") == "word/document.xml"), keys, ("sectPr", "pgSz", "pgMar"))
    section = F.min(F.when(F.col("name") == "sectPr", F.col("element"))).over(Window.partitionBy(*keys))
    inside = nodes.withColumn("__first", section).where("__first = if(name = 'sectPr', element, parent)")
    of = lambda name: F.min_by("attributes", F.when(F.col("name") == name, F.col("element"))).alias(name)
    both = inside.groupBy(*keys).agg(of("pgSz"), of("pgMar"))
    width, height = (_number(F.col("pgSz")[n]) / 20 for n in "wh")
    wide = F.coalesce(F.lower(F.col("pgSz")["orient"]) == "landscape", F.lit(False)) | (width > height)
    said = both.withColumn("__known", width.isNotNull() & height.isNotNull())
    said = said.withColumn("__size", F.when(F.col("__known"), X.nearest_page_size(width, height))).withColumn("__way", F.when(F.col("__known"), F.when(wide, "landscape").otherwise("portrait")))
    sides = ("top", "right", "bottom", "left")
    for s in sides:
        said = said.withColumn(f"__{s}", _number(F.col("pgMar")[s], 0) / 20)
    long_, short = (F.coalesce(*[F.when(F.coalesce("__size", _default("page", "size")) == n, F.lit(side[k])) for n, *side in X.PAGE_SIZES]) for k in (1, 0))
    across = F.coalesce(F.col("__way") == "landscape", F.lit(False))
    room = lambda a, b, size: F.coalesce(f"__{a}", _default("page", f"margin_{a}_pt")) + F.coalesce(f"__{b}", _default("page", f"margin_{b}_pt")) < size - themes.LEAST_TEXT_PT
    fits = room("left", "right", F.when(across, long_).otherwise(short)) & room("top", "bottom", F.when(across, short).otherwise(long_))
    page = F.struct(F.col("__size").alias("size"), F.col("__way").alias("orientation"), *[F.when(fits, F.col(f"__{s}")).alias(f"margin_{s}_pt") for s in sides])
    return said.select(*keys, page.alias("page"))


def word_themes(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Themes of word packages: the default paragraph style, headings 1 to 6 and the first section's page.

    Styles are met by id or name; of several the smallest id holds. A chosen style whose chain comes back to itself is an error.
    """
    plain = lambda c: F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), "[^A-Za-z0-9]", ""))
    normal = F.when(F.col("default"), 0).when((F.lower("id") == "normal") | (F.lower("name") == "normal"), 1)
    role = lambda rank: F.min(F.when(rank.isNotNull(), F.struct(rank.alias("rank"), "id", "open", *_TAKEN)))
    levels = [role(F.when((plain("id") == f"heading{k}") | (plain("name") == f"heading{k}"), 0)).alias(f"h{k}") for k in LEVELS]
    styles, defaults = word_styles(parts, keys)
    styles = styles.groupBy(*keys).agg(role(normal).alias("n"), *levels)
    every = parts.where(F.col("part") == "word/document.xml").select(*keys)
    for side in (styles, defaults, theme_fonts(parts, keys, "word/theme/theme1.xml"), _pages(parts, keys)):
        every = every.join(P.shuffled(side), keys, "left")
    ring = F.concat_ws(", ", *[F.when(F.col(f"{r}.open"), F.col(f"{r}.id")) for r in ("n", *[f"h{k}" for k in LEVELS])])
    every = every.where(F.when(ring != "", F.raise_error(F.concat(F.lit("styles based on themselves: "), ring)).cast("boolean")).otherwise(F.lit(True)))

    font = lambda f: F.coalesce(f["family"], F.when(F.lower(f["slot"]).startswith("major"), F.col("major")).when(F.lower(f["slot"]).startswith("minor"), F.col("minor")))
    body = lambda c: F.when(F.col("n").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"d.{c}"))
    size = body("size")
    exact = body("line")["rule"].isin("exact", "atleast")
    height = F.when(exact, body("line")["line"] / 20 / F.coalesce(size, _default("document", "font_size_pt"))).otherwise(body("line")["line"] / 240)
    text = font(body("font"))
    color = F.coalesce("h1.color", _default("headings", "color"))
    colors = [F.when(F.col(f"h{k}").isNotNull(), F.coalesce(f"h{k}.color", color)).otherwise(_default("headings", "color")) for k in LEVELS]
    sizes = [F.coalesce(f"h{k}.size", _default("headings", "sizes_pt")[k - 1]) for k in LEVELS]
    any_heading = F.coalesce(*[F.col(f"h{k}.id") for k in LEVELS]).isNotNull()
    theme = F.struct(
        F.struct(
            text.alias("font_family"), size.alias("font_size_pt"), body("color").alias("text_color"), body("before").alias("paragraph_spacing_before_pt"),
            body("after").alias("paragraph_spacing_after_pt"), height.alias("line_height"), body("align").alias("text_align"), body("indent").alias("first_line_indent_pt"),
        ).alias("document"),
        F.struct(
            F.coalesce(font(F.col("h1.font")), text).alias("font_family"), F.col("h1.color").alias("color"), F.when(any_heading, F.array(*colors)).alias("level_colors"),
            F.when(any_heading, F.array(*sizes)).alias("sizes_pt"), F.col("h1.before").alias("spacing_before_pt"), F.col("h1.after").alias("spacing_after_pt"),
            F.col("h1.bold").alias("bold"), F.col("h1.italic").alias("italic"),
        ).alias("headings"),
        F.col("page"),
    )
    return every.select(*keys, theme.alias("theme"))


def _first_sheets(parts: DataFrame, by: list[str]) -> DataFrame:
    """(by, rel_id, target): the relationship and the part of each workbook's first sheet; null where it leads nowhere."""
    shape = "struct<sheets: struct<sheet: array<struct<_id: string>>>>"
    first = P.read_xml(parts.where(F.col("part") == "xl/workbook.xml"), by, shape).select(*by, F.coalesce(F.get("x.sheets.sheet", F.lit(0))["_id"], F.lit("")).alias("rel_id"))
    targets = P.relationships(parts, by).where("part = 'xl/workbook.xml'").select(*by, "rel_id", "target")
    return P.sized(first.join(P.shuffled(targets), [*by, "rel_id"], "left").select(*by, "rel_id", "target"))


def _row_styles(parts: DataFrame, books: DataFrame, common: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, row, style, n): how many cells of each style the first rows with cells of the first sheets have."""
    first = _first_sheets(common, ["group"])
    named = F.concat_ws(" ", F.lit("missing sheet"), *[F.col(k).cast("string") for k in keys], F.lit("xl/workbook.xml"), "rel_id")
    there = F.when(F.col("target").isNull(), F.raise_error(named).cast("boolean")).otherwise(F.lit(True))
    firsts = books.join(first, "group").where(there).select(*keys, F.col("target").alias("part"))
    some = parts.join(P.sized(first.select(F.col("target").alias("part")).distinct()), "part", "left_semi")  # few paths, so few other parts are shuffled
    sheets = some.join(P.shuffled(firsts), [*keys, "part"])
    cells = P.first_cells(sheets, keys, TABLE_ROWS, ("c",), "s", "", 1)
    style = F.coalesce(F.col("style").cast("int"), F.col("of_row").cast("int"), F.lit(0))
    return cells.groupBy(*keys, "row", style.alias("style")).agg(F.sum("n").alias("n"))


def _commonest(counts: DataFrame, by: list[str]) -> DataFrame:
    """(by, style): the style of most cells; of equals the smallest."""
    sums = counts.groupBy(*by, "style").agg(F.sum("n").alias("n"))
    return sums.groupBy(*by).agg(F.min_by("style", F.struct(-F.col("n"), "style")).alias("style"))


def _of_table(books: DataFrame, formats: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, theme) of the looks of rows: row 0 is the body, 1 the first row of the sheet, others those below it."""
    look = F.struct("style", "font", "size", "color", "fill", "border", "border_color", "align")
    rows = formats.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("row", look.alias("look"))))).alias("r"))  # TABLE_ROWS and one at most
    of = lambda k: F.try_element_at("r", F.lit(k))
    body, head = of(0), of(1)
    other = lambda c: F.when(~head["style"].eqNullSafe(body["style"]), head[c])
    fills = F.array(*[F.struct(of(k)["style"].alias("style"), of(k)["fill"].alias("fill")) for k in range(2, TABLE_ROWS + 1)])
    stripe = F.get(F.filter(fills, lambda f: ~f["style"].eqNullSafe(body["style"]) & f["fill"].isNotNull() & ~f["fill"].eqNullSafe(body["fill"])), F.lit(0))["fill"]
    theme = F.struct(
        F.struct(body["font"].alias("font_family"), body["size"].alias("font_size_pt"), body["color"].alias("text_color"), body["align"].alias("text_align")).alias("document"),
        F.struct(
            body["size"].alias("font_size_pt"), other("fill").alias("header_background"), other("color").alias("header_color"), F.coalesce(body["border_color"], other("border_color")).alias("border_color"),
            F.coalesce(body["border"], other("border")).alias("border_width_pt"), stripe.alias("stripe_background"),
        ).alias("table"),
    )
    return books.join(P.shuffled(rows), keys, "left").select(*keys, theme.alias("theme"))


def workbook_themes(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Themes of workbooks: the commonest format below the first row, that of the first row, and the first other fill below it.

    Rows are the first TABLE_ROWS of the first sheet that have cells. A format that is not there is an error; a workbook without
    formats says nothing. Formats are found once for all workbooks whose parts but for the sheets are the same.
    """
    used = parts.where(~F.col("part").contains("theme/") | (F.col("part") == "xl/theme/theme1.xml"))
    part = F.col("part")
    fixed = part.isin("xl/workbook.xml", "xl/_rels/workbook.xml.rels", "xl/theme/theme1.xml") | part.endswith("styles.xml")
    groups, common = P.alike(used.where(fixed), keys)
    books = groups.join(P.sized(common.where(part == "xl/workbook.xml").select("group")), "group", "left_semi").select(*keys, "group")
    counts = I.written(_row_styles(used, books, common, keys))
    main = _commonest(counts.where("row > 1"), keys).withColumnRenamed("style", "body")
    by_row = _commonest(counts, [*keys, "row"])
    body = books.select(*keys).join(P.shuffled(main), keys, "left").select(*keys, F.lit(0).alias("row"), F.coalesce("body", F.lit(0)).alias("style"))
    needed = body.unionByName(by_row).join(P.shuffled(books), keys).withColumn("kind", F.lit("cell format"))
    needed = needed.join(P.sized(common.where(part == "xl/styles.xml").select("group")), "group", "left_semi")
    formats = P.resolved(needed, P.sized(P.cell_formats(common, ["group"])), ["group", "style"], "kind", {"cell format": "error"}, [*keys, "style"])
    return _of_table(books.select(*keys), formats, keys)


def slide_themes(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Themes of slide packages: fonts and colours of their first theme part; a package without one says nothing."""
    name = "ppt/theme/theme1.xml"
    every = parts.where(F.col("part") == "ppt/presentation.xml").select(*keys)
    for side in (theme_fonts(parts, keys, name), P.theme_colors(parts.where(F.col("part") == name), keys)):
        every = every.join(P.shuffled(side), keys, "left")
    color = lambda slot: F.concat(F.lit("#"), F.get("theme", F.lit(P.THEME_SLOTS.index(slot))))
    first = P.THEME_SLOTS.index("accent1")
    accent = F.coalesce(color("accent1"), _default("headings", "color"))
    levels = F.array(*[F.coalesce(color(slot), accent) for slot in P.THEME_SLOTS[first : first + 6]])
    theme = F.struct(
        F.struct(F.col("minor").alias("font_family"), color("dk1").alias("text_color")).alias("document"),
        F.struct(F.coalesce("major", "minor").alias("font_family"), color("accent1").alias("color"), F.when(F.col("theme").isNotNull(), levels).alias("level_colors")).alias("headings"),
        F.struct(color("hlink").alias("color")).alias("links"),
        F.struct(color("accent1").alias("header_background"), color("lt1").alias("header_color")).alias("table"),
    )
    return every.select(*keys, theme.alias("theme"))


#: Columns of cell styles of open spreadsheets, and how many repeats of a cell count.
_CELL, MOST_REPEATED = ["font", "size", "color", "fill", "border", "border_color", "align"], 16_384


def sheet_styles(parts: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(keys, id, open, font, ...) of cell styles with what they take from their ancestors, and (keys, font, ...) of default styles.

    A style of several definitions has each property from the last that has it; those of content.xml follow those of styles.xml.
    """
    sides = ("border", "border-left", "border-right", "border-top", "border-bottom")
    inside = {"text-properties": ("font-name", "font-size", "color"), "table-cell-properties": ("background-color", *sides), "paragraph-properties": ("text-align",)}
    found = P.definitions(parts.where(F.col("part").isin("styles.xml", "content.xml")), keys, ("style", "default-style"), ("family", "name", "parent-style-name"), inside)
    at = F.struct((F.col("part") == "content.xml").alias("late"), "element")
    t, c = (lambda name: F.col(f"text-properties_{name}")), (lambda name: F.col(f"table-cell-properties_{name}"))
    border = lambda pattern: F.coalesce(*[F.when(F.regexp_extract(c(side), pattern, 1) != "", F.regexp_extract(c(side), pattern, 1)) for side in sides])
    jc = F.lower("paragraph-properties_text-align")
    own = found.where((F.col("family") == "table-cell") & ((F.col("tag") == "default-style") | F.col("name").isNotNull())).select(
        *keys, at.alias("at"), F.when(F.col("tag") == "style", F.col("name")).alias("id"), F.col("parent-style-name").alias("up"), _not_blank(t("font-name")).alias("font"),
        _number(F.regexp_replace(F.trim(t("font-size")), "pt$", "")).alias("size"), _rgb(t("color")).alias("color"), _rgb(c("background-color")).alias("fill"),
        _number(border(r"(?:^|\s)([0-9]*\.?[0-9]+)(?:pt)?(?=\s|$)")).alias("border"), _rgb(border(r"(?:^|\s)(#[0-9A-Fa-f]{6,8})(?=\s|$)")).alias("border_color"),
        F.when(jc.isin("start", "left"), "left").when(jc == "center", "center").when(jc.isin("end", "right"), "right").when(jc == "justify", "justify").alias("align"),
    )
    every = I.written(_with_ancestors(own, keys, _CELL, merged=True))
    return every.where("id is not null"), every.where("id is null").select(*keys, *_CELL)


def sheet_themes(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Themes of open spreadsheets: as of workbooks, with styles by name; a name that is not there stands for the default style."""
    books = parts.where(F.col("part") == "content.xml")
    cells = P.first_cells(books, keys, TABLE_ROWS, ("table-cell", "covered-table-cell"), "style-name", "number-columns-repeated", MOST_REPEATED)
    counts = I.written(cells.select(*keys, "row", F.coalesce("style", F.lit("")).alias("style"), "n"))
    body = books.select(*keys).join(P.shuffled(_commonest(counts.where("row > 1"), keys)), keys, "left").select(*keys, F.lit(0).alias("row"), "style")
    named, default = sheet_styles(parts, keys)
    own = body.unionByName(_commonest(counts, [*keys, "row"])).withColumn("id", F.col("style")).join(P.shuffled(named), [*keys, "id"], "left")
    own = own.where(F.when(F.coalesce("open", F.lit(False)), F.raise_error(F.concat(F.lit("styles based on themselves: "), "id")).cast("boolean")).otherwise(F.lit(True)))
    both = own.join(P.shuffled(default.select(*keys, F.struct(*_CELL).alias("d"))), keys, "left")
    return _of_table(books.select(*keys), both.select(*keys, "row", "style", *[F.coalesce(c, f"d.{c}").alias(c) for c in _CELL]), keys)


#: How themes are taken, by format.
TAKEN = {"docx": word_themes, "xlsx": workbook_themes, "ods": sheet_themes, "pptx": slide_themes}


def of_files(spark: SparkSession, paths: str | list[str], kind: str) -> DataFrame:
    """(path, theme): the theme of each file as sparse JSON. What is no package, or lacks its main part, is an error."""
    if kind not in TAKEN:
        raise ValueError(f"themes can be taken from {', '.join(TAKEN)}, not from {kind}")
    files = spark.read.format("binaryFile").load(paths).select("path", "content")
    parts = P.package_parts(files, ["path"])
    parts = parts.where(F.when(F.col("error").isNull(), F.lit(True)).otherwise(F.raise_error(F.concat_ws(": ", "path", "error")).cast("boolean"))).drop("error")
    found = files.select("path").join(TAKEN[kind](parts, ["path"]), "path", "left")
    whole = found.where(F.when(F.col("theme").isNotNull(), F.lit(True)).otherwise(F.raise_error(F.concat("path", F.lit(": the main part is missing"))).cast("boolean")))
    return whole.select("path", F.to_json("theme").alias("theme"))
