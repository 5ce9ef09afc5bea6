"""Queries on packages as rows, and on ordered and inherited rows of any depth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import batches as B
from ..operators import inheritance as I
from ..operators import ordered as O
from ..operators import parts as P
from ..operators import taken_themes as K
from . import convert as V
from .queries import _read, _spread, query


def _order_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(o_custkey, json) of each customer's orders, of which _BOOK makes a workbook."""
    row = F.struct("o_orderkey", "o_orderstatus", F.round("o_totalprice", 2).alias("price"))
    return _spread(_read(spark, sf_dir, "orders"), "o_custkey").groupBy("o_custkey").agg(F.to_json(F.array_sort(F.collect_list(row))).alias("json"))


_BOOK = V.converting("json", ["json", "xlsx"], {1: "content"}, failfast=True)


def _order_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(o_custkey, part, bytes, error) of a workbook for each customer, made and opened in one worker."""
    return B.through(_order_books(spark, sf_dir), _BOOK, B.picking(["o_custkey", "content"]), P.opening)


@query(
    "package_parts",
    """SELECT o_custkey, unnest(['[Content_Types].xml', '_rels/.rels', 'xl/_rels/workbook.xml.rels', 'xl/workbook.xml', 'xl/worksheets/sheet1.xml']) AS part
    FROM (SELECT DISTINCT o_custkey FROM orders)""",
)
def package_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _order_parts(spark, sf_dir).select("o_custkey", "part")


@query(
    "package_relationships",
    """SELECT o_custkey, unnest(['', 'xl/workbook.xml']) AS part, 'rId1' AS rel_id, unnest(['officeDocument', 'worksheet']) AS type,
      unnest(['xl/workbook.xml', 'xl/worksheets/sheet1.xml']) AS target, false AS external FROM (SELECT DISTINCT o_custkey FROM orders)""",
)
def package_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.relationships(_order_parts(spark, sf_dir), ["o_custkey"])


@query(
    "package_elements",
    """WITH n AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1)
    SELECT o_custkey, unnest(['row', 'c', 'v', 't', 'pane']) AS name, unnest([n + 1, 3 * n + 3, 2 * n, n + 3, 1]) AS n,
      unnest(['r', 'r,t', '', 'space', 'activePane,state,topLeftCell,ySplit']) AS attributes FROM n""",
)
def package_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each element stands in a workbook's sheet, and which attributes it has."""
    nodes = P.package_elements(_order_books(spark, sf_dir), ["o_custkey"], "json", before=(_BOOK,)).where("part = 'xl/worksheets/sheet1.xml'")
    some = nodes.where(F.col("name").isin("row", "c", "v", "t", "pane"))
    names = F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.map_keys("attributes")))))
    return some.groupBy("o_custkey", "name").agg(F.count("*").alias("n"), F.array_join(names, ",").alias("attributes"))


@query(
    "package_cells",
    """WITH r AS (SELECT *, 1 + row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders)
    SELECT o_custkey, 'A' || k AS ref, o_orderkey::DOUBLE AS number FROM r UNION ALL SELECT o_custkey, 'C' || k, round(o_totalprice, 2) FROM r""",
)
def package_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of the cells: each cell element joined to its value element."""
    nodes = P.package_elements(_order_books(spark, sf_dir), ["o_custkey"], "json", before=(_BOOK,))
    cells = P.children(nodes, ["o_custkey"], "c", "v")
    return cells.select("o_custkey", F.col("parent_attributes")["r"].alias("ref"), F.col("text").cast("double").alias("number"))


def _part(name: str, xml: Column) -> list[Column]:
    return [F.lit(name).alias("part"), xml.cast("binary").alias("bytes")]


@query(
    "list_levels",
    """WITH i AS (SELECT o_orderkey, o_custkey, o_orderkey % 6 AS num, o_orderkey // 6 % 4 AS level, (o_orderkey % 6 + o_custkey) % 3 AS abstract FROM orders)
    SELECT o_orderkey, CASE WHEN num < 5 AND level < 3 THEN CASE WHEN (abstract + level) % 2 = 0 THEN 'bullet' ELSE 'decimal' END END AS format,
      CASE WHEN num < 5 AND level < 3 AND (abstract + level) % 2 = 1 THEN CASE WHEN num = 1 AND level = 0 THEN 100 + o_custkey % 7 WHEN num = 4 AND level = 2 THEN 7
        ELSE 1 + 10 * abstract + level END END AS start
    FROM i""",
)
def list_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as list items: each customer's numbering part has five numbers, three abstract ones of three levels, and two overrides."""
    key = F.col("o_custkey")
    level = lambda a, k: F.format_string('<w:lvl w:ilvl="%d"><w:start w:val="%d"/><w:numFmt w:val="%s"/></w:lvl>', F.lit(k), F.lit(1 + 10 * a + k), F.lit("bullet" if (a + k) % 2 == 0 else "decimal"))
    abstract = [F.concat(F.lit(f'<w:abstractNum w:abstractNumId="{a}">'), *[level(a, k) for k in range(3)], F.lit("</w:abstractNum>")) for a in range(3)]
    first = F.format_string('<w:lvlOverride w:ilvl="0"><w:startOverride w:val="%d"/></w:lvlOverride>', 100 + key % 7)
    own = {1: first, 4: F.lit('<w:lvlOverride w:ilvl="2"><w:startOverride w:val="7"/></w:lvlOverride>')}
    nums = [F.concat(F.format_string('<w:num w:numId="%d"><w:abstractNumId w:val="%d"/>', F.lit(n), (F.lit(n) + key) % 3), own.get(n, F.lit("")), F.lit("</w:num>")) for n in range(5)]
    xml = F.concat(F.lit('<w:numbering xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main">'), *abstract, *nums, F.lit("</w:numbering>"))
    orders = _read(spark, sf_dir, "orders")
    parts = _spread(orders.select("o_custkey"), "o_custkey").distinct().select("o_custkey", *_part("word/numbering.xml", xml))
    items = orders.select("o_orderkey", "o_custkey", (F.col("o_orderkey") % 6).cast("string").alias("num_id"), (F.floor(F.col("o_orderkey") / 6) % 4).cast("int").alias("level"))
    return P.list_levels(items, ["o_custkey"], *P.numbering(parts, ["o_custkey"])).select("o_orderkey", "format", "start")


def _references(spark: SparkSession, sf_dir: str, kind: Column, policies: dict[str, str], targets: Column) -> DataFrame:
    refs = _read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("rel_id"), kind.alias("kind"))
    parts = _read(spark, sf_dir, "customer").where(targets).select(F.col("c_custkey").alias("rel_id"), F.col("c_name").alias("target"))
    return P.resolved(refs, parts, ["rel_id"], "kind", policies).select("o_orderkey", "kind", "target")


@query("references_dropped", "SELECT o_orderkey, 'image' AS kind, c_name AS target FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_custkey % 5 <> 0")
def references_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images whose part is missing are left out."""
    return _references(spark, sf_dir, F.lit("image"), {"image": "drop"}, F.col("c_custkey") % 5 != 0)


@query(
    "references_kept",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'chart' ELSE 'image' END AS kind, c_name AS target
    FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 5 <> 0) ON o_custkey = c_custkey WHERE o_orderkey % 2 = 0 OR c_name IS NOT NULL""",
)
def references_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Charts whose part is missing stay without one, images go."""
    kind = F.when(F.col("o_orderkey") % 2 == 0, "chart").otherwise("image")
    return _references(spark, sf_dir, kind, {"chart": "keep", "image": "drop"}, F.col("c_custkey") % 5 != 0)


@query("references_checked", "SELECT o_orderkey, 'slide' AS kind, c_name AS target FROM orders JOIN customer ON o_custkey = c_custkey")
def references_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slides, each of which has to have a part."""
    return _references(spark, sf_dir, F.lit("slide"), {"slide": "error"}, F.lit(True))


@query(
    "workbook_styles",
    """WITH c AS (SELECT o_orderkey, o_custkey AS b, CASE WHEN o_orderkey % 8 < 5 THEN o_orderkey % 8 WHEN o_orderkey % 3 = 0 THEN o_custkey % 5 ELSE 0 END AS s FROM orders),
      f AS (SELECT *, (s + b) % 3 AS font, s % 2 AS fill, s % 4 AS border FROM c)
    SELECT o_orderkey, 'Font' || font AS font, (8.5 + b % 4 + font)::DOUBLE AS size, font = 1 AS bold, font = 2 AS italic,
      CASE font WHEN 0 THEN '#FF0000' WHEN 1 THEN CASE b % 2 WHEN 0 THEN '#808080' ELSE '#8080C0' END ELSE '#00FF00' END AS color,
      CASE fill WHEN 1 THEN printf('#%02X%02X%02X', b % 256, 16, 32) END AS fill,
      CASE border WHEN 0 THEN NULL WHEN 1 THEN 0.5 WHEN 2 THEN 1.0 ELSE 1.5 END::DOUBLE AS border, CASE WHEN border > 0 THEN '#0000FF' END AS border_color,
      CASE s WHEN 0 THEN 'left' WHEN 1 THEN 'center' WHEN 2 THEN 'right' WHEN 3 THEN 'justify' END AS align
    FROM f""",
)
def workbook_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as cells of a workbook for each customer: own formats, formats of rows, and none; fonts, fills and borders by place; theme, index and tint."""
    b = F.col("o_custkey")
    font = lambda k, more, color: F.concat(F.lit("<font><sz val='"), (F.lit(8.5) + b % 4 + k).cast("string"), F.lit(f"'/><name val='Font{k}'/>{more}<color {color}/></font>"))
    fonts = [font(0, "<b val='0'/>", "rgb='FFFF0000'"), font(1, "<b/>", "theme='4' tint='0.5'"), font(2, "<i val='1'/>", "indexed='3'")]
    fills = [F.lit("<fill><patternFill patternType='none'/></fill>"), F.format_string("<fill><patternFill patternType='solid'><fgColor rgb='%02X1020'/></patternFill></fill>", b % 256)]
    line = "<border><left style='{}'><color indexed='4'/></left><right/></border>"
    borders = ["<border><left/><right/></border>", line.format("thin"), line.format("medium"), line.format("double")]
    aligned = ["general", "centerContinuous", "right", "distributed", "fill"]
    formats = [F.format_string(f"<xf fontId='%d' fillId='{s % 2}' borderId='{s % 4}'><alignment horizontal='{aligned[s]}'/></xf>", (F.lit(s) + b) % 3) for s in range(5)]
    main = F.lit("<styleSheet xmlns='http://schemas.openxmlformats.org/spreadsheetml/2006/main'><fonts>")
    styles = F.concat(main, *fonts, F.lit("</fonts><fills>"), *fills, F.lit("</fills><borders>"), *map(F.lit, borders), F.lit("</borders><cellXfs>"), *formats, F.lit("</cellXfs></styleSheet>"))
    accent = F.when(b % 2 == 0, "<a:accent1><a:srgbClr val='010101'/></a:accent1>").otherwise("<a:accent1><a:sysClr val='x' lastClr='010180'/></a:accent1>")
    theme = F.concat(F.lit("<a:theme xmlns:a='http://schemas.openxmlformats.org/drawingml/2006/main'><a:themeElements><a:clrScheme>"), accent, F.lit("</a:clrScheme></a:themeElements></a:theme>"))
    orders = _read(spark, sf_dir, "orders")
    books = _spread(orders.select("o_custkey"), "o_custkey").distinct()
    parts = books.select("o_custkey", *_part("xl/styles.xml", styles)).union(books.select("o_custkey", *_part("xl/theme/theme1.xml", theme)))
    own = F.when(F.col("o_orderkey") % 8 < 5, F.col("o_orderkey") % 8).cast("int")
    cells = orders.select("o_orderkey", "o_custkey", F.col("o_orderkey").alias("sheet_row"), own.alias("style"))
    rows = orders.where("o_orderkey % 3 = 0").select("o_custkey", F.col("o_orderkey").alias("sheet_row"), (b % 5).cast("int").alias("style"))
    return P.styled_cells(cells, rows, P.cell_formats(parts, ["o_custkey"]), ["o_custkey"]).drop("o_custkey", "sheet_row", "style")


@query(
    "style_cascade",
    """WITH RECURSIVE s AS (SELECT l_orderkey * 8 + l_linenumber AS style, CASE WHEN l_linenumber > 1 THEN l_orderkey * 8 + l_linenumber - 1 END AS parent,
        CASE WHEN l_quantity % 3 = 0 THEN l_quantity::INT END AS size, CASE WHEN l_quantity % 7 = 1 THEN l_returnflag END AS font
        FROM (SELECT l_orderkey, l_linenumber, min(l_quantity) AS l_quantity, min(l_returnflag) AS l_returnflag FROM lineitem GROUP BY 1, 2)),
      known AS (SELECT s.style, p.style AS parent, s.size, s.font FROM s LEFT JOIN s p ON s.parent = p.style),
      chain AS (SELECT style, size, font, 0 AS depth FROM known WHERE parent IS NULL
        UNION ALL SELECT k.style, coalesce(k.size, c.size), coalesce(k.font, c.font), c.depth + 1 FROM chain c JOIN known k ON k.parent = c.style)
    SELECT style, coalesce(size, 11) AS size, coalesce(font, 'Body') AS font, depth FROM chain""",
)
def style_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders as styles, each based on the line before: own values, else an ancestor's, else the defaults."""
    lines = _read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_quantity").alias("q"), F.min("l_returnflag").alias("flag"))
    key = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    styles = lines.select(key.alias("style"), F.when(F.col("l_linenumber") > 1, key - 1).alias("parent"), F.when(F.col("q") % 3 == 0, F.col("q").cast("int")).alias("size"), F.when(F.col("q") % 7 == 1, F.col("flag")).alias("font"))
    return I.cascaded(styles, ["size", "font"], {"size": F.lit(11), "font": F.lit("Body")})


@query(
    "style_chain",
    """WITH s AS (SELECT event_id, CASE WHEN event_id % 50 = 7 THEN user_id END AS own FROM events), n AS (SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS depth FROM s)
    SELECT event_id AS style, coalesce(last_value(own IGNORE NULLS) OVER (ORDER BY event_id), -1) AS size, depth FROM n""",
)
def style_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as one chain of styles, each based on the one before: as many levels as rows."""
    events = _read(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 50 == 7, F.col("user_id")).alias("size"))
    chain = events.select(F.col("event_id").alias("style"), F.when(F.col("event_id") > 0, F.col("event_id") - 1).alias("parent"), "size")
    return I.cascaded(chain, ["size"], {"size": F.lit(-1).cast("long")})


_LEVELS = "SELECT event_id, user_id % 7 AS doc, (event_id * 7919 + user_id) % 13 + 1 AS level FROM events"


@query(
    "outline_deep",
    f"SELECT a.event_id, max(b.event_id) AS parent FROM ({_LEVELS}) a LEFT JOIN ({_LEVELS}) b ON a.doc = b.doc AND b.event_id < a.event_id AND b.level < a.level GROUP BY a.event_id",
)
def outline_deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outlines of thirteen levels in few, long documents."""
    level = (F.col("event_id") * 7919 + F.col("user_id")) % 13 + 1
    rows = _read(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 7).alias("doc"), level.alias("level"))
    return O.outline_parents(rows, ["doc"], "event_id", "level").select("event_id", "parent")


@query(
    "list_numbers_deep",
    f"""WITH x AS ({_LEVELS}), p AS (SELECT a.event_id, a.doc, a.level, max(b.event_id) AS up FROM x a LEFT JOIN x b ON a.doc = b.doc AND b.event_id < a.event_id AND b.level < a.level GROUP BY ALL)
    SELECT event_id, row_number() OVER (PARTITION BY doc, level, up ORDER BY event_id) AS number FROM p""",
)
def list_numbers_deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = (F.col("event_id") * 7919 + F.col("user_id")) % 13 + 1
    rows = _read(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 7).alias("doc"), level.alias("level"))
    return O.list_numbers(rows, ["doc"], "event_id", "level").select("event_id", "number")


@query(
    "merged_cells",
    """WITH d AS (SELECT event_id % 3 AS doc, event_id // 15 AS r, event_id // 3 % 5 AS c, 1 + (event_id * 31 + user_id) % 2 AS span,
        CASE (event_id * 17 + user_id) % 4 WHEN 0 THEN 'restart' WHEN 1 THEN 'continue' WHEN 2 THEN 'continue' END AS merge FROM events),
      g AS (SELECT *, coalesce(sum(span) OVER (PARTITION BY doc, r ORDER BY c ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS col FROM d),
      e AS (SELECT *, unnest(CASE WHEN merge = 'continue' THEN [col] ELSE range(col, col + span) END) AS spot FROM g),
      o AS (SELECT doc, r, c, merge, last_value(CASE WHEN merge IS DISTINCT FROM 'continue' THEN {'open': merge IS NOT NULL, 'r': r, 'c': c} END IGNORE NULLS) OVER (PARTITION BY doc, spot ORDER BY r) AS origin FROM e),
      h AS (SELECT doc, r, c, origin FROM o WHERE merge = 'continue' AND origin.open),
      n AS (SELECT doc, origin.r AS r, origin.c AS c, count(*) AS more FROM h GROUP BY ALL)
    SELECT doc, r, c, col AS column, span AS colspan, coalesce(more, 0) + 1 AS rowspan FROM g LEFT JOIN n USING (doc, r, c)
    WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.doc = g.doc AND h.r = g.r AND h.c = g.c)""",
)
def merged_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as cells of three long tables of five cells a row."""
    e, u = F.col("event_id"), F.col("user_id")
    code = (e * 17 + u) % 4
    cells = _read(spark, sf_dir, "events").select(
        (e % 3).alias("doc"), F.floor(e / 15).alias("r"), (F.floor(e / 3) % 5).alias("c"), (1 + (e * 31 + u) % 2).alias("span"), F.when(code == 0, "restart").when(code < 3, "continue").alias("merge")
    )
    return O.merged_cells(cells, ["doc"], "r", "c", "span", "merge")


_WORD = '<w:%s xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main">'
_DRAWING = '<a:theme xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"><a:themeElements>%s</a:themeElements></a:theme>'


@query(
    "word_themes",
    """WITH c AS (SELECT c_custkey AS c, c_nationkey AS n, c_custkey % 3 <> 0 AS normal, c_custkey % 4 <> 1 AS mid, c_custkey % 2000 AS margin FROM customer)
    SELECT c AS c_custkey, 'Minor' || n AS font, (20 + c % 5) / 2.0::DOUBLE AS size, CASE WHEN normal THEN printf('#0000%02X', n) END AS color, CASE WHEN normal THEN (c % 7)::DOUBLE END AS after,
      CASE c % 2 WHEN 1 THEN 'Major' ELSE 'Minor' END || n AS heading_font, CASE WHEN mid THEN 30 + n ELSE 20 + c % 5 END / 2.0::DOUBLE AS heading_size,
      CASE WHEN c % 5 = 0 THEN '#AB00CD' WHEN mid AND normal THEN printf('#0000%02X', n) END AS heading_color, CASE c % 2 WHEN 0 THEN true END AS heading_bold,
      CASE c % 2 WHEN 0 THEN 'A4' ELSE 'Letter' END AS page, CASE c % 2 WHEN 0 THEN 'portrait' ELSE 'landscape' END AS orientation,
      CASE WHEN margin + 42 < CASE c % 2 WHEN 0 THEN 595.28 ELSE 792 END - 72 THEN margin::DOUBLE END AS margin_left
    FROM c""",
)
def word_themes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A word package for each customer: default style, headings based on it through another style, or on one that is not there."""
    c, n = F.col("c_custkey"), F.col("c_nationkey")
    style = lambda id_, more, *inner: F.concat(F.lit(f'<w:style w:type="paragraph" w:styleId="{id_}"{more}>'), *[F.lit(x) if isinstance(x, str) else x for x in inner], F.lit("</w:style>"))
    defaults = F.format_string('<w:docDefaults><w:rPrDefault><w:rPr><w:rFonts w:asciiTheme="minorHAnsi"/><w:sz w:val="%d"/></w:rPr></w:rPrDefault></w:docDefaults>', 20 + c % 5)
    normal = style("Body", ' w:default="1"', F.format_string('<w:pPr><w:spacing w:after="%d"/></w:pPr><w:rPr><w:color w:val="0000%02x"/></w:rPr>', 20 * (c % 7), n))
    mid = style("Mid", "", '<w:basedOn w:val="Body"/>', F.format_string('<w:rPr><w:sz w:val="%d"/></w:rPr>', 30 + n))
    own = F.concat(F.when(c % 2 == 1, '<w:rFonts w:asciiTheme="majorHAnsi"/>').otherwise("<w:b/>"), F.when(c % 5 == 0, '<w:color w:val="AB00CD"/>').otherwise(""))
    heading = style("T1", "", '<w:name w:val="heading 1"/><w:basedOn w:val="Mid"/><w:rPr>', own, "</w:rPr>")
    styles = F.concat(F.lit(_WORD % "styles"), defaults, F.when(c % 3 != 0, normal).otherwise(""), F.when(c % 4 != 1, mid).otherwise(""), heading, F.lit("</w:styles>"))
    size = F.when(c % 2 == 0, 'w:w="11906" w:h="16838"').otherwise('w:w="15840" w:h="12240" w:orient="landscape"')
    page = F.concat(F.lit(_WORD % "document" + "<w:body><w:p/><w:sectPr><w:pgSz "), size, F.format_string('/><w:pgMar w:left="%d"/></w:sectPr></w:body></w:document>', 20 * (c % 2000)))
    fonts = F.format_string(_DRAWING % '<a:fontScheme><a:majorFont><a:latin typeface="Major%d"/></a:majorFont><a:minorFont><a:latin typeface="Minor%d"/></a:minorFont></a:fontScheme>', n, n)
    packages = F.array(*[F.struct(*_part(name, xml)) for name, xml in (("word/styles.xml", styles), ("word/document.xml", page), ("word/theme/theme1.xml", fonts))])
    parts = _spread(_read(spark, sf_dir, "customer"), "c_custkey").select("c_custkey", F.explode(packages).alias("p")).select("c_custkey", "p.*")
    d, h, p = (f"theme.{x}." for x in ("document", "headings", "page"))
    return K.word_themes(parts, ["c_custkey"]).select(
        "c_custkey", F.col(d + "font_family").alias("font"), F.col(d + "font_size_pt").alias("size"), F.col(d + "text_color").alias("color"), F.col(d + "paragraph_spacing_after_pt").alias("after"),
        F.col(h + "font_family").alias("heading_font"), F.get(h + "sizes_pt", F.lit(0)).alias("heading_size"), F.col(h + "color").alias("heading_color"), F.col(h + "bold").alias("heading_bold"),
        F.col(p + "size").alias("page"), p + "orientation", F.col(p + "margin_left_pt").alias("margin_left"),
    )


@query(
    "workbook_themes",
    """WITH l AS (SELECT l_orderkey AS o, l_linenumber AS n, min(l_quantity)::BIGINT AS q FROM lineitem GROUP BY ALL),
      r AS (SELECT *, row_number() OVER (PARTITION BY o ORDER BY n) AS row FROM l),
      c AS (SELECT o, row, unnest([(q + n) % 4, (o + n) % 4, CASE WHEN q % 2 = 1 THEN q % 4 ELSE 0 END]) AS s FROM r WHERE row <= 6),
      b AS (SELECT o, list(s ORDER BY k DESC, s)[1] AS body FROM (SELECT o, s, count(*) AS k FROM c WHERE row > 1 GROUP BY ALL) GROUP BY o),
      d AS (SELECT o, row, list(s ORDER BY k DESC, s)[1] AS s FROM (SELECT o, row, s, count(*) AS k FROM c GROUP BY ALL) GROUP BY o, row),
      x AS (SELECT d.o, coalesce(any_value(body), 0) AS body, any_value(d.s) FILTER (row = 1) AS head, (list(d.s ORDER BY row) FILTER (row > 1 AND d.s <> body))[1] AS stripe FROM d LEFT JOIN b USING (o) GROUP BY d.o)
    SELECT o AS l_orderkey, 'F' || body AS font, (10 + body)::DOUBLE AS size, CASE WHEN head <> body THEN '#0000A' || head END AS header, CASE WHEN body = 1 OR head = 1 THEN 0.5::DOUBLE END AS border, '#0000A' || stripe AS stripe
    FROM x""",
)
def workbook_themes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A workbook for each order, with a row for each line: cells with a format of their own, of their row, or none."""
    lines = _spread(_read(spark, sf_dir, "lineitem"), "l_orderkey").groupBy("l_orderkey", F.col("l_linenumber").alias("n")).agg(F.min("l_quantity").cast("long").alias("q"))
    o, n, q = (F.col(x) for x in ("l_orderkey", "n", "q"))
    row = F.concat(F.lit("<row"), F.when(q % 2 == 1, F.format_string(' s="%d"', q % 4)).otherwise(""), F.format_string('><c s="%d"/><c s="%d"><v>1</v></c><c/></row>', (q + n) % 4, (o + n) % 4))
    sheet = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", row.alias("x")))), lambda r: r["x"]), "")  # a line number once, so seven at most
    main = '<%s xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships">'
    fonts = "".join(f'<font><name val="F{k}"/><sz val="{10 + k}"/></font>' for k in range(4))
    fills = "".join(f'<fill><patternFill patternType="solid"><fgColor rgb="FF0000A{k}"/></patternFill></fill>' for k in range(4))
    formats = "".join(f'<xf fontId="{k}" fillId="{k}" borderId="{int(k == 1)}"/>' for k in range(4))
    fixed = {
        "xl/styles.xml": main % "styleSheet" + f'<fonts>{fonts}</fonts><fills>{fills}</fills><borders><border/><border><left style="thin"/></border></borders><cellXfs>{formats}</cellXfs></styleSheet>',
        "xl/workbook.xml": main % "workbook" + '<sheets><sheet name="A" r:id="rId7"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="rId7" Type="x/worksheet" Target="worksheets/first.xml"/></Relationships>',
    }
    body = F.concat(F.lit(main % "worksheet" + "<sheetData>"), F.col("sheet"), F.lit("</sheetData></worksheet>"))
    packages = F.array(F.struct(*_part("xl/worksheets/first.xml", body)), *[F.struct(*_part(name, F.lit(xml))) for name, xml in fixed.items()])
    parts = lines.groupBy("l_orderkey").agg(sheet.alias("sheet")).select("l_orderkey", F.explode(packages).alias("p")).select("l_orderkey", "p.*")
    d, t = "theme.document.", "theme.table."
    return K.workbook_themes(parts, ["l_orderkey"]).select(
        "l_orderkey", F.col(d + "font_family").alias("font"), F.col(d + "font_size_pt").alias("size"), F.col(t + "header_background").alias("header"), F.col(t + "border_width_pt").alias("border"), F.col(t + "stripe_background").alias("stripe")
    )


_SHEET_FILL = "CASE %s WHEN 's0' THEN '#0000A0' WHEN 's1' THEN '#0000A0' WHEN 's2' THEN '#0000A2' WHEN 's3' THEN '#0000A3' END"


@query(
    "sheet_themes",
    f"""WITH l AS (SELECT l_orderkey AS o, l_linenumber AS n, min(l_quantity)::BIGINT AS q FROM lineitem GROUP BY ALL),
      r AS (SELECT *, row_number() OVER (PARTITION BY o ORDER BY n) AS row FROM l),
      c AS (SELECT o, row, unnest([{{'s': 's' || (q + n) % 4, 'k': 1 + q % 3}}, {{'s': 's' || (o + n) % 4, 'k': 1}}, {{'s': '', 'k': 1}}], recursive := true) FROM r WHERE row <= 6),
      b AS (SELECT o, list(s ORDER BY k DESC, s)[1] AS body FROM (SELECT o, s, sum(k) AS k FROM c WHERE row > 1 GROUP BY ALL) GROUP BY o),
      d AS (SELECT o, row, list(s ORDER BY k DESC, s)[1] AS s FROM (SELECT o, row, s, sum(k) AS k FROM c GROUP BY ALL) GROUP BY o, row),
      f AS (SELECT d.*, body, {_SHEET_FILL % "d.s"} AS fill, {_SHEET_FILL % "body"} AS body_fill FROM d LEFT JOIN b USING (o)),
      x AS (SELECT o, any_value(body) AS body, any_value(s) FILTER (row = 1) AS head, any_value(fill) FILTER (row = 1) AS head_fill,
        (list(fill ORDER BY row) FILTER (row > 1 AND s IS DISTINCT FROM body AND fill IS NOT NULL AND fill IS DISTINCT FROM body_fill))[1] AS stripe FROM f GROUP BY o)
    SELECT o AS l_orderkey, CASE WHEN body IN ('s1', 's2') THEN 11.0 ELSE 10.0 END::DOUBLE AS size, CASE WHEN head IS DISTINCT FROM body THEN head_fill END AS header,
      CASE WHEN body IN ('s1', 's2') OR head IN ('s1', 's2') THEN 0.5::DOUBLE END AS border, stripe FROM x""",
)
def sheet_themes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An open spreadsheet for each order, with a row for each line: repeated, plain and covered cells, styles based on others."""
    lines = _spread(_read(spark, sf_dir, "lineitem"), "l_orderkey").groupBy("l_orderkey", F.col("l_linenumber").alias("n")).agg(F.min("l_quantity").cast("long").alias("q"))
    o, n, q = (F.col(x) for x in ("l_orderkey", "n", "q"))
    cells = '<x:table-row><x:table-cell x:style-name="s%d" x:number-columns-repeated="%d"/><x:table-cell x:style-name="s%d"><x:p>1</x:p></x:table-cell><x:covered-table-cell/></x:table-row>'
    row = F.format_string(cells, (q + n) % 4, 1 + q % 3, (o + n) % 4)
    rows = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", row.alias("x")))), lambda r: r["x"]), "")  # a line number once, so seven at most
    style = lambda k, up, inner: f'<x:style x:name="s{k}" x:family="table-cell" x:parent-style-name="{up}">{inner}</x:style>'
    fill = lambda k: f'<x:table-cell-properties x:background-color="#0000a{k}"/>'
    own = style(1, "s0", '<x:text-properties x:font-size="11pt"/><x:table-cell-properties x:border="0.5pt solid #0000ff"/>') + style(2, "s1", fill(2)) + style(3, "gone", fill(3))
    common = '<x:styles xmlns:x="urn:x"><x:default-style x:family="table-cell"><x:text-properties x:font-size="10pt"/></x:default-style>' + style(0, "none", fill(0)) + "</x:styles>"
    content = F.concat(F.lit(f'<x:content xmlns:x="urn:x">{own}<x:table>'), F.col("rows"), F.lit("</x:table></x:content>"))
    packages = F.array(F.struct(*_part("content.xml", content)), F.struct(*_part("styles.xml", F.lit(common))))
    parts = lines.groupBy("l_orderkey").agg(rows.alias("rows")).select("l_orderkey", F.explode(packages).alias("p")).select("l_orderkey", "p.*")
    t = "theme.table."
    return K.sheet_themes(parts, ["l_orderkey"]).select(
        "l_orderkey", F.col("theme.document.font_size_pt").alias("size"), F.col(t + "header_background").alias("header"), F.col(t + "border_width_pt").alias("border"), F.col(t + "stripe_background").alias("stripe")
    )


@query(
    "slide_themes",
    """SELECT s_suppkey, 'Minor' || s_nationkey AS font, CASE s_suppkey % 2 WHEN 0 THEN 'Major' ELSE 'Minor' || s_nationkey END AS heading_font, printf('#%02X00%02X', s_suppkey % 256, s_nationkey) AS heading_color,
      printf('#%02X00%02X', s_suppkey % 256, s_nationkey) AS level_1, CASE s_suppkey % 3 WHEN 0 THEN '#0B0B0B' ELSE printf('#%02X00%02X', s_suppkey % 256, s_nationkey) END AS level_2, '#1A1A1A' AS color FROM supplier""",
)
def slide_themes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A slide package for each supplier: its theme's fonts and colours."""
    s, n = F.col("s_suppkey"), F.col("s_nationkey")
    colors = F.concat(F.format_string('<a:clrScheme><a:dk1><a:sysClr lastClr="1a1a1a"/></a:dk1><a:accent1><a:srgbClr val="%02x00%02x"/></a:accent1>', s % 256, n), F.when(s % 3 == 0, '<a:accent2><a:srgbClr val="0b0b0b"/></a:accent2>').otherwise(""), F.lit("</a:clrScheme>"))
    fonts = F.concat(F.lit('<a:fontScheme><a:majorFont><a:latin typeface="'), F.when(s % 2 == 0, "Major").otherwise(" "), F.format_string('"/></a:majorFont><a:minorFont><a:latin typeface="Minor%d"/></a:minorFont></a:fontScheme>', n))
    before, after = _DRAWING.split("%s")
    packages = F.array(F.struct(*_part("ppt/presentation.xml", F.lit("<p/>"))), F.struct(*_part("ppt/theme/theme1.xml", F.concat(F.lit(before), colors, fonts, F.lit(after)))))
    parts = _spread(_read(spark, sf_dir, "supplier"), "s_suppkey").select("s_suppkey", F.explode(packages).alias("p")).select("s_suppkey", "p.*")
    h = "theme.headings."
    return K.slide_themes(parts, ["s_suppkey"]).select(
        "s_suppkey", F.col("theme.document.font_family").alias("font"), F.col(h + "font_family").alias("heading_font"), F.col(h + "color").alias("heading_color"), F.get(h + "level_colors", F.lit(0)).alias("level_1"),
        F.get(h + "level_colors", F.lit(1)).alias("level_2"), F.col("theme.document.text_color").alias("color"),
    )


@query(
    "ragged_union",
    """WITH c AS (SELECT event_id, 'id' AS key, 'integer' AS kind, event_id::VARCHAR AS text FROM events
        UNION ALL SELECT event_id, 'kind', 'string', event_type FROM events WHERE event_id % 3 = 1
        UNION ALL SELECT event_id, 'big', 'boolean', CASE WHEN user_id > 50 THEN 'true' ELSE 'false' END FROM events WHERE event_id % 4 = 2
        UNION ALL SELECT event_id, 'none', 'empty', NULL FROM events WHERE event_id % 5 = 3
        UNION ALL SELECT event_id, 'half', 'float', (user_id + 0.5)::DECIMAL(20, 1)::VARCHAR FROM events WHERE event_id % 7 = 4
        UNION ALL SELECT event_id, 'nest', 'string', '{"a":[1,null]}' FROM events WHERE event_id % 11 = 5),
      h AS (SELECT key, row_number() OVER (ORDER BY min(event_id), key)::INT AS place FROM c GROUP BY key)
    SELECT event_id, place, key, coalesce(kind, 'empty') AS kind, text FROM events CROSS JOIN h LEFT JOIN c USING (event_id, key)""",
)
def ragged_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as objects of one to six keys."""
    e = F.col("event_id")
    piece = lambda divisor, rest, *text: F.when(e % divisor == rest, F.concat(*[t if isinstance(t, Column) else F.lit(t) for t in text]))
    pieces = [
        F.concat(F.lit('"id":'), e.cast("string")), piece(3, 1, '"kind":"', F.col("event_type"), '"'), piece(4, 2, '"big":', (F.col("user_id") > 50).cast("string")), piece(5, 3, '"none":null'),
        piece(7, 4, '"half":', F.col("user_id").cast("string"), ".5"), piece(11, 5, '"nest":{"a":[1,null]}'),
    ]
    text = F.concat(F.lit("{"), F.array_join(F.filter(F.array(*pieces), lambda p: p.isNotNull()), ","), F.lit("}"))
    return P.ragged_union(_read(spark, sf_dir, "events").select("event_id", F.parse_json(text).alias("v")), ["event_id"], "v")


@query(
    "repeated_cells",
    """WITH r AS (SELECT event_id % 5 AS doc, event_id, CASE WHEN event_id % 9 = 0 THEN 1048576 ELSE 1 + user_id % 3 END AS repeat, event_id % 9 = 0 AS blank, user_id FROM events),
      s AS (SELECT *, coalesce(sum(repeat) OVER (PARTITION BY doc ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM r)
    SELECT doc, start + unnest(range(1, repeat + 1)) AS row, 'a|a|' || CASE WHEN user_id % 2 = 0 THEN '-|-|-|' ELSE '' END || user_id AS cells FROM s WHERE NOT blank""",
)
def repeated_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as runs of rows: each ninth is a run of 2^20 blank rows, and each row ends in a run of blank cells."""
    e, u = F.col("event_id"), F.col("user_id")
    cell = lambda value, n: F.struct(value.cast("string").alias("value"), n.cast("int").alias("repeat"))
    full = F.array(cell(F.lit("a"), F.lit(2)), cell(F.lit(None), F.when(u % 2 == 0, 3).otherwise(0)), cell(u, F.lit(1)), cell(F.lit(None), F.lit(16_384)))
    blank = F.array(cell(F.lit(None), F.lit(16_384)))
    runs = _read(spark, sf_dir, "events").select((e % 5).alias("doc"), "event_id", F.when(e % 9 == 0, F.lit(1 << 20)).otherwise(1 + u % 3).alias("repeat"), F.when(e % 9 == 0, blank).otherwise(full).alias("cells"))
    return O.expand_runs(runs, ["doc"], "event_id").select("doc", "row", F.array_join("cells", "|", "-").alias("cells"))


@query(
    "positional_diff",
    """WITH a AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS number, text FROM conversations),
      b AS (SELECT conv_id, number, CASE WHEN turn % 3 = 0 THEN text || '!' ELSE text END AS text FROM (
        SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS number FROM conversations WHERE NOT (conv_id % 4 = 1 AND turn = 1)
        UNION ALL SELECT conv_id, max(turn) + 1, 'new', count(*) + 1 FROM conversations WHERE conv_id % 4 = 2 GROUP BY conv_id)),
      d AS (SELECT coalesce(a.conv_id, b.conv_id) AS conv_id, coalesce(a.number, b.number) AS number, a.text AS old, b.text AS new,
        CASE WHEN a.number IS NULL THEN 'added' WHEN b.number IS NULL THEN 'removed' WHEN a.text IS NOT DISTINCT FROM b.text THEN 'unchanged' ELSE 'edited' END AS change
        FROM a FULL JOIN b ON a.conv_id = b.conv_id AND a.number = b.number)
    SELECT *, bool_or(change IN ('added', 'removed')) OVER (PARTITION BY conv_id) AS structural FROM d""",
)
def positional_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations against a version with edited turns, one turn less in some, and one more in others."""
    old = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    more = old.where("conv_id % 4 = 2").groupBy("conv_id").agg((F.max("turn") + 1).alias("turn")).withColumn("text", F.lit("new"))
    kept = old.where("not (conv_id % 4 = 1 and turn = 1)").union(more)
    new = kept.withColumn("text", F.when(F.col("turn") % 3 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return O.positional_diff(old, new, ["conv_id"], "turn", "text")
