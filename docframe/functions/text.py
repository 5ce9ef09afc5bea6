"""Text functions of the document formats, as expressions that stay inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that each Markdown context escapes, in order.
ESCAPED = {"plain": "\\*`[]", "docx": "\\*`[]~<", "html": "\\*`[]_", "text": "\\*`[]~<_>"}
#: Entities and what they stand for, in the order in which they are replaced.
ENTITIES = (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"))
#: Page sizes in points, short and long side.
PAGE_SIZES = (("A3", 841.89, 1190.55), ("A4", 595.28, 841.89), ("A5", 419.53, 595.28), ("Letter", 612.0, 792.0), ("Legal", 612.0, 1008.0))
#: Schemes that links may have.
SAFE_SCHEMES = ("http", "https", "mailto", "tel")
#: File extensions and their formats.
FORMATS = {"md": "markdown", "markdown": "markdown", "docx": "docx", "odt": "odt", "pdf": "pdf", "csv": "csv", "xlsx": "xlsx", "xlsm": "xlsx", "ods": "ods", "json": "json", "yaml": "yaml", "yml": "yaml", "toml": "toml", "pptx": "pptx", "odp": "odp", "html": "html", "htm": "html", "doc": "doc", "xls": "xls", "ppt": "ppt"}
TEXT_FORMATS = ("markdown", "csv", "json", "yaml", "toml", "html")


def replaced(x: Column, *pairs: tuple[str, str]) -> Column:
    """Literal replacements, one after the other."""
    for old, new in pairs:
        x = F.replace(x, F.lit(old), F.lit(new))
    return x


def markdown_escape(x: Column, context: str = "plain") -> Column:
    return replaced(x, *((c, "\\" + c) for c in ESCAPED[context]))


def markdown_unescape(x: Column) -> Column:
    return F.regexp_replace(x, r"\\([\\*_`~<\[\]])", "$1")


def latex_escape(x: Column) -> Column:
    return replaced(x, *((c, "\\" + c) for c in "\\{}"))


def latex_unescape(x: Column) -> Column:
    return F.regexp_replace(x, r"\\([\\{}])", "$1")


def cell_escape(x: Column) -> Column:
    """Text of a Markdown table cell."""
    return replaced(x, ("\\", "\\\\"), ("|", "\\|"), ("\n", "<br>"))


def xml_escape(x: Column) -> Column:
    return replaced(x, ("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"))


def xml_attribute_escape(x: Column) -> Column:
    return replaced(xml_escape(x), ('"', "&quot;"), ("'", "&apos;"))


def csv_field(x: Column, delimiter: str = ",") -> Column:
    """A field of a CSV record: quoted when it holds the delimiter, a quote or a line break, or is empty alone."""
    quoted = F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(x.rlike("[\"\\r\\n" + ("\\" if delimiter in "|^$.*+?()[]{}\\" else "") + delimiter + "]"), quoted).otherwise(x)


def strip_tags(x: Column) -> Column:
    """Text outside of tags, with the five basic entities decoded; a tag that is never closed takes the rest."""
    return replaced(F.regexp_replace(x, "<[^>]*(>|$)", ""), *ENTITIES)


def collapse_whitespace(x: Column) -> Column:
    """Each run of Unicode white space as one blank."""
    return F.regexp_replace(x, r"(?U)\s+", " ")


def has_visible_text(x: Column) -> Column:
    """Whether a page's text layer holds anything but white space and control characters."""
    return F.coalesce(x.rlike(r"[^\s\p{Cntrl}]"), F.lit(False))


def heading_anchor(x: Column) -> Column:
    """A heading's link target: letters and digits in lower case, runs of blanks and dashes as one dash; null if empty."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(x), "#+$", ""), r"(?U)^\s+|\s+$", "")
    kept = F.regexp_replace(F.lower(bare), r"(?U)[^\p{L}\p{N}\s-]", "")
    slug = F.regexp_replace(F.regexp_replace(kept, r"(?U)[\s-]+", "-"), "^-+|-+$", "")
    return F.when(slug != "", slug)


def slugify(x: Column) -> Column:
    """Letters, digits, dashes and underscores in lower case; runs of anything else as one dash."""
    slug = F.regexp_replace(F.lower(x), r"(?U)[^\p{L}\p{N}_]+", "-")
    return F.regexp_replace(slug, "^-+|-+$", "")


def link_destination(x: Column) -> Column:
    """How a Markdown link writes its target."""
    angled = F.concat(F.lit("<"), F.replace(x, F.lit(">"), F.lit("\\>")), F.lit(">"))
    return F.when(x.rlike(r"(?U)[\s<>]"), angled).otherwise(replaced(x, ("\\", "\\\\"), (")", "\\)")))


def is_bookmark_name(x: Column) -> Column:
    return x.rlike("^[A-Za-z_][A-Za-z0-9_]{0,39}$")


def is_safe_uri(x: Column) -> Column:
    scheme = F.lower(F.split_part(x, F.lit(":"), F.lit(1)))
    return x.contains(":") & scheme.isin(*SAFE_SCHEMES)


def code_fence(x: Column, minimum: int = 2) -> Column:
    """A run of backticks one longer than any in x, and than minimum."""
    longest = F.array_max(F.transform(F.regexp_extract_all(x, F.lit("(`+)"), F.lit(1)), lambda r: F.length(r)))
    return F.repeat(F.lit("`"), F.greatest(F.coalesce(longest, F.lit(0)), F.lit(minimum)) + 1)


def roman_number(n: Column) -> Column:
    """Lower-case Roman numeral of 1 to 3999, else the decimal."""
    digits = [["", "i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix"], ["", "x", "xx", "xxx", "xl", "l", "lx", "lxx", "lxxx", "xc"], ["", "c", "cc", "ccc", "cd", "d", "dc", "dcc", "dccc", "cm"], ["", "m", "mm", "mmm"]]
    parts = [F.try_element_at(F.array(*map(F.lit, d)), (F.floor(n / 10**k) % 10 + 1).cast("int")) for k, d in enumerate(digits)]
    return F.when(n.between(1, 3999), F.concat(*parts[::-1])).otherwise(n.cast("string"))


def list_item(line: Column) -> tuple[Column, Column, Column]:
    """(kind, level, content) of a Markdown list line: kind 1 for bullets, 2 for numbers, null for other lines."""
    bullet, number = r"^([ \t]*)[-*+](?:[ \t]+(.*))?$", r"^([ \t]*)[0-9]{1,9}[.)](?:[ \t]+(.*))?$"
    kind = F.when(line.rlike(bullet), 1).when(line.rlike(number), 2)
    level = F.when(kind.isNotNull(), F.floor(F.length(F.regexp_extract(line, r"^([ \t]*)", 1)) / 4).cast("int"))
    content = F.when(kind == 1, F.regexp_extract(line, bullet, 2)).when(kind == 2, F.regexp_extract(line, number, 2))
    return kind, level, content


def line_kind(line: Column) -> Column:
    """What kind of Markdown block a line starts or goes on."""
    kind, _, _ = list_item(line)
    return (
        F.when(F.trim(line) == "", "blank").when(line.rlike("^#{1,6} "), "heading").when(line.rlike("^ {0,3}(```|~~~)"), "fence")
        .when(line.rlike(r"^ {0,3}(-{3,}|\*{3,}|_{3,})\s*$"), "rule").when(line.rlike("^ {0,3}>"), "quote").when(kind.isNotNull(), "list_item")
        .when(line.contains("|"), "table_row").otherwise("text")
    )


def pageref_target(x: Column) -> Column:
    """The word after PAGEREF in a field instruction; null without one."""
    found = F.regexp_extract(x, r"(?i)(?:^|\s)PAGEREF\s+(\S+)", 1)
    return F.when(found != "", found)


def textual_list_item(x: Column) -> Column:
    """A paragraph that is numbered by hand, as a list line: `1.2. x` is indented by its depth; null for others.

    A single plain number with a dot is left alone unless emphasis wraps the paragraph.
    """
    out = F.lit(None).cast("string")
    for mark in ("_", "*", "~~", "__", "**", ""):
        m = "".join("\\" + c for c in mark)
        shape = rf"(?s)^{m}((?:[0-9]+\.)*)([0-9]+)([.)])(?U:\s+)(.*){m}$"
        depth = F.length(F.regexp_replace(F.regexp_extract(x, shape, 1), "[0-9]", ""))
        line = F.concat(F.repeat(F.lit("    "), depth), F.regexp_replace(F.regexp_extract(x, shape, 2), "^0+(?=[0-9])", ""), F.lit(". " + mark), F.regexp_extract(x, shape, 4), F.lit(mark))
        counts = F.lit(True) if mark else (F.regexp_extract(x, shape, 3) == ")") | (depth > 0)
        out = F.when(x.rlike(shape) & counts, line).otherwise(out)
    return out


def base64_text(x: Column) -> Column:
    """Standard base64 without line breaks."""
    return F.regexp_replace(F.base64(x.cast("binary")), "\r\n", "")


def file_format(name: Column) -> Column:
    """The format of a file name's extension; null if unknown."""
    table = F.create_map(*[F.lit(v) for pair in FORMATS.items() for v in pair])
    return F.try_element_at(table, F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1)))


def chart_number(x: Column) -> Column:
    """A chart label's number: without decimals if it is whole, else with one."""
    return F.when(x == F.floor(x), F.format_string("%.0f", x)).otherwise(F.format_string("%.1f", x))


def pixels_of_emu(x: Column, fallback: float) -> Column:
    return F.when(x > 0, F.least(F.greatest(x / 9525.0, F.lit(64.0)), F.lit(960.0))).otherwise(F.lit(fallback))


def tinted(channel: Column, tint: Column) -> Column:
    """A colour channel moved towards black (tint below 0) or white."""
    moved = F.when(tint < 0, channel * (1 + tint)).otherwise(channel + (255 - channel) * tint)
    return F.least(F.greatest(F.floor(moved + 0.5), F.lit(0)), F.lit(255)).cast("int")


def hex_color(red: Column, green: Column, blue: Column) -> Column:
    return F.format_string("#%02X%02X%02X", red, green, blue)


def nearest_page_size(width: Column, height: Column) -> Column:
    """The page size whose sides differ least in sum; the first of equals."""
    short, long_ = F.least(width, height), F.greatest(width, height)
    sizes = F.array(*[F.struct((F.abs(short - a) + F.abs(long_ - b)).alias("error"), F.lit(k).alias("at"), F.lit(n).alias("name")) for k, (n, a, b) in enumerate(PAGE_SIZES)])
    return F.array_min(sizes)["name"]


def page_fields(x: Column, page: Column, pages: Column) -> Column:
    """Header or footer text with page number fields filled in."""
    return F.replace(F.replace(x, F.lit("{page}"), page.cast("string")), F.lit("{pages}"), pages.cast("string"))


def css_string(x: Column) -> Column:
    """x as a quoted CSS string."""
    return F.concat(F.lit('"'), replaced(x, ("\\", "\\\\"), ('"', '\\"'), ("\n", "\\a "), ("\r", "\\d "), ("<", "\\3C "), (">", "\\3E "), ("&", "\\26 ")), F.lit('"'))


def css_font_family(x: Column) -> Column:
    """x as a quoted CSS font name; signs that could end it are left out."""
    return F.concat(F.lit('"'), F.translate(x, '\\"<>&', ""), F.lit('"'))


def css_page_content(x: Column) -> Column:
    """Header or footer text as CSS content: quoted pieces, with counters in place of page number fields."""
    marked = F.regexp_replace(x, r"(\{pages?\})", "\u0001$1\u0001")
    pieces = F.filter(F.split(marked, "\u0001"), lambda p: p != "")
    shown = lambda p: F.when(p == "{page}", "counter(page)").when(p == "{pages}", "counter(pages)").otherwise(css_string(p))
    return F.array_join(F.transform(pieces, shown), " ")


def twips(points: Column) -> Column:
    """Points as twentieths of a point."""
    return F.round(points * 20).cast("long")


def half_points(points: Column) -> Column:
    return F.round(points * 2).cast("long")


def border_eighths(points: Column) -> Column:
    """Points as eighths of a point, the unit of border widths."""
    return F.round(points * 8).cast("long")
