"""Named queries over the driver's tables, and the SQL that says what each returns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cells as C
from ..functions import text as X
from ..operators import html as H
from ..operators import inheritance as I
from ..operators import nodes as N
from ..operators import ordered as O
from ..operators import relational as R
from ..operators import tables as T
from ..sources import slides as S
from . import convert as V

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _spread(df: DataFrame, key: str) -> DataFrame:
    """df by its key in as many parts as shuffles have: few bytes that become large packages would else be put into one task."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query, with DuckDB SQL for the same rows where SQL can express it."""

    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def _of(name: str, table: str, key: str, sql: str, make: Callable[[], dict]) -> None:
    """A query that selects a key and some expressions from one table."""

    @query(name, sql)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _read(spark, sf_dir, table).select(key, *[e.alias(n) for n, e in make().items()])


def _nested(x: str, *pairs: tuple[str, str]) -> str:
    for old, new in pairs:
        x = "replace({}, '{}', '{}')".format(x, old.replace("'", "''"), new.replace("'", "''"))
    return x


def _escapes(context: str) -> list[tuple[str, str]]:
    return [(c, "\\" + c) for c in X.ESCAPED[context]]


_of(
    "strip_tags",
    "pages",
    "page_id",
    f"SELECT page_id, {_nested("regexp_replace(html, '<[^>]*(>|$)', '', 'g')", *X.ENTITIES)} AS plain FROM pages",
    lambda: {"plain": X.strip_tags(F.col("html"))},
)
for _c in ("plain", "docx", "html", "text"):
    _of(f"markdown_escape_{_c}", "documents", "doc_id", f"SELECT doc_id, {_nested('text', *_escapes(_c))} AS escaped FROM documents", lambda _c=_c: {"escaped": X.markdown_escape(F.col("text"), _c)})
_of(
    "markdown_unescape",
    "documents",
    "doc_id",
    (
        "SELECT doc_id, text AS unescaped FROM documents WHERE text NOT LIKE '%\\%' UNION ALL SELECT doc_id, "
        "regexp_replace(text, '\\\\([\\\\*_`~<\\[\\]])', '\\1', 'g') FROM documents WHERE text LIKE '%\\%'"
    ),
    lambda: {"unescaped": X.markdown_unescape(F.col("text"))},
)
_of(
    "latex_escape",
    "documents",
    "doc_id",
    f"SELECT doc_id, {_nested('text', *[(c, chr(92) + c) for c in chr(92) + '{}'])} AS escaped FROM documents",
    lambda: {"escaped": X.latex_escape(F.col("text"))},
)
_of(
    "latex_escape_inverse",
    "documents",
    "doc_id",
    "SELECT doc_id, text AS same FROM documents",
    lambda: {"same": X.latex_unescape(X.latex_escape(F.col("text")))},
)
_of(
    "xml_escape",
    "documents",
    "doc_id",
    f"SELECT doc_id, {_nested('text', ('&', '&amp;'), ('<', '&lt;'), ('>', '&gt;'))} AS escaped FROM documents",
    lambda: {"escaped": X.xml_escape(F.col("text"))},
)
_of(
    "xml_attribute_escape",
    "documents",
    "doc_id",
    f"SELECT doc_id, {_nested('text', ('&', '&amp;'), ('<', '&lt;'), ('>', '&gt;'), (chr(34), '&quot;'), (chr(39), '&apos;'))} AS escaped FROM documents",
    lambda: {"escaped": X.xml_attribute_escape(F.col("text"))},
)
_of(
    "cell_escape",
    "documents",
    "doc_id",
    "SELECT doc_id, replace(replace(replace(text, '\\', '\\\\'), '|', '\\|'), chr(10), '<br>') AS cell FROM documents",
    lambda: {"cell": X.cell_escape(F.col("text"))},
)
_of(
    "collapse_whitespace",
    "documents",
    "doc_id",
    (
        'SELECT doc_id, regexp_replace(text, '
        "'[\\s\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x0B]+', ' ', 'g') AS collapsed FROM "
        'documents'
    ),
    lambda: {"collapsed": X.collapse_whitespace(F.col("text"))},
)
_of(
    "text_layer_usable",
    "documents",
    "doc_id",
    "SELECT doc_id, coalesce(regexp_matches(text, '[^\\s[:cntrl:]]'), false) AS usable FROM documents",
    lambda: {"usable": X.has_visible_text(F.col("text"))},
)
_of(
    "base64_text",
    "documents",
    "doc_id",
    "SELECT doc_id, base64(encode(text)) AS encoded FROM documents",
    lambda: {"encoded": X.base64_text(F.col("text"))},
)
_of(
    "heading_anchor",
    "pages",
    "page_id",
    """SELECT page_id, nullif(regexp_replace(regexp_replace(regexp_replace(lower(t), '[^\\p{L}\\p{N}\\s-]', '', 'g'), '[\\s-]+', '-', 'g'), '^-+|-+$', '', 'g'), '') AS anchor
    FROM (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS t FROM pages)""",
    lambda: {"anchor": X.heading_anchor(F.regexp_extract("html", "<title>([^<]*)</title>", 1))},
)
_of(
    "slugify",
    "part",
    "p_partkey",
    (
        "SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name || ' ' || p_type || '_' || p_brand), '[^\\p{L}\\p{N}_]+', "
        "'-', 'g'), '^-+|-+$', '', 'g') AS slug FROM part"
    ),
    lambda: {"slug": X.slugify(F.concat("p_name", F.lit(" "), "p_type", F.lit("_"), "p_brand"))},
)
_of(
    "link_destination",
    "pages",
    "page_id",
    """SELECT page_id, CASE WHEN regexp_matches(u, '[\\s<>]') THEN '<' || replace(u, '>', '\\>') || '>' ELSE replace(replace(u, '\\', '\\\\'), ')', '\\)') END AS destination
    FROM (SELECT page_id, CASE page_id % 3 WHEN 0 THEN url WHEN 1 THEN url || ' (a)' ELSE url || '/(b)' END AS u FROM pages)""",
    lambda: {"destination": X.link_destination(F.when(F.col("page_id") % 3 == 0, F.col("url")).when(F.col("page_id") % 3 == 1, F.concat("url", F.lit(" (a)"))).otherwise(F.concat("url", F.lit("/(b)"))))},
)
_of(
    "bookmark_name",
    "part",
    "p_partkey",
    "SELECT p_partkey, regexp_matches(replace(p_name, ' ', '_'), '^[A-Za-z_][A-Za-z0-9_]{0,39}$') AS valid FROM part",
    lambda: {"valid": X.is_bookmark_name(F.replace(F.col("p_name"), F.lit(" "), F.lit("_")))},
)
_of(
    "safe_uri",
    "pages",
    "page_id",
    "SELECT page_id, contains(url, ':') AND lower(split_part(url, ':', 1)) IN ('http', 'https', 'mailto', 'tel') AS safe FROM pages",
    lambda: {"safe": X.is_safe_uri(F.col("url"))},
)
_of(
    "code_fence",
    "documents",
    "doc_id",
    (
        "SELECT doc_id, repeat('`', greatest(coalesce(list_max(list_transform(regexp_extract_all(text || '``', '`+'), lambda "
        'x: length(x))), 0), 2) + 1) AS fence FROM documents'
    ),
    lambda: {"fence": X.code_fence(F.concat("text", F.lit("``")))},
)
_of(
    "roman_number",
    "part",
    "p_partkey",
    """SELECT p_partkey, CASE WHEN n BETWEEN 1 AND 3999 THEN (['', 'm', 'mm', 'mmm'])[n // 1000 + 1] || (['', 'c', 'cc', 'ccc', 'cd', 'd', 'dc', 'dcc', 'dccc', 'cm'])[n // 100 % 10 + 1]
    || (['', 'x', 'xx', 'xxx', 'xl', 'l', 'lx', 'lxx', 'lxxx', 'xc'])[n // 10 % 10 + 1] || (['', 'i', 'ii', 'iii', 'iv', 'v', 'vi', 'vii', 'viii', 'ix'])[n % 10 + 1] ELSE n::VARCHAR END AS label
    FROM (SELECT p_partkey, p_partkey * 3 - 3 AS n FROM part)""",
    lambda: {"label": X.roman_number(F.col("p_partkey") * 3 - 3)},
)
_of(
    "pageref_target",
    "part",
    "p_partkey",
    (
        "SELECT p_partkey, nullif(regexp_extract(CASE p_partkey % 2 WHEN 0 THEN ' pageref ' ELSE ' PAGES ' END || p_name, "
        "'(?i)(?:^|\\s)PAGEREF\\s+(\\S+)', 1), '') AS target FROM part"
    ),
    lambda: {"target": X.pageref_target(F.concat(F.when(F.col("p_partkey") % 2 == 0, " pageref ").otherwise(" PAGES "), "p_name"))},
)
_of(
    "page_fields",
    "part",
    "p_partkey",
    "SELECT p_partkey, 'Page ' || p_size || ' of ' || p_partkey AS footer FROM part",
    lambda: {"footer": X.page_fields(F.lit("Page {page} of {pages}"), F.col("p_size"), F.col("p_partkey"))},
)
_of(
    "css_string",
    "part",
    "p_partkey",
    "SELECT p_partkey, '\"' || replace(replace(p_name || '\"', '\\', '\\\\'), '\"', '\\\"') || '\"' AS quoted FROM part",
    lambda: {"quoted": X.css_string(F.concat("p_name", F.lit('"')))},
)
_of(
    "chart_number",
    "supplier",
    "s_suppkey",
    (
        "SELECT s_suppkey, CASE WHEN v = floor(v) THEN printf('%.0f', v) ELSE printf('%.1f', v) END AS label FROM (SELECT "
        's_suppkey, s_suppkey / 4.0::DOUBLE + 0.01::DOUBLE * (s_suppkey % 2) AS v FROM supplier)'
    ),
    lambda: {"label": X.chart_number(F.col("s_suppkey") / 4.0 + F.lit(0.01) * (F.col("s_suppkey") % 2))},
)
_of(
    "pixels_of_emu",
    "part",
    "p_partkey",
    (
        'SELECT p_partkey, CASE WHEN e > 0 THEN least(greatest(e / 9525.0::DOUBLE, 64.0), 960.0) ELSE 320.0 END AS pixels FROM '
        '(SELECT p_partkey, ((p_partkey - 5) * 10000)::DOUBLE AS e FROM part)'
    ),
    lambda: {"pixels": X.pixels_of_emu(((F.col("p_partkey") - 5) * 10000).cast("double"), 320.0)},
)
_of(
    "tinted_color",
    "part",
    "p_partkey",
    """SELECT p_partkey, printf('#%02X%02X%02X', c, c, c) AS color FROM (SELECT p_partkey, least(greatest(floor(CASE WHEN t < 0 THEN b * (1 + t) ELSE b + (255 - b) * t END + 0.5), 0), 255)::INT AS c
    FROM (SELECT p_partkey, (p_partkey * 7 % 256)::DOUBLE AS b, (p_size - 25) / 32.0::DOUBLE AS t FROM part))""",
    lambda: {"color": X.hex_color(*[X.tinted((F.col("p_partkey") * 7 % 256).cast("double"), (F.col("p_size") - 25) / 32.0)] * 3)},
)
_of(
    "nearest_page_size",
    "part",
    "p_partkey",
    """SELECT p_partkey, (SELECT name FROM (VALUES (0, 'A3', 841.89::DOUBLE, 1190.55::DOUBLE), (1, 'A4', 595.28, 841.89), (2, 'A5', 419.53, 595.28), (3, 'Letter', 612.0, 792.0), (4, 'Legal', 612.0, 1008.0)) s(k, name, a, b)
    ORDER BY abs(least(w, h) - a) + abs(greatest(w, h) - b), k LIMIT 1) AS size FROM (SELECT p_partkey, 400.0::DOUBLE + p_size * 9 AS w, 500.0::DOUBLE + p_partkey % 700 AS h FROM part)""",
    lambda: {"size": X.nearest_page_size(F.lit(400.0) + F.col("p_size") * 9, F.lit(500.0) + F.col("p_partkey") % 700)},
)
_of(
    "format_detect",
    "pages",
    "page_id",
    (
        "SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'markdown' WHEN 1 THEN 'docx' WHEN 2 THEN 'xlsx' WHEN 3 THEN 'yaml' WHEN "
        "4 THEN 'html' END AS format FROM pages"
    ),
    lambda: {"format": X.file_format(F.concat("url", F.element_at(F.array(*map(F.lit, [".md", ".DOCX", ".xlsm", ".yml", ".htm", ".tsv"])), (F.col("page_id") % 6 + 1).cast("int"))))},
)
_of(
    "textual_list_item",
    "part",
    "p_partkey",
    (
        "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '    2. ' || p_name WHEN 1 THEN p_partkey || '. ' || p_name WHEN 2 "
        "THEN NULL ELSE '3. **' || p_name || '**' END AS item FROM part"
    ),
    lambda: {"item": X.textual_list_item(F.element_at(F.array(F.concat(F.lit("1.2. "), "p_name"), F.concat(F.col("p_partkey").cast("string"), F.lit(")  "), "p_name"), F.concat(F.lit("7. "), "p_name"), F.concat(F.lit("**3. "), "p_name", F.lit("**"))), (F.col("p_partkey") % 4 + 1).cast("int")))},
)
_of(
    "cell_kind",
    "lineitem",
    "l_orderkey, l_linenumber".split(", ")[0],
    (
        "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity = floor(l_quantity) THEN 'integer' ELSE 'float' END AS "
        "quantity_kind, CASE WHEN l_extendedprice = floor(l_extendedprice) THEN 'integer' ELSE 'float' END AS price_kind FROM "
        'lineitem'
    ),
    lambda: {"l_linenumber": F.col("l_linenumber"), "quantity_kind": C.float_kind(F.col("l_quantity")), "price_kind": C.float_kind(F.col("l_extendedprice"))},
)
_of(
    "cell_text",
    "orders",
    "o_orderkey",
    (
        'SELECT o_orderkey, CASE WHEN v = floor(v) THEN v::BIGINT::VARCHAR ELSE v::VARCHAR END AS cell FROM (SELECT '
        'o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN floor(o_totalprice) ELSE o_totalprice END AS v FROM orders)'
    ),
    lambda: {"cell": C.float_text(F.when(F.col("o_orderkey") % 5 == 0, F.floor("o_totalprice").cast("double")).otherwise(F.col("o_totalprice")))},
)
_of(
    "json_cell",
    "events",
    "event_id",
    (
        "SELECT event_id, CASE WHEN props IS NULL THEN 'empty' WHEN json_type(props) = 'OBJECT' THEN 'string' ELSE 'other' END "
        "AS kind, CASE json_type(props, '$.' || json_keys(props)[1]) WHEN 'UBIGINT' THEN 'integer' WHEN 'BIGINT' THEN "
        "'integer' WHEN 'DOUBLE' THEN 'float' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'VARCHAR' THEN 'string' ELSE 'empty' END AS "
        'first_kind FROM events'
    ),
    lambda: {"kind": C.json_kind(F.col("props")), "first_kind": C.json_kind(F.to_json(F.variant_get(F.parse_json("props"), F.concat(F.lit("$."), F.element_at(F.json_object_keys("props"), 1)), "variant")))},
)


@query("extract_links", "SELECT page_id, unnest(regexp_extract_all(html, '<a [^>]*href=\"([^\"]*)\"', 1)) AS target FROM pages")
def extract_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.regexp_extract_all("html", F.lit('<a [^>]*href="([^"]*)"'), F.lit(1))
    return _read(spark, sf_dir, "pages").select("page_id", F.explode(found).alias("target"))


@query("line_kind", """SELECT kind, count(*) AS n FROM (SELECT CASE WHEN trim(line) = '' THEN 'blank' WHEN regexp_matches(line, '^#{1,6} ') THEN 'heading' WHEN regexp_matches(line, '^ {0,3}(```|~~~)') THEN 'fence'
    WHEN regexp_matches(line, '^ {0,3}(-{3,}|\\*{3,}|_{3,})\\s*$') THEN 'rule' WHEN regexp_matches(line, '^ {0,3}>') THEN 'quote' WHEN regexp_matches(line, '^[ \\t]*([-*+]|[0-9]{1,9}[.)])([ \\t].*)?$') THEN 'list_item'
    WHEN contains(line, '|') THEN 'table_row' ELSE 'text' END AS kind FROM (SELECT unnest(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10))) AS line FROM documents)) GROUP BY kind""")
def line_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = R.lines_of(_read(spark, sf_dir, "documents"), ["doc_id"], "text")
    return lines.groupBy(X.line_kind(F.col("line")).alias("kind")).agg(F.count("*").alias("n"))


@query("markdown_table", (
    "SELECT '| n_nationkey | n_name | n_regionkey |' || chr(10) || '| --- | --- | --- |' || chr(10) || string_agg('| ' || "
    "n_nationkey || ' | ' || n_name || ' | ' || n_regionkey || ' |', chr(10) ORDER BY n_nationkey) AS markdown FROM nation"
))
def markdown_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.markdown_tables(_read(spark, sf_dir, "nation"), [], ["n_nationkey", "n_name", "n_regionkey"], ["n_nationkey"])


@query("sheet_text", (
    "SELECT r_name, '## ' || r_name || chr(10) || chr(10) || '| n_nationkey | n_name |' || chr(10) || '| --- | --- |' || "
    "chr(10) || string_agg('| ' || n_nationkey || ' | ' || n_name || ' |', chr(10) ORDER BY n_nationkey) AS sheet FROM "
    'nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name'
))
def sheet_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = _read(spark, sf_dir, "nation").join(_read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    sheets = T.markdown_tables(both, ["r_name"], ["n_nationkey", "n_name"], ["n_nationkey"])
    return sheets.select("r_name", F.concat(F.lit("## "), "r_name", F.lit("\n\n"), "markdown").alias("sheet"))


@query("csv_render", (
    'SELECT doc_id, doc_id || \',\' || CASE WHEN regexp_matches(text, \'[",\\r\\n]\') THEN \'"\' || replace(text, \'"\', \'""\') || '
    '\'"\' ELSE text END || \',\' || coalesce(lang, \'\') AS record FROM documents'
))
def csv_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "documents").select("doc_id", T.csv_record(["doc_id", "text", "lang"]).alias("record"))


@query("column_widths", (
    "SELECT col, greatest(8, least(40, max(length(v)))) AS width FROM (SELECT unnest(['c_custkey', 'c_name', "
    "'c_mktsegment']) AS col, unnest([c_custkey::VARCHAR, c_name, c_mktsegment]) AS v FROM customer) GROUP BY col"
))
def column_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = _read(spark, sf_dir, "customer").select(F.explode(F.create_map(*[x for c in ("c_custkey", "c_name", "c_mktsegment") for x in (F.lit(c), F.col(c).cast("string"))])).alias("col", "v"))
    return R.column_widths(cells, [], "col", "v")


@query("header_union", (
    'SELECT key, row_number() OVER (ORDER BY first_id, first_pos) AS place FROM (SELECT key, min(event_id) AS first_id, '
    'arg_min(pos, event_id) AS first_pos FROM (SELECT event_id, unnest(json_keys(props)) AS key, '
    'generate_subscripts(json_keys(props), 1) AS pos FROM events) GROUP BY key)'
))
def header_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = _read(spark, sf_dir, "events").select("event_id", F.posexplode(F.json_object_keys("props")).alias("pos", "key"))
    return R.first_seen(keys, [], "key", "event_id", "pos")


@query("slug_dedupe", """SELECT p_partkey, CASE WHEN n = 0 THEN slug ELSE slug || '-' || n END AS anchor FROM (SELECT p_partkey, slug, row_number() OVER (PARTITION BY p_size, slug ORDER BY p_partkey) - 1 AS n
    FROM (SELECT p_partkey, p_size, regexp_replace(regexp_replace(lower(p_type), '[^\\p{L}\\p{N}_]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM part))""")
def slug_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    slugs = _read(spark, sf_dir, "part").select("p_partkey", "p_size", X.slugify(F.col("p_type")).alias("slug"))
    return R.suffix_duplicates(slugs, ["p_size"], ["p_partkey"], "slug").select("p_partkey", "anchor")


@query("run_merge", """SELECT user_id, run, any_value(event_type) AS event_type, string_agg(event_id::VARCHAR, ',' ORDER BY event_id) AS ids, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY event_id) AS run
    FROM (SELECT *, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AND row_number() OVER (PARTITION BY user_id ORDER BY event_id) > 1 THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, run""")
def run_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _read(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.concat(F.col("event_id").cast("string"), F.lit(",")).alias("ids"))
    merged = R.merge_runs(events, ["user_id"], ["event_id"], "event_type", "ids")
    return merged.select("user_id", "run", "event_type", F.rtrim("ids", F.lit(",")).alias("ids"), "n")


@query("chart_pivot", (
    "SELECT idx, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'view') AS view, count(*) "
    "FILTER (event_type = 'purchase') AS purchase FROM (SELECT unnest(generate_series(0, (SELECT max(user_id % 20) FROM "
    'events))) AS idx) LEFT JOIN events ON user_id % 20 = idx GROUP BY idx'
))
def chart_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["click", "view", "purchase"]
    points = _read(spark, sf_dir, "events").groupBy((F.col("user_id") % 20).alias("idx"), "event_type").agg(F.count("*").alias("n"))
    return R.chart_table(points, "idx", "event_type", "n", names).na.fill(0, names).select(F.col("idx").cast("bigint").alias("idx"), *names)


@query("outline_parent", (
    'SELECT a.p_partkey, max(b.p_partkey) AS parent FROM (SELECT p_partkey, p_partkey // 40 AS doc, p_size % 6 + 1 AS '
    'level FROM part) a LEFT JOIN (SELECT p_partkey, p_partkey // 40 AS doc, p_size % 6 + 1 AS level FROM part) b ON a.doc '
    '= b.doc AND b.p_partkey < a.p_partkey AND b.level < a.level GROUP BY a.p_partkey'
))
def outline_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    headings = _read(spark, sf_dir, "part").select("p_partkey", F.floor(F.col("p_partkey") / 40).alias("doc"), (F.col("p_size") % 6 + 1).alias("level"))
    return O.outline_parents(headings, ["doc"], "p_partkey", "level").select("p_partkey", "parent")


@query("list_numbers", """SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, level, island ORDER BY turn) AS number FROM (SELECT conv_id, turn, level, (SELECT coalesce(max(b.turn), -1) FROM conversations b WHERE b.conv_id = a.conv_id AND b.turn <= a.turn AND length(b.text) % 3 < a.level) AS island
    FROM (SELECT conv_id, turn, length(text) % 3 AS level FROM conversations) a)""")
def list_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _read(spark, sf_dir, "conversations").select("conv_id", "turn", (F.length("text") % 3).alias("level"))
    return O.list_numbers(items, ["conv_id"], "turn", "level").select("conv_id", "turn", "number")


@query("style_inheritance", """WITH RECURSIVE s AS (SELECT p_partkey AS style, CASE WHEN p_partkey >= 2 THEN p_partkey // 2 END AS parent, CASE WHEN p_size % 3 = 0 THEN p_size END AS size, CASE WHEN p_size % 4 = 1 THEN p_brand END AS font FROM part),
    chain AS (SELECT style, parent AS up, 0 AS depth, size, font FROM s UNION ALL SELECT c.style, s.parent, c.depth + 1, coalesce(c.size, s.size), coalesce(c.font, s.font) FROM chain c JOIN s ON c.up = s.style)
    SELECT style, arg_max(coalesce(size, -1), depth) AS size, arg_max(coalesce(font, ''), depth) AS font, max(depth) AS depth FROM chain GROUP BY style""")
def style_inheritance(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    styles = _read(spark, sf_dir, "part").select(key.alias("style"), F.when(key >= 2, F.floor(key / 2)).alias("parent"), F.when(F.col("p_size") % 3 == 0, F.col("p_size")).alias("size"), F.when(F.col("p_size") % 4 == 1, F.col("p_brand")).alias("font"))
    return I.inherited(styles, ["size", "font"]).select("style", F.coalesce("size", F.lit(-1)).alias("size"), F.coalesce("font", F.lit("")).alias("font"), "depth")


@query("referenced_notes", "SELECT doc_id, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def referenced_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.referenced(_read(spark, sf_dir, "documents").select("doc_id", "n_chars"), _read(spark, sf_dir, "labels"), ["doc_id"])


@query(
    "padded_rows",
    """WITH r AS (SELECT conv_id, turn, list_transform(range(turn % 3 + 1), lambda i: role || i) AS cells FROM conversations)
    SELECT conv_id, turn, array_to_string(list_concat(cells, list_transform(range(max(len(cells)) OVER (PARTITION BY conv_id) - len(cells)), lambda i: '')), '|') AS line FROM r""",
)
def padded_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = F.transform(F.sequence(F.lit(0).cast("long"), F.col("turn") % 3), lambda i: F.concat("role", i.cast("string")))
    rows = R.padded(_read(spark, sf_dir, "conversations").select("conv_id", "turn", cells.alias("cells")), ["conv_id"], "cells")
    return rows.select("conv_id", "turn", F.array_join("cells", "|").alias("line"))


@query(
    "share_of_max",
    (
        'SELECT user_id, event_id, round(value / greatest(max(value) OVER (PARTITION BY user_id), 1.0), 9) AS share FROM '
        'events WHERE value IS NOT NULL'
    ),
)
def share_of_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _read(spark, sf_dir, "events").where("value is not null").select("user_id", "event_id", "value")
    return R.share_of_max(points, ["user_id"], "value").select("user_id", "event_id", F.round("share", 9).alias("share"))


_of(
    "unit_conversion",
    "part",
    "p_partkey",
    (
        'SELECT p_partkey, round(p_retailprice * 20)::BIGINT AS twips, round(p_size / 4.0 * 2)::BIGINT AS half_points, '
        'round(p_size / 8.0 * 8)::BIGINT AS eighths FROM part'
    ),
    lambda: {"twips": X.twips(F.col("p_retailprice")), "half_points": X.half_points(F.col("p_size") / 4.0), "eighths": X.border_eighths(F.col("p_size") / 8.0)},
)
_of(
    "css_values",
    "part",
    "p_partkey",
    (
        'SELECT p_partkey, \'"\' || replace(p_name, \'a\', \'\') || \'"\' AS family, \'"\' || p_brand || \'\\3C " counter(page) " / \\26 " '
        "counter(pages)' AS content FROM part"
    ),
    lambda: {
        "family": X.css_font_family(F.translate("p_name", "a", '"')),
        "content": X.css_page_content(F.concat("p_brand", F.lit("<{page} / &{pages}"))),
    },
)


@query("dominant_style", (
    'SELECT user_id, event_type, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS '
    'k FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY user_id, event_type)) WHERE k = 1'
))
def dominant_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.dominant(_read(spark, sf_dir, "events"), ["user_id"], "event_type")


@query(
    "first_rows_style",
    """SELECT user_id, event_type, count(*) AS n
    FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events)
    WHERE k <= 6 GROUP BY ALL""",
)
def first_rows_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = R.numbered(_read(spark, sf_dir, "events").select("user_id", "event_type", "event_id"), ["user_id"], ["event_id"])
    return rows.where("number <= 6").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@query("image_dedupe", "SELECT source, n_chars, min(doc_id) AS doc_id FROM documents GROUP BY source, n_chars")
def image_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.first_of(_read(spark, sf_dir, "documents").select("source", "n_chars", "doc_id"), ["source", "n_chars"], ["doc_id"])


@query("image_numbers", "SELECT source, doc_id, 'image' || row_number() OVER (PARTITION BY source ORDER BY doc_id) || '.png' AS file FROM documents")
def image_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = R.numbered(_read(spark, sf_dir, "documents").select("source", "doc_id"), ["source"], ["doc_id"])
    return rows.select("source", "doc_id", F.concat(F.lit("image"), F.col("number").cast("string"), F.lit(".png")).alias("file"))


@query(
    "relationship_targets",
    """SELECT o_orderkey, CASE WHEN o_custkey % 5 = 0 THEN NULL WHEN o_custkey % 2 = 0 THEN 'https://example.org/' || c_name
      ELSE 'ppt/media/' || c_name || '.png' END AS target
    FROM orders JOIN customer ON o_custkey = c_custkey""",
)
def relationship_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as references in slides, customers as relationships of packages: every fifth is missing, every second external."""
    external = F.col("c_custkey") % 2 == 0
    inner = F.concat(F.lit("../media/./x/../"), "c_name", F.lit(".png"))
    target = F.when(external, F.concat(F.lit("https://example.org/"), "c_name")).otherwise(inner)
    customers = _read(spark, sf_dir, "customer").where(F.col("c_custkey") % 5 != 0)
    package = (F.col("c_custkey") % 7).alias("package")
    rels = customers.select(package, F.col("c_custkey").alias("rel_id"), target.alias("target"), external.alias("external"))
    part = F.lit("ppt/slides/slide1.xml").alias("part")
    references = _read(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 7).alias("package"), F.col("o_custkey").alias("rel_id"), part)
    return R.relationship_targets(references, rels, ["package"]).select("o_orderkey", "target")


@query(
    "slide_split",
    """SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn))::INT AS slide, role || ' ' || turn AS title,
      unnest([1, 2, 3])::INT AS block, unnest(['text', 'text', 'table']) AS kind,
      unnest([length(text) || ' characters', 'from ' || role, 'turn|size' || chr(10) || turn || '|' || length(text)]) AS text
    FROM conversations""",
)
def slide_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A slide for each turn of a conversation: a line, a bullet and a table."""
    turn, size = F.col("turn").cast("string"), F.length("text").cast("string")
    lines = [
        F.concat(F.lit("## "), "role", F.lit(" "), turn),
        F.concat(size, F.lit(" characters")),
        F.concat(F.lit("- from "), "role"),
        F.concat(F.lit("| turn | size |\n| --- | --- |\n| "), turn, F.lit(" | "), size, F.lit(" |\n")),
    ]
    decks = _read(spark, sf_dir, "conversations").groupBy("conv_id").agg(T.ordered_lines(F.concat_ws("\n\n", *lines), ["turn"]).alias("markdown"))
    return S.rows_of_markdown(decks, ["conv_id"])


@query("table_row_parse", "SELECT p_partkey, p_name AS first, p_brand || '|' || p_size AS second, 3 AS n FROM part")
def table_row_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _read(spark, sf_dir, "part").select("p_partkey", T.table_row(F.array("p_name", F.concat("p_brand", F.lit("|"), F.col("p_size").cast("string")), F.lit("a\\b\nc"))).alias("line"))
    cells = part.select("p_partkey", T.row_cells(F.col("line")).alias("cells"))
    return cells.where(F.col("cells")[2] == "a\\b\nc").select("p_partkey", F.col("cells")[0].alias("first"), F.col("cells")[1].alias("second"), F.size("cells").alias("n"))


@query("part_path", "SELECT n_nationkey, 'ppt/media/' || n_name AS path FROM nation")
def part_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "nation").select("n_nationkey", R.resolve_part(F.concat(F.lit("/ppt/slides/./../media/"), "n_name")).alias("path"))


@query(
    "html_structure",
    """SELECT page_id, len(regexp_extract_all(html, '<h[1-6]>')) AS n_heading, len(regexp_extract_all(html, '<li>')) AS n_list_item,
      len(regexp_extract_all(html, '<ul>')) AS n_list, len(regexp_extract_all(html, '<table')) AS n_table,
      len(regexp_extract_all(html, '<a href="[^"]')) AS n_link,
      regexp_replace(replace(regexp_replace(regexp_extract(html, '<h1>(.*?)</h1>', 1), '&(amp|quot|copy|lt);', ' ', 'g'), '_', ''), '[^\\p{L}\\p{N}]+', '', 'g') AS title,
      replace(array_to_string(regexp_extract_all(html, '<a href="([^"]+)"', 1), ' '), '&amp;', '&') AS targets
    FROM pages""",
)
def html_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the tree of each page's Markdown holds, with the letters of its title, against what its HTML says."""
    nodes = N.of_markdown(_read(spark, sf_dir, "pages").select("page_id", "html"), ["page_id"], before=(H.to_markdown_step,))
    n = lambda kind: F.sum((F.col("kind") == kind).cast("long")).alias(f"n_{kind}")
    links = F.array_sort(F.collect_list(F.when(F.col("kind") == "link", F.struct("node_id", "destination"))))
    counted = nodes.groupBy("page_id").agg(*map(n, ("heading", "list_item", "list", "table", "link")), F.array_join(F.transform(links, lambda x: x["destination"]), " ").alias("targets"))
    heading = nodes.where("kind = 'heading' and level = 1").select("page_id", F.col("path")[0].alias("at"))
    titles = N.plain_text(nodes.join(heading, "page_id").where("path[0] = at"), ["page_id"]).withColumnRenamed("plain", "title")
    letters = F.regexp_replace("title", r"[^\p{L}\p{N}]+", "").alias("title")
    return counted.join(titles, "page_id").select("page_id", "n_heading", "n_list_item", "n_list", "n_table", "n_link", letters, "targets")


@query("html_to_markdown")
def html_to_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.markdown_of(_read(spark, sf_dir, "pages"), ["page_id"])


@query("markdown_nodes")
def markdown_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes by kind of every page's tree."""
    nodes = N.of_markdown(_read(spark, sf_dir, "pages").select("page_id", "html"), ["page_id"], before=(H.to_markdown_step,))
    return nodes.groupBy("page_id", "scope", "kind").agg(F.count("*").alias("n"), F.max("depth").alias("deepest"))


@query("markdown_plain_text")
def markdown_plain_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.plain_text(N.of_markdown(_read(spark, sf_dir, "pages").select("page_id", "html"), ["page_id"], before=(H.to_markdown_step,)), ["page_id"])


@query("tables_only", "SELECT n_regionkey AS doc, 6 + 3 * count(*) * 2 + count(*) AS nodes, count(*) + 1 AS rows FROM nation GROUP BY n_regionkey")
def tables_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree of a heading, a paragraph and a quoted table for each region, cut down to the table and its quote."""
    tables = T.markdown_tables(_read(spark, sf_dir, "nation"), ["n_regionkey"], ["n_nationkey", "n_name", "n_regionkey"], ["n_nationkey"])
    text = F.concat(F.lit("# Head\n\nText.\n\n> "), F.replace("markdown", F.lit("\n"), F.lit("\n> ")), F.lit("\n"))
    nodes = N.of_markdown(tables.select(F.col("n_regionkey").alias("doc"), text.alias("markdown")), ["doc"])
    kept = N.tables_only(nodes, ["doc"])
    return kept.groupBy("doc").agg((F.count("*") - 3).alias("nodes"), F.sum((F.col("kind") == "table_row").cast("int")).alias("rows"))


def _converted(name: str, *steps: str, lossless: bool = True) -> None:
    """A query that takes every page's canonical Markdown through formats and back, and says whether nothing was lost.

    A page that can't be converted stops the query: its nulls would else be equal and count as kept, or count as lost.
    """

    @query(name, "SELECT page_id, true AS same FROM pages" if lossless else None)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        through = ["html", "json", *steps]
        df = V.convert_steps(_spread(_read(spark, sf_dir, "pages").select("page_id", "html"), "page_id"), "html", through, {2: "first", len(through) - 1: "now"}, failfast=True)
        return df.select("page_id", F.col("now").eqNullSafe(F.col("first")).alias("same"))


for _f in ("json", "yaml", "toml", "docx"):
    _converted(f"markdown_{_f}_roundtrip", "markdown", _f, "markdown")
_converted("markdown_odt_roundtrip", "markdown", "odt", "markdown")
_converted("markdown_html_roundtrip", "markdown", "html", "markdown", lossless=False)
_converted("document_chain", "markdown", "docx", "json", "toml", "yaml", "markdown")
_converted("slides_pptx", "markdown", "pptx", "markdown", lossless=False)
_converted("slides_odp", "markdown", "odp", "markdown", lossless=False)


def _workbook(name: str, *steps: str) -> None:
    @query(name, "SELECT r_name, count(*) + 1 AS rows FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        """A JSON document for each region, through workbooks and back to the rows it was made of."""
        both = _read(spark, sf_dir, "nation").join(_read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        rows = F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name", (F.col("n_nationkey") % 2 == 0).alias("even"), (F.col("n_nationkey") / 4).alias("quarter"))))
        df = both.groupBy("r_name").agg(F.to_json(rows).alias("now"))
        for a, b in zip(steps, steps[1:]):
            df = V.convert_column(df, "now", a, b, output="next", failfast=True).drop("now", "error").withColumnRenamed("next", "now")
        parsed = F.from_json("now", "array<struct<n_nationkey bigint, n_name string, even boolean, quarter double>>")
        return df.where(F.forall(parsed, lambda x: x["even"] == (x["n_nationkey"] % 2 == 0))).select("r_name", (F.size(parsed) + 1).cast("bigint").alias("rows"))


_workbook("workbook_xlsx", "json", "xlsx", "json")
_workbook("workbook_ods", "json", "ods", "json")
_workbook("workbook_chain", "json", "xlsx", "ods", "xlsx", "json", "toml", "yaml", "ods", "json")


@query("csv_to_markdown", (
    "SELECT n_regionkey, '| id | name |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || n_nationkey || ' | "
    "' || n_name || ' |', chr(10) ORDER BY n_nationkey) AS markdown FROM nation GROUP BY n_regionkey"
))
def csv_to_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat_ws(";", F.col("n_nationkey").cast("string"), "n_name")
    text = _read(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.concat(F.lit("id;name\n"), T.ordered_lines(line, ["n_nationkey"])).alias("csv"))
    return V.convert_column(text, "csv", "csv", "markdown", V.Options(delimiter=";"), "markdown", failfast=True).select("n_regionkey", "markdown")


@query("sheets_of_text", "SELECT r_name, count(*) + 1 AS rows FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def sheets_of_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sheets of one text with a section for each region: lines to sections by a running last heading."""
    sheets = sheet_text(spark, sf_dir).agg(F.array_join(F.array_sort(F.collect_list("sheet")), "\n\n").alias("text")).withColumn("doc", F.lit(0))
    lines = R.lines_of(sheets, ["doc"], "text")
    name = R.running_last(F.when(F.startswith("line", F.lit("## ")), F.substring("line", 4, 1000)), ["doc"], "line_no")
    rows = lines.select("doc", "line", name.alias("r_name")).where(F.col("line").contains("|") & ~T.is_separator(F.col("line")))
    return rows.groupBy("r_name").agg(F.count("*").alias("rows"))


#: What routes() has to give: a table of direct routes, old formats by their new ones, and Markdown between all others. No query, as it reads no table.
ROUTES_SQL = """WITH direct AS (SELECT a, unnest(string_split(targets, ' ')) AS b FROM (VALUES
        ('markdown', 'docx odt pdf json yaml toml csv xlsx ods pptx odp html'), ('docx', 'markdown html csv xlsx json yaml toml pdf'),
        ('odt', 'markdown html pdf csv xlsx ods json yaml toml'), ('pdf', 'markdown json yaml toml'),
        ('csv', 'json yaml toml markdown docx odt xlsx ods'), ('xlsx', 'markdown docx ods json csv yaml toml'),
        ('ods', 'markdown docx odt html pdf csv xlsx json yaml toml'), ('json', 'csv markdown docx odt xlsx ods pptx odp pdf html yaml toml'),
        ('yaml', 'csv markdown docx odt xlsx ods pptx odp pdf html json toml'), ('toml', 'csv markdown docx odt xlsx ods pptx odp pdf html json yaml'),
        ('pptx', 'markdown json yaml toml'), ('odp', 'markdown json yaml toml'), ('html', 'markdown json yaml toml')) t(a, targets)),
      modern AS (FROM (VALUES ('doc', 'docx'), ('xls', 'xlsx'), ('ppt', 'pptx')) t(old, new)),
      name AS (SELECT DISTINCT a AS f FROM direct UNION SELECT old FROM modern),
      pair AS (SELECT x.f AS a, y.f AS b, coalesce(m.new, x.f) AS p, coalesce(n.new, y.f) AS q
        FROM name x JOIN name y ON x.f <> y.f LEFT JOIN modern m ON m.old = x.f LEFT JOIN modern n ON n.old = y.f)
    SELECT a, b, CASE WHEN a <> p THEN a || '>' ELSE '' END
        || CASE WHEN p = q THEN p WHEN EXISTS (SELECT 1 FROM direct d WHERE d.a = p AND d.b = q) THEN p || '>' || q ELSE p || '>markdown>' || q END
        || CASE WHEN b <> q THEN '>' || b ELSE '' END AS route,
      NOT (a IN ('pdf', 'doc', 'xls', 'ppt') OR b IN ('pdf', 'doc', 'xls', 'ppt')) AS runs
    FROM pair"""


def routes(spark: SparkSession) -> DataFrame:
    """The route of every pair of formats, and whether it runs without libraries beyond Spark's."""
    pairs = [(a, b, ">".join(V.plan(a, b)), V.supported(a, b)) for a in V.DIRECT for b in V.DIRECT if a != b]
    return spark.createDataFrame(pairs, "a string, b string, route string, runs boolean")


#: Customers of a nation in one document: a document grows with the table else, and a task holds its whole tree.
VOLUME_ROWS = 500


def _cells_through(target: str) -> None:
    """A query that takes tables of customers, as many documents for each nation as it needs, through a format, and returns their cells."""

    @query(
        f"cells_through_{target}",
        """SELECT c_nationkey, (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey))::INT AS row_idx, c_custkey::VARCHAR AS id,
          c_name AS name, c_mktsegment || '|a b' AS segment, 'Nation ' || c_nationkey AS title FROM customer""",
    )
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        cells = F.array(F.col("c_custkey").cast("string"), F.col("c_name"), F.concat("c_mktsegment", F.lit(r"\|a b")))
        line = F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
        head = F.concat(F.lit("# Nation "), F.col("c_nationkey").cast("string"), F.lit("\n\nIts customers:\n\n| id | name | segment |\n| --- | --- | --- |\n"))
        placed = R.numbered(_read(spark, sf_dir, "customer"), ["c_nationkey"], ["c_custkey"])
        volumes = placed.withColumn("volume", F.floor((F.col("number") - 1) / VOLUME_ROWS).cast("int"))
        count = int(spark.conf.get("spark.sql.shuffle.partitions"))
        grouped = volumes.repartition(count, "c_nationkey", "volume").groupBy("c_nationkey", "volume").agg(T.ordered_lines(line, ["c_custkey"]).alias("lines"))
        keys = ["c_nationkey", "volume"]
        df = V.convert_steps(grouped.select(*keys, F.concat(head, "lines", F.lit("\n")).alias("text")), "text", ["markdown", target, "markdown"], {2: "now"}, failfast=True)
        nodes = N.of_markdown(df, keys, "now")
        column = lambda k, name: F.max(F.when(F.col("col_idx") == k, F.col("text"))).alias(name)
        rows = nodes.where("kind = 'table_cell' and row_idx > 0").groupBy(*keys, "row_idx").agg(column(0, "id"), column(1, "name"), column(2, "segment"))
        titles = N.plain_text(nodes.where("path[0] = 0"), keys).withColumnRenamed("plain", "title")
        place = (F.col("volume") * VOLUME_ROWS + F.col("row_idx")).cast("int").alias("row_idx")
        return rows.join(titles, keys).select("c_nationkey", place, "id", "name", "segment", "title")


for _f in ("docx", "odt", "pptx", "odp", "html", "json", "yaml", "toml"):
    _cells_through(_f)


def _images_through(target: str) -> None:
    """A query that takes an image for each supplier, inside a document, through a package, and returns its checksum."""

    @query(
        f"images_through_{target}",
        "SELECT s_suppkey, s_name AS alt, 'image/gif' AS media_type, md5('GIF89a' || s_name || s_suppkey) AS checksum FROM supplier",
    )
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        content = F.concat(F.lit("GIF89a"), "s_name", F.col("s_suppkey").cast("string"))
        image = F.concat(F.lit("!["), "s_name", F.lit("](data:image/gif;base64,"), X.base64_text(content), F.lit(")"))
        df = _read(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("# Image\n\n"), image, F.lit("\n")).alias("now"))
        for a, b in (("markdown", target), (target, "markdown")):
            df = V.convert_column(df, "now", a, b, output="next", failfast=True).drop("now", "error").withColumnRenamed("next", "now")
        part = lambda k: F.regexp_extract("now", r"!\[([^\]]*)\]\(data:([^;]*);base64,([^)]*)\)", k)
        return df.select("s_suppkey", part(1).alias("alt"), part(2).alias("media_type"), F.md5(F.unbase64(part(3))).alias("checksum"))


for _f in ("docx", "odt", "pptx", "odp"):
    _images_through(_f)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per page: its title, Markdown, and what its tree holds."""
    made = N.with_counts(_read(spark, sf_dir, "pages").select("page_id", "html"), ["heading", "link", "list_item", "table"], before=(H.to_markdown_step,))
    title = F.regexp_extract("markdown", r"(?m)^# (.*)$", 1).alias("title")
    counts = [F.col(f"n_{k}").alias(f"n_{k}s") for k in ("heading", "link", "list_item", "table")]
    return made.select("page_id", title, *counts, "plain_text_chars", "markdown")


query("flagship")(flagship)

from . import package_queries, source_queries  # noqa: E402, F401  they add their queries
