"""Conversion between formats: a planner over the routing matrix, and conversion of files and of columns.

A plan is a list of formats from source to target. Pairs without a direct route go through Markdown.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import FORMATS, TEXT_FORMATS
from ..operators import html, to_html
from ..operators import markdown as M
from ..operators.batches import Run, Step, pieces, through
from ..sources import images, packages, payload, slides, stores, structured, wordprocessing, workbooks

STRUCTURED = ("json", "yaml", "toml")
#: Need libraries that do not come with Spark: page layout and recognition, and the binary office formats.
UNSUPPORTED = ("pdf", "doc", "xls", "ppt")
#: Targets that a format reaches without Markdown in between.
DIRECT = {
    "markdown": ("docx", "odt", "pdf", "json", "yaml", "toml", "csv", "xlsx", "ods", "pptx", "odp", "html"),
    "docx": ("markdown", "html", "csv", "xlsx", "json", "yaml", "toml", "pdf"),
    "odt": ("markdown", "html", "pdf", "csv", "xlsx", "ods", "json", "yaml", "toml"),
    "pdf": ("markdown", "json", "yaml", "toml"),
    "csv": ("json", "yaml", "toml", "markdown", "docx", "odt", "xlsx", "ods"),
    "xlsx": ("markdown", "docx", "ods", "json", "csv", "yaml", "toml"),
    "ods": ("markdown", "docx", "odt", "html", "pdf", "csv", "xlsx", "json", "yaml", "toml"),
    **{f: ("csv", "markdown", "docx", "odt", "xlsx", "ods", "pptx", "odp", "pdf", "html", *(g for g in STRUCTURED if g != f)) for f in STRUCTURED},
    **{f: ("markdown", "json", "yaml", "toml") for f in ("pptx", "odp", "html")},
    **{f: () for f in ("doc", "xls", "ppt")},
}
#: The format that stands for a binary office format.
MODERN = {"doc": "docx", "xls": "xlsx", "ppt": "pptx"}


class ConversionError(ValueError):
    """A conversion that can't be done. code: UnsupportedFormat, InvalidInput, InvalidOption, OutputExists, NotImplemented."""

    def __init__(self, code: str, message: str) -> None:
        super().__init__(message)
        self.code = code


def plan(source: str, target: str) -> list[str]:
    """Formats from source to target; raises NotImplemented for a format to itself."""
    for f in (source, target):
        if f not in DIRECT:
            raise ConversionError("UnsupportedFormat", f"unknown format {f}")
    if source == target:
        raise ConversionError("NotImplemented", f"{source} to {target}")
    if source in MODERN:
        modern = MODERN[source]
        return [source, modern] if target == modern else [source, *plan(modern, target)]
    if target in MODERN:
        modern = MODERN[target]
        return [source, target] if source == modern else [*plan(source, modern), target]
    return [source, target] if target in DIRECT[source] else [source, "markdown", target]


def supported(source: str, target: str) -> bool:
    """Whether this engine can run the plan."""
    try:
        return not set(plan(source, target)) & set(UNSUPPORTED)
    except ConversionError:
        return False


@dataclass(frozen=True)
class Options:
    delimiter: str = ","
    tables_only: bool = False
    overwrite: bool = False
    css: str = ""
    #: Bytes of images by the path that a document names; formats that hold images take them in.
    assets: Mapping[str, bytes] | None = None
    #: Trees as JSON, YAML and TOML hold their images' bytes.
    embed: bool = False
    #: OpenDocument to Markdown: the package goes along in a comment, for lossless edits.
    keep_package: bool = False


def parse_delimiter(text: str) -> str:
    """`tab` or one character."""
    t = text if text == "\t" else text.strip()
    if t.lower() == "tab" or t == "\\t":
        return "\t"
    if len(t) != 1:
        raise ConversionError("InvalidOption", "the delimiter must be `tab` or one character")
    return t


def detect(name: str) -> str:
    """The format of a file name."""
    ext = name.rsplit(".", 1)[-1].lower() if "." in os.path.basename(name) else ""
    if ext not in FORMATS:
        raise ConversionError("UnsupportedFormat", f"no format has the extension of {name}")
    return FORMATS[ext]


@dataclass
class _Held:
    """A document on its way: a tree, sheets, or slides."""

    blocks: list[dict] | None = None
    sheets: structured.Sheets | None = None
    slides: list[dict] | None = None
    value: object = None


def _text(data: bytes) -> str:
    try:
        return data.decode("utf-8-sig")
    except UnicodeDecodeError as e:
        raise ConversionError("InvalidInput", str(e)) from None


def _read(data: bytes, fmt: str, o: Options) -> _Held:
    if fmt == "markdown":
        return _Held(blocks=M.parse(_text(data)), value=_text(data))
    if fmt == "html":
        text = html.to_markdown(_text(data))
        return _Held(blocks=M.parse(text), value=text)
    if fmt == "csv":
        return _Held(sheets=structured.read_csv(_text(data), o.delimiter))
    if fmt in STRUCTURED:
        value = structured.load(_text(data), fmt)
        if structured.is_document(value):
            M.check_depth(value["blocks"])
            return _Held(blocks=value["blocks"])
        return _Held(value=value)
    if fmt == "docx":
        return _Held(blocks=wordprocessing.read(data))
    if fmt == "odt":
        return _Held(blocks=packages.read_odt(data))
    if fmt in ("xlsx", "ods"):
        return _Held(sheets=packages.read_xlsx(data) if fmt == "xlsx" else packages.read_ods(data))
    if fmt in ("pptx", "odp"):
        return _Held(slides=slides.read_pptx(data) if fmt == "pptx" else slides.read_odp(data))
    raise ConversionError("NotImplemented", f"{fmt} needs a library that is not there")


def _as_markdown(h: _Held, fmt: str) -> str:
    if h.blocks is not None:
        return M.render(h.blocks)
    if h.slides is not None:
        return slides.to_markdown(h.slides)
    sheets = h.sheets if h.sheets is not None else structured.sheets_of(h.value)
    level = 0 if fmt == "csv" else 1 if fmt in STRUCTURED else 2
    return structured.sheets_markdown(sheets, level)


def _as_blocks(h: _Held, fmt: str, o: Options) -> list[dict]:
    blocks = h.blocks if h.blocks is not None else M.parse(_as_markdown(h, fmt))
    return M.tables_only(blocks) if o.tables_only else blocks


def _as_sheets(h: _Held, fmt: str) -> structured.Sheets:
    if h.sheets is not None:
        return h.sheets
    if h.blocks is None and h.slides is None:
        return structured.sheets_of(h.value)
    found = structured.markdown_sheets(h.value if isinstance(h.value, str) else _as_markdown(h, fmt))
    if not found:
        raise ConversionError("NotImplemented", "there is no table in the document")
    return found


def _inlined(x: object, assets: Mapping[str, bytes] | None) -> object:
    """A tree whose images with known bytes are data URIs."""
    if not assets:
        return x
    if isinstance(x, list):
        return [_inlined(i, assets) for i in x]
    if not isinstance(x, dict):
        return x
    if x.get("type") == "image" and (data := images.bytes_of(x.get("destination") or "", assets)):
        return x | {"destination": images.data_uri(data)}
    return {k: _inlined(v, assets) for k, v in x.items()}


def _write(h: _Held, source: str, target: str, o: Options) -> bytes:
    if target in ("csv", "xlsx", "ods"):
        sheets = _as_sheets(h, source)
        return structured.write_csv(sheets, o.delimiter).encode() if target == "csv" else packages.write_xlsx(sheets) if target == "xlsx" else packages.write_ods(sheets)
    if target in STRUCTURED:
        if h.sheets is not None:
            return structured.dump(structured.value_of(h.sheets, target), target).encode()
        if h.blocks is None and h.slides is None:
            return structured.dump(h.value, target).encode()
        blocks = _as_blocks(h, source, o)
        return structured.dump({"blocks": _inlined(blocks, o.assets) if o.embed else blocks}, target).encode()
    if target == "markdown":
        return (M.render(_as_blocks(h, source, o)) if o.tables_only else h.value if source == "html" else _as_markdown(h, source)).encode()
    if target in ("pptx", "odp"):
        made = h.slides if h.slides is not None else slides.of_markdown(h.value if source == "markdown" else _as_markdown(h, source))
        return slides.write_pptx(made, o.assets) if target == "pptx" else slides.write_odp(made, o.assets)
    blocks = _as_blocks(h, source, o)
    if target == "html":
        return to_html.page(_inlined(blocks, o.assets), o.css).encode()
    if target == "docx":
        return wordprocessing.write(blocks, o.assets)
    if target == "odt":
        return packages.write_odt(blocks, o.assets)
    raise ConversionError("NotImplemented", f"{target} needs a library that is not there")


def convert_bytes(data: bytes, source: str, target: str, options: Options = Options()) -> bytes:
    """One document from format to format, along the plan."""
    stages = plan(source, target)
    if set(stages) & set(UNSUPPORTED):
        raise ConversionError("NotImplemented", f"{source} to {target} needs a library that is not there")
    try:
        for a, b in zip(stages, stages[1:]):
            held = None
            if a == "markdown":
                text, held = payload.split(_text(data))
                data = text.encode() if held else data
            if held and b in packages.ODF_TYPE:
                data = payload.apply(text, held, b)
                continue
            made = _write(_read(data, a, options), a, b, options)
            data = payload.attach(made.decode(), data, a).encode() if options.keep_package and b == "markdown" and a in packages.ODF_TYPE else made
    except ConversionError:
        raise
    except (ValueError, KeyError, RecursionError) as e:
        raise ConversionError("InvalidInput", str(e)) from e
    return data


def convert_column(df: DataFrame, content: str, source: str, target: str, options: Options = Options(), output: str = "converted", failfast: bool = False) -> DataFrame:
    """df with the converted document (text or binary) and an error struct, row by row.

    A row that fails has a null document and error (code, message); failfast stops the query at the first.
    """
    return convert_steps(df, content, [source, target], {1: output}, options, failfast)


def convert_steps(df: DataFrame, content: str, steps: list[str], outputs: dict[int, str], options: Options = Options(), failfast: bool = False) -> DataFrame:
    """convert_column through all steps in one pass: a document goes from format to format in its worker.

    outputs: columns by the step whose documents they hold. What comes after a step that fails is null, and the error struct
    says so; who drops that struct has to set failfast, as a null is no result.
    """
    return through(df, converting(content, steps, outputs, options, failfast))


def converting(content: str, steps: list[str], outputs: dict[int, str], options: Options = Options(), failfast: bool = False) -> Step:
    """convert_steps() as a step of batches."""
    return lambda schema: _converting(schema, content, steps, outputs, options, failfast)


def _converting(given: T.StructType, content: str, steps: list[str], outputs: dict[int, str], options: Options, failfast: bool) -> tuple[Run, T.StructType]:
    if any(set(plan(a, b)) & set(UNSUPPORTED) for a, b in zip(steps, steps[1:])):
        raise ConversionError("NotImplemented", f"{' to '.join(steps)} needs a library that is not there")
    error = T.StructType([T.StructField("code", T.StringType()), T.StructField("message", T.StringType())])
    kinds = {k: T.StringType() if steps[k] in TEXT_FORMATS else T.BinaryType() for k in outputs}
    schema = T.StructType([*given, *[T.StructField(name, kinds[k]) for k, name in outputs.items()], T.StructField("error", error)])
    at = given.names.index(content)

    def of(data: str | bytes | None) -> tuple[dict[int, str | bytes], dict[str, str] | None]:
        made: dict[int, str | bytes] = {}
        if data is None:
            return made, None
        now = data.encode() if isinstance(data, str) else data
        for k, (a, b) in enumerate(zip(steps, steps[1:]), 1):
            try:
                now = convert_bytes(now, a, b, options)
            except ConversionError as e:
                if failfast:
                    raise ConversionError(e.code, f"{a} to {b}: {e.code}: {e}") from e
                return made, {"code": e.code, "message": str(e)}
            if k in outputs:
                made[k] = now.decode() if kinds[k] == T.StringType() else now
        return made, None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, at):
            rows = [of(data.as_py()) for data in batch.column(at)]
            columns = [pa.array([made.get(k) for made, _ in rows], pa.string() if kinds[k] == T.StringType() else pa.binary()) for k in outputs]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns, pa.array([failed for _, failed in rows], pa.struct([("code", pa.string()), ("message", pa.string())]))], names=schema.names)

    return run, schema


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of files, which may be a glob; nested folders are left out."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def _name(path: Column, base: str, target: str) -> Column:
    """A file's name below base, with the target's extension."""
    extension = {"markdown": "md"}.get(target, target)
    inside = F.regexp_replace(path, "^.*?" + re.escape(base.rstrip("/")).replace("\\/", "/") + "/", "") if base else F.element_at(F.split(path, "/"), -1)
    return F.concat(F.regexp_replace(inside, r"\.[^./]*$", ""), F.lit("." + extension))


def _base(pattern: str) -> str:
    """The folder of a glob above its first wildcard, without scheme and host."""
    plain = re.split(r"[*?\[{]", re.sub(r"^\w+://[^/]*|^file:", "", pattern))[0]
    return plain.rpartition("/")[0]


def convert_files(spark: SparkSession, path: str, source: str, target: str, options: Options = Options(), failfast: bool = False) -> DataFrame:
    """(path, name, converted, error) for each file; name is the output's, from the glob's fixed folder on.

    Two files that would have one output are an error: names are compared before any file is read.
    """
    names = spark.read.format("binaryFile").load(path).select(_name(F.col("path"), _base(path), target).alias("name"))
    twice = names.groupBy("name").count().where("count > 1").select(F.min("name")).first()[0]
    if twice is not None:
        raise ConversionError("InvalidInput", f"several files would be written to {twice}")
    done = convert_column(read_files(spark, path), "content", source, target, options, failfast=failfast)
    return done.select("path", _name(F.col("path"), _base(path), target).alias("name"), "converted", "error")


def save_files(converted: DataFrame, folder: str, overwrite: bool = False) -> DataFrame:
    """(name, bytes, error): what convert_files gave, all documents written at once below a folder of a store that all executors see.

    Tasks put files aside, and the commit shows them, so a write that fails leaves nothing. Unless overwrite is set, nothing
    is written if one of the outputs is there.
    """
    spark = converted.sparkSession
    workbooks.register(spark)
    rows = converted.select("name", F.col("converted").alias("content"), "error")
    try:
        rows.write.format("document_files").mode("overwrite" if overwrite else "append").save(folder)
    except Exception as e:
        if m := re.search(r"FileExistsError: (.*)", str(e)):
            raise ConversionError("OutputExists", m[1]) from None
        raise
    listed = stores.listing(folder)
    return spark.createDataFrame([(f["name"], f["bytes"], f["error"]) for f in listed], "name string, bytes long, error struct<code string, message string>")


def save(place: str, data: bytes, overwrite: bool = False) -> None:
    """Writes one output, which must not be there unless overwrite is set."""
    if os.path.exists(place) and not overwrite:
        raise ConversionError("OutputExists", f"{place} exists")
    _save(place, data)


def _save(place: str, data: bytes) -> int:
    """Writes a file that appears whole under its name."""
    os.makedirs(os.path.dirname(os.path.abspath(place)), exist_ok=True)
    part = f"{place}.{uuid.uuid4().hex}.part"
    with open(part, "wb") as f:
        f.write(data)
    os.replace(part, place)
    return len(data)


def convert_file(path: str, output: str, options: Options = Options(), source: str | None = None, target: str | None = None, keep_intermediate: bool = False) -> None:
    """One local file on the driver. The output may not be the input, and is only replaced if options say so.

    keep_intermediate: the document goes through JSON in `<output>.intermediate.json`, which holds its images and stays,
    whatever becomes of the last step.
    """
    source, target = source or detect(path), target or detect(output)
    between = [f"{output}.intermediate.json"] if keep_intermediate else []
    for place in (output, *between):
        if os.path.exists(place):
            if os.path.samefile(path, place):
                raise ConversionError("InvalidOption", "the output is the input")
            if not options.overwrite:
                raise ConversionError("OutputExists", f"{place} exists")
    with open(path, "rb") as f:
        data = f.read()
    options = replace(options, assets=options.assets or LocalImages(os.path.dirname(os.path.abspath(path))))
    for place in between:
        if source != "json":
            data = convert_bytes(data, source, "json", replace(options, embed=True))
        data = structured.dump(structured.load(_text(data), "json"), "json").encode()
        _save(place, data)
        source = "json"
    made = data if between and target == "json" else convert_bytes(data, source, target, options)
    if target == "markdown" and b"data:image/" in made:  # images go to files beside the output; structured formats hold them
        blocks, pictures = images.to_files(M.parse(made.decode()))
        made = M.render(blocks).encode() if pictures else made
        for name, content in pictures.items():
            _save(os.path.join(os.path.dirname(os.path.abspath(output)), name), content)
    _save(output, made)


class LocalImages(Mapping):
    """Image files inside a folder, by their path from there."""

    def __init__(self, folder: str) -> None:
        self.folder = os.path.realpath(folder)

    def __getitem__(self, name: str) -> bytes:
        place = os.path.realpath(os.path.join(self.folder, name))
        if "://" in name or not place.startswith(self.folder + os.sep) or not os.path.isfile(place):
            raise KeyError(name)
        with open(place, "rb") as f:
            return f.read()

    def __iter__(self) -> Iterator[str]:
        return iter(())

    def __len__(self) -> int:
        return 1


def tree_json(text: str) -> str:
    """Canonical JSON of a Markdown text's tree."""
    return json.dumps({"blocks": M.parse(text)}, ensure_ascii=False, separators=(",", ":"))
