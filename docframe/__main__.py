"""Command line: convert one file or standard input, convert the files of a glob with Spark, write the standard theme, or one taken from a package.

A settings file (--config, or the variable DOCFRAME_CONFIG) is TOML with a table for each command, whose keys are the names of
its options; an option on the command line wins over the file, and the file over the option's default.
"""

from __future__ import annotations

import argparse
import json
import os
import sys
import tomllib

from .functions import themes
from .plans import convert as V


def _format(text: str | None) -> str | None:
    return V.FORMATS.get(text.strip().lower(), text.strip().lower()) if text else None


def _piped(a: argparse.Namespace, options: V.Options) -> None:
    """Standard input or output in place of a file: text formats only, and both formats must be clear."""
    source = _format(a.source) if a.input == "-" else _format(a.source) or V.detect(a.input)
    target = _format(a.target) if a.output == "-" else _format(a.target) or V.detect(a.output)
    if not source or not target:
        raise V.ConversionError("InvalidOption", "standard input needs --from, standard output needs --to")
    for way, used, fmt in (("input", a.input, source), ("output", a.output, target)):
        if used == "-" and fmt not in V.TEXT_FORMATS:
            raise V.ConversionError("InvalidOption", f"standard {way} takes text formats only, not {fmt}")
    if a.keep_intermediate:
        raise V.ConversionError("InvalidOption", "--keep-intermediate needs files")
    if a.input == "-":
        data = sys.stdin.buffer.read()
    else:
        with open(a.input, "rb") as f:
            data = f.read()
    made = V.convert_bytes(data, source, target, options)
    if a.output == "-":
        sys.stdout.buffer.write(made)
        sys.stdout.buffer.flush()
    else:
        V.save(a.output, made, options.overwrite)


def _batch(a: argparse.Namespace, options: V.Options) -> int:
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    if not a.source or not a.target:
        raise V.ConversionError("InvalidOption", "batch needs --from and --to")
    spark = SparkSession.builder.appName("docframe").getOrCreate()
    done = V.save_files(V.convert_files(spark, a.input, _format(a.source), _format(a.target), options), a.output, a.overwrite)
    written, failed, first = done.agg(F.count("bytes"), F.count("error"), F.min(F.when(F.col("error").isNotNull(), F.concat_ws(": ", "name", "error.message")))).first()
    print(f"{written} files written, {failed} failed" + (f", first {first}" if first else ""), file=sys.stderr)
    return int(failed > 0)


def _settings(path: str | None, command: str, options: dict[str, argparse.Action]) -> dict[str, object]:
    """What the settings file says on a command, by the options' places in its arguments."""
    if not path:
        return {}
    try:
        with open(path, "rb") as f:
            tables = tomllib.load(f)
    except (tomllib.TOMLDecodeError, UnicodeDecodeError) as e:
        raise V.ConversionError("InvalidOption", f"{path}: {e}") from None
    found = {}
    for key, value in tables.get(command, {}).items():
        option = options.get(key.replace("_", "-"))
        if option is None or not isinstance(value, bool if option.nargs == 0 else str):
            raise V.ConversionError("InvalidOption", f"{path}: {command}.{key} is no option, or not its kind of value")
        found[option.dest] = value
    return found


def _save(path: str, text: str, overwrite: bool) -> None:
    with open(path, "w" if overwrite else "x", encoding="utf-8") as f:
        f.write(text)


def _style_import(a: argparse.Namespace) -> None:
    from pyspark.sql import SparkSession

    from .operators import taken_themes

    kind = V.detect(a.input)
    if kind not in taken_themes.TAKEN:
        raise V.ConversionError("InvalidOption", f"themes can be taken from {', '.join(taken_themes.TAKEN)}, not from {kind}")
    if os.path.exists(a.output) and (not a.overwrite or os.path.samefile(a.input, a.output)):
        raise V.ConversionError("OutputExists", a.output)
    spark = SparkSession.builder.appName("docframe").getOrCreate()
    found = taken_themes.of_files(spark, os.path.abspath(a.input), kind).first()
    _save(a.output, themes.dump(themes.resolve(json.loads(found["theme"]))), a.overwrite)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="docframe")
    parser.add_argument("--config", default=os.environ.get("DOCFRAME_CONFIG"), help="a settings file")
    commands = parser.add_subparsers(dest="command", required=True)
    made = {}
    for name in ("convert", "batch"):
        made[name] = c = commands.add_parser(name)
        c.add_argument("input", help="a file, or - for standard input" if name == "convert" else "a glob")
        c.add_argument("output", help="a file, or - for standard output" if name == "convert" else "a folder")
        c.add_argument("--from", dest="source")
        c.add_argument("--to", dest="target")
        c.add_argument("--delimiter", default=",")
        c.add_argument("--tables-only", action=argparse.BooleanOptionalAction, default=False)
        c.add_argument("--overwrite", action=argparse.BooleanOptionalAction, default=False)
        c.add_argument("--style")
        if name == "convert":
            c.add_argument("--keep-intermediate", action=argparse.BooleanOptionalAction, default=False, help="keep the document as JSON beside the output")
    for name in ("style-template", "style-import"):
        made[name] = c = commands.add_parser(name)
        if name == "style-import":
            c.add_argument("input", help="a word, workbook or slide package")
        c.add_argument("output", help="the theme's file")
        c.add_argument("--overwrite", action=argparse.BooleanOptionalAction, default=False)
    a = parser.parse_args(argv)
    try:
        options = {o.lstrip("-"): action for o, action in made[a.command]._option_string_actions.items() if not o.startswith("--no-") and o not in ("-h", "--help")}
        made[a.command].set_defaults(**_settings(a.config, a.command, options))
        a = parser.parse_args(argv)
        if a.command == "style-template":
            _save(a.output, themes.dump(themes.default()), a.overwrite)
            return 0
        if a.command == "style-import":
            _style_import(a)
            return 0
        css = ""
        if a.style:
            with open(a.style, encoding="utf-8") as f:
                css = themes.css(themes.load(f.read()))
        options = V.Options(V.parse_delimiter(a.delimiter), a.tables_only, a.overwrite, css)
        if a.command == "batch":
            return _batch(a, options)
        if "-" in (a.input, a.output):
            _piped(a, options)
        else:
            V.convert_file(a.input, a.output, options, _format(a.source), _format(a.target), a.keep_intermediate)
        return 0
    except (V.ConversionError, themes.ThemeError, OSError) as e:
        print(e, file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
