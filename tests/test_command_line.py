import io
import json
import sys

import pytest

from docframe import __main__ as cli
from docframe.functions import themes
from docframe.plans import convert as V
from tests.test_convert import png


class _Pipe:
    def __init__(self, data=b""):
        self.buffer = io.BytesIO(data)


def run(monkeypatch, *argv, given=b""):
    out = _Pipe()
    monkeypatch.setattr(sys, "stdin", _Pipe(given))
    monkeypatch.setattr(sys, "stdout", out)
    return cli.main(list(argv)), out.buffer.getvalue()


def test_pipes(monkeypatch, tmp_path):
    code, out = run(monkeypatch, "convert", "-", "-", "--from", "json", "--to", "yaml", given=b'{"ship": "Orca", "crew": 12}')
    assert code == 0 and b"ship: Orca" in out
    (tmp_path / "a.csv").write_text("x\n1\n")
    assert run(monkeypatch, "convert", str(tmp_path / "a.csv"), "-", "--to", "md") == (0, b"| x |\n| --- |\n| 1 |")
    assert run(monkeypatch, "convert", "-", str(tmp_path / "b.json"), "--from", "csv", given=b"x\n2\n")[0] == 0
    assert json.loads((tmp_path / "b.json").read_text()) == [{"x": "2"}]


@pytest.mark.parametrize("argv", [("-", "-", "--to", "yaml"), ("-", "-", "--from", "docx", "--to", "json"), ("-", "-", "--from", "json", "--to", "xlsx")])
def test_pipes_need_text_formats(monkeypatch, argv):
    assert run(monkeypatch, "convert", *argv, given=b"{}") == (1, b"")


def test_broken_input_leaves_nothing(monkeypatch, tmp_path):
    (tmp_path / "a.json").write_text("{broken")
    assert run(monkeypatch, "convert", str(tmp_path / "a.json"), str(tmp_path / "a.yaml"))[0] == 1
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a.json"]


def test_intermediate_stays_and_holds_images(monkeypatch, tmp_path):
    (tmp_path / "x.png").write_bytes(png(2, 2))
    (tmp_path / "a.md").write_text("# T\n\n![x](x.png)\n")
    assert run(monkeypatch, "convert", str(tmp_path / "a.md"), str(tmp_path / "a.docx"), "--keep-intermediate")[0] == 0
    kept = tmp_path / "a.docx.intermediate.json"
    assert "data:image/png;base64," in kept.read_text()
    V.convert_file(str(kept), str(tmp_path / "b.docx"), source="json", target="docx")
    assert (tmp_path / "b.docx").read_bytes() == (tmp_path / "a.docx").read_bytes()
    assert run(monkeypatch, "convert", str(tmp_path / "a.md"), str(tmp_path / "c.csv"), "--keep-intermediate")[0] == 1  # no table
    assert (tmp_path / "c.csv.intermediate.json").exists() and not (tmp_path / "c.csv").exists()
    assert run(monkeypatch, "convert", str(tmp_path / "a.md"), str(tmp_path / "a.docx"), "--keep-intermediate")[0] == 1  # exists


def test_batch_writes_files(spark, monkeypatch, tmp_path):
    for folder in ("one", "two"):
        (tmp_path / "in" / folder).mkdir(parents=True)
        (tmp_path / "in" / folder / "same.csv").write_text(f"x\n{folder}\n")
    (tmp_path / "in" / "two" / "bad.csv").write_text("x,y\n1\n")
    argv = ("batch", f"{tmp_path}/in/*/*.csv", f"{tmp_path}/out", "--from", "csv", "--to", "json")
    assert run(monkeypatch, *argv)[0] == 1  # one of them is broken
    assert sorted(str(p.relative_to(tmp_path / "out")) for p in (tmp_path / "out").rglob("*.*")) == ["one/same.json", "two/same.json"]
    assert json.loads((tmp_path / "out" / "two" / "same.json").read_text()) == [{"x": "two"}]
    (tmp_path / "out" / "one" / "same.json").write_text("kept")
    (tmp_path / "out" / "two" / "same.json").unlink()
    assert run(monkeypatch, *argv)[0] == 1 and (tmp_path / "out" / "one" / "same.json").read_text() == "kept"
    assert not (tmp_path / "out" / "two" / "same.json").exists()  # nothing is written if one output is there
    assert run(monkeypatch, *argv, "--overwrite")[0] == 1 and (tmp_path / "out" / "one" / "same.json").read_text() != "kept"


def test_batch_refuses_equal_names(spark, tmp_path):
    (tmp_path / "a.md").write_text("x\n")
    (tmp_path / "a.markdown").write_text("x\n")
    with pytest.raises(V.ConversionError, match="several files"):
        V.convert_files(spark, f"{tmp_path}/a.*", "markdown", "json")


def test_settings_file(monkeypatch, tmp_path):
    settings = tmp_path / "s.toml"
    settings.write_text('[convert]\nfrom = "csv"\nto = "json"\ndelimiter = ";"\n[batch]\noverwrite = true\n')
    given = ("--config", str(settings), "convert", "-", "-")
    assert json.loads(run(monkeypatch, *given, given=b"a;b\n1;2\n")[1]) == [{"a": "1", "b": "2"}]
    assert run(monkeypatch, *given, "--to", "md", "--delimiter", ",", given=b"a,b\n")[1].startswith(b"| a | b |")
    monkeypatch.setenv("DOCFRAME_CONFIG", str(settings))
    assert json.loads(run(monkeypatch, "convert", "-", "-", given=b"a\n3\n")[1]) == [{"a": "3"}]
    settings.write_text("[convert]\noverwrite = true\n")
    (tmp_path / "a.csv").write_text("x\n1\n")
    (tmp_path / "a.md").write_text("old")
    assert run(monkeypatch, "convert", str(tmp_path / "a.csv"), str(tmp_path / "a.md"), "--no-overwrite")[0] == 1
    assert run(monkeypatch, "convert", str(tmp_path / "a.csv"), str(tmp_path / "a.md"))[0] == 0 and (tmp_path / "a.md").read_text() != "old"


@pytest.mark.parametrize("text", ["[convert]\nwhat = 1\n", '[convert]\noverwrite = "yes"\n', "[convert]\nstyle = 3\n", "[convert"])
def test_wrong_settings(monkeypatch, tmp_path, text):
    (tmp_path / "s.toml").write_text(text)
    assert run(monkeypatch, "--config", str(tmp_path / "s.toml"), "convert", "-", "-", "--from", "csv", "--to", "json", given=b"a\n")[0] == 1


def test_style_import(spark, monkeypatch, tmp_path):
    (tmp_path / "a.md").write_text("# T\n\nwords\n")
    V.convert_file(str(tmp_path / "a.md"), str(tmp_path / "a.docx"))
    V.convert_file(str(tmp_path / "a.md"), str(tmp_path / "a.pptx"))
    for name in ("a.docx", "a.pptx"):
        out = tmp_path / f"{name}.toml"
        assert run(monkeypatch, "style-import", str(tmp_path / name), str(out))[0] == 0
        themes.load(out.read_text())
        assert run(monkeypatch, "style-import", str(tmp_path / name), str(out))[0] == 1
    assert run(monkeypatch, "style-import", str(tmp_path / "a.md"), str(tmp_path / "x.toml"))[0] == 1
