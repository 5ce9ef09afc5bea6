import pytest

from docframe.plans import convert as V
from docframe.sources import packages, payload

KEEP = V.Options(keep_package=True)
TEXT = "# Title\n\nSome *old* words.\n\n- item\n"
SHEET = '[{"name": "Ada", "score": 42, "active": true}]'


def test_unchanged_text_gives_the_same_bytes():
    for data, fmt in ((V.convert_bytes(TEXT.encode(), "markdown", "odt"), "odt"), (V.convert_bytes(SHEET.encode(), "json", "ods"), "ods")):
        text = V.convert_bytes(data, fmt, "markdown", KEEP)
        assert V.convert_bytes(text, "markdown", fmt) == data


def test_changed_words_are_patched_and_other_parts_stay():
    data = V.convert_bytes(TEXT.encode(), "markdown", "odt")
    data = packages.package(packages.parts(data) | {"extra/part.bin": b"\x00\x01"}, first="mimetype")
    text = V.convert_bytes(data, "odt", "markdown", KEEP).replace(b"*old*", b"*new*")
    made = V.convert_bytes(text, "markdown", "odt")
    assert packages.parts(made)["extra/part.bin"] == b"\x00\x01"
    assert V.convert_bytes(made, "odt", "markdown").decode() == TEXT.replace("old", "new")


def test_cells_keep_their_types():
    data = V.convert_bytes(SHEET.encode(), "json", "ods")
    text = V.convert_bytes(data, "ods", "markdown", KEEP).replace(b"| 42 | true |", b"| 43 | false |")
    assert packages.read_ods(V.convert_bytes(text, "markdown", "ods")) == {"Sheet1": [["name", "score", "active"], ["Ada", 43, False]]}
    with pytest.raises(V.ConversionError):
        V.convert_bytes(text.replace(b"| 43 |", b"| x |"), "markdown", "ods")


@pytest.mark.parametrize("edit", [lambda t: t.replace(b"Some", b"New paragraph.\n\nSome", 1), lambda t: t + b"after", lambda t: t.replace(b" -->", b"")])
def test_structure_and_broken_comments_are_errors(edit):
    text = V.convert_bytes(V.convert_bytes(TEXT.encode(), "markdown", "odt"), "odt", "markdown", KEEP)
    with pytest.raises(V.ConversionError):
        V.convert_bytes(edit(text), "markdown", "odt")


def test_other_targets_ignore_the_package():
    text = V.convert_bytes(V.convert_bytes(TEXT.encode(), "markdown", "odt"), "odt", "markdown", KEEP).decode()
    assert payload.BEGIN in text and payload.BEGIN not in V.convert_bytes(text.encode(), "markdown", "html").decode()
    with pytest.raises(V.ConversionError):
        V.convert_bytes(text.encode(), "markdown", "ods")
