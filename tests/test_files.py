"""Contracts and deny lists in files: both forms of a list, broken files and lines, references in every form."""

import json

import pytest

from ledgerlens.sources import files

DIGEST = "ab" * 31 + "01"
RAW = bytes.fromhex(DIGEST)[::-1].hex() + "00000000"


@pytest.mark.parametrize(
    ("text", "found"),
    [
        (json.dumps([f"{DIGEST}_0", f"{DIGEST}:0"]), [RAW]),
        (json.dumps({"refs": [{"ref": f"{DIGEST}_0", "reason": "x"}, RAW, "none", None, {"no": 1}, 5]}), [RAW]),
        (json.dumps({"refs": []}), []),
        (json.dumps({"refs": 5}), []),
        ("[", []),
        ("", []),
    ],
)
def test_denied(spark, tmp_path, text, found):
    (tmp_path / "list.json").write_text(text)
    assert [r.ref.lower() for r in files.read_denied(spark, str(tmp_path)).collect()] == found


def test_contracts_come_back_and_are_denied_in_any_form(spark, tmp_path):
    rows = [(f"{DIGEST}_0", "a", 1, 2**60, 3, True), ("cd" * 32 + "_1", None, None, None, None, False), ("no reference", "c", 0, 0, 0, True)]
    written = spark.createDataFrame(rows, files.CONTRACTS)
    files.write_contracts(written, str(tmp_path / "c"))
    (tmp_path / "c" / "broken.json").write_text('{"ref": \n[1]\n')
    back = files.read_contracts(spark, str(tmp_path / "c"))
    assert sorted(map(tuple, back.collect())) == sorted(rows)
    denied = spark.createDataFrame([(RAW.upper(),)], "ref string")
    assert sorted(r.ref for r in files.allowed(back, denied).collect()) == sorted(r[0] for r in rows[1:])
    assert files.allowed(back, denied.limit(0)).count() == 3
    assert files.allowed(back.limit(0), denied).count() == 0
