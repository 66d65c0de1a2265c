import json

from akuru.__main__ import main


def test_commands(spark, tmp_path, capsys):
    (tmp_path / "w.tsv").write_text("ދިވެހި\t9\nބަސް\t5\n", encoding="utf-8")
    (tmp_path / "t.txt").write_text("dhivehi", encoding="utf-8")
    assert main(["to-thaana", "--file", str(tmp_path / "t.txt")]) == 0
    assert capsys.readouterr().out == "ދިވެހި\n"
    assert main(["check", "--json", "--lexicon", str(tmp_path / "w.tsv"), "ދިވެހ ބަސް"]) == 1
    (issue,) = json.loads(capsys.readouterr().out)
    assert (issue["word"], issue["status"], issue["suggestions"][0]["word"], issue["start"], issue["end"]) == ("ދިވެހ", "structure", "ދިވެހި", 0, 5)
    assert main(["check", "--lexicon", str(tmp_path / "w.tsv"), "ދިވެހި ބަސް"]) == 0
    assert main(["grammar", "ބަސް  ބަސް"]) == 1
    assert main(["validate", "ދިވެހ"]) == 0
