import json

import pytest

from fieldglass import cli


@pytest.fixture(scope="module")
def events(tmp_path_factory):
    path = tmp_path_factory.mktemp("cli") / "e.jsonl"
    rows = [{"date": f"2026-06-{d:02d}", "type": "battle", "actor1": f"Unit {d % 3}", "actor2": "Guard", "country": "Mali", "location": "Town", "lat": 14.0 + d / 1000, "lon": -4.0, "fatalities": d, "notes": "clash"} for d in range(1, 29)]
    rows.append(rows[0])
    path.write_text("\n".join(map(json.dumps, rows)))
    return str(path)


@pytest.mark.parametrize("command", sorted(set(cli.COMMANDS) - {"sanctions"}))
def test_commands_run(spark, events, capsys, command):
    assert cli.main([command, events], spark) == 0
    for line in capsys.readouterr().out.splitlines():
        json.loads(line)


def test_ingest_drops_repeats(spark, events, capsys):
    assert cli.main(["ingest", events], spark) == 0
    assert len(capsys.readouterr().out.splitlines()) == 28


def test_reports_and_files(spark, events, tmp_path, capsys):
    assert cli.main(["report", events, "--to", "intsum"], spark) == 0 and "EVENTS: 29" in capsys.readouterr().out
    assert cli.main(["export", events, "--to", "geojson", "--out", str(tmp_path / "g.json")], spark) == 0
    assert len(json.loads((tmp_path / "g.json").read_text())["features"]) == 29
    assert cli.main(["hotspots", events, "--out", str(tmp_path / "h")], spark) == 0 and list((tmp_path / "h").glob("part-*"))
    assert cli.main(["export", events, "--to", "nope"], spark) == 1 and "unknown format" in capsys.readouterr().err


def test_other_tables(spark, tmp_path, capsys):
    kb = tmp_path / "kb.json"
    kb.write_text(json.dumps([{"key": 1, "text": "drone cover"}, {"key": 2, "text": "supply"}]))
    assert cli.main(["kbsearch", str(kb), "--format", "json", "--id", "key", "--query", "drone"], spark) == 0
    assert json.loads(capsys.readouterr().out)["doc"] == 1
    sdn = tmp_path / "sdn.csv"
    sdn.write_text('7,"UNIT GUARD",,,,,,,,,,\n')
    ev = tmp_path / "e.csv"
    ev.write_text("date,actor1,country\n2026-01-01,The Unit Guard,Mali\n")
    assert cli.main(["sanctions", str(ev), "--list", str(sdn)], spark) == 0
    assert json.loads(capsys.readouterr().out)["ids"] == ["7"]
