"""Command-line scans that commit their findings part by part."""

import json
import os
import signal
import threading
import time

from sieveline.operators import report

LINE = 'password = "hunter2abc{}"\n'


def _cli(capsys, *args):
    from sieveline.__main__ import main

    code = main([str(a) for a in args])
    return code, [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")]


def _told(records):
    found = sorted((r["finding"]["path"], r["finding"]["line"]) for r in records if r["type"] == "finding")
    return found, [r["error"]["message"] for r in records if r["type"] == "error"], records[-1]


def test_an_interrupted_scan_reports_what_is_committed_and_goes_on(spark, tmp_path, capsys, monkeypatch):
    for d in ("a", "b", "c"):
        (tmp_path / "in" / d).mkdir(parents=True)
        (tmp_path / "in" / d / "f.txt").write_text(LINE.format(d))
    args = ("scan", "--units", tmp_path / "kept", "--unit-folders", 1, tmp_path / "in")
    own, calls = report.written_units, []

    def interrupted(units, place, control):
        calls.append(place)
        if len(calls) == 3:  # the process is told to end while the third unit is about to run
            os.kill(os.getpid(), signal.SIGTERM)
            while not control.cancelled:
                time.sleep(0.01)
        return own(units, place, control)

    known = signal.getsignal(signal.SIGTERM)
    monkeypatch.setattr(report, "written_units", interrupted)
    code, records = _cli(capsys, *args)
    found, errors, closing = _told(records)
    assert code == 2 and errors == [report.CANCELLED] and not closing["complete"] and len(found) in (1, 2) and closing["stats"]["files"] == len(found)
    assert signal.getsignal(signal.SIGTERM) == known
    monkeypatch.setattr(report, "written_units", own)

    seen = []
    monkeypatch.setattr(report, "written_units", lambda units, place, control: (seen.append(place), own(units, place, control))[1])
    code, records = _cli(capsys, *args)
    found, errors, closing = _told(records)
    assert code == 1 and not errors and found == [(f"{d}/f.txt", 1) for d in "abc"] and closing["complete"] and closing["stats"]["files"] == 3
    assert len(seen) == 4 - 2  # the root and three folders are units; two were committed

    # A whole scan is not taken up again: what has come since is found.
    (tmp_path / "in" / "a" / "g.txt").write_text(LINE.format("new"))
    assert [p for p, _ in _told(_cli(capsys, *args)[1])[0]] == ["a/f.txt", "a/g.txt", "b/f.txt", "c/f.txt"]


def test_folders_that_come_in_between_are_scanned(spark, tmp_path, capsys, monkeypatch):
    (tmp_path / "in" / "b").mkdir(parents=True)
    (tmp_path / "in" / "b" / "f.txt").write_text(LINE.format("b"))
    args = ("scan", "--units", tmp_path / "kept", "--unit-folders", 1, tmp_path / "in")
    own, calls = report.written_units, []

    def stops(units, place, control):
        calls.append(place)
        if len(calls) == 2:
            control.cancelled = True
        return own(units, place, control)

    monkeypatch.setattr(report, "written_units", stops)
    assert _cli(capsys, *args)[0] == 2
    monkeypatch.setattr(report, "written_units", own)
    (tmp_path / "in" / "a").mkdir()  # comes before what is committed or left
    (tmp_path / "in" / "a" / "f.txt").write_text(LINE.format("a"))
    assert [p for p, _ in _told(_cli(capsys, *args)[1])[0]] == ["a/f.txt", "b/f.txt"]
    # Other rules are another scan.
    assert _told(_cli(capsys, "--no-builtin", "--providers", *args)[1])[0] == []


def test_standard_input_has_no_units(spark, tmp_path, capsys):
    assert _cli(capsys, "scan", "--units", tmp_path, "-")[0] == 2


def test_archives_are_spread_by_the_command_line(spark, tmp_path, capsys):
    import zipfile

    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        for i in range(3):
            z.writestr(f"m{i}", LINE.format(i))
    code, records = _cli(capsys, "scan", "--spread-archives", 4, tmp_path)
    assert code == 1 and _told(records)[0] == [(f"a.zip!m{i}", 1) for i in range(3)]


def test_interrupts_are_left_alone_in_other_threads(spark):
    known, done = signal.getsignal(signal.SIGINT), []

    def run():
        with report.interrupts(report.Control(spark, "g")):
            done.append(signal.getsignal(signal.SIGINT))

    t = threading.Thread(target=run)
    t.start(), t.join()
    assert done == [known]
