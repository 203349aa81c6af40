"""Indexing and the tools from the command line."""

import json

import pytest

from graphloom import cli, config

from .test_sources import tree


def test_config(tmp_path):
    config.init(str(tmp_path))
    (tmp_path / config.FILE).write_text(json.dumps({"large_file_symbols": 5}))
    assert config.load(str(tmp_path)).large_file_symbols == 5
    assert config.load(str(tmp_path), large_file_symbols=7).large_file_symbols == 7
    with pytest.raises(ValueError, match="unknown"):
        config.load(str(tmp_path), colour="red")
    with pytest.raises(FileExistsError):
        config.init(str(tmp_path))


def test_index_and_tools(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(cli, "local_session", lambda: spark)
    root = tree(tmp_path)
    run = lambda *a: (cli.main(["--root", root, *a]), capsys.readouterr())
    assert run("index")[0] == 0
    code, out = run("find", "create_dog")
    assert code == 0 and "**create_dog** (Function) [exported]" in out.out
    assert "1 caller" in out.out
    (tmp_path / "main.py").write_text("def other():\n    return 1\n")
    assert run("index")[0] == 0  # only main.py is read again
    assert "0 callers" in run("find", "create_dog")[1].out
    (tmp_path / "main.py").write_text("def other():\n    create_dog()\n\ndef more():\n    return create_dog()\n")
    assert run("index")[0] == 0  # calls into files that did not change are linked
    assert "2 callers" in run("find", "create_dog")[1].out
    assert "Dog" in run("query", "MATCH (a)-[:EXTENDS]->(b) RETURN a.name")[1].out
    assert "# Code Map" in run("map")[1].out and "# Guide to" in run("guide")[1].out
    code, out = run("impact", "nothing")
    assert code == 1 and json.loads(out.err)["error"] == "symbol_not_found"
    assert run("status")[0] == 0
    assert run("clean")[0] == 0 and not (tmp_path / ".graphloom").exists()
