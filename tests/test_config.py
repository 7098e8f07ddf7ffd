"""Settings on the driver, and the command line."""

import pytest

from mosaiq import cli
from mosaiq.plans import config

TREE = {"a": {"b": 1, "on": True, "name": "x"}, "list": [1]}


def test_overrides():
    out = config.with_overrides(TREE, {"a.b": 2.5, "a.on": False})
    assert out["a"] == {"b": 2.5, "on": False, "name": "x"} and TREE["a"]["b"] == 1
    for key, value in (("a.on", 1), ("a.b", True), ("a.name", 3), ("list", "x")):
        with pytest.raises(TypeError):
            config.with_overrides(TREE, {key: value})
    with pytest.raises(KeyError):
        config.with_overrides(TREE, {"a.none": 1})


def test_trees():
    assert config.flatten(TREE) == {"a.b": 1, "a.on": True, "a.name": "x", "list": [1]}
    assert config.deep_merge(TREE, {"a": {"b": 3}, "c": 1}) == {"a": {"b": 3, "on": True, "name": "x"}, "list": [1], "c": 1}
    with pytest.raises(ValueError, match="odd"):
        config.reject_unknown({"odd": 1}, {"a"}, "settings")
    assert len(config.study_plan({"x": [1, 2], "y": [3]}, 2)) == 4


def test_command_line(capsys):
    assert cli.main(["list"]) == 0
    assert "stability_variant_summary" in capsys.readouterr().out
