"""The driver contract where what the training-data queries need is absent."""

from __future__ import annotations

import sys

import pytest

import __spark_entry__ as entry
from linemill.catalog import ORACLE_SQL, QUERIES


def _without(monkeypatch, absent: str) -> None:
    """Makes the imports of a module fail, and the training-data modules be imported anew."""
    for name in [n for n in sys.modules if n == "corpus_pipeline" or n.startswith("linemill.llm")]:
        monkeypatch.delitem(sys.modules, name)
    if absent.startswith("linemill."):
        parent, _, child = absent.rpartition(".")
        monkeypatch.delattr(sys.modules[parent], child, raising=False)

    class Absent:
        def find_spec(self, name, path=None, target=None):
            if name == absent:
                raise ModuleNotFoundError(f"No module named {name!r}", name=name)

    monkeypatch.delitem(sys.modules, absent, raising=False)
    monkeypatch.setattr(sys, "meta_path", [Absent(), *sys.meta_path])


@pytest.mark.parametrize("absent", ["linemill.llm", "corpus_pipeline"])
def test_other_queries_without_the_folders(monkeypatch, absent):
    _without(monkeypatch, absent)
    assert entry.queries() == QUERIES
    assert entry.oracle_sql() == ORACLE_SQL


def test_other_queries_without_a_package(monkeypatch):
    pytest.importorskip("linemill.llm")
    _without(monkeypatch, "xxhash")
    with pytest.warns(RuntimeWarning, match="xxhash"):
        assert entry.queries() == QUERIES


def test_a_missing_part_of_the_library_raises(monkeypatch):
    pytest.importorskip("linemill.llm")
    _without(monkeypatch, "linemill.llm")

    class Absent:
        def find_spec(self, name, path=None, target=None):
            if name in ("corpus_pipeline", "linemill.llm"):
                raise ModuleNotFoundError("No module named 'linemill.absent'", name="linemill.absent")

    monkeypatch.setattr(sys, "meta_path", [Absent(), *sys.meta_path])
    with pytest.raises(ModuleNotFoundError):
        entry.queries()
