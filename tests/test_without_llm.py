"""The library without its subpackage for training data."""

import importlib
import sys
from importlib.abc import MetaPathFinder

import __spark_entry__ as entry


class Hidden(MetaPathFinder):
    """Modules of the subpackage as if their folder were away; the pipeline stays where it is."""

    def find_spec(self, name, path=None, target=None):
        if name.startswith("tessella.llm"):
            raise ModuleNotFoundError(f"No module named {name!r}", name=name)
        return None


def test_other_queries_are_all_there_without_the_subpackage(monkeypatch):
    rest = {n for n in entry.queries() if not n.startswith("op") and n != "pipeline"}
    for name in [n for n in sys.modules if n.startswith("tessella.llm") or n == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setattr("importlib.util.find_spec", lambda n, find=importlib.util.find_spec: None if n == "tessella.llm" else find(n))
    monkeypatch.setattr(sys, "meta_path", [Hidden(), *sys.meta_path])
    spec = importlib.util.spec_from_file_location("entry_alone", entry.__file__)
    alone = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(alone)
    assert set(alone.queries()) == rest
    assert set(alone.oracle_sql()) <= rest
