"""Workers that live on give back what a task has freed."""

from __future__ import annotations

from palimpsest.llm import common


def test_free_memory_goes_back_when_a_task_ends(monkeypatch):
    seen = []
    monkeypatch.setattr(common, "give_back", lambda: seen.append("given"))
    run = common.trimmed(lambda batches: (b + 1 for b in batches))
    rows = run(iter([1, 2]))
    assert next(rows) == 2 and not seen
    assert list(rows) == [3] and seen == ["given"]


def test_giving_back_needs_nothing():
    common.give_back()


def test_a_task_of_another_kind_empties_the_caches(monkeypatch):
    monkeypatch.setattr(common, "CACHES", {"words": {"a": 1}, "others": {"b": 2}})
    assert list(common.trimmed(lambda batches: batches, "words")(iter([1]))) == [1]
    assert common.CACHES == {"words": {"a": 1}, "others": {}}
    assert list(common.trimmed(lambda batches: batches)(iter([1]))) == [1]
    assert common.CACHES["words"] == {}
