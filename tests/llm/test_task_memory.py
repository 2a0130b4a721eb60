"""What tasks of the pipeline leave behind in a worker that lives on."""

import pytest
from larder.llm import common


def test_memory_is_given_back_when_a_task_ends(monkeypatch):
    calls = []
    monkeypatch.setattr(common, "give_back", lambda: calls.append(1))

    def task(batches):
        for b in batches:
            yield 1 / b

    assert list(common.tidy(task)([1, 2])) == [1, 0.5] and calls == [1]
    with pytest.raises(ZeroDivisionError):
        list(common.tidy(task)([0]))
    assert calls == [1, 1]
    common.tidy(task)([1]).close()  # not begun: nothing was taken


def test_freed_memory_leaves_the_process():
    def held():
        with open("/proc/self/statm") as f:
            return int(f.read().split()[1]) * 4096

    def task(batches):
        # Small pieces with one kept at the end: the C library holds on to what lies before it.
        pieces = [b"%d" % i * 15_000 for i in range(1000, 4000)]
        kept.append(pieces[-1])
        del pieces
        yield held()

    kept = []
    (inside,) = common.tidy(task)([])
    assert held() < inside - 100_000_000
