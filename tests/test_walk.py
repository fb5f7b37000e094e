"""Pages of a batch are walked a few at a time."""

import tracemalloc

import pyarrow as pa

from corvane.operators import pages


def arguments(n):
    body = [None if i % 50 == 7 else f"<title>Page {i}</title><main><h2>Head</h2><p>{'word ' * 200}</p>" + "".join(f'<a href="/p/{i}/{k}">x</a>' for k in range(20)) + "</main>" for i in range(n)]
    texts = pa.array([["main"]] * n, pa.list_(pa.string()))
    return pa.array([f"https://x.org/{i}" for i in range(n)], pa.string()), pa.array(body, pa.string()), pa.array(["html"] * n, pa.string()), texts, texts.slice(0, n), pa.array([False] * n, pa.bool_())


def walked(given):
    tracemalloc.start()
    found = pages._walked.func(*given)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return found, peak


def test_memory_does_not_grow_with_the_batch(monkeypatch):
    monkeypatch.setattr(pages, "WALK_BYTES", 1 << 16)
    few, many = walked(arguments(100)), walked(arguments(600))
    assert many[1] < 2 * few[1]


def test_slices_are_the_whole():
    for n in (0, 1, 150):
        given = arguments(n)
        found, _ = walked(given)
        assert found.to_pylist() == pa.array([pages._walk(*r) for r in zip(*(x.to_pylist() for x in given), strict=True)], found.type).to_pylist()
