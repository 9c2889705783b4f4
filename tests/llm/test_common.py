"""Memory of workers that are used again."""

from sparkvec.llm.common import releasing


def _resident() -> int:
    with open("/proc/self/statm") as f:
        return int(f.read().split()[1]) * 4096


def test_freed_memory_goes_back_to_the_system():
    kept = []

    def run(batches):
        held = [bytes(2000) for _ in range(100_000)]
        kept.extend(held[::500])  # blocks that stay keep the C library from shrinking its heap by itself
        yield from batches

    before = _resident()
    assert list(releasing(run)(iter([1, 2]))) == [1, 2]
    assert _resident() - before < 60_000_000
    assert len(kept) == 200
