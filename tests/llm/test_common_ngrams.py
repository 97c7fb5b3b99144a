"""Near copies: n-grams that very many sets have, and what staged tables leave on disk."""

import time

import numpy as np

from vecframe.llm.common import stage
from vecframe.llm.ngram_join import Bound, part_hashes


def test_common_ngrams_chain_no_sets():
    """Sets that share a passage and nothing else have far fewer keys in common where its n-grams are known to be common."""
    rng = np.random.default_rng(5)
    bound, line = Bound(80), rng.integers(0, 1 << 63, 40).astype("u8")
    sets = [np.unique(np.concatenate([line, rng.integers(0, 1 << 63, 360).astype("u8")])) for _ in range(200)]
    for turn in (0, 1):
        shared = lambda common: len(x := np.concatenate([np.unique(part_hashes(s, bound, turn, common)) for s in sets])) - len(np.unique(x))  # noqa: E731, B023
        assert 10 * shared(np.sort(line)) < shared(None)


def test_common_ngrams_lose_no_link():
    """Pairs at the very limit share a key, however many of their n-grams are common, all of them included."""
    rng = np.random.default_rng(6)
    bound = Bound(80)
    for size in (9, 40, 300, 2000):
        for share in (0.0, 0.3, 0.6, 0.9, 1.0):
            for _ in range(5):
                pool = rng.integers(0, 1 << 63, 2 * size).astype("u8")
                away = size // 9
                a, b = np.sort(pool[:size]), np.sort(pool[away : size + away])
                assert 100 * (size - away) >= 80 * (size + away)
                common = np.sort(pool[rng.random(len(pool)) < share])
                for turn in (0, 1):
                    assert len(np.intersect1d(part_hashes(a, bound, turn, common), part_hashes(b, bound, turn, common)))


def test_stage_leaves_no_shuffle_files(spark):
    """What a staged table shuffled is gone when it is staged, also from disk."""
    disk = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager()
    files = lambda: disk.getAllFiles().mkString("\n").count("shuffle_")
    before = files()
    staged = stage(spark.range(10_000).repartition(4, "id"), "test-clean")
    until = time.time() + 20  # Spark deletes them a moment later
    while files() > before and time.time() < until:
        time.sleep(0.1)
    assert files() <= before
    assert staged.count() == 10_000
