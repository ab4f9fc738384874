import numpy as np
from corpusdeck.llm import simhash
from corpusdeck.llm.common import components


def test_crowded_sampled_routes_are_brute_force(spark):
    """All fingerprints agree on the one route: each two within the radius are linked."""
    rng = np.random.default_rng(9)
    mask = np.zeros((1, 4), np.uint64)
    mask[0, 0] = 0xFF
    words = rng.integers(0, 2**63, (60, 4), np.uint64) & ~mask[0]
    words = np.concatenate([words, words.copy()])
    words[60:, 3] ^= np.uint64(0b111)
    rows = [(bytearray(w.tobytes()), k) for k, w in enumerate(words)]
    import xxhash

    names = {np.array([xxhash.xxh64_intdigest(w.tobytes())], np.uint64).view(np.int64).item(): k for k, w in enumerate(words)}
    fps = spark.createDataFrame(rows, "fp binary, node long")
    edges = simhash.linked(fps, simhash.Routes(mask, 3, False), "test-crowded", tree_size=2)
    roots = {names[r["node"]]: names[r["root"]] for r in components(edges, "test-crowded").collect()}
    assert len(roots) == 120 and all(roots[k] == roots[k + 60] for k in range(60)) and len(set(roots.values())) == 60
