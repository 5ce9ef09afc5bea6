import random

from docframe.llm.common import components


def test_components_against_union_find(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)] + [(1000, k) for k in range(1001, 1400)] + [(k, k + 1) for k in range(2000, 2100)] + [(5, 5)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    want = sorted((x, find(x)) for x in list(root))
    got = sorted((r["node"], r["root"]) for r in components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect())
    assert got == want


def test_no_edges(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_threads_keep_their_own_tables(spark):
    """Components in three threads of one driver: none deletes another's tables."""
    from concurrent.futures import ThreadPoolExecutor

    def run(k):
        edges = spark.createDataFrame([(10 * j + k, 10 * j + k + 10) for j in range(30)], "a long, b long")
        return {r["root"] for r in components(edges).collect()}

    with ThreadPoolExecutor(3) as pool:
        for _ in range(2):
            assert list(pool.map(run, range(3))) == [{0}, {1}, {2}]
