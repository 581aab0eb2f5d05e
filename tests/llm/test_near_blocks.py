"""Sets that share a key are compared however far apart they lie in its order."""

from folioflux.llm import near_copies as near


def test_links_cross_the_blocks_of_a_key(spark):
    common = list(range(1000, 1040))
    # The first and the last set of one key are similar, those between are like nothing.
    found = {1: [1, *common], 9: [2, *common], **{n: list(range(n * 100, n * 100 + 40)) for n in range(2, 9)}}
    rest = spark.createDataFrame([(7, n, 0, n, len(v)) for n, v in found.items()], "key long, node long, segment long, root long, size long")
    marks = spark.createDataFrame([(n, [n] * near.SEGMENTS) for n in found], "node long, marks array<int>")
    sets = spark.createDataFrame(list(found.items()), "node long, found array<long>")
    for block in (2, 4, 128):
        links = near._within_blocks(rest, marks, sets, block).collect()
        assert [tuple(sorted(r)) for r in links] == [(1, 9)], block
