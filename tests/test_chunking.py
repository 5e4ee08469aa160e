"""Packing against a sequential loop, on random sizes and on one long list."""

import random

from pyspark.sql import functions as F

from lexloom.operators import chunking


def pack(sizes, low, high, hard, separator, overlap):
    out, chunk, used = [], -1, 0
    for size in sizes:
        total = used + separator + size
        if chunk >= 0 and (total <= high or (total <= hard and used < low)):
            used = total
        else:
            used = size + (min(used, overlap) + separator if chunk >= 0 and overlap else 0)
            chunk += 1
        out.append(chunk)
    return out


def batch(sizes, budget):
    out, number, used = [], 0, 0
    for size in sizes:
        if used and used + size > budget:
            number, used = number + 1, 0
        used += size
        out.append(number)
    return out


def test_packing_equals_a_loop(spark):
    rng = random.Random(5)
    lists = [[rng.choice([1, 2, 3, 8, 30, 60, 79, 90, 120, 500]) for _ in range(rng.randrange(40))] for _ in range(300)] + [[], [7], [3, 3000], [40] * 20_000]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(lists)], "id int, sizes array<int>")
    for low, high, hard, overlap in ((50, 80, 100, 10), (50, 80, 100, 0), (20, 90, 95, 44)):
        found = {r.id: r.c for r in rows.select("id", chunking.pack_units(F.col("sizes"), low, high, hard, 1, overlap).alias("c")).collect()}
        for i, sizes in enumerate(lists):
            assert found[i] == pack(sizes, low, high, hard, 1, overlap), sizes[:50]
    zeros = [[rng.choice([0, 0, 1, 5, 50]) for _ in range(rng.randrange(20))] for _ in range(200)]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(zeros)], "id int, sizes array<int>")
    for r in rows.select("sizes", chunking.batches(F.col("sizes"), 20).alias("b")).collect():
        assert r.b == batch(r.sizes, 20), r.sizes
