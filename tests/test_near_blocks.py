import random

import pytest
from pyspark.sql import functions as F

from mediaquarry.operators import duplicates, near_blocks
from mediaquarry.operators.components import connected_components

SCHEMA = "id long, h long, type string, duration double"


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(near_blocks, "LEAST_ROWS", 40)


def match(a, b):
    return abs(a - b) <= max(1.0, 0.02 * max(a, b))


def some_rows():
    """Hashes near to each other, many copies of one, ids that come twice, two types and lengths of every size."""
    r = random.Random(3)
    hashes = [r.getrandbits(63) for _ in range(5)]
    rows = []
    for i in range(400):
        h = r.choice(hashes)
        for b in r.sample(range(63), r.choice([0, 0, 1, 3, 6])):
            h ^= 1 << b
        rows.append((i, hashes[0] if i % 5 == 0 else h, r.choice(["photo", "video"]), r.choice([r.uniform(0, 60), 10.0 * r.randrange(9), r.uniform(0, 3000)])))
    return [*rows, (7, rows[7][1] ^ 1, rows[7][2], rows[7][3]), (501, None, "photo", 1.0), (502, hashes[0], None, 1.0)]


def brute(rows, distance, fits):
    known = [x for x in rows if x[1] is not None]
    return sorted((a[0], b[0], (a[1] ^ b[1]).bit_count()) for a in known for b in known if a[0] < b[0] and (a[1] ^ b[1]).bit_count() <= distance and fits(a, b))


@pytest.mark.parametrize("distance", [6, 10])
def test_all_pairs_over_several_blocks(spark, small_blocks, distance):
    """A file that comes with two near hashes was paired with itself; blocks must lose and repeat no pair."""
    rows = some_rows()
    found = sorted(map(tuple, duplicates.near_pairs(spark.createDataFrame(rows, SCHEMA), distance).collect()))
    assert found == brute(rows, distance, lambda a, b: a[2] is not None and a[2] == b[2])


def test_runs_of_copies_are_cut(monkeypatch, spark, small_blocks):
    monkeypatch.setattr(near_blocks, "_RUN", 7)
    rows = [(i, 5 if i % 3 else 4, "photo", 1.0) for i in range(150)]
    found = sorted(map(tuple, duplicates.near_pairs(spark.createDataFrame(rows, SCHEMA), 6).collect()))
    assert found == brute(rows, 6, lambda a, b: True)


def test_pairs_come_in_runs(spark, small_blocks):
    """Pairs came in the order of hashes, with a and b in turns: each column of a written result took its full room."""
    r = random.Random(8)
    rows = [(i, sum(1 << b for b in r.sample(range(63), r.randrange(4))), "photo", 1.0) for i in r.sample(range(3000), 300)]
    found = [tuple(x) for x in duplicates.near_pairs(spark.createDataFrame(rows, SCHEMA), 10).collect()]
    assert sorted(found) == brute(rows, 10, lambda a, b: True)
    for columns, most in ((slice(0, 1), len(found) / 20), (slice(0, 3, 2), len(found) / 4)):
        assert 1 + sum(x[columns] != y[columns] for x, y in zip(found, found[1:])) < most


@pytest.mark.parametrize("distance", [6, 10])
def test_pairs_of_videos_over_several_blocks(spark, small_blocks, distance):
    rows = [(i, h, "video", d) for i, h, _, d in some_rows()]
    found = duplicates.video_pairs(spark.createDataFrame(rows, SCHEMA), distance)
    assert sorted(map(tuple, found.collect())) == brute(rows, distance, lambda a, b: match(a[3], b[3]))


def test_pairs_of_videos_are_not_joined(spark):
    """Pairs were joined with the videos twice; now they leave the comparison as they are."""
    plan = duplicates.video_pairs(spark.createDataFrame(some_rows(), SCHEMA), 6)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lstrip().startswith("MapInArrow")


def test_links_over_several_blocks_are_few_and_enough(spark, small_blocks):
    """Of near hashes all pairs were links; there are no more than rows, for each block that a row meets, however dense."""
    r = random.Random(8)
    dense = [(i, sum(1 << b for b in r.sample(range(63), r.randrange(4))), r.choice(["photo", "video"]), r.choice([5.0, 5.5, 30.0, 100.0])) for i in range(300)]
    for rows in (some_rows(), dense):
        table = spark.createDataFrame(rows, SCHEMA)
        photos = duplicates.near_links(table, 6)
        want = connected_components(duplicates.near_pairs(table, 6).select("a", "b"))
        assert sorted(map(tuple, connected_components(photos).collect())) == sorted(map(tuple, want.collect()))
        videos = duplicates.video_links(table, 6)
        want = connected_components(duplicates.video_pairs(table, 6).select("a", "b"))
        assert sorted(map(tuple, connected_components(videos).collect())) == sorted(map(tuple, want.collect()))
    assert photos.count() < 2 * len(dense)


def test_an_index_links_files_and_not_pairs(spark, tmp_path):
    """An index took all near pairs of a key as links: of hashes that are all near, the square of their number."""
    r = random.Random(9)
    hashes = sorted({sum(1 << b for b in r.sample(range(63), r.randrange(4))) for _ in range(150)})
    keyed = duplicates.chunk_keys(spark.createDataFrame([(h, "photo") for h in hashes], "h long, kind string"), 6).withColumn("fresh", F.col("h") % 2 == 0)
    links = [(x.hx, x.hy) for x in near_blocks.links_by_keys(keyed, 6).collect()]
    parts = {h: h for h in hashes}
    for a, b in links:
        old, new = parts[b], parts[a]
        parts = {h: new if p == old else p for h, p in parts.items()}
    assert len(set(parts.values())) == 1 and len(links) < 28 * len(hashes)
    assert sum((a ^ b).bit_count() <= 6 for a in hashes for b in hashes if a < b) > 2 * len(links)
