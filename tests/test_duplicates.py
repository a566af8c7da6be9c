import random

import pytest
from pyspark.sql import functions as F

from mediaquarry.functions.text import difference_hash
from mediaquarry.operators import duplicates
from mediaquarry.operators.components import connected_components

H = 0x0F0F3C3CA5A59669
MEDIA = (
    "id long, root string, rel_path string, type string, size long, mtime double, present boolean, duration double, "
    "sha256 string, sha_size long, sha_mtime double, phash long, sig_size long, sig_mtime double"
)


def signed(h):
    return h - (1 << 64) if h >= 1 << 63 else h


def flip(h, *bits):
    for b in bits:
        h ^= 1 << b
    return h


def row(i, *, size=10, sha=None, h=None, kind="photo", present=True, duration=None, stale=False):
    t = 0.0 if stale else 1.0
    return (i, "/lib", f"f{i}.jpg", kind, size, 1.0, present, duration, sha, size, t, None if h is None else signed(h), size, t)


def groups(spark, rows, **options):
    ignored = options.pop("ignored", None)
    members = duplicates.find_members(spark.createDataFrame(rows, MEDIA), **options).cache()
    ids = {}
    for r in members.collect():
        ids.setdefault(r.group_id, []).append(r.id)
    return sorted((tuple(sorted(ids[r.group_id])), r.kind) for r in duplicates.groups_of(members, ignored).collect())


@pytest.mark.parametrize("distance", [0, 1, 3, 6, 10])
def test_near_pairs_equal_brute_force(spark, distance):
    r = random.Random(distance)
    hashes = [r.getrandbits(64) for _ in range(200)]
    hashes += [flip(r.choice(hashes), *r.sample(range(64), r.randint(0, 12))) for _ in range(100)]
    rows = [(i, signed(h), "photo") for i, h in enumerate(hashes)]
    got = {(x.a, x.b): x.distance for x in duplicates.near_pairs(spark.createDataFrame(rows, "id long, h long, type string"), distance).collect()}
    want = {(i, j): bin(hashes[i] ^ hashes[j]).count("1") for i in range(len(hashes)) for j in range(i + 1, len(hashes))}
    assert got == {p: d for p, d in want.items() if d <= distance}
    assert duplicates.near_pairs(spark.createDataFrame(rows, "id long, h long, type string"), distance).count() == len(got)


def test_threshold_chains_and_types(spark):
    near = [row(1, h=H), row(2, h=flip(H, 0, 9, 20, 33))]
    assert groups(spark, near) == [((1, 2), "similar")]
    assert groups(spark, near, max_distance=3) == []
    chain = [row(1, h=H), row(2, h=flip(H, 1, 2, 3, 4, 5)), row(3, h=flip(H, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10))]
    assert groups(spark, chain) == [((1, 2, 3), "similar")]
    assert groups(spark, [row(1, h=H), row(2, h=H, kind="video", duration=1.0)]) == []
    assert groups(spark, [row(1, sha="x"), row(2, sha="x", kind="video")]) == [((1, 2), "exact")]


def test_durations(spark):
    videos = [row(1, h=H, kind="video", duration=10.0), row(2, h=H, kind="video", duration=10.5), row(3, h=H, kind="video", duration=60.0), row(4, h=H, kind="video")]
    assert groups(spark, videos) == [((1, 2), "similar")]


def test_video_groups_are_those_of_all_pairs(spark):
    r = random.Random(11)
    hashes = [r.getrandbits(64) for _ in range(4)]
    videos = []
    for i in range(90):
        h = flip(r.choice(hashes), *r.sample(range(64), r.randint(0, 5)))
        videos.append(row(i, h=h, kind="video", duration=None if i % 17 == 0 else r.choice([10.0, 60.0, 300.0, 1000.0]) * r.uniform(0.96, 1.04)))
    label = list(range(len(videos)))

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, x in enumerate(videos):
        for j, y in enumerate(videos[:i]):
            fine = x[7] is not None and y[7] is not None and abs(x[7] - y[7]) <= max(1.0, 0.02 * max(x[7], y[7]))
            if fine and bin((x[11] ^ y[11]) & (1 << 64) - 1).count("1") <= 6:
                a, b = top(i), top(j)
                label[max(a, b)] = min(a, b)
    want = {}
    for i in range(len(videos)):
        want.setdefault(top(i), []).append(i)
    assert [g for g, _ in groups(spark, videos)] == sorted(tuple(g) for g in want.values() if len(g) > 1)
    one = [row(i, h=H, kind="video", duration=float(i)) for i in range(200)]
    links = duplicates.video_links(spark.createDataFrame(one, MEDIA).withColumn("h", F.col("phash")), 6)
    assert links.count() < 200


def test_similar_only(spark):
    rows = [row(1, sha="a"), row(2, sha="a"), row(3, sha="b", h=H), row(4, sha="c", h=H)]
    assert groups(spark, rows, exact=False) == [((3, 4), "similar")]
    assert groups(spark, rows, similar=False) == [((1, 2), "exact")]


def test_members_and_stats_of_exact_groups(spark):
    media = spark.createDataFrame([row(1, sha="a"), row(2, sha="a"), row(3, sha="b", size=7), row(4, sha="c", size=0), row(5, sha="a", present=False)], MEDIA)
    assert sorted((r.id, r.group_id, r.n) for r in duplicates.exact_members(media).collect()) == [(1, 1, 2), (2, 1, 2)]
    assert [(r.group_id, r.n, r.first_path) for r in duplicates.exact_groups(media, by_size=True).collect()] == [(1, 2, "f1.jpg")]
    assert tuple(duplicates.exact_stats(media).first()) == (4, 1, 2)


def test_index_keeps_lengths_and_stamps_failures(spark):
    media = spark.createDataFrame([row(1, h=H, duration=3.0, stale=True), row(2, h=H, stale=True), row(3, h=H)], MEDIA)
    measured = spark.createDataFrame([(1, None, None), (2, 7, 9.0)], "id long, phash long, duration double")
    after = duplicates.indexed(media, measured)
    assert sorted((r.id, r.phash, r.duration, r.sig_mtime) for r in after.collect()) == [(1, None, 3.0, 1.0), (2, 7, 9.0, 1.0), (3, signed(H), None, 1.0)]
    assert duplicates.signature_candidates(after).count() == 0


def test_an_index_run_goes_on_where_it_was_cancelled(spark, tmp_path):
    media = spark.createDataFrame([row(i, stale=True) for i in range(40)], MEDIA)
    store, measured, calls = f"file://{tmp_path}/index", [], []

    def measure(batch):
        measured.extend(r.id for r in batch.collect())
        return batch.select("id", F.col("id").alias("phash"), F.lit(None).cast("double").alias("duration"))

    def cancelled():
        calls.append(1)
        return len(calls) > 2

    assert duplicates.index_run(duplicates.signature_candidates(media), measure, store, 4, cancelled) == 2
    some = len(measured)
    assert 0 < some < 40
    assert duplicates.index_run(duplicates.signature_candidates(media), measure, store, 4) == 4
    assert sorted(measured) == list(range(40))
    assert duplicates.signature_candidates(duplicates.indexed(media, spark.read.parquet(store))).count() == 0


def test_absent_empty_and_stale(spark):
    assert groups(spark, [row(1, sha="x"), row(2, sha="x", present=False), row(3, sha="x", size=0)]) == []
    assert groups(spark, [row(1, sha="x"), row(2, sha="x", stale=True)]) == []


def test_kinds_order_and_ignored(spark):
    rows = [row(1, sha="a"), row(2, sha="a"), row(3, sha="b", size=99, h=H), row(4, sha="c", size=98, h=H), row(5, sha="d", size=500), row(6, sha="d", size=500)]
    found = duplicates.find_groups(spark.createDataFrame(rows, MEDIA)).cache()
    assert [(r.group_id, r.kind, r.n) for r in found.orderBy(*duplicates.group_order()).collect()] == [(5, "exact", 2), (1, "exact", 2), (3, "similar", 2)]
    assert [r.group_id for r in found.orderBy(*duplicates.by_first_path()).collect()] == [1, 3, 5]
    ignored = found.where("group_id = 1").select("sig")
    assert len(groups(spark, rows, ignored=ignored)) == 2
    assert duplicates.groups_of(duplicates.find_members(spark.createDataFrame(rows, MEDIA)), ignored).where("group_id = 1").count() == 0
    assert len(groups(spark, [*rows, row(7, sha="a")], ignored=ignored)) == 3


def test_candidates(spark):
    media = spark.createDataFrame([row(1, stale=True), row(2), row(3, size=77, stale=True), row(4, size=0, stale=True)], MEDIA)
    assert [r.id for r in duplicates.exact_candidates(media).collect()] == [1]
    assert sorted(r.id for r in duplicates.signature_candidates(media).collect()) == [1, 3]


def test_keep_one(spark):
    media = spark.createDataFrame([row(1, sha="x"), row(2, sha="x"), row(3, sha="y")], MEDIA)
    links = spark.createDataFrame([(2, "a", "A", 1.0, False), (3, "b", "b", 1.0, False)], "media_id long, tag_key string, tag string, updated_at double, deleted boolean")
    choices = spark.createDataFrame([(1, 2, "exact"), (1, 3, "exact"), (1, 1, "exact")], "keep_id long, remove_id long, kind string")
    changes, gone = duplicates.kept_one(links, media, choices, 9.0)
    assert [(r.media_id, r.tag) for r in changes.collect()] == [(1, "A")]
    assert [r.id for r in gone.collect()] == [2]
    more = spark.createDataFrame([(1, 2, "exact"), (1, 3, "exact"), (1, 3, "similar"), (1, 4, "exact"), (4, 1, "exact"), (9, 1, "exact"), (1, 9, "exact")], "keep_id long, remove_id long, kind string")
    media = media.union(spark.createDataFrame([row(4, sha="x", present=False)], MEDIA))
    assert sorted((r.keep_id, r.remove_id, r.kind, r.outcome) for r in duplicates.keep_outcomes(media, more).collect()) == [
        (1, 2, "exact", "removed"), (1, 3, "exact", "its content is no longer that of the kept file"), (1, 3, "similar", "removed"), (1, 4, "exact", "file not found"),
        (4, 1, "exact", "the file to keep is missing"), (9, 1, "exact", "the file to keep is missing"),
    ]


def test_difference_hash(spark):
    def of(values):
        return spark.createDataFrame([(values,)], "px array<int>").select(difference_hash(F.col("px"))).first()[0]

    down, up = list(range(9, 0, -1)), list(range(9))
    assert of(down * 4 + up * 4) == signed(0xFFFFFFFF00000000)
    assert of([0] * 72) is None and of([1] * 71) is None


def test_components_of_a_long_path_and_of_random_links(spark):
    path = [(i, i + 1) for i in range(40)]
    got = connected_components(spark.createDataFrame(path, "a long, b long")).collect()
    assert {r.id: r.label for r in got} == {i: 0 for i in range(41)}
    r = random.Random(7)
    links = [(r.randint(0, 60), r.randint(0, 60)) for _ in range(45)]
    parent = list(range(61))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    got = {x.id: x.label for x in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: root(i) for i in {x for p in links if p[0] != p[1] for x in p}}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_pairs_of_videos_meet_by_length(spark):
    import random

    r = random.Random(5)
    hashes = [r.getrandbits(63) for _ in range(6)]
    rows = [(i, r.choice(hashes) ^ (1 << r.randrange(60) if i % 3 else 0), r.choice([r.uniform(0, 60), 50 + r.uniform(-1.1, 1.1), r.uniform(0, 4000), 10.0 * r.randrange(8), 49.0 + r.randrange(4)])) for i in range(260)]
    rows += [(300, hashes[0], None), (301, None, 5.0), (302, hashes[1], 0.0)]

    def match(a, b):
        return a is not None and b is not None and abs(a - b) <= max(1.0, 0.02 * max(a, b))

    want = {(a[0], b[0], (a[1] ^ b[1]).bit_count()) for a in rows for b in rows if a[0] < b[0] and None not in (a[1], b[1]) and (a[1] ^ b[1]).bit_count() <= 3 and match(a[2], b[2])}
    found = duplicates.video_pairs(spark.createDataFrame(rows, "id long, h long, duration double"), 3).collect()
    assert len(found) == len(want) > 50 and {tuple(x) for x in found} == want
