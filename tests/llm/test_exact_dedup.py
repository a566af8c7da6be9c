import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from mediaquarry.llm.exact_dedup import build_directory, build_index, exact_dedup


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = []
    for i, t in rows:
        own = groups[t or ""]
        keep = max((x for x in own if x is not None), default=None)
        out.append((i, keep, len(own), i is not None and i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str)


def run(table, **options):
    return sorted((tuple(r) for r in exact_dedup(table, **options).collect()), key=str)


def test_brute_force_and_hard_cases(docs, hard):
    rows = hard + [(i, f"text {i % 7}") for i in range(100, 160)]
    assert run(docs(rows)) == brute(rows)
    assert run(docs(rows), bucket_bytes=200, max_depth=6) == brute(rows)
    assert run(docs(rows), bucket_bytes=200, fold_rows=2) == brute(rows)


def test_collisions_are_told_apart_by_their_bytes(docs):
    rows = [(i, f"text {i % 5}") for i in range(40)]
    for fold_rows in (3, 1000):
        assert run(docs(rows), key=lambda t: F.length(t).cast("long"), fold_rows=fold_rows) == brute(rows)
    index, _, _ = build_index(docs(rows), key=lambda t: F.length(t).cast("long"))
    assert {(r._id % 5, r._link) for r in index.collect()} == {(i, i + 1) for i in range(5)}


def test_the_directory_doubles_and_each_bucket_is_one_file(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    index, many, buckets = build_index(table, bucket_bytes=4 << 20)
    assert buckets > 4
    files = {}
    for r in index.select("_bucket", F.input_file_name().alias("file")).distinct().collect():
        files.setdefault(r._bucket, set()).add(r.file)
    assert sorted(files) == list(range(buckets)) and all(len(f) == 1 for f in files.values())
    assert len(set.union(*files.values())) == buckets
    ranges = index.groupBy("_bucket").agg(F.min(F.shiftrightunsigned("_key", 1)).alias("low"), F.max(F.shiftrightunsigned("_key", 1)).alias("high")).orderBy("_bucket").collect()
    assert all(a.high < b.low for a, b in zip(ranges, ranges[1:]))
    assert build_index(table)[2] > 1


def test_empty_table(docs):
    assert run(docs([])) == []


def test_no_python_in_the_plan(docs):
    plan = exact_dedup(docs([(1, "a")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_directory_splits_overfull_buckets():
    g, cells = build_directory({0: 5, 1: 5, 2: 1, 7: 1}, 3, 6)
    assert g == 3 and cells[0] != cells[1] and cells[4:] == [cells[4]] * 4
    assert build_directory({}, 3, 6) == (0, [0])
    assert build_directory({0: 100}, 2, 6)[0] == 2
