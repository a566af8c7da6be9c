import re
from collections import defaultdict
from itertools import permutations

from pyspark.sql import functions as F

from mediaquarry.llm.filter_audit import audit, failure_masks, filter_audit, mask_cells, parity_sums

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, labels):
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    parts = defaultdict(list)
    for i, t, lang in rows:
        text = t or ""
        words = WORD.findall(text)
        fails = "A" * (len(words) < 200) + "B" * (100 * len(set(words)) < 50 * len(words)) + "C" * (100 * len(re.findall("[A-Z]", text)) > 3 * len(text))
        fails += "D" * bool(re.search(r"[#$%&*|]", text)) + "E" * (i is not None and first[text] < i)
        marks = [x for x in labels if x[0] == i and i is not None]
        parts[lang or ""].append((fails, any(x[1] == 1 for x in marks), any(x[2] == 1 for x in marks)))
    out = []
    for part, own in parts.items():
        shapley, steps = defaultdict(int), []
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [m for m in left if f in m[0]]
                left = [m for m in left if f not in m[0]]
                shapley[f] += len(gone)
                counts = (len(left), len(gone), sum(f in m[0] for m in own) - len(gone), sum(m[0] == f for m in own), sum(m[1] for m in gone), sum(m[2] for m in gone))
                steps.append(((part, "".join(order), step, *counts), f))
        out += [(*row, shapley[f]) for row, f in steps]
    return sorted(out)


def table(spark, docs, rows, labels):
    lang = F.when(F.col("source") != "null", F.col("source"))
    return docs([(i, t, lang or "null") for i, t, lang in rows]).withColumn("lang", lang), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def run(frames):
    return sorted(tuple(r) for r in filter_audit(*frames).collect())


def test_brute_force(spark, docs, hard):
    long = " ".join(f"w{i}" for i in range(250))
    rows = [(i, t, "en") for i, t in hard] + [
        (20, long, "de"), (21, long, "de"), (21, long, "en"), (22, long + " #", "de"), (23, long.upper(), None), (24, "w " * 300, None), (25, long + " x\x85y", "de"),
        (26, "W " * 300 + "&", "de"), (None, long, "de"), (27, "ÄÖ " + long, "fr"), (28, None, "fr"),
    ]
    labels = [(20, 1, 0), (21, 1, 1), (21, 0, 0), (23, None, 1), (None, 1, 1), (26, 1, 1), (24, 0, None), (1, 1, 0), (99, 1, 1)]
    assert run(table(spark, docs, rows, labels)) == brute(rows, labels)


def test_empty_tables(spark, docs):
    assert run(table(spark, docs, [], [(1, 1, 1)])) == []
    rows = [(1, "a", "en")]
    assert run(table(spark, docs, rows, [])) == brute(rows, [])


def test_small_tables(spark):
    both = [spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "labels")]
    rows = [(r.doc_id, r.text, r.lang) for r in both[0].collect()]
    assert run(both) == brute(rows, [tuple(r) for r in both[1].select("doc_id", "quality", "toxic").collect()])


def test_masks_meet_by_id_and_digest(spark, docs):
    rows = [(3, "t", "en"), (1, "t", "en"), (1, "t", "de"), (2, None, "en"), (5, "", "en"), (None, "t", "en"), (4, "t", "en"), (4, "t", "en")]
    masks = {(r._id, r._part): (r._mask >> 4, r._n) for r in failure_masks(table(spark, docs, rows, [])[0]).collect()}
    assert masks == {(3, "en"): (1, 1), (1, "en"): (0, 1), (1, "de"): (0, 1), (2, "en"): (0, 1), (5, "en"): (1, 1), (None, "en"): (0, 1), (4, "en"): (1, 2)}


def test_the_transform_is_inverted_exactly_at_any_size(spark):
    counts = [(m * 7919 + 13) % 101 * 10**14 for m in range(32)]
    rows = spark.createDataFrame([("p", "", m, n) for m, n in enumerate(counts)], "_part string, _label string, _mask int, _n long")
    assert parity_sums(rows, 5).select(mask_cells(F.col("_sums"), 5).alias("c")).first().c == counts


def test_other_numbers_of_filters(spark):
    rows = spark.createDataFrame([("p", "", 3, 4), ("p", "", 1, 1), ("p", "good", 3, 2)], "_part string, _label string, _mask int, _n long")
    found = {(r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.shapley) for r in audit(rows, "XY", ["good"]).collect()}
    assert found == {("XY", 1): (0, 5, 0, 1, 2, 6), ("XY", 2): (0, 0, 4, 0, 0, 4), ("YX", 1): (1, 4, 0, 0, 2, 4), ("YX", 2): (0, 1, 4, 1, 0, 6)}
