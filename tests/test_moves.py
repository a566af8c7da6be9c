import json
import random

import pytest
from pyspark.sql import functions as F

from mediaquarry.operators import moves
from mediaquarry.operators.pointers import followed, placed

MEDIA = "id long, rel_path string, size long, present boolean"
MOVES = "from_path string, to_path string, size long, moved_at double, n long"


def in_order(media, steps):
    """Outcomes and changes of moves that are replayed one by one."""
    here = {m[1].lower(): {"id": m[0], "size": m[2], "present": m[3]} for m in sorted(media)}
    final, outcomes = {}, []
    for src, dst, size, _, _ in steps:
        (a, x), (b, y) = ((p.rpartition("/")[0].lower(), p.rpartition("/")[2]) for p in (src, dst))
        row, there = here.get(src.lower()), here.get(dst.lower())
        if a == b and x == y:
            what = "unchanged"
        elif a != b and x != y:
            what = "skipped: move and rename in one"
        elif row is None or not row["present"]:
            what = "relinked" if row and there and there["present"] and there["size"] == size else "absent"
        elif row["size"] != size:
            what = "skipped: a different file"
        elif src.lower() != dst.lower() and there:
            what = "skipped: destination occupied"
        else:
            what = "applied"
        outcomes.append(what)
        if what == "applied":
            here[dst.lower()] = here.pop(src.lower())
            final[row["id"]] = (dst, None)
        elif what == "relinked":
            final[here.pop(src.lower())["id"]] = (src, there["id"])
    return outcomes, final


def replay(spark, rows, steps):
    table, log = spark.createDataFrame(rows, MEDIA), spark.createDataFrame([], "from_path string, to_path string, size long, moved_at double")
    records = spark.createDataFrame(steps, MOVES).withColumn("seq", F.struct("moved_at", "n")).drop("n")
    outcomes, changes = moves.replayed(table, records, log)
    found = {json.loads(r.key)["n"]: r.outcome for r in outcomes.collect()}
    return [found[s[4]] for s in steps], {r.id: (r.rel_path, r.replaced_by) for r in changes.collect()}


@pytest.mark.parametrize("seed", range(4))
def test_crowded_moves_agree_with_a_replay_one_by_one(spark, seed):
    r = random.Random(seed)
    files = 12
    rows = [(i, f"d{i % 3}/{i}.jpg", 1 + i % 2, i % 5 != 0) for i in range(files)]
    steps = []
    for n in range(120):
        i = r.randrange(files)
        name = f"{i}.jpg" if r.random() < 0.8 else r.choice([f"{r.randrange(files)}.jpg", f"{i}.JPG"])
        steps.append((f"d{r.randrange(3)}/{i}.jpg", f"d{r.randrange(4)}/{name}", 1 + r.randrange(2), float(r.randrange(40)), n))
    steps.sort(key=lambda s: (s[3], s[4]))
    assert replay(spark, rows, steps) == in_order(rows, steps)


def test_a_path_that_every_move_touches(spark):
    rows = [(i, f"d{i}/x.jpg", 1, True) for i in range(40)]
    steps = [(f"d{i}/x.jpg", "hub/x.jpg", 1, float(2 * i), 2 * i) for i in range(40)] + [("hub/x.jpg", f"e{i}/x.jpg", 1, 2.0 * i + 1, 2 * i + 1) for i in range(0, 40, 3)]
    steps.sort(key=lambda s: s[3])
    assert replay(spark, rows, steps) == in_order(rows, steps)


def test_a_chain_of_a_hundred_thousand_moves(spark):
    n = 100_000
    chain = spark.range(n).select(
        F.concat(F.lit("d"), "id", F.lit("/x.jpg")).alias("from_path"), F.concat(F.lit("d"), F.col("id") + 1, F.lit("/x.jpg")).alias("to_path"), F.lit(1).cast("long").alias("size"),
        F.col("id").cast("double").alias("moved_at"), F.struct("id").alias("seq"),
    )
    media = spark.createDataFrame([(7, "d0/x.jpg", 1, True)], MEDIA)
    outcomes, changes = moves.replayed(media, chain, chain.limit(0).select("from_path", "to_path", "size", "moved_at"))
    assert [tuple(r) for r in outcomes.groupBy("outcome").count().collect()] == [("applied", n)]
    assert [tuple(r) for r in changes.collect()] == [(7, f"d{n}/x.jpg", None)]


def test_no_moves(spark):
    assert replay(spark, [(1, "a/x.jpg", 1, True)], []) == ([], {})


def test_links_are_followed_to_their_ends(spark):
    links = [(1, 2), (2, 3), (3, None), (4, 3), (5, 6), (6, 7), (7, 5), (8, 5), (9, None), (10, 11), (11, 10), (20, 21), (21, 22), (22, 23), (23, 24), (24, 25), (25, 1)]
    found = {r.id: (r.end, r.steps, r.low) for r in followed(spark.createDataFrame(links, "id long, next long")).collect()}
    assert found[1] == (3, 2, 1) and found[4] == (3, 1, 3) and found[9] == (9, 0, 9) and found[20] == (3, 8, 1)
    assert all(found[i] == (None, None, 5) for i in (5, 6, 7)) and found[8][:2] == (None, None) and found[10] == (None, None, 10) == found[11]
    assert followed(spark.createDataFrame([], "id long, next long")).count() == 0


def test_places_follow_the_order(spark):
    rows = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("k"), F.lit("x").alias("v"))
    assert placed(rows.repartition(7), ["k"], "places").where("k <> _pos").count() == 0
