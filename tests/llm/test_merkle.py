import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from mediaquarry.llm.merkle import Block, build_manifest, document_manifest, folded, height, proofs

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def tree(nodes, fanout):
    found = [nodes]
    while len(found[-1]) > 1:
        own = found[-1]
        found.append([digest("".join(own[i : i + fanout])) for i in range(0, len(own), fanout)])
    return found


def path(levels, i, fanout):
    out = []
    for own in levels[:-1]:
        low = i // fanout * fanout
        out.append(("".join(own[low:i]), "".join(own[i + 1 : low + fanout])))
        i //= fanout
    return out


def brute(rows, fanout=2):
    def leaf(r, more):
        values = (r[0], r[3], r[2], None if r[4] is None else r[4] + more, r[1])
        return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))

    parts = defaultdict(list)
    for r in rows:
        parts[r[2]].append((r[0], leaf(r, 0), leaf(r, int(r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0))))
    names = sorted(parts, key=lambda x: (x is not None, (x or "").encode()))
    for name in names:
        parts[name].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    trees = {name: tree([x[1] for x in parts[name]], fanout) for name in names}
    top = tree([trees[name][-1][0] for name in names], fanout)
    out = []
    for k, name in enumerate(names):
        for i, (doc_id, own, claim) in enumerate(parts[name]):
            steps = path(trees[name], i, fanout) + path(top, k, fanout)
            at = claim
            for left, right in steps:
                at = digest(left + at + right)
            out.append((doc_id, own, trees[name][-1][0], top[-1][0], digest("".join(a + b for a, b in steps)), at, at == top[-1][0]))
    return sorted(out, key=str)


def run(table, **options):
    return sorted((tuple(r) for r in document_manifest(table, **options).collect()), key=str)


def rows_of(n, langs=("en", "de", None, "", "é")):
    return [(i, f"text {i}", langs[i * i % 7 % len(langs)], "s", 6 if i % 3 else None) for i in range(n)]


@pytest.mark.parametrize(("fanout", "block"), [(2, 4096), (2, 4), (3, 9), (2, 2)])
def test_brute_force_over_blocks_and_stages(spark, fanout, block):
    rows = rows_of(75)
    assert run(spark.createDataFrame(rows, SCHEMA), fanout=fanout, block=block) == brute(rows, fanout)


def test_hard_rows_and_clashing_columns(docs, hard):
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in hard]
    assert run(docs(hard)) == brute(rows)


def test_lone_leaves_one_part_and_no_rows(spark):
    for rows in ([(7, "a", "en", "s", 1)], [(1, "a", "en", None, 1), (2, "b", None, "s", 1)], rows_of(9, ("en",)), []):
        assert run(spark.createDataFrame(rows, SCHEMA), block=2) == brute(rows)


def test_many_parts(spark):
    rows = [(i, "t", f"lang {i % 40}", "s", 1) for i in range(90)]
    assert run(spark.createDataFrame(rows, SCHEMA), block=4) == brute(rows)


def test_equal_rows_keep_places_of_their_own(spark):
    rows = [(1, "same", "en", "s", 4)] * 30 + [(2, "other", "en", "s", 5)]
    assert run(spark.createDataFrame(rows, SCHEMA), block=4) == brute(rows)


def test_proofs_lead_to_the_root(spark):
    rows = spark.createDataFrame(rows_of(50), SCHEMA).select(
        F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("")).alias("_tree"), F.col("doc_id").alias("_id"), F.sha2("text", 256).alias("_digest")
    )
    manifest = build_manifest(rows, ["_id"], block=8)
    found = proofs(manifest, "_id long").collect()
    assert len(found) == 50 and all(folded(r.leaf, r.lefts, r.rights) == manifest.root for r in found)
    assert folded(digest("x"), found[0].lefts, found[0].rights) != manifest.root


def test_a_block_must_be_a_power_of_the_fanout(spark):
    with pytest.raises(ValueError):
        run(spark.createDataFrame(rows_of(3), SCHEMA), fanout=2, block=6)


def test_heights_and_blocks():
    assert [height(n, 2, 8) for n in (1, 2, 3, 8, 9, 100)] == [0, 1, 2, 3, 3, 3]
    leaves = [digest(str(i)) for i in range(5)]
    import pandas as pd

    own = Block(pd.Series(leaves), 100, 2, 8)
    assert own.root == digest(digest(digest(leaves[0] + leaves[1]) + digest(leaves[2] + leaves[3])) + digest(digest(leaves[4])))
    assert [len(x) for x in own.levels] == [5, 3, 2, 1] and all(x.dtype == np.uint8 for x in own.levels)


def test_small_tables(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in table.collect()]
    assert run(table, block=16) == brute(rows)
