import hashlib
import struct
from collections import Counter

import corpus_pipeline
from mediaquarry.llm import mixing, quality, queries


def test_stages_keep_what_they_should(spark, docs):
    rows = [(i, " ".join(f"w{(i * 31 + j * 7) % 997}" for j in range(60))) for i in range(40)]
    near = rows[3][1].split()
    near[10] = "changed"
    rows += [(100, rows[0][1]), (100, rows[0][1]), (101, " ".join(near)), (102, None), (None, "a null id stays here")]
    table = docs(rows)
    kept = corpus_pipeline.drop_copies(spark, table, "")
    assert kept.columns == table.columns
    ids = sorted((r.doc_id for r in kept.collect()), key=str)
    assert ids == sorted([*range(1, 40), 100, 101, 102, None], key=str)
    left = corpus_pipeline.drop_near_copies(spark, kept, "")
    assert sorted((r.doc_id for r in left.collect()), key=str) == sorted([*range(1, 40), 100, 102, None], key=str)
    mixed = corpus_pipeline.mix(spark, left, "")
    assert mixed.columns == table.columns and mixed.count() > 0
    assert corpus_pipeline.encode(spark, mixed, "").count() == mixed.count()


def test_whole_run(spark):
    sf_dir = "/root/testdata/sf0.001"
    got = corpus_pipeline.run(spark, sf_dir).collect()
    known = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id").collect()}
    assert got and {r.doc_id for r in got} <= known
    assert [name for name, _ in corpus_pipeline.STAGES][-1] == "BPE encoding" and len(corpus_pipeline.STAGES) == 5


def test_queries_are_named_by_operator():
    numbers = sorted(int(name[2:].split("_")[0]) for name in queries.QUERIES)
    assert numbers == list(range(1, 14)) and set(queries.ORACLES) <= set(queries.QUERIES)


def test_keep_good_by_brute_force(spark, hard, docs):
    """Rows, repeated and null ones too, whose text scores 0.3 or more stay, with all columns."""
    sf_dir = "/root/testdata/sf0.01"
    table = docs(hard).drop("n_chars").unionByName(spark.read.parquet(f"{sf_dir}/documents.parquet").drop("n_chars"), allowMissingColumns=True)
    model = quality.train(table, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    kept = corpus_pipeline.keep_good(spark, table, sf_dir)
    assert kept.columns == table.columns
    rows = [(r.doc_id, r.text) for r in table.collect()]
    want = Counter(r for r in rows if model.score(quality.np.array([quality.features(r[1])]))[0] >= 0.3)
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == want and 0 < sum(want.values()) < len(rows)


def test_mix_and_encode_by_brute_force(spark, small, hard):
    """The mix returns the words that the operator takes of each row, in order; each is encoded as the library does."""
    from tokenizers import Tokenizer

    table = small.unionByName(spark.createDataFrame([(r[0], r[1], "en", "s", None) for r in hard], small.schema))
    mixed = corpus_pipeline.mix(spark, table, "").collect()
    taken = Counter()
    for r in mixing.mix_sources(table).collect():
        taken[r.doc_id] += r.taken
    words = Counter()
    texts = {}
    for r in table.collect():
        texts.setdefault(r.doc_id, []).append((r.text or "").encode().split())
    for r in mixed:
        own = r.text.encode().split()
        words[r.doc_id] += len(own)
        assert r.n_chars == len(r.text) and any(is_part(own, t) for t in texts[r.doc_id])
    assert +words == +taken
    library = Tokenizer.from_file(queries.vocabulary_path())
    library.no_truncation()
    library.no_padding()
    made = spark.createDataFrame(mixed, table.schema)
    want = Counter()
    for r in mixed:
        ids = library.encode(r.text, add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        want[r.doc_id, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in corpus_pipeline.encode(spark, made, "").collect()) == want


def is_part(words, text):
    """Whether ``words`` are some of the words of ``text``, in order."""
    rest = iter(text)
    return all(w in rest for w in words)


def test_stages_take_empty_tables(spark, docs):
    empty = docs([])
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, empty, "/root/testdata/sf0.001")
        assert got.count() == 0 and (name == "BPE encoding" or got.columns == empty.columns)
