"""A media catalog as views of the test tables, and the same views as SQL for the oracle.

documents are the media, events the tag records of three machines, labels further tags, conversations
the moves, pages the paths.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediaquarry.functions.text import LOWER, UPPER, fold_ascii
from mediaquarry.operators.tags import LINK, resolve

ROOT = "/lib"
#: A document's time: an hour for each id from the first of January 2024 on.
FIRST_TIME = 1704067200


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, root, album, filename, rel_path, type, size, mtime, duration, present."""
    docs = table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    album = F.when(i % 7 == 0, "").when(i % 3 == 0, F.col("source")).otherwise(F.concat("source", F.lit("/"), "lang"))
    video = i % 5 == 0
    rows = docs.select(
        i.alias("id"), F.lit(ROOT).alias("root"), album.alias("album"),
        F.concat(F.lit("doc_"), i.cast("string"), F.when(video, ".mp4").otherwise(".jpg")).alias("filename"),
        F.when(video, "video").otherwise("photo").alias("type"), F.col("n_chars").alias("size"),
        (FIRST_TIME + 3600 * i).cast("double").alias("mtime"), F.when(video, F.col("n_chars") / 100.0).alias("duration"),
        (i % 11 != 10).alias("present"),
    )
    return rows.withColumn("rel_path", F.when(F.col("album") == "", F.col("filename")).otherwise(F.concat("album", F.lit("/"), "filename")))


def contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id and sha256 of the text."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))


def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id and phash: a 64-bit similarity hash of the words, null unless 6 to 58 bits are set.

    Each word votes for the bits of the first half of its MD5. Two bits are counted by one sum, one in
    each half of a long, so 32 sums count 64 bits.
    """
    docs = table(spark, sf_dir, "documents")
    # words are hashed and counted where the text is read; partial sums are all that is shuffled
    words = docs.select("doc_id", F.explode(F.split(fold_ascii(F.col("text")), r"\s+")).alias("w")).where("w <> ''")
    h = F.conv(F.substring(F.md5(F.col("w").cast("binary")), 1, 16), 16, -10).cast("long")
    pair = (1 << 32) | 1
    votes = words.select("doc_id", h.alias("h")).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(F.shiftrightunsigned("h", i).bitwiseAND(F.lit(pair))).alias(f"v{i}") for i in range(32)]
    )
    bits = [F.when(2 * F.col(f"v{i}").bitwiseAND(F.lit(0xFFFFFFFF)) > F.col("n"), F.shiftleft(F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")) for i in range(32)]
    bits += [F.when(2 * F.shiftrightunsigned(f"v{i}", 32) > F.col("n"), F.shiftleft(F.lit(1).cast("long"), i + 32)).otherwise(F.lit(0).cast("long")) for i in range(32)]
    value = reduce(lambda a, b: a.bitwiseOR(b), bits)
    return votes.select(F.col("doc_id").alias("id"), value.alias("v")).select("id", F.when(F.bit_count("v").between(6, 58), F.col("v")).alias("phash"))


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tag records: media_id, tag, updated_at, deleted, machine, seq."""
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("media_id"), F.col("event_type").alias("tag"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("updated_at"),
        (k % 4 == 0).alias("deleted"), (F.col("event_id") % 3).alias("machine"), F.col("event_id").alias("seq"),
    )


def label_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live tags 'quality' and 'toxic' of labelled documents, older than all records."""
    rows = table(spark, sf_dir, "labels")
    flags = F.explode(F.filter(F.array(F.when(F.col("quality") == 1, "quality"), F.when(F.col("toxic") == 1, "toxic")), lambda t: t.isNotNull()))
    return rows.select(F.col("doc_id").alias("media_id"), flags.alias("tag"), F.lit(0.0).alias("updated_at"), F.lit(False).alias("deleted"), F.lit(-1).cast("long").alias("seq"))


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resolved links of events and labels."""
    both = records(spark, sf_dir).drop("machine").unionByName(label_records(spark, sf_dir))
    return resolve(both).select(*LINK)


# -- the same in SQL -----------------------------------------------------------------------------


def fold(column: str) -> str:
    return f"translate({column}, '{UPPER}', '{LOWER}')"


MEDIA = f"""media AS (
    SELECT *, CASE WHEN album = '' THEN filename ELSE album || '/' || filename END AS rel_path FROM (
        SELECT doc_id AS id, '{ROOT}' AS root,
               CASE WHEN doc_id % 7 = 0 THEN '' WHEN doc_id % 3 = 0 THEN source ELSE source || '/' || lang END AS album,
               'doc_' || doc_id || CASE WHEN doc_id % 5 = 0 THEN '.mp4' ELSE '.jpg' END AS filename,
               CASE WHEN doc_id % 5 = 0 THEN 'video' ELSE 'photo' END AS type, n_chars AS size,
               ({FIRST_TIME} + 3600 * doc_id)::DOUBLE AS mtime, CASE WHEN doc_id % 5 = 0 THEN n_chars / 100.0 END AS duration,
               doc_id % 11 <> 10 AS present, sha256(text) AS sha256
        FROM documents))"""

RECORDS = """records AS (
    SELECT user_id AS media_id, event_type AS tag, epoch_us(ts) / 1e6 AS updated_at,
           (props->>'$.k')::BIGINT % 4 = 0 AS deleted, event_id % 3 AS machine, event_id AS seq FROM events)"""

ALL_RECORDS = f"""{RECORDS},
all_records AS (
    SELECT media_id, tag, updated_at, deleted, seq FROM records
    UNION ALL SELECT doc_id, 'quality', 0.0, false, -1 FROM labels WHERE quality = 1
    UNION ALL SELECT doc_id, 'toxic', 0.0, false, -1 FROM labels WHERE toxic = 1)"""

LINKS = f"""{ALL_RECORDS},
ranked AS (SELECT *, {fold("tag")} AS tag_key, row_number() OVER (PARTITION BY media_id, {fold("tag")} ORDER BY updated_at DESC, seq) AS turn FROM all_records),
spelled AS (SELECT tag_key, arg_min(tag, seq) AS tag FROM ranked GROUP BY tag_key),
links AS (SELECT r.media_id, r.tag_key, s.tag, r.updated_at, r.deleted FROM ranked r JOIN spelled s USING (tag_key) WHERE turn = 1)"""

PHASH = f"""words AS (SELECT doc_id, unnest(string_split_regex({fold("text")}, '\\s+')) AS w FROM documents),
votes AS (
    SELECT doc_id, count(*) AS n, {", ".join(f"sum((h >> {i}) & 1) AS v{i}" for i in range(64))}
    FROM (SELECT doc_id, ('0x' || substr(md5(w), 1, 16))::UBIGINT AS h FROM words WHERE w <> '') GROUP BY doc_id),
prints AS (
    SELECT doc_id AS id, CASE WHEN bit_count(u) BETWEEN 6 AND 58 THEN u END AS h
    FROM (SELECT doc_id, ({" + ".join(f"(CASE WHEN 2 * v{i} > n THEN {1 << i}::HUGEINT ELSE 0 END)" for i in range(64))})::UBIGINT AS u FROM votes))"""

#: A hash as the signed number that it is stored as.
SIGNED = "CASE WHEN h >= 9223372036854775808 THEN (h::HUGEINT - 18446744073709551616)::BIGINT ELSE h::BIGINT END"

ANCESTORS = """list_transform(range(1, len(string_split(album, '/')) + 1), lambda n: array_to_string(string_split(album, '/')[1:n], '/'))"""
