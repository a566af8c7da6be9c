"""Catalog queries on trees, schedules, stored tables and streams' batches, with the DuckDB SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mediaquarry.functions import text
from mediaquarry.operators import duplicates, folders, moves, near_index, provider, rename, sync
from mediaquarry.operators.pointers import placed
from mediaquarry.plans import catalog, catalog_queries
from mediaquarry.plans.catalog import MEDIA, PHASH, RECORDS, fold
from mediaquarry.sources import sync_files
from mediaquarry.storage import materialise, work_path
from mediaquarry.streaming import exports
from mediaquarry.streaming.upsert import LinkTable

QUERIES: dict = {}
ORACLES: dict = {}


def _query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return add


# -- a provider's tree -------------------------------------------------------------------------------

_LEVELS = 12


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a provider's entries: every fourth is a folder. Some hang under folders that aren't there, some folders under each
    other, some are listed twice, some list a folder above them; some have no name, some are hidden."""
    docs = catalog.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("i"), F.col("n_chars").alias("n"))
    i = F.col("i")

    def entry(number, parent, name, mime, size=None, modified=None) -> list:
        none = F.lit(None).cast("long")
        own = F.concat(F.lit("d"), number.cast("string")).alias("document_id")
        return [own, parent.alias("parent_id"), name.alias("name"), mime.alias("mime"), (none if size is None else size).alias("size"), (none if modified is None else modified).alias("last_modified")]

    def folder(number) -> Column:
        return F.concat(F.lit("d"), number.cast("long").cast("string"))

    is_folder = i % 4 == 0
    parent = F.when(i % 97 == 5, F.concat(F.lit("lost"), i.cast("string"))).when(i % 40 == 12, folder(i + 4)).when(i % 40 == 16, folder(i - 4)).otherwise(folder(4 * F.floor(i / 16)))
    ending = F.when(i % 3 == 0, ".jpg").when(i % 3 == 1, ".txt").otherwise("")
    name = F.when(i % 50 == 7, F.concat(F.lit(".h"), i.cast("string"))).when(i % 51 == 9, F.lit(None)).when(is_folder, F.concat(F.lit("n"), i.cast("string"))).otherwise(F.concat(F.lit("f"), i.cast("string"), ending))
    mime = F.when(is_folder, provider.DIRECTORY).when(i % 5 == 0, "video/x").when(i % 5 == 1, "image/y").otherwise("text/plain")
    main = docs.select(*entry(i, parent, name, mime, F.when(i % 6 != 0, F.col("n")), F.when(i % 8 != 1, i * 1000)))
    kind = F.lit(provider.DIRECTORY)
    short = docs.where("i % 28 = 0").select(*entry(i, F.lit("d0"), F.concat(F.lit("short"), i.cast("string")), kind))
    back = docs.where("i % 12 = 0").select(*entry((4 * F.floor(i / 64)).cast("long"), F.concat(F.lit("d"), i.cast("string")), F.concat(F.lit("back"), i.cast("string")), kind))
    return main.unionByName(short).unionByName(back)


_ENTRIES = f"""b AS (SELECT doc_id AS i, n_chars AS n FROM documents),
e AS (
    SELECT 'd' || i AS id, CASE WHEN i % 97 = 5 THEN 'lost' || i WHEN i % 40 = 12 THEN 'd' || (i + 4) WHEN i % 40 = 16 THEN 'd' || (i - 4) ELSE 'd' || (4 * (i // 16)) END AS parent,
           CASE WHEN i % 50 = 7 THEN '.h' || i WHEN i % 51 = 9 THEN NULL WHEN i % 4 = 0 THEN 'n' || i ELSE 'f' || i || CASE i % 3 WHEN 0 THEN '.jpg' WHEN 1 THEN '.txt' ELSE '' END END AS name,
           i % 4 = 0 AS dir, CASE i % 5 WHEN 0 THEN 'video' WHEN 1 THEN 'photo' END AS by_mime, CASE WHEN i % 6 <> 0 THEN n ELSE 0 END AS size, CASE WHEN i % 8 <> 1 THEN i * 1000 ELSE 0 END AS last_modified FROM b
    UNION ALL SELECT 'd' || i, 'd0', 'short' || i, true, NULL, 0, 0 FROM b WHERE i % 28 = 0
    UNION ALL SELECT 'd' || (4 * (i // 64)), 'd' || i, 'back' || i, true, NULL, 0, 0 FROM b WHERE i % 12 = 0),
k AS (SELECT * FROM e WHERE name IS NOT NULL AND NOT starts_with(name, '.')),
v0 AS (SELECT 'd0' AS id, '' AS path), s0 AS (SELECT * FROM v0),
""" + ",\n".join(
    f"""v{n + 1} AS (SELECT k.id, arg_min(CASE WHEN v.path = '' THEN '' ELSE v.path || '/' END || k.name, (k.parent, k.name)) AS path FROM k JOIN v{n} v ON v.id = k.parent
        WHERE k.dir AND k.id NOT IN (SELECT id FROM s{n}) GROUP BY k.id), s{n + 1} AS (SELECT * FROM s{n} UNION ALL SELECT * FROM v{n + 1})"""
    for n in range(_LEVELS)
) + f""",
found AS (SELECT k.*, CASE WHEN s.path = '' THEN '' ELSE s.path || '/' END || k.name AS path FROM k JOIN s{_LEVELS} s ON s.id = k.parent)"""


@_query(
    "provider_media",
    f"WITH {_ENTRIES} SELECT id AS document_id, path AS rel_path, CASE WHEN path LIKE '%.jpg' THEN 'photo' ELSE by_mime END AS type, size, last_modified FROM found WHERE NOT dir AND (path LIKE '%.jpg' OR by_mime IS NOT NULL)",
)
def _(spark, sf_dir):
    return provider.traversed(_entries(spark, sf_dir), "d0")[0]


@_query("provider_folders", f"WITH {_ENTRIES} SELECT DISTINCT path AS rel_path FROM found WHERE dir")
def _(spark, sf_dir):
    return provider.traversed(_entries(spark, sf_dir), "d0")[1]


# -- schedules of renames ----------------------------------------------------------------------------


def _renames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plan for all documents as files, twelve to a folder: swaps, circles of three, chains, free names, other letters' case, and some that don't change."""
    i = F.col("doc_id")
    place = (i % 12).cast("int")
    here = F.concat(F.lit("d"), F.floor(i / 12).cast("string"), F.lit("/f"))
    target = F.get(F.array(*map(F.lit, ["1", "0", "3", "4", "2", "6", "7", "_end", "_new", "9", "10", "11"])), place)
    new = F.when(place == 9, F.concat(F.upper(here), F.lit("9.JPG"))).otherwise(F.concat(here, target, F.lit(".jpg")))
    status = F.when(place == 10, "unchanged").when(place == 11, "the name is taken").otherwise("ok")
    return catalog.table(spark, sf_dir, "documents").select(i.alias("id"), F.concat(here, place.cast("string"), F.lit(".jpg")).alias("old_path"), new.alias("new_path"), status.alias("status"))


_SCHEDULE = """p AS (SELECT doc_id AS id, 'd' || doc_id // 12 || '/f' AS here, doc_id % 12 AS r FROM documents WHERE doc_id % 12 < 10),
    q AS (SELECT id, here || r || '.jpg' AS old, CASE WHEN r = 9 THEN upper(here) || '9.JPG' ELSE here || ['1', '0', '3', '4', '2', '6', '7', '_end', '_new'][r + 1] || '.jpg' END AS new FROM p),
    nx AS (SELECT a.id, a.old, a.new, b.id AS next FROM q a LEFT JOIN q b ON lower(b.old) = lower(a.new) AND b.id <> a.id),
    way(id, spot, steps) AS (SELECT id, id, 0 FROM nx UNION ALL SELECT way.id, nx.next, steps + 1 FROM way JOIN nx ON nx.id = way.spot WHERE nx.next IS NOT NULL AND steps < 12),
    ends AS (SELECT way.id, way.spot AS fin, steps FROM way JOIN nx ON nx.id = way.spot WHERE nx.next IS NULL),
    low AS (SELECT id, min(spot) AS low FROM way WHERE id NOT IN (SELECT id FROM ends) GROUP BY id),
    turns AS (SELECT id, fin AS step_group, steps AS turn, CASE WHEN fin IN (SELECT fin FROM ends WHERE steps > 0) THEN 'chain' ELSE 'single' END AS kind FROM ends
              UNION ALL SELECT l.id, l.low, (SELECT min(steps) FROM way WHERE way.id = l.id AND way.spot = l.low), 'cycle' FROM low l),
    steps AS (
        SELECT t.step_group, t.turn, t.id, t.kind, n.old AS from_path, CASE WHEN t.kind = 'cycle' AND t.turn = 0 THEN regexp_replace(n.old, '[^/]*$', '') || '.rename-' || t.id || '.jpg' ELSE n.new END AS to_path FROM turns t JOIN nx n USING (id)
        UNION ALL SELECT t.step_group, (SELECT max(u.turn) + 1 FROM turns u WHERE u.step_group = t.step_group), t.id, t.kind, regexp_replace(n.old, '[^/]*$', '') || '.rename-' || t.id || '.jpg', n.new FROM turns t JOIN nx n USING (id) WHERE t.kind = 'cycle' AND t.turn = 0)"""


@_query("rename_schedule", f"WITH RECURSIVE {_SCHEDULE} SELECT step_group, turn::BIGINT AS turn, id, kind, from_path, to_path FROM steps")
def _(spark, sf_dir):
    return rename.rename_schedule(_renames(spark, sf_dir))


@_query(
    "rename_rollback",
    f"""WITH RECURSIVE {_SCHEDULE}, f AS (SELECT step_group, max(turn) AS failed FROM steps WHERE step_group % 3 <> 1 GROUP BY step_group)
    SELECT step_group, (failed - 1 - turn)::BIGINT AS turn, id, to_path AS from_path, from_path AS to_path FROM steps JOIN f USING (step_group) WHERE turn < failed""",
)
def _(spark, sf_dir):
    """The last step of two groups in three fails."""
    schedule = materialise(rename.rename_schedule(_renames(spark, sf_dir)), "rename-steps")
    failed = schedule.where("step_group % 3 <> 1").groupBy("step_group").agg(F.max("turn").alias("turn"))
    return rename.rolled_back(schedule, failed)


# -- stored tables that take batches -----------------------------------------------------------------


@_query(
    "near_index_increment",
    f"""WITH RECURSIVE {MEDIA}, {PHASH}, x AS (SELECT m.id, m.type, p.h FROM media m JOIN prints p USING (id) WHERE present AND h IS NOT NULL),
    edges AS (SELECT a.id AS a, b.id AS b FROM x a JOIN x b ON a.type = b.type AND a.id <> b.id WHERE bit_count(xor(a.h, b.h)) <= 6),
    reach(id, to_id) AS (SELECT a, a FROM edges UNION SELECT reach.id, b FROM reach JOIN edges ON to_id = a)
    SELECT id, min(to_id) AS label FROM reach GROUP BY id""",
)
def _(spark, sf_dir):
    """All media in three batches, the later ids first, and the second batch once more."""
    rows = catalog.media(spark, sf_dir).where("present").join(catalog.fingerprints(spark, sf_dir), "id").select("id", F.col("phash").alias("h"), F.col("type").alias("kind"))
    rows = materialise(rows, "hashed-media")
    index = near_index.HashIndex(spark, work_path(spark, "near-index"))
    for batch, part in ((0, 2), (1, 1), (1, 0), (2, 0)):
        index.add(rows.where(F.col("id") % 3 == part), batch)
    return index.groups()


@_query(
    "link_batches",
    f"""WITH {RECORDS}, r AS (SELECT *, row_number() OVER (PARTITION BY media_id, tag ORDER BY updated_at DESC, seq) AS turn FROM records),
    s AS (SELECT tag, arg_min(CASE WHEN seq % 3 = 0 THEN upper(tag) ELSE tag END, seq) AS spelled FROM records GROUP BY tag)
    SELECT media_id, r.tag AS tag_key, spelled AS tag, updated_at, deleted FROM r JOIN s USING (tag) WHERE turn = 1""",
)
def _(spark, sf_dir):
    """All records in four batches, in their order, the third of which comes twice."""
    rows = catalog.records(spark, sf_dir).withColumn("tag", F.when(F.col("seq") % 3 == 0, F.upper("tag")).otherwise(F.col("tag")))
    rows = materialise(rows, "tag-records")
    last = (rows.agg(F.max("seq")).first()[0] or 0) + 1
    table = LinkTable(spark, work_path(spark, "link-table"), buckets=16)
    for batch in (0, 1, 2, 2, 3):
        table.merge(rows.where(F.floor(F.col("seq") * 4 / last) == batch), batch)
    return table.read()


# -- edits and exports -------------------------------------------------------------------------------

_QUIET = 300


@_query(
    "export_sessions",
    f"""WITH e AS (SELECT event_id % 3 AS machine, ts AS t FROM events),
    g AS (SELECT *, CASE WHEN t <= lag(t) OVER (PARTITION BY machine ORDER BY t) + INTERVAL {_QUIET} SECOND THEN 0 ELSE 1 END AS starts FROM e),
    s AS (SELECT *, sum(starts) OVER (PARTITION BY machine ORDER BY t ROWS UNBOUNDED PRECEDING) AS run FROM g)
    SELECT machine, min(t) AS first_edit, max(t) AS last_edit, count(*) AS edits, max(t) + INTERVAL {_QUIET} SECOND AS export_at FROM s GROUP BY machine, run""",
)
def _(spark, sf_dir):
    edits = catalog.table(spark, sf_dir, "events").select((F.col("event_id") % 3).alias("machine"), F.col("ts").alias("at"))
    return exports.export_sessions(edits, f"{_QUIET} seconds")


# -- roots -------------------------------------------------------------------------------------------


@_query(
    "root_overlaps",
    r"""WITH u AS (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS p FROM pages),
    r AS (SELECT '/' || p AS root FROM u UNION ALL SELECT upper('/' || regexp_replace(p, '/[^/]*$', '') || '/') FROM u WHERE page_id % 2 = 0 UNION ALL SELECT '/' || regexp_extract(p, '^[^/]*') FROM u WHERE page_id % 5 = 0
          UNION ALL SELECT '/' || regexp_extract(p, '^[^/]*') || 'x' FROM u),
    f AS (SELECT lower(rtrim(root, '/')) AS key, min(rtrim(root, '/')) AS root FROM r GROUP BY key)
    SELECT a.root AS inside, arg_max(b.root, length(b.key)) AS holder, count(*) AS holders FROM f a JOIN f b ON starts_with(a.key, b.key || '/') GROUP BY a.root""",
)
def _(spark, sf_dir):
    """Urls as paths, some of their folders in capitals, some of their hosts, and names that only begin like a host."""
    p = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")
    rows = catalog.table(spark, sf_dir, "pages").select("page_id", p.alias("p"))
    host = F.concat(F.lit("/"), F.regexp_extract("p", "^[^/]*", 0))
    roots = (
        rows.select(F.concat(F.lit("/"), "p").alias("root"))
        .unionByName(rows.where("page_id % 2 = 0").select(F.upper(F.concat(F.lit("/"), F.regexp_replace("p", "/[^/]*$", ""), F.lit("/"))).alias("root")))
        .unionByName(rows.where("page_id % 5 = 0").select(host.alias("root")))
        .unionByName(rows.select(F.concat(host, F.lit("x")).alias("root")))
    )
    return folders.root_overlaps(roots)


# -- exchange documents ------------------------------------------------------------------------------


@_query(
    "sync_documents_judged",
    """SELECT conv_id, turn, CASE (conv_id + turn) % 7 WHEN 1 THEN 'file is too large' WHEN 2 THEN 'not a sync file' WHEN 3 THEN 'written by a newer version' WHEN 4 THEN 'missing machine id' WHEN 5 THEN 'not a sync file' END AS problem,
              CASE WHEN (conv_id + turn) % 7 IN (0, 6) THEN text END AS path FROM conversations""",
)
def _(spark, sf_dir):
    """Each turn's text as the path of a document: too large ones, other formats, newer versions, without a machine, cut off."""
    k = (F.col("conv_id") + F.col("turn")) % 7
    media = F.array(F.struct(F.col("text").alias("path"), F.lit(1).alias("size")))
    doc = F.struct(
        F.when(k == 2, "other").otherwise(sync_files.FORMAT).alias("format"), F.when(k == 3, 2).otherwise(1).alias("version"), F.when(k != 4, "m").alias("machine_id"), F.lit(1.5).alias("exported_at"), media.alias("media")
    )
    whole = F.to_json(doc)
    content = F.when(k == 5, F.substring(whole, 1, 12)).otherwise(whole).cast("binary")
    files = catalog.table(spark, sf_dir, "conversations").select(
        F.format_string("%d/%d", "conv_id", "turn").alias("path"), F.when(k == 1, sync_files.MAX_BYTES + 1).otherwise(F.octet_length(content)).cast("long").alias("length"), content.alias("content")
    )
    key = F.split("file", "/")
    shown = F.when(F.col("problem").isNull(), F.get("doc.media", F.lit(0))["path"])
    return sync_files.judged_documents(files).select(key[0].cast("long").alias("conv_id"), key[1].cast("long").alias("turn"), "problem", shown.alias("path"))


# -- merging into what is stored ---------------------------------------------------------------------


def _stored_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of two records in three."""
    from mediaquarry.operators.tags import LINK, resolve

    return resolve(catalog.records(spark, sf_dir).where("seq % 3 <> 0")).select(*LINK)


_STORED = f"""{RECORDS}, stored AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY media_id, tag ORDER BY updated_at DESC, seq) AS turn FROM records WHERE seq % 3 <> 0) WHERE turn = 1)"""


def _late_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All records for documents that are there: as new as what is stored, a second newer, or a second older; ties say the opposite."""
    known = catalog.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("media_id"))
    shift = F.when(F.col("seq") % 5 == 0, 1.0).when(F.col("seq") % 5 == 1, -1.0).otherwise(0.0)
    rows = catalog.records(spark, sf_dir).join(known, "media_id", "left_semi")
    return rows.select("media_id", "tag", (F.col("updated_at") + shift).alias("updated_at"), (F.col("deleted") != (F.col("seq") % 5 > 1)).alias("deleted"), "seq")


_LATE = "late AS (SELECT media_id, tag, updated_at + CASE seq % 5 WHEN 0 THEN 1.0 WHEN 1 THEN -1.0 ELSE 0.0 END AS updated_at, deleted <> (seq % 5 > 1) AS deleted, seq FROM records WHERE media_id IN (SELECT doc_id FROM documents))"


@_query(
    "sync_merge_stored",
    f"""WITH {_STORED}, {_LATE}, e AS (SELECT media_id, tag, updated_at, deleted, -1 AS seq FROM stored UNION ALL SELECT * FROM late),
    r AS (SELECT *, row_number() OVER (PARTITION BY media_id, tag ORDER BY updated_at DESC, seq) AS turn FROM e) SELECT media_id, tag AS tag_key, updated_at, deleted FROM r WHERE turn = 1""",
)
def _(spark, sf_dir):
    """Records that are as new as the stored links leave them as they are; newer ones win, older ones don't."""
    return sync.merged(_stored_links(spark, sf_dir), _late_records(spark, sf_dir)).select("media_id", "tag_key", "updated_at", "deleted")


@_query(
    "sync_counts_stored",
    f"""WITH {_STORED}, {_LATE}, e AS (SELECT media_id, tag, updated_at, deleted, -1 AS seq FROM stored UNION ALL SELECT * FROM late),
    m AS (SELECT *, max(updated_at) OVER (PARTITION BY media_id, tag ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest FROM e),
    b AS (SELECT *, lag(deleted) OVER (PARTITION BY media_id, tag ORDER BY seq) AS last FROM m WHERE newest IS NULL OR updated_at > newest)
    SELECT (SELECT count(*) FROM late) AS records, 0::BIGINT AS held, count(*) FILTER (seq >= 0) AS accepted, count(*) FILTER (seq >= 0 AND coalesce(last, true) <> deleted) AS changed FROM b""",
)
def _(spark, sf_dir):
    return sync.import_counts(_stored_links(spark, sf_dir), _late_records(spark, sf_dir))


_HELD = f"""{RECORDS}, gone AS (SELECT 'gone/' || media_id AS path, tag, updated_at, deleted, seq FROM records),
    before AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path, tag ORDER BY updated_at DESC, seq) AS turn FROM gone WHERE seq % 3 <> 0) WHERE turn = 1),
    news AS (SELECT path, tag, updated_at + CASE seq % 5 WHEN 0 THEN 1.0 WHEN 1 THEN -1.0 ELSE 0.0 END AS updated_at, deleted <> (seq % 5 > 1) AS deleted, seq FROM gone WHERE seq % 5 < 2 OR seq % 3 <> 0),
    both_ AS (SELECT path, tag, updated_at, deleted, -1 AS seq FROM before UNION ALL SELECT * FROM news)"""


@_query(
    "sync_pending_stored",
    f"WITH {_HELD}, r AS (SELECT *, row_number() OVER (PARTITION BY path, tag ORDER BY updated_at DESC, seq) AS turn FROM both_), t AS (SELECT path, tag, updated_at, bool_or(deleted) <> bool_and(deleted) AS torn, count(*) FILTER (seq >= 0) AS late, count(*) FILTER (seq < 0) AS early FROM both_ GROUP BY ALL) "
    "SELECT r.path, r.tag, r.updated_at, CASE WHEN early > 0 OR NOT torn THEN deleted END AS deleted FROM r JOIN t ON t.path = r.path AND t.tag = r.tag AND t.updated_at = r.updated_at WHERE turn = 1",
)
def _(spark, sf_dir):
    """Records of files that are nowhere, held in part before: ties keep what was held."""
    gone = catalog.records(spark, sf_dir).select(F.concat(F.lit("gone/"), F.col("media_id").cast("string")).alias("path"), "tag", "updated_at", "deleted", "seq")
    best = F.max_by(F.struct("updated_at", "deleted"), F.struct("updated_at", -F.col("seq")))
    before = gone.where("seq % 3 <> 0").groupBy("path", "tag").agg(best.alias("r")).select("path", "tag", "r.*")
    shift = F.when(F.col("seq") % 5 == 0, 1.0).when(F.col("seq") % 5 == 1, -1.0).otherwise(0.0)
    news = gone.where("seq % 5 < 2 or seq % 3 <> 0").select("path", "tag", (F.col("updated_at") + shift).alias("updated_at"), (F.col("deleted") != (F.col("seq") % 5 > 1)).alias("deleted"), F.lit(None).cast("long").alias("media_id"))
    return sync.held(before, news)


@_query(
    "move_outcomes_logged",
    f"""WITH {MEDIA}, k AS (SELECT *, 'moved/' || filename AS new_path FROM media)
    SELECT id, CASE WHEN id % 3 = 0 THEN 'known' WHEN NOT present THEN 'absent' ELSE 'applied' END AS outcome FROM k WHERE album <> 'moved'""",
)
def _(spark, sf_dir):
    """Every file moves into one folder; every third move is in the log, a third has a record there with another time, which is another move."""
    rows = catalog.media(spark, sf_dir)
    at = F.col("id").cast("double")
    steps = rows.select(F.upper("rel_path").alias("from_path"), F.concat(F.lit("moved/"), F.substring_index(F.upper("rel_path"), "/", -1)).alias("to_path"), "size", at.alias("moved_at"), F.struct(at.alias("at"), "id").alias("seq"))
    log = steps.where("seq.id % 3 <> 2").select("from_path", "to_path", "size", (F.col("moved_at") + F.col("seq.id") % 3).alias("moved_at"))
    found = moves.replayed(rows, steps, log)[0]
    return found.select(F.get_json_object("key", "$.id").cast("long").alias("id"), "outcome")


@_query("sync_skip_reasons", f"WITH {catalog_queries.MEDIA}, {catalog_queries._OUTCOMES} SELECT substr(outcome, 10) AS reason, count(*) AS n FROM outcomes WHERE starts_with(outcome, 'skipped') GROUP BY ALL")
def _(spark, sf_dir):
    rows = catalog_queries._file_moves(spark, sf_dir)
    return sync.skip_reasons(moves.replayed(catalog.media(spark, sf_dir), rows, catalog_queries._library(spark, sf_dir).log)[0])


@_query("sync_replay_order", "SELECT conv_id, turn, row_number() OVER (ORDER BY turn % 3, conv_id % 10, conv_id, turn) - 1 AS place FROM conversations")
def _(spark, sf_dir):
    """The moves of all documents, a conversation each: by time, of one time by file name, then by their places in the file."""
    rows = catalog.table(spark, sf_dir, "conversations")
    move = F.struct(F.col("text").alias("from"), F.col("turn").cast("string").alias("to"), F.col("conv_id").alias("size"), (F.col("turn") % 3).cast("double").alias("at"))
    own = rows.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", move.alias("m")))), lambda x: x["m"]).alias("moves"))
    docs = own.select(F.format_string("sync-%d-%020d.json", F.col("conv_id") % 10, "conv_id").alias("file"), F.struct("moves").alias("doc"))
    return placed(sync.flat_moves(docs), ["seq"], "moves-in-order").select(F.col("size").alias("conv_id"), F.col("to_path").cast("long").alias("turn"), F.col("_pos").alias("place"))


# -- videos and times --------------------------------------------------------------------------------


@_query(
    "video_pairs",
    f"""WITH {MEDIA}, {PHASH}, x AS (SELECT m.id, m.duration, p.h FROM media m JOIN prints p USING (id) WHERE present AND h IS NOT NULL AND type = 'video')
    SELECT a.id AS a, b.id AS b, bit_count(xor(a.h, b.h))::INT AS distance FROM x a JOIN x b ON a.id < b.id
    WHERE bit_count(xor(a.h, b.h)) <= 10 AND abs(a.duration - b.duration) <= greatest(1.0, 0.02 * greatest(a.duration, b.duration))""",
)
def _(spark, sf_dir):
    rows = catalog.media(spark, sf_dir).where("present and type = 'video'")
    return duplicates.video_pairs(rows.join(catalog.fingerprints(spark, sf_dir), "id").select("id", F.col("phash").alias("h"), "duration"), 10)


@_query("times_shown", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M') AS shown FROM events")
def _(spark, sf_dir):
    rows = catalog.table(spark, sf_dir, "events")
    return rows.select("event_id", text.shown_time(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("shown"))


# -- an import over all that is stored ---------------------------------------------------------------

_LOGGED = catalog_queries._OUTCOMES.replace("WHEN 4 THEN 'absent' WHEN 0 THEN 'unchanged'\n           ELSE CASE", "WHEN 0 THEN 'unchanged'\n           ELSE CASE WHEN id % 3 = 0 THEN 'known' WHEN id % 7 = 4 THEN 'absent'")
_IMPORT = catalog_queries._IMPORT.replace(catalog_queries._OUTCOMES, _LOGGED).replace(
    "r.updated_at + 1 AS updated_at, r.deleted", "r.updated_at + (r.seq % 4 = 0)::INT AS updated_at, r.deleted <> (r.seq % 2 = 1) AS deleted"
)


@_query(
    "sync_import_stored",
    f"""WITH {_IMPORT}, {catalog_queries._found_in("moved")},
    before AS (SELECT upper(rel_path) AS path, 'From Afar' AS tag, {catalog_queries.NOW} AS updated_at, false AS deleted FROM media WHERE id % 4 = 1
               UNION ALL SELECT path, upper(tag), updated_at, NOT deleted FROM incoming WHERE seq % 10 = 2),
    waiting AS (SELECT path, tag, updated_at, deleted, -1 AS place FROM before UNION ALL SELECT path, tag, updated_at, deleted, seq FROM found WHERE media_id IS NULL),
    held AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {fold("path")}, {fold("tag")} ORDER BY updated_at DESC, place) AS turn FROM waiting) WHERE turn = 1),
    met AS (SELECT h.*, m.id FROM held h LEFT JOIN moved m ON m.present AND {fold("m.rel_path")} = {fold("h.path")}),
    every AS (SELECT media_id, tag_key, updated_at, deleted, -1 AS place FROM links UNION ALL SELECT media_id, {fold("tag")}, updated_at, deleted, seq FROM found WHERE media_id IS NOT NULL
              UNION ALL SELECT id, {fold("tag")}, updated_at, deleted, 4611686018427387904 FROM met WHERE id IS NOT NULL),
    r AS (SELECT *, row_number() OVER (PARTITION BY media_id, tag_key ORDER BY updated_at DESC, place) AS turn FROM every)
    SELECT 'links' AS store, media_id::VARCHAR AS key, tag_key AS tag, updated_at, deleted FROM r WHERE turn = 1
    UNION ALL SELECT 'held', path, tag, updated_at, deleted FROM met WHERE id IS NULL
    UNION ALL SELECT 'moves', outcome, NULL, NULL, NULL FROM outcomes WHERE outcome IN ('known', 'applied')""",
)
def _(spark, sf_dir):
    """Links, held records and a log are there: a third of the moves is in the log, records are as new as links or held records and say the opposite."""
    rows, steps = catalog.media(spark, sf_dir), catalog_queries._file_moves(spark, sf_dir)
    incoming = catalog_queries._incoming(spark, sf_dir).withColumns(
        {"updated_at": F.col("updated_at") + F.when(F.col("seq") % 4 == 0, 1).otherwise(0), "deleted": F.col("deleted") != (F.col("seq") % 2 == 1)}
    )
    held = rows.where("id % 4 = 1").select(F.upper("rel_path").alias("path"), F.lit("From Afar").alias("tag"), F.lit(catalog_queries.NOW).alias("updated_at"), F.lit(False).alias("deleted"))
    held = held.unionByName(incoming.where("seq % 10 = 2").select("path", F.upper("tag").alias("tag"), "updated_at", (~F.col("deleted")).alias("deleted")))
    log = steps.where("seq.id % 3 = 0").select("from_path", "to_path", "size", "moved_at")
    after, _, outcomes = sync.imported_with_outcomes(sync.Library(rows, catalog.links(spark, sf_dir), held, log), incoming, steps)
    links = after.links.select(F.lit("links").alias("store"), F.col("media_id").cast("string").alias("key"), F.col("tag_key").alias("tag"), "updated_at", "deleted")
    left = after.pending.select(F.lit("held").alias("store"), F.col("path").alias("key"), "tag", "updated_at", "deleted")
    judged = outcomes.where("outcome in ('known', 'applied')").select(F.lit("moves").alias("store"), F.col("outcome").alias("key"), F.lit(None).cast("string").alias("tag"), F.lit(None).cast("double").alias("updated_at"), F.lit(None).cast("boolean").alias("deleted"))
    return links.unionByName(left).unionByName(judged)


@_query(
    "sync_attach_stored",
    f"""WITH {MEDIA}, {_STORED}, held AS (SELECT upper(m.rel_path) AS path, m.id, m.present, r.tag, r.updated_at + CASE r.media_id % 3 WHEN 0 THEN 1.0 WHEN 1 THEN -1.0 ELSE 0.0 END AS updated_at, NOT r.deleted AS deleted
              FROM stored r JOIN media m ON m.id = r.media_id WHERE r.media_id % 2 = 0),
    every AS (SELECT media_id, tag, updated_at, deleted, 0 AS late FROM stored UNION ALL SELECT id, tag, updated_at, deleted, 1 FROM held WHERE present),
    r AS (SELECT *, row_number() OVER (PARTITION BY media_id, tag ORDER BY updated_at DESC, late) AS turn FROM every)
    SELECT 'links' AS store, media_id::VARCHAR AS key, tag, updated_at, deleted FROM r WHERE turn = 1 UNION ALL SELECT 'held', path, tag, updated_at, deleted FROM held WHERE NOT present""",
)
def _(spark, sf_dir):
    """Held records that are newer, older and as new as the links that are there, all of which say the opposite."""
    rows, stored = catalog.media(spark, sf_dir), _stored_links(spark, sf_dir)
    shift = F.when(F.col("media_id") % 3 == 0, 1.0).when(F.col("media_id") % 3 == 1, -1.0).otherwise(0.0)
    own = rows.select(F.col("id").alias("media_id"), F.upper("rel_path").alias("path"))
    held = stored.where("media_id % 2 = 0").join(own, "media_id").select("path", F.col("tag_key").alias("tag"), (F.col("updated_at") + shift).alias("updated_at"), (~F.col("deleted")).alias("deleted"))
    links, left = sync.attached(stored, held, rows)
    shown = links.select(F.lit("links").alias("store"), F.col("media_id").cast("string").alias("key"), F.col("tag_key").alias("tag"), "updated_at", "deleted")
    return shown.unionByName(left.select(F.lit("held").alias("store"), F.col("path").alias("key"), "tag", "updated_at", "deleted"))
