"""The catalog queries by name, with the DuckDB SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediaquarry.functions import text
from mediaquarry.operators import duplicates, folders, moves, path_tags, rename, scan, search, sync, tags
from mediaquarry.plans import catalog
from mediaquarry.plans.catalog import ALL_RECORDS, ANCESTORS, LINKS, MEDIA, PHASH, RECORDS, SIGNED, fold
from mediaquarry.storage import materialise

NOW = 1800000000.0

QUERIES: dict = {}
ORACLES: dict = {}


def _query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return add


# -- search ------------------------------------------------------------------------------------------

_LIVE = "EXISTS (SELECT 1 FROM links l WHERE l.media_id = m.id AND NOT l.deleted AND l.tag_key IN ({}))"


def _search(name: str, line: str, where: str, columns: tuple[str, ...] = ("id", "rel_path", "type", "mtime")) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = search.search(catalog.media(spark, sf_dir), catalog.links(spark, sf_dir), search.parse_query(line))
        return found.select(*columns)

    QUERIES[name] = run
    ORACLES[name] = f"WITH {MEDIA}, {LINKS} SELECT {', '.join(columns)} FROM media m WHERE present AND {where}"


_search("search_require_all", "#Click #quality", f"{_LIVE.format(chr(39) + 'click' + chr(39))} AND {_LIVE.format(chr(39) + 'quality' + chr(39))}")
_search("search_or_group", "#click|VIEW", _LIVE.format("'click', 'view'"))
_search("search_exclude", "-#click -#error", f"NOT {_LIVE.format(chr(39) + 'click' + chr(39) + ', ' + chr(39) + 'error' + chr(39))}")
_search("search_text", "DOC_1 jp", f"contains({fold('rel_path')}, 'doc_1') AND contains({fold('rel_path')}, 'jp')")
_search("search_type", "type:video", "type = 'video'")
_search("search_album_prefix", "album:SRC1", f"({fold('album')} = 'src1' OR starts_with({fold('album')}, 'src1/'))")
_search("search_date_range", "after:2024-01-05 before:2024-01-20", "mtime >= epoch(TIMESTAMP '2024-01-05') AND mtime < epoch(TIMESTAMP '2024-01-21')")
_search("search_combined", "#click -#error type:photo", f"{_LIVE.format(chr(39) + 'click' + chr(39))} AND NOT {_LIVE.format(chr(39) + 'error' + chr(39))} AND type = 'photo'")


def _wild_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third path has the characters that are wildcards elsewhere."""
    rows = catalog.media(spark, sf_dir)
    return rows.withColumn("rel_path", F.concat("rel_path", F.when(F.col("id") % 3 == 0, "_100%").when(F.col("id") % 3 == 1, "x1000").otherwise("")))


@_query("search_wildcards", f"WITH {MEDIA} SELECT id FROM media WHERE present AND id % 3 = 0")
def _(spark, sf_dir):
    return search.search(_wild_media(spark, sf_dir), catalog.links(spark, sf_dir), search.parse_query("_100%")).select("id")


@_query("search_bound", f"WITH {MEDIA} SELECT id, rel_path FROM media WHERE present AND type = 'photo' AND (album = 'src2' OR starts_with(album, 'src2/'))")
def _(spark, sf_dir):
    """A typed type wins over the one chosen elsewhere, a chosen folder counts where none was typed."""
    query = search.bind(search.parse_query("type:photo"), type="video", album="src2")
    return search.search(catalog.media(spark, sf_dir), catalog.links(spark, sf_dir), query).select("id", "rel_path")


@_query("search_scope", f"WITH {MEDIA} SELECT 'folder' AS scope, id FROM media WHERE present AND album = 'src2' UNION ALL SELECT 'library', id FROM media WHERE present AND type = 'video'")
def _(spark, sf_dir):
    """Without a query the current folder's own media, with one the whole library's."""
    rows, held = catalog.media(spark, sf_dir), catalog.links(spark, sf_dir)
    here, every = (search.in_scope(rows, held, search.parse_query(line), "SRC2") for line in ("", "type:video"))
    return here.select(F.lit("folder").alias("scope"), "id").unionByName(every.select(F.lit("library").alias("scope"), "id"))


@_query("search_unsorted", f"WITH {MEDIA}, {LINKS} SELECT id, rel_path FROM media m WHERE present AND album = '' AND NOT EXISTS (SELECT 1 FROM links l WHERE l.media_id = m.id AND NOT l.deleted)")
def _(spark, sf_dir):
    return search.list_media(catalog.media(spark, sf_dir), catalog.links(spark, sf_dir), loose=True).select("id", "rel_path")


@_query(
    "search_tag_arrays",
    f"WITH {MEDIA}, {LINKS}, t AS (SELECT media_id, list(tag_key) AS ks FROM links WHERE NOT deleted GROUP BY media_id) "
    "SELECT id, rel_path FROM media m LEFT JOIN t ON t.media_id = m.id WHERE present AND (list_contains(ks, 'click') OR list_contains(ks, 'view')) AND NOT coalesce(list_contains(ks, 'toxic'), false)",
)
def _(spark, sf_dir):
    rows = catalog.media(spark, sf_dir).join(tags.tags_of(catalog.links(spark, sf_dir)).withColumnRenamed("media_id", "id"), "id", "left")
    rows = rows.withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))
    return search.match_tag_arrays(rows, search.parse_query("#click|view -#toxic")).select("id", "rel_path")


def _report(sort: str, order: str) -> None:
    """A report of the first 200 in an order, as a preview shows them, with their places."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        top = search.ordered(catalog.media(spark, sf_dir).where("present"), sort).limit(200)
        rows = top.agg(F.collect_list(F.struct("id", "mtime", "filename")).alias("x"))
        return rows.select(F.posexplode("x").alias("pos", "x")).select("x.id", "x.mtime", "x.filename", (F.col("pos") + 1).cast("long").alias("place"))

    QUERIES[f"list_{sort}"] = run
    ORACLES[f"list_{sort}"] = f"WITH {MEDIA} SELECT id, mtime, filename, row_number() OVER (ORDER BY {order}) AS place FROM media WHERE present ORDER BY place LIMIT 200"


_report("newest", "mtime DESC, id DESC")
_report("oldest", "mtime, id")
_report("name", "lower(filename), id")


# -- tags --------------------------------------------------------------------------------------------


@_query("lww_resolve", f"WITH {LINKS} SELECT media_id, tag_key, tag, updated_at, deleted FROM links")
def _(spark, sf_dir):
    return catalog.links(spark, sf_dir)


@_query(
    "lww_change_counts",
    f"""WITH {RECORDS}, m AS (SELECT *, max(updated_at) OVER w AS newest FROM records WINDOW w AS (PARTITION BY media_id, tag ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    a AS (SELECT *, newest IS NULL OR updated_at > newest AS accepted FROM m),
    b AS (SELECT *, lag(deleted) OVER (PARTITION BY media_id, tag ORDER BY seq) AS last FROM a WHERE accepted)
    SELECT tag AS tag_key, (SELECT count(*) FROM a x WHERE x.tag = b.tag) AS records, count(*) AS accepted, count(*) FILTER (coalesce(last, true) <> deleted) AS changed FROM b GROUP BY tag""",
)
def _(spark, sf_dir):
    marked = tags.accepted_records(catalog.records(spark, sf_dir))
    return marked.groupBy("tag_key").agg(F.count(F.lit(1)).alias("records"), F.count_if("accepted").alias("accepted"), F.count_if("changed").alias("changed"))


@_query("tag_counts", f"WITH {LINKS} SELECT tag_key, min(tag) AS tag, count(*) AS n FROM links WHERE NOT deleted GROUP BY tag_key")
def _(spark, sf_dir):
    return tags.tag_counts(catalog.links(spark, sf_dir))


@_query("tag_counts_present", f"WITH {MEDIA}, {LINKS} SELECT tag_key, min(tag) AS tag, count(*) AS n FROM links WHERE NOT deleted AND media_id IN (SELECT id FROM media WHERE present) GROUP BY tag_key")
def _(spark, sf_dir):
    return tags.present_tag_counts(catalog.links(spark, sf_dir), catalog.media(spark, sf_dir))


@_query("selection_tag_counts", f"WITH {MEDIA}, {LINKS} SELECT tag_key, min(tag) AS tag, count(*) AS n FROM links WHERE NOT deleted AND media_id IN (SELECT id FROM media WHERE type = 'video') GROUP BY tag_key")
def _(spark, sf_dir):
    chosen = catalog.media(spark, sf_dir).where("type = 'video'").select(F.col("id").alias("media_id"))
    return tags.selection_tag_counts(catalog.links(spark, sf_dir), chosen)


@_query("tags_per_media", f"WITH {LINKS} SELECT media_id, string_agg(tag, ',' ORDER BY tag_key) AS tags FROM links WHERE NOT deleted GROUP BY media_id")
def _(spark, sf_dir):
    return tags.tags_of(catalog.links(spark, sf_dir)).select("media_id", F.array_join("tags", ",").alias("tags"))


_RENAMED = f"""WITH {LINKS}, new AS (
    SELECT media_id, 'view' AS tag_key, 'view' AS tag, {NOW} AS updated_at, false AS deleted FROM links WHERE tag_key = 'click' AND NOT deleted
    UNION ALL SELECT media_id, tag_key, tag, {NOW}, true FROM links WHERE tag_key = 'click' AND NOT deleted)
    SELECT media_id, tag_key, tag, updated_at, deleted FROM new
    UNION ALL SELECT media_id, tag_key, tag, updated_at, deleted FROM links l WHERE NOT EXISTS (SELECT 1 FROM new n WHERE n.media_id = l.media_id AND n.tag_key = l.tag_key)"""


@_query("tag_rename_merge", _RENAMED)
def _(spark, sf_dir):
    return tags.rename_tag(catalog.links(spark, sf_dir), "Click", "view", NOW)


@_query("tag_delete", f"WITH {LINKS} SELECT media_id, tag_key, tag, CASE WHEN tag_key = 'click' AND NOT deleted THEN {NOW} ELSE updated_at END AS updated_at, deleted OR tag_key = 'click' AS deleted FROM links")
def _(spark, sf_dir):
    held = catalog.links(spark, sf_dir)
    return tags.apply(held, tags.delete_tag(held, "CLICK", NOW))


@_query(
    "tag_add",
    f"""WITH {MEDIA}, {LINKS}, new AS (SELECT id AS media_id, unnest(['new york', 'click']) AS tag_key, unnest(['New York', 'click']) AS tag FROM media WHERE type = 'video')
    SELECT media_id, tag_key, tag, {NOW} AS updated_at, false AS deleted FROM new
    UNION ALL SELECT media_id, tag_key, tag, updated_at, deleted FROM links l WHERE NOT EXISTS (SELECT 1 FROM new n WHERE n.media_id = l.media_id AND n.tag_key = l.tag_key)""",
)
def _(spark, sf_dir):
    held = catalog.links(spark, sf_dir)
    chosen = catalog.media(spark, sf_dir).where("type = 'video'").select(F.col("id").alias("media_id"))
    return tags.apply(held, tags.add_tags(held, chosen, [" New  York ", "Click"], NOW))


@_query("tag_remove", f"WITH {MEDIA}, {LINKS} SELECT media_id, tag_key, tag, {NOW} AS updated_at, true AS deleted FROM links WHERE tag_key = 'view' AND NOT deleted AND media_id IN (SELECT id FROM media WHERE type = 'photo')")
def _(spark, sf_dir):
    chosen = catalog.media(spark, sf_dir).where("type = 'photo'").select(F.col("id").alias("media_id"))
    return tags.remove_tag(catalog.links(spark, sf_dir), chosen, "view", NOW)


@_query("tag_names_parsed", "SELECT conv_id, turn, string_agg(n, '|' ORDER BY i) AS names FROM (SELECT conv_id, turn, n, i FROM (SELECT conv_id, turn, n, i, row_number() OVER (PARTITION BY conv_id, turn, lower(n) ORDER BY i) AS r FROM (SELECT conv_id, turn, unnest(list_transform(string_split(text, ','), lambda s: trim(regexp_replace(s, '\\s+', ' ', 'g')))) AS n, unnest(range(len(string_split(text, ',')))) AS i FROM conversations) WHERE n <> '') WHERE r = 1) GROUP BY conv_id, turn")
def _(spark, sf_dir):
    rows = catalog.table(spark, sf_dir, "conversations").select("conv_id", "turn", text.parse_names(F.col("text")).alias("names"))
    return rows.where(F.size("names") > 0).select("conv_id", "turn", F.array_join("names", "|").alias("names"))


# -- folders -----------------------------------------------------------------------------------------

_FOLDERS = f"folders AS (SELECT DISTINCT root, unnest({ANCESTORS}) AS rel_path FROM media WHERE album <> '')"


@_query(
    "album_counts",
    f"""WITH {MEDIA}, {_FOLDERS} SELECT f.root, f.rel_path, count(m.id) AS n_media, count(m.id) FILTER (m.type = 'photo') AS n_photos,
    count(m.id) FILTER (m.type = 'video') AS n_videos, (len(string_split(f.rel_path, '/')) - 1)::INT AS depth
    FROM folders f LEFT JOIN media m ON m.present AND m.root = f.root AND (m.album = f.rel_path OR starts_with(m.album, f.rel_path || '/')) GROUP BY f.root, f.rel_path""",
)
def _(spark, sf_dir):
    rows = catalog.media(spark, sf_dir)
    return folders.folder_counts(folders.folder_table(rows), rows)


@_query("album_children", f"WITH {MEDIA}, {_FOLDERS} SELECT root, rel_path FROM folders WHERE starts_with(rel_path, 'src1/') AND NOT contains(substr(rel_path, 6), '/')")
def _(spark, sf_dir):
    return search.children(folders.folder_table(catalog.media(spark, sf_dir)), "SRC1")


@_query(
    "album_relocate",
    f"WITH {MEDIA} SELECT id, CASE WHEN i THEN 'Archive/One' || substr(rel_path, 5) ELSE rel_path END AS rel_path, CASE WHEN i THEN 'Archive/One' || substr(album, 5) ELSE album END AS album "
    "FROM (SELECT *, album = 'src1' OR starts_with(album, 'src1/') AS i FROM media)",
)
def _(spark, sf_dir):
    return folders.relocated(catalog.media(spark, sf_dir), catalog.ROOT, "src1", "Archive/One").select("id", "rel_path", "album")


@_query("album_relocate_moves", f"WITH {MEDIA} SELECT rel_path AS from_path, 'Archive/One' || substr(rel_path, 5) AS to_path, size, {NOW} AS moved_at FROM media WHERE present AND (album = 'src1' OR starts_with(album, 'src1/'))")
def _(spark, sf_dir):
    return folders.relocation_moves(catalog.media(spark, sf_dir), catalog.ROOT, "src1", "Archive/One", NOW)


@_query("album_membership", f"WITH {MEDIA} SELECT id, (album = 'src2' OR starts_with(album, 'src2/')) AS inside, starts_with(album, 'src2/') AS below FROM media")
def _(spark, sf_dir):
    return catalog.media(spark, sf_dir).select("id", text.in_folder(F.col("album"), "Src2").alias("inside"), text.holds_folder(F.col("album"), "Src2").alias("below"))


@_query(
    "album_move_files",
    f"""WITH {MEDIA}, w AS (SELECT * FROM media WHERE type = 'video'), n AS (SELECT *, 'src3/' || filename AS new_path FROM w)
    SELECT n.id, n.rel_path, n.new_path, CASE WHEN NOT n.present THEN 'file is missing' WHEN n.album = 'src3' THEN 'already there'
      WHEN o.id IS NOT NULL AND o.id <> n.id AND o.present THEN 'the name is taken there' WHEN o.id IS NOT NULL AND o.id <> n.id THEN 'an older record has that path' ELSE 'moved' END AS outcome
    FROM n LEFT JOIN media o ON o.rel_path = n.new_path""",
)
def _(spark, sf_dir):
    rows = catalog.media(spark, sf_dir)
    return folders.move_to_folder(rows, rows.where("type = 'video'"), catalog.ROOT, "src3")


@_query(
    "album_deletable",
    f"""WITH {MEDIA}, {_FOLDERS}, own AS (SELECT * FROM media WHERE type = 'video' AND id % 4 = 0), every AS (SELECT rel_path FROM folders UNION SELECT 'empty' UNION SELECT 'empty/in')
    SELECT '{catalog.ROOT}' AS root, rel_path FROM every e WHERE NOT EXISTS (SELECT 1 FROM own WHERE album = e.rel_path OR starts_with(album, e.rel_path || '/'))
      AND NOT EXISTS (SELECT 1 FROM every f WHERE starts_with(f.rel_path, e.rel_path || '/'))""",
)
def _(spark, sf_dir):
    """All folders of a library that has kept every fourth video only, and two new ones."""
    rows = catalog.media(spark, sf_dir)
    extra = spark.range(1).select(F.lit(catalog.ROOT).alias("root"), F.explode(F.array(F.lit("empty"), F.lit("empty/in"))).alias("rel_path"))
    return folders.deletable(folders.folder_table(rows).unionByName(extra), rows.where("type = 'video' and id % 4 = 0"))


@_query("album_list", f"WITH {MEDIA}, {_FOLDERS}, n AS (SELECT f.root, f.rel_path, count(m.id) AS n_media FROM folders f LEFT JOIN media m ON m.present AND (m.album = f.rel_path OR starts_with(m.album, f.rel_path || '/')) GROUP BY ALL) SELECT *, row_number() OVER (ORDER BY lower(rel_path)) AS place FROM n ORDER BY place LIMIT 200")
def _(spark, sf_dir):
    """A report of the first 200 folders by path."""
    rows = catalog.media(spark, sf_dir)
    top = folders.listed(folders.folder_table(rows), rows).limit(200).agg(F.collect_list(F.struct("root", "rel_path", "n_media")).alias("x"))
    return top.select(F.posexplode("x").alias("pos", "x")).select("x.root", "x.rel_path", "x.n_media", (F.col("pos") + 1).cast("long").alias("place"))


@_query(
    "album_names_checked",
    f"""WITH {MEDIA}, n AS (SELECT id, CASE id % 8 WHEN 0 THEN '' WHEN 1 THEN '.hid/x' WHEN 2 THEN 'a:b' WHEN 3 THEN 'end.' WHEN 4 THEN 'Con.x/y' WHEN 5 THEN repeat('l', 121) WHEN 6 THEN ' a  b / c' ELSE source END AS path
        FROM media JOIN documents ON id = doc_id)
    SELECT id, CASE id % 8 WHEN 0 THEN 'album name cannot be empty' WHEN 1 THEN 'album name cannot start with a dot' WHEN 2 THEN 'album name cannot contain reserved or control characters'
      WHEN 3 THEN 'album name cannot end with a dot' WHEN 4 THEN 'album name cannot be a reserved name' WHEN 5 THEN 'album name is too long' END AS problem FROM n""",
)
def _(spark, sf_dir):
    docs = catalog.table(spark, sf_dir, "documents")
    names = F.array(*map(F.lit, ["", ".hid/x", "a:b", "end.", "Con.x/y", "l" * 121, " a  b / c"]))
    path = F.coalesce(F.get(names, (F.col("doc_id") % 8).cast("int")), F.col("source"))
    return docs.select(F.col("doc_id").alias("id"), text.album_problem(path).alias("problem"))


@_query("album_upgrade", f"WITH {MEDIA} SELECT id, album FROM media")
def _(spark, sf_dir):
    return folders.upgraded(catalog.media(spark, sf_dir).drop("album")).select("id", "album")


@_query("library_removed", f"WITH {MEDIA} SELECT id, present AND id % 2 = 1 AS present FROM media")
def _(spark, sf_dir):
    """One of two libraries is removed."""
    rows = catalog.media(spark, sf_dir).withColumn("root", F.when(F.col("id") % 2 == 0, "/A").otherwise("/B"))
    return folders.without_root(rows, "/A").select("id", "present")


# -- paths -------------------------------------------------------------------------------------------


@_query(
    "path_functions",
    r"""WITH p AS (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') AS p FROM pages)
    SELECT page_id, CASE WHEN contains(p, '/') THEN regexp_replace(p, '/[^/]*$', '') ELSE '' END AS dir, regexp_extract(p, '[^/]*$') AS base,
           (len(string_split(p, '/')) - 1)::INT AS depth, regexp_extract(regexp_extract(p, '[^/]*$'), '^\.*[^.].*(\.[^.]*)$', 1) AS ext, sha1(p) AS cache_name FROM p""",
)
def _(spark, sf_dir):
    path = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), "[?#].*$", "")
    rows = catalog.table(spark, sf_dir, "pages").select("page_id", path.alias("p"))
    p = F.col("p")
    return rows.select("page_id", text.dirname(p).alias("dir"), text.basename(p).alias("base"), text.depth(p).alias("depth"), text.extension(p).alias("ext"), F.sha1(p.cast("binary")).alias("cache_name"))


@_query(
    "path_safety",
    r"""WITH p AS (SELECT page_id, 'url' AS kind, url AS p FROM pages UNION ALL SELECT page_id, 'rest', regexp_replace(url, '^[a-z]+://', '') FROM pages)
    SELECT page_id, kind, length(p) BETWEEN 1 AND 1024 AND NOT contains(p, chr(92)) AND NOT contains(p, ':') AND NOT starts_with(p, '/')
      AND len(list_filter(string_split(p, '/'), lambda x: x IN ('', '.', '..'))) = 0 AS safe FROM p""",
)
def _(spark, sf_dir):
    rows = catalog.table(spark, sf_dir, "pages")
    both = rows.select("page_id", F.lit("url").alias("kind"), F.col("url").alias("p")).unionByName(
        rows.select("page_id", F.lit("rest").alias("kind"), F.regexp_replace("url", "^[a-z]+://", "").alias("p"))
    )
    return both.select("page_id", "kind", text.safe_path(F.col("p")).alias("safe"))


@_query(
    "size_labels",
    """SELECT doc_id, CASE WHEN s < 1024 THEN format('{} B', s) WHEN s < 1048576 THEN printf('%.1f KB', s / 1024.0) WHEN s < 1073741824 THEN printf('%.1f MB', s / 1048576.0)
    ELSE printf('%.1f GB', s / 1073741824.0) END AS label FROM (SELECT doc_id, n_chars * 1000 + 7 AS s FROM documents)""",
)
def _(spark, sf_dir):
    return catalog.table(spark, sf_dir, "documents").select("doc_id", text.human_size(F.col("n_chars") * 1000 + 7).alias("label"))


@_query(
    "media_kinds",
    r"""WITH n AS (SELECT page_id, regexp_replace(url, '[?#].*$', '') || CASE page_id % 9 WHEN 0 THEN '.JPG' WHEN 1 THEN '.x.mp4' WHEN 2 THEN '.txt' WHEN 3 THEN '.heic' WHEN 4 THEN '' WHEN 5 THEN '.3GP' WHEN 6 THEN '.jpg.bak' WHEN 7 THEN '/.jpg' ELSE '.mKv' END AS name FROM pages),
    e AS (SELECT *, lower(regexp_extract(regexp_extract(name, '[^/]*$'), '^\.*[^.].*(\.[^.]*)$', 1)) AS ext FROM n)
    SELECT page_id, name, CASE WHEN list_contains(['.jpg', '.jpeg', '.png', '.gif', '.webp', '.bmp', '.tif', '.tiff', '.heic', '.heif'], ext) THEN 'photo'
      WHEN list_contains(['.mp4', '.mov', '.mkv', '.avi', '.webm', '.m4v', '.wmv', '.flv', '.mpg', '.mpeg', '.3gp'], ext) THEN 'video' END AS kind FROM e""",
)
def _(spark, sf_dir):
    ends = F.array(*map(F.lit, [".JPG", ".x.mp4", ".txt", ".heic", "", ".3GP", ".jpg.bak", "/.jpg", ".mKv"]))
    name = F.concat(F.regexp_replace("url", "[?#].*$", ""), F.get(ends, (F.col("page_id") % 9).cast("int")))
    return catalog.table(spark, sf_dir, "pages").select("page_id", name.alias("name")).withColumn("kind", text.media_type(F.col("name")))


@_query("luma", "SELECT vec_id, (77 * (vec_id % 256) + 150 * (vec_id * 7 % 256) + 29 * (vec_id * 13 % 256))::BIGINT >> 8 AS grey FROM embeddings")
def _(spark, sf_dir):
    i = F.col("vec_id")
    return catalog.table(spark, sf_dir, "embeddings").select("vec_id", text.luma(i % 256, i * 7 % 256, i * 13 % 256).alias("grey"))


@_query(
    "gray_hash",
    "SELECT vec_id, CASE WHEN bit_count(v) BETWEEN 6 AND 58 THEN CASE WHEN v >= 9223372036854775808 THEN (v::HUGEINT - 18446744073709551616)::BIGINT ELSE v::BIGINT END END AS hash FROM (SELECT vec_id, ("
    + " + ".join(f"(CASE WHEN floor(1000 * embedding[{(y * 9 + x) % 64 + 1}]::DOUBLE) > floor(1000 * embedding[{(y * 9 + x + 1) % 64 + 1}]::DOUBLE) THEN {1 << (63 - (y * 8 + x))}::HUGEINT ELSE 0 END)" for y in range(8) for x in range(8))
    + ")::UBIGINT AS v FROM embeddings)",
)
def _(spark, sf_dir):
    cells = F.transform(F.sequence(F.lit(0), F.lit(71)), lambda i: F.floor(1000 * F.get("embedding", i % 64).cast("double")).cast("int"))
    return catalog.table(spark, sf_dir, "embeddings").select("vec_id", text.difference_hash(cells).alias("hash"))


# -- duplicates --------------------------------------------------------------------------------------


def _with_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Media with fresh content hashes for all but each 13th and fresh similarity hashes for all but each 17th."""
    rows = catalog.media(spark, sf_dir).join(catalog.contents(spark, sf_dir), "id").join(catalog.fingerprints(spark, sf_dir), "id", "left")
    size, mtime = F.col("size"), F.col("mtime")
    return rows.withColumns(
        {
            "sha_size": size, "sha_mtime": F.when(F.col("id") % 13 == 0, mtime - 1).otherwise(mtime),
            "sig_size": F.when(F.col("id") % 17 == 0, F.lit(None)).otherwise(size), "sig_mtime": mtime,
        }
    )


_FRESH = f"{MEDIA}, {PHASH}, held AS (SELECT m.*, CASE WHEN m.id % 13 <> 0 THEN m.sha256 END AS sha, CASE WHEN m.id % 17 <> 0 THEN p.h END AS h FROM media m LEFT JOIN prints p USING (id) WHERE present AND size > 0)"


@_query("exact_candidates", f"WITH {MEDIA}, h AS (SELECT * FROM media WHERE present AND size > 0) SELECT id, size FROM h WHERE id % 13 = 0 AND size IN (SELECT size FROM h GROUP BY size HAVING count(*) > 1)")
def _(spark, sf_dir):
    rows = catalog.media(spark, sf_dir)
    rows = rows.withColumns({"sha_size": F.col("size"), "sha_mtime": F.when(F.col("id") % 13 == 0, F.col("mtime") - 1).otherwise(F.col("mtime"))})
    return duplicates.exact_candidates(rows).select("id", "size")


@_query("exact_groups", f"WITH {MEDIA} SELECT min(id) AS group_id, sha256, size, count(*) AS n, min(lower(rel_path)) AS first_path FROM media WHERE present AND size > 0 GROUP BY sha256, size HAVING count(*) > 1")
def _(spark, sf_dir):
    return duplicates.exact_groups(catalog.media(spark, sf_dir).join(catalog.contents(spark, sf_dir), "id"), by_size=True)


@_query("exact_members", f"WITH {MEDIA}, g AS (SELECT sha256, count(*) AS n, min(id) AS group_id FROM media WHERE present AND size > 0 GROUP BY sha256 HAVING count(*) > 1) SELECT id, group_id, n FROM media JOIN g USING (sha256) WHERE present AND size > 0")
def _(spark, sf_dir):
    return duplicates.exact_members(catalog.media(spark, sf_dir).join(catalog.contents(spark, sf_dir), "id")).select("id", "group_id", "n")


@_query(
    "exact_group_order",
    f"WITH {MEDIA}, g AS (SELECT min(id) AS group_id, size, count(*) AS n, min(lower(rel_path)) AS first_path FROM media WHERE present AND size > 0 GROUP BY sha256, size HAVING count(*) > 1) SELECT group_id, n, row_number() OVER (ORDER BY size DESC, first_path) AS place FROM g ORDER BY place LIMIT 100",
)
def _(spark, sf_dir):
    """A report of the 100 first groups: the largest files first."""
    groups = duplicates.exact_groups(catalog.media(spark, sf_dir).join(catalog.contents(spark, sf_dir), "id"), by_size=True)
    return _places(groups.limit(100), "group_id", "n")


def _places(ordered: DataFrame, *columns: str) -> DataFrame:
    """The rows of a short report with their places from 1 on."""
    rows = ordered.agg(F.collect_list(F.struct(*columns)).alias("x")).select(F.posexplode("x").alias("pos", "x"))
    return rows.select(*[f"x.{c}" for c in columns], (F.col("pos") + 1).cast("long").alias("place"))


@_query(
    "exact_stats",
    f"WITH {MEDIA} SELECT count(*) AS files, count(*) FILTER (size <= 0) AS unknown_sizes, count(*) FILTER (size > 0 AND size IN (SELECT size FROM media WHERE present AND size > 0 GROUP BY size HAVING count(*) > 1)) AS hashed FROM media WHERE present",
)
def _(spark, sf_dir):
    return duplicates.exact_stats(catalog.media(spark, sf_dir))


@_query(
    "signature_index",
    f"""WITH {MEDIA} SELECT id, CASE WHEN NOT present OR size <= 0 OR id % 17 <> 0 THEN 5 WHEN id % 4 = 0 THEN NULL ELSE id END AS phash, CASE WHEN present AND size > 0 AND id % 17 = 0 AND id % 3 = 0 THEN 1.5 ELSE duration END AS duration,
    CASE WHEN present AND size > 0 AND id % 17 = 0 OR id % 17 <> 0 THEN size END AS sig_size FROM media""",
)
def _(spark, sf_dir):
    """Stale signatures are measured again; some files can't be read, some have no length."""
    rows = catalog.media(spark, sf_dir)
    rows = rows.withColumns({"phash": F.lit(5).cast("long"), "sig_size": F.when(F.col("id") % 17 != 0, F.col("size")), "sig_mtime": F.col("mtime")})
    measured = duplicates.signature_candidates(rows).select("id", F.when(F.col("id") % 4 != 0, F.col("id")).alias("phash"), F.when(F.col("id") % 3 == 0, 1.5).alias("duration"))
    return duplicates.indexed(rows, measured).select("id", "phash", "duration", "sig_size")


@_query("phash", f"WITH {PHASH} SELECT id, {SIGNED} AS phash FROM prints")
def _(spark, sf_dir):
    return catalog.fingerprints(spark, sf_dir)


def _near(distance: int) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = catalog.media(spark, sf_dir).where("present").join(catalog.fingerprints(spark, sf_dir), "id").select("id", F.col("phash").alias("h"), "type")
        return duplicates.near_pairs(rows, distance)

    QUERIES[f"near_pairs_d{distance}"] = run
    ORACLES[f"near_pairs_d{distance}"] = (
        f"WITH {MEDIA}, {PHASH}, x AS (SELECT m.id, m.type, p.h FROM media m JOIN prints p USING (id) WHERE present AND h IS NOT NULL) "
        f"SELECT a.id AS a, b.id AS b, bit_count(xor(a.h, b.h))::INT AS distance FROM x a JOIN x b ON a.type = b.type AND a.id < b.id WHERE bit_count(xor(a.h, b.h)) <= {distance}"
    )


for _d in (0, 3, 6, 10):
    _near(_d)

_VIDEO_PAIRS = f"""WITH {MEDIA}, {PHASH}, x AS (SELECT m.id, m.duration, p.h FROM media m JOIN prints p USING (id) WHERE present AND h IS NOT NULL AND type = 'video')
    SELECT a.id AS a, b.id AS b, bit_count(xor(a.h, b.h))::INT AS distance FROM x a JOIN x b ON a.id < b.id
    WHERE bit_count(xor(a.h, b.h)) <= 6 AND abs(a.duration - b.duration) <= greatest(1.0, 0.02 * greatest(a.duration, b.duration))"""


@_query("near_video_pairs", _VIDEO_PAIRS)
def _(spark, sf_dir):
    rows = catalog.media(spark, sf_dir).where("present and type = 'video'")
    return duplicates.video_pairs(rows.join(catalog.fingerprints(spark, sf_dir), "id").select("id", F.col("phash").alias("h"), "duration"), 6)


_GROUPS = f"""WITH RECURSIVE {_FRESH},
    near AS (SELECT a.id AS a, b.id AS b FROM held a JOIN held b ON a.type = b.type AND a.id < b.id
             WHERE bit_count(xor(a.h, b.h)) <= 6 AND (a.type = 'photo' OR abs(a.duration - b.duration) <= greatest(1.0, 0.02 * greatest(a.duration, b.duration)))),
    same AS (SELECT a.id AS a, b.id AS b FROM held a JOIN held b ON a.sha = b.sha AND a.id < b.id),
    pairs AS (SELECT a, b FROM near UNION SELECT a, b FROM same),
    edges AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
    reach(id, to_id) AS (SELECT a, a FROM edges UNION SELECT reach.id, b FROM reach JOIN edges ON to_id = a),
    labels AS (SELECT id, min(to_id) AS group_id FROM reach GROUP BY id),
    groups AS (SELECT group_id, count(*) AS n, count(sha) = count(*) AND min(sha) = max(sha) AS exact, string_agg(id::VARCHAR, ',' ORDER BY id) AS ids,
               max(size) AS top_size FROM labels JOIN held USING (id) GROUP BY group_id)"""


def _members(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return duplicates.find_members(_with_hashes(spark, sf_dir), **options)


@_query("dup_components", f"{_GROUPS} SELECT id, group_id FROM labels")
def _(spark, sf_dir):
    return _members(spark, sf_dir).select("id", "group_id")


_KINDS = "SELECT g.group_id, CASE WHEN exact THEN 'exact' ELSE 'similar' END AS kind, g.n, g.top_size, f.first_path FROM groups g JOIN (SELECT group_id, min(lower(rel_path)) AS first_path FROM labels JOIN held USING (id) GROUP BY group_id) f USING (group_id)"


@_query("dup_group_kinds", f"{_GROUPS} {_KINDS}")
def _(spark, sf_dir):
    return duplicates.groups_of(_members(spark, sf_dir)).select("group_id", "kind", "n", "top_size", "first_path")


@_query("dup_group_members", f"{_GROUPS} SELECT group_id, id, row_number() OVER (PARTITION BY group_id ORDER BY size DESC, lower(rel_path), id)::INT AS place FROM labels JOIN held USING (id)")
def _(spark, sf_dir):
    return duplicates.members_in_order(_members(spark, sf_dir)).select("group_id", "id", "place")


@_query(
    "dup_group_order",
    f"{_GROUPS}, t AS (SELECT group_id, min(lower(rel_path)) AS top_path FROM labels JOIN held USING (id) JOIN groups USING (group_id) WHERE size = top_size GROUP BY group_id) "
    "SELECT group_id, CASE WHEN exact THEN 'exact' ELSE 'similar' END AS kind, row_number() OVER (ORDER BY exact DESC, top_size DESC, top_path) AS place FROM groups JOIN t USING (group_id) ORDER BY place LIMIT 100",
)
def _(spark, sf_dir):
    """A report of the 100 first groups: exact ones first, then by the largest file."""
    return _places(duplicates.groups_of(_members(spark, sf_dir)).orderBy(*duplicates.group_order()).limit(100), "group_id", "kind")


_SIMILAR = _GROUPS.replace("pairs AS (SELECT a, b FROM near UNION SELECT a, b FROM same)", "pairs AS (SELECT a, b FROM near)")


@_query("similar_only_groups", f"{_SIMILAR}, f AS (SELECT group_id, n, min(lower(rel_path)) AS first_path FROM labels JOIN held USING (id) JOIN groups USING (group_id) GROUP BY ALL) SELECT group_id, n, row_number() OVER (ORDER BY first_path) AS place FROM f ORDER BY place LIMIT 100")
def _(spark, sf_dir):
    """A report of the first 100 groups of similar files by path; equal contents don't link."""
    found = duplicates.groups_of(_members(spark, sf_dir, exact=False))
    return _places(found.orderBy(*duplicates.by_first_path()).limit(100), "group_id", "n")


@_query("dup_ignore", f"{_GROUPS} SELECT group_id, n FROM groups WHERE n <> 2")
def _(spark, sf_dir):
    """Groups after all pairs have been put on the list of ignored groups."""
    members = materialise(_members(spark, sf_dir), "members")
    pairs = duplicates.groups_of(members).where("n = 2").select("sig")
    return duplicates.groups_of(members, ignored=pairs).select("group_id", "n")


@_query("dup_summary", f"{_GROUPS} SELECT CASE WHEN exact THEN 'exact' ELSE 'similar' END AS kind, count(*) AS groups, sum(n)::BIGINT AS files, sum(n - 1)::BIGINT AS extra_files FROM groups GROUP BY ALL")
def _(spark, sf_dir):
    return duplicates.summary(duplicates.groups_of(_members(spark, sf_dir)))


@_query(
    "dup_keep_one",
    f"""WITH {MEDIA}, {LINKS}, held AS (SELECT * FROM media WHERE present AND size > 0), g AS (SELECT id, min(id) OVER (PARTITION BY sha256) AS keep_id FROM held)
    SELECT DISTINCT keep_id AS media_id, tag_key, {NOW} AS updated_at, false AS deleted FROM g JOIN links l ON l.media_id = g.id WHERE g.id <> keep_id AND NOT l.deleted""",
)
def _(spark, sf_dir):
    rows = catalog.media(spark, sf_dir).join(catalog.contents(spark, sf_dir), "id")
    choices = duplicates.exact_members(rows).select(F.col("group_id").alias("keep_id"), F.col("id").alias("remove_id"), F.lit("exact").alias("kind"))
    return duplicates.kept_one(catalog.links(spark, sf_dir), rows, choices, NOW)[0].select("media_id", "tag_key", "updated_at", "deleted")


_CHOICES = f"""{MEDIA}, g AS (SELECT id, sha256, min(id) OVER (PARTITION BY sha256) AS first FROM media),
    c AS (SELECT first AS keep_id, id AS remove_id, 'exact' AS kind FROM g UNION ALL SELECT id, id + 1, CASE WHEN id % 2 = 0 THEN 'exact' ELSE 'similar' END FROM media),
    o AS (SELECT keep_id, remove_id, kind, CASE WHEN NOT k.present THEN 'the file to keep is missing' WHEN NOT r.present THEN 'file not found'
            WHEN kind = 'exact' AND r.sha256 <> k.sha256 THEN 'its content is no longer that of the kept file' ELSE 'removed' END AS outcome
          FROM c JOIN media r ON r.id = remove_id JOIN media k ON k.id = keep_id WHERE keep_id <> remove_id)"""


@_query("dup_keep_outcomes", f"WITH {_CHOICES} SELECT keep_id, remove_id, kind, outcome FROM o")
def _(spark, sf_dir):
    """Equal files with absent ones among them, and each file with the one after it."""
    rows = catalog.media(spark, sf_dir).join(catalog.contents(spark, sf_dir), "id")
    first = rows.groupBy("sha256").agg(F.min("id").alias("keep_id"))
    equal = rows.join(first, "sha256").select("keep_id", F.col("id").alias("remove_id"), F.lit("exact").alias("kind"))
    beside = rows.select(F.col("id").alias("keep_id"), (F.col("id") + 1).alias("remove_id"), F.when(F.col("id") % 2 == 0, "exact").otherwise("similar").alias("kind"))
    return duplicates.keep_outcomes(rows, equal.unionByName(beside)).select("keep_id", "remove_id", "kind", "outcome")


@_query("dup_dropped", f"WITH {_CHOICES} SELECT DISTINCT remove_id AS id FROM o WHERE outcome = 'removed' AND kind = 'exact'")
def _(spark, sf_dir):
    rows = catalog.media(spark, sf_dir).join(catalog.contents(spark, sf_dir), "id")
    first = rows.groupBy("sha256").agg(F.min("id").alias("keep_id"))
    equal = rows.join(first, "sha256").select("keep_id", F.col("id").alias("remove_id"), F.lit("exact").alias("kind"))
    beside = rows.where("id % 2 = 0").select(F.col("id").alias("keep_id"), (F.col("id") + 1).alias("remove_id"), F.lit("exact").alias("kind"))
    return duplicates.kept_one(catalog.links(spark, sf_dir), rows, equal.unionByName(beside), NOW)[1]


# -- sync --------------------------------------------------------------------------------------------


def _incoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records by path: most as stored, some under another folder, some of unknown files, some of another size."""
    rows = catalog.media(spark, sf_dir).select("id", "rel_path", "filename", "size")
    records = catalog.records(spark, sf_dir).join(rows, F.col("media_id") == F.col("id"))
    k = F.col("seq") % 5
    path = F.when(k == 1, F.concat(F.lit("elsewhere/"), "filename")).when(k == 2, F.concat(F.lit("gone/"), F.col("seq").cast("string"), F.lit(".jpg"))).otherwise(F.upper("rel_path"))
    size = F.when(F.col("seq") % 10 == 1, F.lit(None)).when(F.col("seq") % 15 == 6, F.col("size") + 1).otherwise(F.col("size"))
    return records.select("seq", path.alias("path"), size.alias("size"), "tag", "updated_at", "deleted")


_INCOMING = f"""{MEDIA}, {RECORDS}, incoming AS (
    SELECT r.seq, CASE r.seq % 5 WHEN 1 THEN 'elsewhere/' || m.filename WHEN 2 THEN 'gone/' || r.seq || '.jpg' ELSE upper(m.rel_path) END AS path,
           CASE WHEN r.seq % 10 = 1 THEN NULL WHEN r.seq % 15 = 6 THEN m.size + 1 ELSE m.size END AS size, r.tag, r.updated_at, r.deleted
    FROM records r JOIN media m ON m.id = r.media_id),
matched AS (
    SELECT i.*, CASE WHEN p.id IS NOT NULL THEN CASE WHEN p.present THEN p.id END ELSE
        (SELECT CASE WHEN count(*) = 1 THEN min(c.id) END FROM media c WHERE c.present AND {fold("c.filename")} = {fold("regexp_extract(i.path, '[^/]*$')")} AND (i.size IS NULL OR c.size = i.size)) END AS media_id
    FROM incoming i LEFT JOIN media p ON {fold("p.rel_path")} = {fold("i.path")})"""


@_query("sync_match_fallback", f"WITH {_INCOMING} SELECT seq, media_id FROM matched")
def _(spark, sf_dir):
    return sync.matched(_incoming(spark, sf_dir), catalog.media(spark, sf_dir)).select("seq", "media_id")


@_query("sync_pending_split", f"WITH {_INCOMING}, h AS (SELECT *, row_number() OVER (PARTITION BY {fold('path')}, {fold('tag')} ORDER BY updated_at DESC, seq) AS turn FROM matched WHERE media_id IS NULL) SELECT path, tag, updated_at, deleted FROM h WHERE turn = 1")
def _(spark, sf_dir):
    pending = spark.createDataFrame([], "path string, tag string, updated_at double, deleted boolean")
    return sync.held(pending, sync.matched(_incoming(spark, sf_dir), catalog.media(spark, sf_dir)))


@_query("sync_merge", f"WITH {_INCOMING}, r AS (SELECT *, row_number() OVER (PARTITION BY media_id, {fold('tag')} ORDER BY updated_at DESC, seq) AS turn FROM matched WHERE media_id IS NOT NULL) SELECT media_id, {fold('tag')} AS tag_key, updated_at, deleted FROM r WHERE turn = 1")
def _(spark, sf_dir):
    none = catalog.links(spark, sf_dir).limit(0)
    return sync.merged(none, sync.matched(_incoming(spark, sf_dir), catalog.media(spark, sf_dir))).select("media_id", "tag_key", "updated_at", "deleted")


@_query(
    "sync_attach",
    f"""WITH {MEDIA}, {ALL_RECORDS}, p AS (SELECT upper(m.rel_path) AS path, m.id, m.present, r.tag, r.updated_at, r.deleted, r.seq FROM records r JOIN media m ON m.id = r.media_id),
    h AS (SELECT *, row_number() OVER (PARTITION BY path, tag ORDER BY updated_at DESC, seq) AS turn FROM p)
    SELECT id AS media_id, tag AS tag_key, updated_at, deleted FROM h WHERE turn = 1 AND present""",
)
def _(spark, sf_dir):
    rows = catalog.media(spark, sf_dir)
    records = catalog.records(spark, sf_dir).join(rows.select(F.col("id").alias("media_id"), F.upper("rel_path").alias("path")), "media_id")
    nothing = spark.createDataFrame([], "path string, tag string, updated_at double, deleted boolean")
    pending = sync.held(nothing, records.withColumn("media_id", F.lit(None).cast("long")))
    return sync.attached(catalog.links(spark, sf_dir).limit(0), pending, rows)[0].select("media_id", "tag_key", "updated_at", "deleted")


@_query(
    "relink_all_media",
    f"""WITH {MEDIA}, {LINKS}, t AS (SELECT DISTINCT media_id FROM links), b AS (SELECT id, present, id // 11 AS block, id % 11 AS place FROM media),
    k AS (SELECT id, present, CASE WHEN place IN (0, 10) THEN 'n' || CASE WHEN block % 5 = 0 THEN block - block % 10 ELSE block END WHEN place = 1 AND block % 3 = 1 THEN 'n' || block ELSE 'other' || id END AS name,
                 CASE WHEN present AND block % 7 = 3 THEN 2 ELSE 1 END AS size FROM b),
    o AS (SELECT name, size, min(id) AS old_id FROM k JOIN t ON t.media_id = k.id WHERE NOT present GROUP BY ALL HAVING count(*) = 1),
    n AS (SELECT name, size, min(id) AS new_id FROM k WHERE present GROUP BY ALL HAVING count(*) = 1)
    SELECT old_id, new_id FROM o JOIN n USING (name, size)""",
)
def _(spark, sf_dir):
    """All media: some vanished ones have one new file of their name, others several, none, or one of another size."""
    rows = catalog.media(spark, sf_dir)
    block, place = F.floor(F.col("id") / 11), F.col("id") % 11
    shared = F.concat(F.when(F.col("present"), "n").otherwise("N"), F.when(block % 5 == 0, block - block % 10).otherwise(block).cast("string"))
    name = F.when(place.isin(0, 10), shared).when((place == 1) & (block % 3 == 1), F.concat(F.lit("N"), block.cast("string"))).otherwise(F.concat(F.lit("other"), F.col("id").cast("string")))
    rows = rows.withColumns({"filename": name, "size": F.when(F.col("present") & (block % 7 == 3), 2).otherwise(1)})
    return sync.relinks(rows, catalog.links(spark, sf_dir))


@_query(
    "export_nested",
    f"""WITH {MEDIA}, {LINKS} SELECT rel_path AS path, size, string_agg(tag || ':' || deleted::VARCHAR, ',' ORDER BY tag_key) AS tags FROM media m JOIN links l ON l.media_id = m.id WHERE present GROUP BY id, rel_path, size""",
)
def _(spark, sf_dir):
    nested = sync.export(catalog.media(spark, sf_dir), catalog.links(spark, sf_dir))
    return nested.select("path", "size", F.array_join(F.transform("tags", lambda t: F.concat(t["name"], F.lit(":"), t["deleted"].cast("string"))), ",").alias("tags"))


@_query("sync_summary", "SELECT user_id, count(*) || ' tag change(s), ' || sum(event_id % 2) || ' file move(s)' || CASE WHEN sum((event_id % 50 = 0)::INT) > 0 THEN ', ' || sum((event_id % 50 = 0)::INT) || ' move(s) skipped' ELSE '' END AS line FROM events GROUP BY user_id")
def _(spark, sf_dir):
    rows = catalog.table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("t"), F.sum(F.col("event_id") % 2).alias("m"), F.count_if(F.col("event_id") % 50 == 0).alias("s"))
    return rows.select("user_id", sync.summary_line(F.col("t"), F.col("m"), F.lit(0), F.col("s"), F.lit(0)).alias("line"))


# -- moves -------------------------------------------------------------------------------------------

_DAY = 86400.0


def _moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn of a conversation moves the conversation's file one folder on."""
    rows = catalog.table(spark, sf_dir, "conversations")
    file = F.concat(F.lit("/c"), F.col("conv_id").cast("string"), F.lit(".jpg"))
    return rows.select(
        F.concat(F.lit("conv/"), F.col("turn").cast("string"), file).alias("from_path"), F.concat(F.lit("conv/"), (F.col("turn") + 1).cast("string"), file).alias("to_path"),
        F.lit(1).cast("long").alias("size"), (NOW - _DAY * (F.col("conv_id") % 120) + F.col("turn")).alias("moved_at"),
        F.struct((NOW - _DAY * (F.col("conv_id") % 120) + F.col("turn")).alias("at"), "conv_id", "turn").alias("seq"),
    )


@_query("move_prune", f"SELECT conv_id, count(*) AS n FROM conversations WHERE {NOW} - {_DAY} * (conv_id % 120) + turn >= {NOW} - 90 * {_DAY} GROUP BY conv_id")
def _(spark, sf_dir):
    return sync.retained_moves(_moves(spark, sf_dir), NOW).groupBy(F.col("seq.conv_id").alias("conv_id")).agg(F.count(F.lit(1)).alias("n"))


@_query("move_known", "SELECT conv_id, turn FROM conversations WHERE turn % 2 = 1")
def _(spark, sf_dir):
    rows = _moves(spark, sf_dir)
    return sync.unknown_moves(rows, rows.where("seq.turn % 2 = 0")).select("seq.conv_id", "seq.turn")


@_query(
    "move_final_location",
    """WITH RECURSIVE c AS (SELECT DISTINCT conv_id, turn FROM conversations), s AS (SELECT conv_id, min(turn) AS t FROM c GROUP BY conv_id),
    r(conv_id, t) AS (SELECT conv_id, t FROM s UNION ALL SELECT r.conv_id, r.t + 1 FROM r JOIN c ON c.conv_id = r.conv_id AND c.turn = r.t)
    SELECT conv_id AS id, 'conv/' || max(t) || '/c' || conv_id || '.jpg' AS rel_path FROM r GROUP BY conv_id""",
)
def _(spark, sf_dir):
    """Where each conversation's file is after all moves, starting in the folder of its first turn."""
    rows = _moves(spark, sf_dir)
    first = rows.groupBy(F.col("seq.conv_id").alias("id")).agg(F.min_by("from_path", "seq").alias("rel_path"))
    media = first.select("id", "rel_path", F.lit(1).cast("long").alias("size"), F.lit(True).alias("present"))
    nothing = rows.limit(0).select("from_path", "to_path", "size", "moved_at")
    changes = moves.replayed(media, rows.dropDuplicates(["from_path"]), nothing)[1]
    return media.join(changes.select("id", F.col("rel_path").alias("new")), "id", "left").select("id", F.coalesce("new", "rel_path").alias("rel_path"))


# -- imports -----------------------------------------------------------------------------------------


def _file_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A move of every medium, of seven kinds by its id: into a folder, with another size, onto its neighbour's name, of a file
    that is nowhere, with another name at once, malformed, and to where it is."""
    rows = catalog.media(spark, sf_dir)
    k, i = F.col("id") % 7, F.col("id")
    prefix = F.when(F.col("album") == "", "").otherwise(F.concat("album", F.lit("/")))
    beside = F.concat(prefix, F.lit("doc_"), (i + 1).cast("string"), F.when((i + 1) % 5 == 0, ".mp4").otherwise(".jpg"))
    from_path = F.when(k == 4, F.concat(F.lit("nowhere/"), "filename")).when(k == 6, F.concat(F.lit("../"), "filename")).otherwise(F.upper("rel_path"))
    moved = F.concat(F.lit("moved/"), F.upper("filename"))
    to_path = F.when(k == 3, beside).when(k == 5, F.concat(F.lit("moved/x"), "filename")).when(k == 0, F.upper("rel_path")).otherwise(moved)
    return rows.select(
        from_path.alias("from_path"), F.when(k == 3, to_path).when(k == 4, F.concat(F.lit("moved/"), "filename")).otherwise(to_path).alias("to_path"),
        F.when(k == 2, F.col("size") + 1).otherwise(F.col("size")).alias("size"), (NOW - i).alias("moved_at"), F.struct((NOW - i).alias("at"), i.alias("id")).alias("seq"),
    )


def _library(spark: SparkSession, sf_dir: str) -> sync.Library:
    """The catalog with held records of every fourth path, some of them absent, and an empty log."""
    rows = catalog.media(spark, sf_dir)
    held = rows.where("id % 4 = 1").select(F.upper("rel_path").alias("path"), F.lit("From Afar").alias("tag"), F.lit(NOW).alias("updated_at"), F.lit(False).alias("deleted"))
    log = spark.createDataFrame([], "from_path string, to_path string, size long, moved_at double")
    return sync.Library(rows, catalog.links(spark, sf_dir), held, log)


#: k = 3 moves a file onto its neighbour's name in its own folder: taken where the neighbour is there (it stays, as its own move fails).
_OUTCOMES = f"""beside AS (SELECT m.*, CASE WHEN album = '' THEN '' ELSE album || '/' END || 'doc_' || (id + 1) || CASE WHEN (id + 1) % 5 = 0 THEN '.mp4' ELSE '.jpg' END AS next_path FROM media m),
outcomes AS (
    SELECT id, CASE id % 7 WHEN 6 THEN 'skipped: malformed record' WHEN 5 THEN 'skipped: move and rename in one' WHEN 4 THEN 'absent' WHEN 0 THEN 'unchanged'
           ELSE CASE WHEN NOT present THEN 'absent' WHEN id % 7 = 2 THEN 'skipped: a different file' WHEN id % 7 = 3 AND EXISTS (SELECT 1 FROM media o WHERE o.rel_path = b.next_path) THEN 'skipped: destination occupied'
                ELSE 'applied' END END AS outcome, next_path FROM beside b)"""

_MOVED = f"""{MEDIA}, {_OUTCOMES},
moved AS (SELECT m.* EXCLUDE (rel_path), CASE WHEN o.outcome = 'applied' AND m.id % 7 = 1 THEN 'moved/' || m.filename WHEN o.outcome = 'applied' THEN o.next_path ELSE rel_path END AS rel_path
          FROM media m JOIN outcomes o USING (id))"""


@_query("move_outcomes", f"WITH {MEDIA}, {_OUTCOMES} SELECT id, outcome FROM outcomes")
def _(spark, sf_dir):
    rows = _file_moves(spark, sf_dir)
    found = moves.replayed(catalog.media(spark, sf_dir), rows, _library(spark, sf_dir).log)[0]
    return found.select(F.get_json_object("key", "$.id").cast("long").alias("id"), "outcome")


def _found_in(media: str) -> str:
    """The records of ``incoming`` with the media that they belong to."""
    return f"""found AS (
    SELECT i.*, CASE WHEN p.id IS NOT NULL THEN CASE WHEN p.present THEN p.id END ELSE
        (SELECT CASE WHEN count(*) = 1 THEN min(c.id) END FROM {media} c WHERE c.present AND {fold("regexp_extract(c.rel_path, '[^/]*$')")} = {fold("regexp_extract(i.path, '[^/]*$')")} AND (i.size IS NULL OR c.size = i.size)) END AS media_id
    FROM incoming i LEFT JOIN {media} p ON {fold("p.rel_path")} = {fold("i.path")})"""


_IMPORT = f"""{_MOVED}, {ALL_RECORDS}, {LINKS[len(ALL_RECORDS) + 2:]}, incoming AS (
    SELECT r.seq, CASE r.seq % 5 WHEN 1 THEN 'elsewhere/' || m.filename WHEN 2 THEN 'gone/' || r.seq || '.jpg' ELSE upper(m.rel_path) END AS path,
           CASE WHEN r.seq % 10 = 1 THEN NULL WHEN r.seq % 15 = 6 THEN m.size + 1 ELSE m.size END AS size, r.tag, r.updated_at + 1 AS updated_at, r.deleted
    FROM records r JOIN media m ON m.id = r.media_id)"""


@_query(
    "sync_import",
    f"""WITH {_IMPORT}, {_found_in("moved")},
    held AS (SELECT upper(rel_path) AS path, 'from afar' AS tag_key, {NOW} AS updated_at, false AS deleted FROM media WHERE id % 4 = 1
             UNION ALL SELECT path, {fold("tag")}, updated_at, deleted FROM (SELECT *, row_number() OVER (PARTITION BY {fold("path")}, {fold("tag")} ORDER BY updated_at DESC, seq) AS turn FROM found WHERE media_id IS NULL) WHERE turn = 1),
    every AS (SELECT media_id, tag_key, updated_at, deleted, -1 AS place FROM links UNION ALL SELECT media_id, {fold("tag")}, updated_at, deleted, seq FROM found WHERE media_id IS NOT NULL
              UNION ALL SELECT m.id, h.tag_key, h.updated_at, h.deleted, 4611686018427387904 FROM held h JOIN moved m ON m.present AND {fold("m.rel_path")} = {fold("h.path")}),
    r AS (SELECT *, row_number() OVER (PARTITION BY media_id, tag_key ORDER BY updated_at DESC, place) AS turn FROM every) SELECT media_id, tag_key, updated_at, deleted FROM r WHERE turn = 1""",
)
def _(spark, sf_dir):
    """All moves, then all records by the new paths, then what was held."""
    incoming = _incoming(spark, sf_dir).withColumn("updated_at", F.col("updated_at") + 1)
    return sync.imported(_library(spark, sf_dir), incoming, _file_moves(spark, sf_dir))[0].links.select("media_id", "tag_key", "updated_at", "deleted")


@_query(
    "sync_import_result",
    f"""WITH {_IMPORT}, {_found_in("moved")},
    every AS (SELECT media_id, tag_key, updated_at, deleted, -1 AS place FROM links UNION ALL SELECT media_id, {fold("tag")}, updated_at, deleted, seq FROM found WHERE media_id IS NOT NULL),
    a AS (SELECT *, max(updated_at) OVER (PARTITION BY media_id, tag_key ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest FROM every),
    b AS (SELECT *, lag(deleted) OVER (PARTITION BY media_id, tag_key ORDER BY place) AS last FROM a WHERE newest IS NULL OR updated_at > newest),
    h AS (SELECT *, max(updated_at) OVER (PARTITION BY {fold("path")}, {fold("tag")} ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest FROM found WHERE media_id IS NULL)
    SELECT (SELECT count(*) FROM outcomes WHERE outcome = 'applied') AS moves_applied, (SELECT count(*) FROM outcomes WHERE starts_with(outcome, 'skipped')) AS moves_skipped,
           (SELECT count(*) FROM b WHERE place >= 0 AND coalesce(last, true) <> deleted) AS tags_changed, (SELECT count(*) FROM h WHERE newest IS NULL OR updated_at > newest) AS held""",
)
def _(spark, sf_dir):
    incoming = _incoming(spark, sf_dir).withColumn("updated_at", F.col("updated_at") + 1)
    return sync.imported(_library(spark, sf_dir), incoming, _file_moves(spark, sf_dir))[1]


@_query(
    "sync_dry_run",
    f"""WITH {_IMPORT}, {_found_in("media")}
    SELECT (SELECT count(*) FROM outcomes WHERE outcome = 'applied') AS moves_applied, (SELECT count(*) FROM outcomes WHERE starts_with(outcome, 'skipped')) AS moves_skipped,
           (SELECT count(*) FROM found f LEFT JOIN links l ON l.media_id = f.media_id AND l.tag_key = {fold("f.tag")} WHERE f.media_id IS NOT NULL AND (l.tag_key IS NULL OR f.updated_at > l.updated_at) AND coalesce(l.deleted, true) <> f.deleted) AS tags_changed,
           (SELECT count(*) FROM found WHERE media_id IS NULL) AS held""",
)
def _(spark, sf_dir):
    incoming = _incoming(spark, sf_dir).withColumn("updated_at", F.col("updated_at") + 1)
    return sync.dry_run(_library(spark, sf_dir), incoming, _file_moves(spark, sf_dir))


# -- scans and renames -------------------------------------------------------------------------------


def _listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The disk: some files gone, some changed, some back, some new."""
    rows = catalog.media(spark, sf_dir).where("id % 10 <> 3")
    size = F.when(F.col("id") % 9 == 4, F.col("size") + 1).otherwise(F.col("size"))
    path = F.when(F.col("id") % 8 == 1, F.concat(F.lit("new/"), "filename")).otherwise(F.upper("rel_path"))
    return rows.select("root", path.alias("rel_path"), size.alias("size"), "mtime")


_DIFF = f"""WITH {MEDIA}, listing AS (SELECT CASE WHEN id % 8 = 1 THEN 'new/' || filename ELSE upper(rel_path) END AS rel_path, CASE WHEN id % 9 = 4 THEN size + 1 ELSE size END AS size, mtime FROM media WHERE id % 10 <> 3),
    d AS (SELECT lower(coalesce(l.rel_path, m.rel_path)) AS path_key, m.id, CASE WHEN m.id IS NULL THEN 'added' WHEN l.rel_path IS NOT NULL AND NOT m.present THEN 'restored'
          WHEN l.rel_path IS NOT NULL AND (l.size <> m.size OR l.mtime <> m.mtime) THEN 'updated' WHEN l.rel_path IS NULL AND m.present THEN 'missing' ELSE 'same' END AS status
          FROM listing l FULL JOIN media m ON lower(l.rel_path) = lower(m.rel_path))"""


@_query("scan_diff", f"{_DIFF} SELECT path_key, id, status FROM d")
def _(spark, sf_dir):
    return scan.scan_diff(_listing(spark, sf_dir), catalog.media(spark, sf_dir), [catalog.ROOT]).select("path_key", "id", "status")


@_query("scan_diff_counts", f"{_DIFF} SELECT " + ", ".join(f"count(*) FILTER (status = '{s}') AS {s}" for s in ("added", "updated", "missing", "restored")) + " FROM d")
def _(spark, sf_dir):
    return scan.scan_counts(scan.scan_diff(_listing(spark, sf_dir), catalog.media(spark, sf_dir), [catalog.ROOT]))


@_query("scan_refresh", f"{_DIFF} SELECT path_key, status <> 'missing' AND NOT (status = 'same' AND NOT m.present) AS present FROM (SELECT d.*, m.present FROM d LEFT JOIN media m USING (id)) m")
def _(spark, sf_dir):
    rows = catalog.media(spark, sf_dir)
    diff = scan.scan_diff(_listing(spark, sf_dir), rows, [catalog.ROOT])
    return scan.refreshed(diff, rows, 1 << 40).select(text.fold_unicode(F.col("rel_path")).alias("path_key"), "present")


@_query("scan_folders", f"WITH {MEDIA}, {_FOLDERS} SELECT rel_path, CASE WHEN rel_path LIKE '%/en' THEN 'missing' ELSE 'same' END AS status FROM folders UNION ALL SELECT 'brand/new', 'added'")
def _(spark, sf_dir):
    known = folders.folder_table(catalog.media(spark, sf_dir)).withColumn("present", F.lit(True))
    disk = known.where("rel_path not like '%/en'").select("root", F.upper("rel_path").alias("rel_path"))
    new = spark.range(1).select(F.lit(catalog.ROOT).alias("root"), F.lit("brand/new").alias("rel_path"))
    return scan.folder_diff(disk.unionByName(new), known, [catalog.ROOT]).select("rel_path", "status")


def _two_roots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Even ids in one root, odd ones in another; the first's disk, with files whose paths the other root has, and the other's names."""
    rows = catalog.media(spark, sf_dir).withColumn("root", F.when(F.col("id") % 2 == 0, "/A").otherwise("/B"))
    k = F.col("id") % 20
    path = F.when(k == 2, F.concat(F.lit("new/"), "filename")).otherwise(F.upper("rel_path"))
    disk = rows.where((k != 4) & ((F.col("root") == "/A") | k.isin(3, 5)))
    return rows, disk.select(F.lit("/A").alias("root"), path.alias("rel_path"), F.when(k == 6, F.col("size") + 1).otherwise(F.col("size")).alias("size"), "mtime")


@_query(
    "scan_two_roots",
    f"""WITH {MEDIA}, m AS (SELECT *, CASE WHEN id % 2 = 0 THEN '/A' ELSE '/B' END AS own FROM media),
    listing AS (SELECT CASE WHEN id % 20 = 2 THEN 'new/' || filename ELSE upper(rel_path) END AS rel_path, CASE WHEN id % 20 = 6 THEN size + 1 ELSE size END AS size, mtime
                FROM m WHERE id % 20 <> 4 AND (own = '/A' OR id % 20 IN (3, 5))),
    d AS (SELECT lower(coalesce(l.rel_path, m.rel_path)) AS path_key, m.id, CASE WHEN m.id IS NULL THEN 'added' WHEN l.rel_path IS NOT NULL AND NOT m.present THEN 'restored'
          WHEN l.rel_path IS NOT NULL AND (l.size <> m.size OR l.mtime <> m.mtime) THEN 'updated' WHEN l.rel_path IS NULL AND m.present THEN 'missing' ELSE 'same' END AS status
          FROM listing l FULL JOIN (SELECT * FROM m WHERE own = '/A') m ON lower(l.rel_path) = lower(m.rel_path))
    SELECT path_key, id, status FROM d WHERE status <> 'added' OR path_key NOT IN (SELECT lower(rel_path) FROM media)""",
)
def _(spark, sf_dir):
    rows, disk = _two_roots(spark, sf_dir)
    return scan.scan_diff(disk, rows, ["/A"]).select("path_key", "id", "status")


@_query("scan_two_roots_refreshed", f"WITH {MEDIA} SELECT CASE WHEN id % 2 = 0 THEN '/A' ELSE '/B' END AS root, present AND id % 20 <> 4 AND id % 20 <> 2 OR (id % 2 = 0 AND id % 20 NOT IN (2, 4)) AS present, count(*) AS n FROM media GROUP BY ALL UNION ALL SELECT '/A', true, count(*) FROM media WHERE id % 20 = 2")
def _(spark, sf_dir):
    rows, disk = _two_roots(spark, sf_dir)
    found = scan.refreshed(scan.scan_diff(disk, rows, ["/A"]), rows, 1 << 40)
    # the new files are counted by themselves, as in the SQL
    new = F.col("id") >= 1 << 40
    return found.groupBy("root", "present", new.alias("new")).agg(F.count(F.lit(1)).alias("n")).select("root", "present", "n")


@_query(
    "scan_then_attach",
    f"""WITH {MEDIA}, {LINKS}, t AS (SELECT DISTINCT media_id FROM links),
    k AS (SELECT *, CASE WHEN id % 11 IN (0, 10) AND id > 0 THEN 'n' || (id + 1) // 11 ELSE 'other' || id END AS name FROM media),
    o AS (SELECT g.id AS old_id, h.id AS new_id FROM k g JOIN k h ON g.name = h.name AND NOT g.present AND h.present WHERE g.id IN (SELECT media_id FROM t)),
    p AS (SELECT id AS media_id, 'from afar' AS tag_key, {NOW} AS updated_at, false AS deleted FROM media WHERE present AND id % 4 = 1),
    moved AS (SELECT coalesce(o.new_id, l.media_id) AS media_id, tag_key, updated_at, deleted, (o.new_id IS NOT NULL)::INT AS late FROM links l LEFT JOIN o ON o.old_id = l.media_id
              UNION ALL SELECT *, 2 FROM p),
    r AS (SELECT *, row_number() OVER (PARTITION BY media_id, tag_key ORDER BY updated_at DESC, late) AS turn FROM moved) SELECT media_id, tag_key, updated_at, deleted FROM r WHERE turn = 1""",
)
def _(spark, sf_dir):
    """Vanished files come back as the ones after them, and held records of every fourth path, some of them absent."""
    rows = catalog.media(spark, sf_dir)
    place = F.col("id") % 11
    name = F.when(place.isin(0, 10) & (F.col("id") > 0), F.concat(F.lit("N"), F.floor((F.col("id") + 1) / 11).cast("string"))).otherwise(F.concat(F.lit("other"), F.col("id").cast("string")))
    held = rows.where("id % 4 = 1").select(F.upper("rel_path").alias("path"), F.lit("From Afar").alias("tag"), F.lit(NOW).alias("updated_at"), F.lit(False).alias("deleted"))
    rows = rows.withColumns({"filename": name, "size": F.lit(1)})
    return scan.after_scan(rows, catalog.links(spark, sf_dir), held)[1].select("media_id", "tag_key", "updated_at", "deleted")


@_query("rename_numbered", f"WITH {MEDIA} SELECT id, 'trip' || CASE WHEN length((id + 9)::VARCHAR) < 3 THEN lpad((id + 9)::VARCHAR, 3, '0') ELSE (id + 9)::VARCHAR END || right(filename, 4) AS new_name FROM media")
def _(spark, sf_dir):
    chosen = catalog.media(spark, sf_dir).select("id", F.col("id").alias("pos"), "filename")
    return rename.numbered_names(chosen, " trip ", start=9, digits=3).select("id", "new_name")


def _plan(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All media and some more files, and a plan of new names for all media: numbers that repeat, names of other files, bad ones."""
    rows = catalog.media(spark, sf_dir)
    i = F.col("id")
    prefix = F.when(F.col("album") == "", "").otherwise(F.concat("album", F.lit("/")))
    extra = rows.where("id % 12 in (2, 7)").withColumns(
        {"id": i + (1 << 40), "rel_path": F.concat(prefix, F.lit("Other_"), i.cast("string"), F.lit(".jpg")), "present": i % 24 < 12}
    )
    other = F.concat(F.when(i % 12 == 2, "oTHER_").otherwise("other_"), i.cast("string"), F.lit(".jpg"))
    name = (
        F.when(i % 12 == 0, "con.jpg").when(i % 12 == 1, F.col("filename")).when((i % 12).isin(2, 7), other).when(i % 12 == 3, "a:b.jpg").otherwise(F.concat(F.lit("N"), F.floor(i / 40).cast("string"), F.lit(".jpg")))
    )
    every = rows.unionByName(extra)
    return every, rename.rename_plan(every, rows.select("id", i.alias("pos"), name.alias("new_name")))


_PLAN = f"""WITH {MEDIA}, names AS (SELECT *, CASE id % 12 WHEN 0 THEN 'con.jpg' WHEN 1 THEN filename WHEN 2 THEN 'oTHER_' || id || '.jpg' WHEN 7 THEN 'other_' || id || '.jpg' WHEN 3 THEN 'a:b.jpg' ELSE 'N' || id // 40 || '.jpg' END AS new_name FROM media),
    n AS (SELECT *, CASE WHEN album = '' THEN new_name ELSE album || '/' || new_name END AS new_path FROM names),
    s AS (SELECT *, CASE WHEN NOT present THEN 'file is missing' WHEN new_name = 'con.jpg' THEN 'name cannot be a reserved name' WHEN new_name = 'a:b.jpg' THEN 'name cannot contain reserved or control characters' WHEN new_path = rel_path THEN 'unchanged' END AS early FROM n),
    t AS (SELECT *, row_number() OVER (PARTITION BY CASE WHEN early IS NULL THEN lower(new_path) ELSE id::VARCHAR END ORDER BY id) AS turn FROM s),
    p AS (SELECT id, rel_path AS old_path, new_path, CASE WHEN early IS NOT NULL THEN early WHEN turn > 1 THEN 'two files would get the same name'
      WHEN id % 12 IN (2, 7) AND id % 24 < 12 THEN 'the name is taken' WHEN id % 12 IN (2, 7) THEN 'an older record has that name' ELSE 'ok' END AS status FROM t)"""


@_query("rename_plan", f"{_PLAN} SELECT id, old_path, new_path, status FROM p")
def _(spark, sf_dir):
    return _plan(spark, sf_dir)[1]


@_query("rename_conflicts", f"{_PLAN} SELECT count(*) FILTER (status = 'ok') AS n_ok, count(*) FILTER (status = 'unchanged') AS n_unchanged, count(*) FILTER (status NOT IN ('ok', 'unchanged')) AS n_problems, bool_and(status IN ('ok', 'unchanged')) AS ok FROM p")
def _(spark, sf_dir):
    return rename.is_applicable(_plan(spark, sf_dir)[1])


@_query("rename_applied", f"{_PLAN} SELECT id, CASE WHEN status = 'ok' THEN new_path ELSE old_path END AS rel_path, status = 'ok' AS logged FROM p")
def _(spark, sf_dir):
    """The catalog after the fine part of the plan, and which of its files have a move record."""
    every, plan = _plan(spark, sf_dir)
    after = rename.renamed(every, plan).where(F.col("id") < 1 << 40).select("id", "rel_path")
    logged = rename.rename_moves(every, plan, NOW).select("to_path", F.lit(True).alias("logged"))
    return after.join(logged, F.col("rel_path") == F.col("to_path"), "left").select("id", "rel_path", F.coalesce("logged", F.lit(False)).alias("logged"))


@_query(
    "rename_prefix",
    f"""WITH {MEDIA}, c AS (SELECT id, rel_path, album, row_number() OVER (ORDER BY lower(rel_path), id) AS n FROM media WHERE type = 'video'),
    k AS (SELECT *, CASE WHEN album = '' THEN '' ELSE album || '/' END || 'doc_' || n || '.mp4' AS new_path FROM c)
    SELECT id, rel_path AS old_path, new_path, CASE WHEN EXISTS (SELECT 1 FROM media o WHERE lower(o.rel_path) = lower(k.new_path) AND lower(o.rel_path) <> lower(k.rel_path)) THEN 'another file has the name' ELSE 'ok' END AS status FROM k""",
)
def _(spark, sf_dir):
    """All videos numbered behind a prefix that some files have already."""
    rows = catalog.media(spark, sf_dir)
    return rename.prefix_plan(rows, rows.where("type = 'video'"), "doc_")


# -- further rules -----------------------------------------------------------------------------------


@_query("preview_names", f"WITH {MEDIA} SELECT id, sha1(rel_path || '|256|' || ({catalog.FIRST_TIME} + 3600 * id)) AS name FROM media")
def _(spark, sf_dir):
    rows = catalog.media(spark, sf_dir)
    return rows.select("id", text.cache_name(F.col("rel_path"), F.col("mtime").cast("long")).alias("name"))


@_query("library_stats", f"WITH {MEDIA} SELECT count(*) AS files, sum(size)::BIGINT AS bytes, count(*) FILTER (size <= 0) AS unknown_sizes FROM media WHERE present")
def _(spark, sf_dir):
    return scan.library_stats(catalog.media(spark, sf_dir))


@_query("selection_with_folder", f"WITH {MEDIA} SELECT id FROM media WHERE id % 50 = 0 OR (present AND type = 'photo' AND (album = 'src1' OR starts_with(album, 'src1/')))")
def _(spark, sf_dir):
    rows = catalog.media(spark, sf_dir)
    return search.with_folder_photos(rows, rows.where("id % 50 = 0"), "src1")


@_query(
    "sync_match_strict",
    f"""WITH {_INCOMING} SELECT i.seq, coalesce(p.id, (SELECT CASE WHEN count(*) = 1 THEN min(c.id) END FROM media c WHERE c.present AND c.size = i.size
      AND {fold("c.filename")} = {fold("regexp_extract(i.path, '[^/]*$')")})) AS media_id
    FROM incoming i LEFT JOIN media p ON p.present AND {fold("p.rel_path")} = {fold("i.path")} AND p.size = i.size""",
)
def _(spark, sf_dir):
    return sync.matched_strictly(_incoming(spark, sf_dir), catalog.media(spark, sf_dir)).select("seq", "media_id")


@_query("sync_strict_records", f"WITH {_INCOMING} SELECT seq, path, tag FROM incoming WHERE coalesce(size, 0) >= 0 AND length(tag) <= 5")
def _(spark, sf_dir):
    return sync.strict_records(_incoming(spark, sf_dir), longest=5).select("seq", "path", "tag")


@_query(
    "sync_import_counts",
    f"""WITH {_INCOMING}, m AS (SELECT *, max(updated_at) OVER (PARTITION BY media_id, tag ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest FROM matched WHERE media_id IS NOT NULL),
    b AS (SELECT *, lag(deleted) OVER (PARTITION BY media_id, tag ORDER BY seq) AS last FROM m WHERE newest IS NULL OR updated_at > newest)
    SELECT (SELECT count(*) FROM matched) AS records, (SELECT count(*) FROM matched WHERE media_id IS NULL) AS held, count(*) AS accepted, count(*) FILTER (coalesce(last, true) <> deleted) AS changed FROM b""",
)
def _(spark, sf_dir):
    found = sync.matched(_incoming(spark, sf_dir), catalog.media(spark, sf_dir))
    return sync.import_counts(catalog.links(spark, sf_dir).limit(0), found)


@_query(
    "tag_move",
    f"""WITH {LINKS}, k AS (SELECT CASE WHEN media_id % 2 = 1 THEN media_id - 1 ELSE media_id END AS media_id, tag_key, updated_at, deleted, media_id % 2 AS moved FROM links),
    r AS (SELECT *, row_number() OVER (PARTITION BY media_id, tag_key ORDER BY updated_at DESC, moved) AS turn FROM k) SELECT media_id, tag_key, updated_at, deleted FROM r WHERE turn = 1""",
)
def _(spark, sf_dir):
    """Every odd medium's tags move to the even one before it."""
    held = catalog.links(spark, sf_dir)
    moved = held.where("media_id % 2 = 1").select("media_id", (F.col("media_id") - 1).alias("to_id")).distinct()
    return tags.move_tags(held, moved).select("media_id", "tag_key", "updated_at", "deleted")


@_query("album_create", f"WITH {MEDIA}, {_FOLDERS}, w AS (SELECT DISTINCT 'Year ' || id % 5 AS y, id % 3 AS m FROM media) SELECT '{catalog.ROOT}' AS root, y AS rel_path FROM w UNION SELECT '{catalog.ROOT}', y || '/' || m FROM w")
def _(spark, sf_dir):
    rows = catalog.media(spark, sf_dir)
    path = F.concat(F.lit(" Year  "), (F.col("id") % 5).cast("string"), F.lit(" \\ "), (F.col("id") % 3).cast("string"), F.lit("/"))
    return folders.created(folders.folder_table(rows), rows.select("root", path.alias("path")))


@_query(
    "album_move_checks",
    f"""WITH {MEDIA}, {_FOLDERS}, a AS (SELECT root, rel_path AS path, CASE length(rel_path) % 3 WHEN 0 THEN '' WHEN 1 THEN 'src1' ELSE 'nowhere' END AS to_parent FROM folders),
    n AS (SELECT *, CASE WHEN to_parent = '' THEN '' ELSE to_parent || '/' END || regexp_extract(path, '[^/]*$') AS new_path FROM a)
    SELECT path, new_path, CASE WHEN to_parent = 'nowhere' THEN 'the destination does not exist' WHEN to_parent <> '' AND (to_parent = path OR starts_with(to_parent, path || '/')) THEN 'not into itself or below'
      WHEN new_path = path THEN NULL WHEN EXISTS (SELECT 1 FROM folders f WHERE f.rel_path = new_path) THEN 'the name is taken there' END AS problem FROM n""",
)
def _(spark, sf_dir):
    known = folders.folder_table(catalog.media(spark, sf_dir))
    parent = F.when(F.length("rel_path") % 3 == 0, "").when(F.length("rel_path") % 3 == 1, "src1").otherwise("nowhere")
    asks = known.select("root", F.col("rel_path").alias("path"), F.col("root").alias("to_root"), parent.alias("to_parent"))
    return folders.check_moves(known, asks).select("path", "new_path", "problem")


@_query(
    "relink_merge",
    f"""WITH {MEDIA}, {LINKS}, o AS (SELECT id AS old_id, id + 1 AS new_id FROM media WHERE id % 11 = 10 AND id + 1 IN (SELECT id FROM media) AND id IN (SELECT media_id FROM links)),
    k AS (SELECT coalesce(o.new_id, l.media_id) AS media_id, tag_key, updated_at, deleted, (o.new_id IS NOT NULL)::INT AS moved FROM links l LEFT JOIN o ON o.old_id = l.media_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY media_id, tag_key ORDER BY updated_at DESC, moved) AS turn FROM k) SELECT media_id, tag_key, updated_at, deleted FROM r WHERE turn = 1""",
)
def _(spark, sf_dir):
    """Each vanished document comes back as the one after it."""
    rows = catalog.media(spark, sf_dir)
    pair = F.when(F.col("id") % 11 == 10, F.col("id")).when((F.col("id") > 0) & (F.col("id") % 11 == 0), F.col("id") - 1)
    rows = rows.withColumns({"filename": F.coalesce(F.concat(F.lit("n"), pair.cast("string")), F.concat(F.lit("other"), F.col("id").cast("string"))), "size": F.lit(1)})
    return sync.relinked(rows, catalog.links(spark, sf_dir))[1].select("media_id", "tag_key", "updated_at", "deleted")


# -- tags by path ------------------------------------------------------------------------------------

_PATHS = f"""{MEDIA}, {RECORDS},
    every AS (SELECT 'lib' || machine AS library, m.rel_path AS path, r.tag AS name, r.updated_at, r.deleted, r.seq FROM records r JOIN media m ON m.id = r.media_id),
    store AS (SELECT library, path, name, updated_at, deleted FROM (SELECT *, row_number() OVER (PARTITION BY library, path, name ORDER BY updated_at DESC, seq) AS turn FROM every) WHERE turn = 1)"""


def _path_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The machines' records by library and path: library, path, name, updated_at, deleted, seq."""
    rows = catalog.media(spark, sf_dir).select("id", F.col("rel_path").alias("path"))
    records = catalog.records(spark, sf_dir).join(rows, F.col("media_id") == F.col("id"))
    return records.select(F.concat(F.lit("lib"), F.col("machine").cast("string")).alias("library"), "path", F.col("tag").alias("name"), "updated_at", "deleted", "seq")


def _path_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = F.max_by(F.struct("updated_at", "deleted"), F.struct("updated_at", -F.col("seq")))
    return _path_records(spark, sf_dir).groupBy("library", "path", "name").agg(best.alias("r")).select("library", "path", "name", "r.*")


def _in_libraries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.media(spark, sf_dir).withColumn("library", F.concat(F.lit("lib"), (F.col("id") % 3).cast("string")))


@_query("path_tags_media", f"WITH {_PATHS} SELECT m.id, s.library, m.rel_path, s.name FROM media m JOIN store s ON s.library = 'lib' || m.id % 3 AND s.path = m.rel_path WHERE m.present AND NOT s.deleted")
def _(spark, sf_dir):
    store = _path_store(spark, sf_dir).withColumn("path", F.upper("path"))
    return path_tags.by_media(_in_libraries(spark, sf_dir), store)


@_query(
    "path_tags_edited",
    f"""WITH {_PATHS}, touched AS (SELECT s.*, NOT deleted AND (s.library = 'lib0' AND name = 'click' AND path LIKE '%.jpg' OR s.library = 'lib2' AND name = 'view' OR s.library = 'lib1' AND name = 'error') AS t FROM store s),
    new AS (SELECT 'lib1' AS library, rel_path AS path, 'Sun' AS name FROM media WHERE type = 'video' UNION SELECT library, path, 'Seen' FROM touched WHERE t AND name = 'view')
    SELECT library, path, name, CASE WHEN t THEN {NOW} ELSE updated_at END AS updated_at, deleted OR t AS deleted FROM touched UNION ALL SELECT library, path, name, {NOW}, false FROM new""",
)
def _(spark, sf_dir):
    """A tag added to videos, one taken off photos, one renamed and one deleted, each in one library."""
    paths = catalog.media(spark, sf_dir).select(F.col("rel_path").alias("path"), "type")
    store = path_tags.add(_path_store(spark, sf_dir), paths.where("type = 'video'").select(F.lit("lib1").alias("library"), "path"), [" Sun "], NOW)
    store = path_tags.remove(store, paths.where("type = 'photo'").select(F.lit("lib0").alias("library"), F.upper("path").alias("path")), "CLICK", NOW)
    return path_tags.delete(path_tags.rename(store, "lib2", "View", "Seen", NOW), "lib1", "Error", NOW).select("library", "path", "name", "updated_at", "deleted")


@_query(
    "path_tags_moved",
    f"""WITH {_PATHS}, k AS (SELECT s.library, CASE WHEN m.id % 2 = 1 THEN o.rel_path ELSE s.path END AS path, name, updated_at, deleted, m.id % 2 AS moved
            FROM store s JOIN media m ON m.rel_path = s.path LEFT JOIN media o ON o.id = m.id - 1),
    r AS (SELECT *, row_number() OVER (PARTITION BY library, path, name ORDER BY updated_at DESC, moved) AS turn FROM k) SELECT library, path, name, updated_at, deleted FROM r WHERE turn = 1""",
)
def _(spark, sf_dir):
    """Every odd file's tags move to the path of the even one before it, in all libraries."""
    return path_tags.moved(_path_store(spark, sf_dir), _pairs_of_paths(spark, sf_dir)).select("library", "path", "name", "updated_at", "deleted")


def _pairs_of_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moves of every odd file to the path of the even one before it: library, from_path, to_path."""
    rows = catalog.media(spark, sf_dir).select("id", "rel_path")
    odd = rows.where("id % 2 = 1").select((F.col("id") - 1).alias("id"), F.upper("rel_path").alias("from_path"))
    return odd.join(rows.withColumnRenamed("rel_path", "to_path"), "id").select(F.explode(F.array(*[F.lit(f"lib{n}") for n in range(3)])).alias("library"), "from_path", "to_path")


@_query("path_move_records", f"WITH {MEDIA} SELECT 'lib' || m.id % 3 AS library, upper(m.rel_path) AS from_path, o.rel_path AS to_path, m.size, {NOW}::DOUBLE AS moved_at FROM media m JOIN media o ON o.id = m.id - 1 WHERE m.id % 2 = 1")
def _(spark, sf_dir):
    return path_tags.move_records(_in_libraries(spark, sf_dir), _pairs_of_paths(spark, sf_dir), NOW)


_TWO_STORES = f"""{_PATHS}, one AS (SELECT * FROM store WHERE library = 'lib0'), two AS (SELECT 'lib0' AS library, path, name, updated_at, deleted FROM store WHERE library = 'lib1'),
    latest AS (SELECT path, name, max(updated_at) AS time, arg_max(deleted, updated_at) AS gone FROM (SELECT * FROM one UNION ALL SELECT * FROM two) GROUP BY ALL),
    taken AS (SELECT s.path, s.name, s.updated_at, s.deleted, l.gone, m.present FROM store s JOIN media m ON m.rel_path = s.path LEFT JOIN latest l ON l.path = s.path AND l.name = s.name
              WHERE s.library = 'lib2' AND (l.time IS NULL OR s.updated_at > l.time))"""


def _two_stores(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One machine's records as the store, another's as the held ones, the third's as what comes in."""
    store = _path_store(spark, sf_dir)
    one, two, new = (store.where(F.col("library") == f"lib{n}").withColumn("library", F.lit("lib0")) for n in range(3))
    return path_tags.merge(one, two, catalog.media(spark, sf_dir).withColumn("library", F.lit("lib0")), new)


@_query(
    "path_tags_merged",
    f"""WITH {_TWO_STORES}, s AS (SELECT path, name, updated_at, deleted FROM taken WHERE present UNION ALL SELECT path, name, updated_at, deleted FROM one o WHERE NOT EXISTS (SELECT 1 FROM taken t WHERE t.present AND t.path = o.path AND t.name = o.name)),
    h AS (SELECT path, name, updated_at, deleted FROM taken WHERE NOT present UNION ALL SELECT path, name, updated_at, deleted FROM two o WHERE NOT EXISTS (SELECT 1 FROM taken t WHERE NOT t.present AND t.path = o.path AND t.name = o.name))
    SELECT 'tags' AS store, * FROM s UNION ALL SELECT 'held', * FROM h""",
)
def _(spark, sf_dir):
    store, pending, _ = _two_stores(spark, sf_dir)
    both = store.withColumn("store", F.lit("tags")).unionByName(pending.withColumn("store", F.lit("held")))
    return both.select("store", "path", "name", "updated_at", "deleted")


@_query("path_tags_merge_counts", f"WITH {_TWO_STORES} SELECT count(*) AS accepted, count(*) FILTER (coalesce(gone, true) <> deleted) AS changed FROM taken")
def _(spark, sf_dir):
    return _two_stores(spark, sf_dir)[2]


@_query("sync_remapped", f"WITH {_PATHS} SELECT seq, CASE WHEN m.id % 2 = 1 THEN o.rel_path ELSE m.rel_path END AS path FROM every e JOIN media m ON m.rel_path = e.path LEFT JOIN media o ON o.id = m.id - 1")
def _(spark, sf_dir):
    """Records of files that moved before go to where they are now."""
    done = _pairs_of_paths(spark, sf_dir).where("library = 'lib0'").select(F.lower("from_path").alias("from_path"), "to_path", F.lit(1).alias("seq"))
    return path_tags.remapped(_path_records(spark, sf_dir).select("seq", F.lower("path").alias("path"), F.col("path").alias("own")), done).select(
        "seq", F.when(F.lower("own") == F.col("path"), F.col("own")).otherwise(F.col("path")).alias("path")
    )


@_query(
    "sync_flat_records",
    f"""WITH {MEDIA}, {RECORDS}, r AS (SELECT r.*, m.rel_path, m.size FROM records r JOIN media m ON m.id = r.media_id)
    SELECT seq, rel_path AS path, size, CASE WHEN seq % 7 = 3 THEN 'a b' ELSE tag END AS tag, deleted AND seq % 4 <> 1 AS deleted FROM r WHERE seq % 7 NOT IN (1, 2) AND seq % 9 <> 4""",
)
def _(spark, sf_dir):
    """Documents of one record each, some with unsafe paths, blank names, no time, or no word on deletion."""
    rows = catalog.media(spark, sf_dir).select("id", "rel_path", "size")
    held = catalog.records(spark, sf_dir).join(rows, F.col("media_id") == F.col("id"))
    k = F.col("seq") % 7
    name = F.when(k == 1, " ").when(k == 3, " a  b").otherwise(F.col("tag"))
    tag = F.struct(name.alias("name"), F.when(k != 2, F.col("updated_at")).alias("updated_at"), F.when(F.col("seq") % 4 != 1, F.col("deleted")).alias("deleted"))
    path = F.when(F.col("seq") % 9 == 4, F.concat(F.lit("../"), "rel_path")).otherwise(F.col("rel_path"))
    media = F.struct(path.alias("path"), "size", F.array(tag).alias("tags"))
    docs = held.select(F.format_string("%020d", "seq").alias("file"), F.struct(F.array(media).alias("media")).alias("doc"))
    return sync.flat_records(docs).select(F.col("seq.file").cast("long").alias("seq"), "path", "size", "tag", "deleted")


@_query("sync_strict_documents", "SELECT conv_id, turn FROM conversations WHERE turn % 5 >= 1 AND conv_id % 4 < 2")
def _(spark, sf_dir):
    """Documents by version and machine id: too old ones, blank, missing and long ids."""
    rows = catalog.table(spark, sf_dir, "conversations")
    k = F.col("conv_id") % 4
    machine = F.when(k == 0, "m").when(k == 1, F.lit("x" * 128)).when(k == 2, F.when(F.col("turn") % 2 == 0, " ")).otherwise(F.lit("x" * 129))
    docs = rows.select("conv_id", "turn", F.struct((F.col("turn") % 5).cast("int").alias("version"), machine.alias("machine_id")).alias("doc"))
    return sync.strict_documents(docs).select("conv_id", "turn")
