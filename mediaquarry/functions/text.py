"""Scalar functions on names and paths, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# File extensions by kind of media.
PHOTO_EXTENSIONS = ("jpg", "jpeg", "png", "gif", "bmp", "webp", "tif", "tiff", "heic", "heif")
VIDEO_EXTENSIONS = ("mp4", "mkv", "mov", "webm", "avi", "m4v", "wmv", "flv", "mpg", "mpeg", "3gp")

# Names that some file systems reserve.
RESERVED_NAMES = ("con", "prn", "aux", "nul", *(f"com{i}" for i in range(1, 10)), *(f"lpt{i}" for i in range(1, 10)))


def fold_ascii(text: Column) -> Column:
    """Lower case of A-Z alone: the folding of stored names, tags and paths."""
    return F.translate(text, UPPER, LOWER)


def fold_unicode(text: Column) -> Column:
    """Full lower case: the folding of disk listings, relinking and sort keys."""
    return F.lower(text)


def normalize_space(text: Column) -> Column:
    """Trimmed, with every run of white space as one space."""
    return F.trim(F.regexp_replace(text, r"[\s\x1c-\x1f]+", " "))


def dirname(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """The last suffix with its dot; none for names that only begin with dots."""
    return F.regexp_extract(basename(path), r"^\.*[^.].*(\.[^.]*)$", 1)


def depth(path: Column) -> Column:
    """How many folders are above the last part."""
    return F.size(F.split(path, "/")) - 1


def join_path(folder: Column, name: Column) -> Column:
    return F.when(folder == "", name).otherwise(F.concat(folder, F.lit("/"), name))


def ancestors(folder: Column) -> Column:
    """The folder and all folders above it; none for the root ''."""
    parts = F.split(folder, "/")
    every = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    return F.when(folder == "", F.array().cast("array<string>")).otherwise(every)


def in_folder(path: Column, folder: Column | str) -> Column:
    """Whether a folder path is ``folder`` or lies in it, by whole parts and A-Z folded; all are in ''."""
    folder = F.lit(folder) if isinstance(folder, str) else folder
    own, top = fold_ascii(path), fold_ascii(folder)
    return (top == "") | (own == top) | F.startswith(own, F.concat(top, F.lit("/")))


def holds_folder(path: Column, folder: Column | str) -> Column:
    """Like ``in_folder``, but a folder doesn't hold itself."""
    folder = F.lit(folder) if isinstance(folder, str) else folder
    own, top = fold_ascii(path), fold_ascii(folder)
    return ((top == "") & (own != "")) | ((top != "") & F.startswith(own, F.concat(top, F.lit("/"))))


def media_type(path: Column, mime: Column | None = None) -> Column:
    """'photo' or 'video' by extension, else by mime prefix if given, else null."""
    suffix = F.lower(F.ltrim(extension(path), F.lit(".")))
    kind = F.when(suffix.isin(*PHOTO_EXTENSIONS), "photo").when(suffix.isin(*VIDEO_EXTENSIONS), "video")
    if mime is not None:
        kind = kind.when(F.startswith(mime, F.lit("image/")), "photo").when(F.startswith(mime, F.lit("video/")), "video")
    return kind


def hidden(path: Column) -> Column:
    """Whether a part of the path begins with a dot."""
    return F.exists(F.split(path, "/"), lambda p: F.startswith(p, F.lit(".")))


def safe_path(path: Column) -> Column:
    """Whether a relative path stays inside a library: 1 to 1024 characters, no backslash, colon, NUL, and no empty, '.' or '..' part."""
    bad = F.contains(path, F.lit("\\")) | F.contains(path, F.lit(":")) | F.contains(path, F.lit("\0"))
    return F.coalesce((F.length(path).between(1, 1024)) & ~bad & ~F.exists(F.split(path, "/"), lambda p: p.isin("", ".", "..")), F.lit(False))


def _bad_part(part: Column, most: int, what: str, extra: str = "") -> Column:
    reasons = [
        (part.rlike(r"^\."), f"{what} cannot start with a dot"),
        (part.rlike(f'[<>:"|?*{extra}\\x00-\\x1f]'), f"{what} cannot contain reserved or control characters"),
        (part.rlike(r"\.$"), f"{what} cannot end with a dot"),
        (F.lower(F.substring_index(part, ".", 1)).isin(*RESERVED_NAMES), f"{what} cannot be a reserved name"),
        (F.length(part) > most, f"{what} is too long"),
    ]
    return reduce(lambda a, r: a.when(r[0], r[1]), reasons[1:], F.when(*reasons[0]))


def filename_problem(name: Column) -> Column:
    """Why a name can't be a single file's, or null if it can."""
    empty = F.coalesce(name, F.lit("")) == ""
    edges = name.rlike(r"^\s") | name.rlike(r"\s$")
    return F.when(empty | edges, "name cannot be empty or start or end with a space").otherwise(_bad_part(name, 200, "name", r"/\\"))


def album_parts(path: Column) -> Column:
    """The parts of a typed folder path: both slashes divide, spaces are normalised, empty parts go."""
    return F.filter(F.transform(F.split(F.translate(path, "\\", "/"), "/"), normalize_space), lambda p: p != "")


def album_problem(path: Column) -> Column:
    """Why a typed folder path can't be used, or null if it can: the first bad part decides."""
    found = F.filter(F.transform(album_parts(path), lambda p: _bad_part(p, 120, "album name")), lambda r: r.isNotNull())
    return F.when(F.size(album_parts(path)) == 0, "album name cannot be empty").otherwise(F.get(found, 0))


def zero_filled(number: Column, digits: int) -> Column:
    """A number with leading zeros to ``digits`` places; longer numbers stay whole."""
    text = number.cast("string")
    return F.when(F.length(text) >= digits, text).otherwise(F.lpad(text, digits, "0"))


def human_size(size: Column, units: tuple[str, ...] = ("B", "KB", "MB", "GB")) -> Column:
    """A size in the largest unit that leaves at least 1, with one decimal beyond bytes."""
    out = F.format_string("%.1f " + units[-1], size / float(1024 ** (len(units) - 1)))
    for power in range(len(units) - 2, 0, -1):
        out = F.when(size < 1024 ** (power + 1), F.format_string("%.1f " + units[power], size / float(1024**power))).otherwise(out)
    return F.when(size < 1024, F.format_string("%d " + units[0], size.cast("long"))).otherwise(out)


def shown_time(seconds: Column) -> Column:
    """A time in seconds since 1970 as a day and minute in the session's time zone."""
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd HH:mm")


def parse_names(text: Column) -> Column:
    """Comma-separated names: normalised, without empty ones; of names that fold alike the first stays."""
    names = F.filter(F.transform(F.split(text, ","), normalize_space), lambda n: n != "")
    return F.filter(names, lambda n, i: ~F.exists(F.slice(names, F.lit(1), i), lambda m: fold_unicode(m) == fold_unicode(n)))


def cache_name(path: Column, mtime: Column, size: int = 256) -> Column:
    """The name of a preview of ``size`` pixels in a cache: it changes with the file's time."""
    return F.sha1(F.concat_ws("|", path, F.lit(str(size)), mtime.cast("string")).cast("binary"))


def luma(red: Column, green: Column, blue: Column) -> Column:
    """Grey value of a colour."""
    return F.shiftright(77 * red + 150 * green + 29 * blue, 8)


def hamming(a: Column, b: Column) -> Column:
    """Bits in which two 64-bit hashes differ; signed values do."""
    return F.bit_count(a.bitwiseXOR(b))


def difference_hash(raster: Column) -> Column:
    """64 bits of a 9 x 8 grey raster, row by row, first bit highest: whether a value is above its right neighbour.

    Null unless there are 72 values and 6 to 58 bits are set.
    """
    places = F.filter(F.sequence(F.lit(0), F.lit(70)), lambda i: i % 9 < 8)
    bits = F.transform(places, lambda i: (F.get(raster, i) > F.get(raster, i + 1)).cast("long"))
    value = F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: F.shiftleft(a, 1).bitwiseOR(b))
    return F.when((F.size(raster) == 72) & F.bit_count(value).between(6, 58), value)
