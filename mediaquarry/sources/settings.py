"""Settings as a table of keys and values, some of them JSON."""

from __future__ import annotations

import json
import posixpath
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def get_setting(settings: DataFrame, key: str, default: str | None = None) -> str | None:
    row = settings.where(F.col("key") == key).select("value").first()
    return default if row is None else row[0]


def set_setting(settings: DataFrame, key: str, value: str) -> DataFrame:
    new = settings.sparkSession.range(1).select(F.lit(key).alias("key"), F.lit(value).alias("value"))
    return settings.where(F.col("key") != key).unionByName(new)


def machine_id(settings: DataFrame) -> tuple[DataFrame, str]:
    """This machine's id, twelve hexadecimal digits, made and stored at the first call; returns the settings with it."""
    own = get_setting(settings, "machine_id")
    if own:
        return settings, own
    own = uuid.uuid4().hex[:12]
    return set_setting(settings, "machine_id", own), own


def roots(settings: DataFrame) -> DataFrame:
    """Library roots in their stored order, each once, as absolute paths without '.', '..' and double slashes: root, pos.

    What is no JSON list gives no roots.
    """
    stored = get_setting(settings, "roots", "[]")
    try:
        listed = json.loads(stored)
    except ValueError:
        listed = []
    paths = dict.fromkeys(posixpath.abspath(posixpath.expanduser(r)) for r in listed if isinstance(r, str)) if isinstance(listed, list) else {}
    return settings.sparkSession.createDataFrame([(r, i) for i, r in enumerate(paths)], "root string, pos int")
