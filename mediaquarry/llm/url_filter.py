"""URL filter: host and path rules first, else a weighted vocabulary found by an Aho-Corasick automaton.

Hosts, paths and rules are column expressions. Only the automaton runs in Python, over the whole url.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache
from hashlib import sha256
from pathlib import Path
from typing import NamedTuple

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = _UPPER.lower()
_FOLD = str.maketrans(_UPPER, _LOWER)

#: The vocabulary that comes with the package: a header, then term, kind and weight, separated by tabs.
TERMS = Path(__file__).with_name("url_terms.tsv")
TERMS_SHA256 = "0211f836bfbd39373dc9abf340b6f966cde501915c77adf58477643dc32c95a2"
#: A strict term has this weight, so that one rejects.
LIMIT = 6


class Rule(NamedTuple):
    """``verdict`` for ``host`` and its subdomains where the path starts with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


class Term(NamedTuple):
    """A term in lower case; ``kind`` is strict or soft."""

    term: str
    kind: str
    weight: int


def load_terms(path: str | Path = TERMS, digest: str | None = None) -> tuple[Term, ...]:
    """The terms of a file, which the driver reads; ``digest``, its SHA-256, is checked where it is given."""
    data = Path(path).read_bytes()
    if digest is not None and sha256(data).hexdigest() != digest:
        raise ValueError(f"{path} is not the file with SHA-256 {digest}")
    rows = [line.split("\t") for line in data.decode().splitlines()[1:]]
    return tuple(Term(term, kind, int(weight)) for term, kind, weight in rows)


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for a null url or one without ``://``."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def match_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest fitting rule as (name, verdict), null if none fits; of equally long ones that of the longer host, then block."""
    found = F.lit(None).cast("struct<name: string, verdict: string>")
    for rule in sorted(rules, key=lambda r: (len(r.name), len(r.host), r.verdict == "block")):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        found = F.when(fits, F.struct(F.lit(rule.name).alias("name"), F.lit(rule.verdict).alias("verdict"))).otherwise(found)
    return found


@lru_cache(maxsize=8)
def vocabulary(terms: tuple[Term, ...]) -> ahocorasick.Automaton:
    """One automaton for all terms; of a term that is listed twice the heavier entry counts."""
    found = ahocorasick.Automaton()
    for term in sorted(terms, key=lambda t: t.weight):
        found.add_word(term.term, term)
    found.make_automaton()
    return found


def count_terms(text: str, automaton: ahocorasick.Automaton) -> tuple[int, int, int, int, int]:
    """Distinct strict and soft terms in ``text`` that no letter or digit touches on either side, how often either kind
    occurs, and the weight of the distinct ones."""
    hits: dict[Term, int] = {}
    if len(automaton):
        for end, term in automaton.iter(text):
            start = end - len(term.term) + 1
            if not (start and text[start - 1].isalnum()) and not text[end + 1 : end + 2].isalnum():
                hits[term] = hits.get(term, 0) + 1
    strict = [n for t, n in hits.items() if t.kind == "strict"]
    soft = [n for t, n in hits.items() if t.kind != "strict"]
    return len(strict), len(soft), sum(strict), sum(soft), sum(t.weight for t in hits)


def url_filter(
    pages: DataFrame,
    *,
    rules: Sequence[Rule] = (),
    terms: Sequence[Term] | None = None,
    limit: int = LIMIT,
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """Judge every url: id, host, path, rule, verdict, strict_hits, soft_hits, strict_count, soft_count, weight.

    A fitting rule decides; rules see host and path only, and become one expression, so they are meant to be
    tens. Else the vocabulary (``terms``; those of the package if None) is looked up in the whole url, lower-cased
    (A-Z), with query string and fragment: distinct terms whose weights come to ``limit`` block, so one
    strict term does or several soft ones. Hits are distinct terms, counts all places. A null url, an empty one and one
    without ``://`` have an empty host and path and no rule; the vocabulary decides on the last, the others
    have the verdict allow. Null ids are kept. Repeated rows give repeated rows; an empty table gives an
    empty result. Other columns are not read.
    """
    held = tuple(load_terms(TERMS, TERMS_SHA256) if terms is None else terms)

    def found(urls: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        automaton = vocabulary(held)
        for part in urls:
            rows = [count_terms(url.translate(_FOLD), automaton) for url in part]
            yield pd.DataFrame(rows, columns=["strict_hits", "soft_hits", "strict_count", "soft_count", "weight"])

    counted = F.pandas_udf(found, "strict_hits int, soft_hits int, strict_count int, soft_count int, weight int")
    url = F.col(url_col).cast("string")
    host, path = split_url(url)
    rows = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"), counted(F.coalesce(url, F.lit(""))).alias("hits"))
    judged = rows.select("id", "host", "path", match_rule(F.col("host"), F.col("path"), rules).alias("own"), "hits")
    verdict = F.coalesce("own.verdict", F.when(F.col("hits.weight") >= limit, "block").otherwise("allow"))
    return judged.select(F.col("id").alias(id_col), "host", "path", F.col("own.name").alias("rule"), verdict.alias("verdict"), "hits.*")
