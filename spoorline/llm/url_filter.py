"""URL filter: host and path rules first, then a weighted vocabulary.

Rules name a host with a path; a rule fits its host and all subdomains if the
url's path starts with the rule's, and the longest one that fits decides. Urls
that no rule fits are scanned by an Aho-Corasick automaton for whole terms
(bounded by anything but a-z and 0-9): one strict term or several distinct
soft terms, weighed against a limit, reject the url.

Defined results: a null url, or one without ``://``, has an empty host and
path; a null url meets no term and is allowed; repeated urls give repeated
rows; a term counts once however often it occurs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import UPPER, ascii_lower


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (
    UrlRule("allow", "com", "/"),
    UrlRule("block", "example.com", "/en/"),
    UrlRule("allow", "www.example.com", "/en/"),
    UrlRule("block", "net", "/es/"),
    UrlRule("block", "net", "/fr/"),
)
#: One of these rejects a url.
STRICT = "adult casino casinos escort gambling hentai nude porn porno sexcam spam viagra warez xxx xnxx".split()
#: Weights of terms that reject together, when they reach LIMIT.
SOFT = {
    "ads": 1, "bet": 1, "bets": 1, "betting": 1, "bonus": 1, "cheap": 1, "click": 1, "coupon": 1, "crack": 1, "dating": 1, "deal": 1, "deals": 1, "discount": 1, "farm": 1,
    "free": 1, "loan": 1, "loans": 1, "lottery": 1, "pharmacy": 1, "pill": 1, "pills": 1, "poker": 1, "popup": 1, "prize": 1, "promo": 1, "redirect": 1, "replica": 1, "slots": 1,
    "torrent": 1, "track": 1, "tracker": 1, "win": 1, "winner": 1,
}
LIMIT = 2


def build_automaton(strict: list[str], soft: dict[str, int], limit: int) -> ahocorasick.Automaton:
    auto = ahocorasick.Automaton()
    for term, weight in soft.items():
        auto.add_word(term, (term, weight))
    for term in strict:
        auto.add_word(term, (term, limit))
    auto.make_automaton()
    return auto


def term_weight(auto: ahocorasick.Automaton, url: str) -> int:
    """Weights of the distinct whole terms in a lower-cased url."""
    seen: dict[str, int] = {}
    n = len(url)
    word = "abcdefghijklmnopqrstuvwxyz0123456789"
    for end, (term, weight) in auto.iter(url):
        start = end - len(term) + 1
        if (start == 0 or url[start - 1] not in word) and (end + 1 == n or url[end + 1] not in word):
            seen[term] = weight
    return sum(seen.values())


def filter_urls(
    pages: DataFrame,
    url_col: str = "url",
    rules: tuple[UrlRule, ...] = RULES,
    strict: list[str] = STRICT,
    soft: dict[str, int] = SOFT,
    limit: int = LIMIT,
) -> DataFrame:
    """Add host, path, rule, term_weight and verdict to ``pages``."""
    to_lower = str.maketrans(UPPER, UPPER.lower())

    @F.pandas_udf("long")
    def weigh(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        auto = build_automaton(strict, soft, limit)
        for urls in batches:
            yield pd.Series([term_weight(auto, u.translate(to_lower)) if u else 0 for u in urls], dtype="int64")

    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce(F.col(url_col), F.lit(""))
    out = pages.withColumns({"host": ascii_lower(F.regexp_extract(url, parts, 1)), "path": F.regexp_extract(url, parts, 2)})
    host, path = F.col("host"), F.col("path")
    fits = [(r, ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)) for r in sorted(rules, key=lambda r: -len(r.text))]
    out = out.withColumns(
        {
            "rule": F.coalesce(*[F.when(c, F.lit(r.text)) for r, c in fits], F.lit(None).cast("string")),
            "__v": F.coalesce(*[F.when(c, F.lit(r.verdict)) for r, c in fits], F.lit(None).cast("string")),
            "term_weight": weigh(F.col(url_col)),
        }
    )
    return out.withColumn("verdict", F.coalesce("__v", F.when(F.col("term_weight") >= limit, "block").otherwise("allow"))).drop("__v")


def oracle_sql() -> str:
    """The same for DuckDB, with one pattern for each term."""
    url = "translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    weights = SOFT | {t: LIMIT for t in STRICT}
    total = " + ".join(f"CASE WHEN regexp_matches(u, '(^|[^a-z0-9]){t}($|[^a-z0-9])') THEN {w} ELSE 0 END" for t, w in weights.items())
    ordered = sorted(RULES, key=lambda r: -len(r.text))
    when = lambda pick: "CASE " + " ".join(f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{pick(r)}'" for r in ordered) + " END"
    return f"""
WITH p AS (
  SELECT page_id, {url} AS u,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path
  FROM pages),
w AS (SELECT *, CAST({total} AS BIGINT) AS term_weight FROM p)
SELECT page_id, host, path, {when(lambda r: r.text)} AS rule,
       coalesce({when(lambda r: r.verdict)}, CASE WHEN term_weight >= {LIMIT} THEN 'block' ELSE 'allow' END) AS verdict,
       term_weight
FROM w"""
