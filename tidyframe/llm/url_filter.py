"""URL verdicts: host and path rules first, else a weighted vocabulary found by Aho-Corasick.

A term counts only between boundaries (no ASCII letter or digit beside it). One strict term, or
``soft_limit`` different soft terms, reject a URL; the rest are allowed.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator, Sequence

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

# The terms that reject at once, and those of which several do.
STRICT = (
    "porn", "porno", "pornography", "xxx", "hentai", "milf", "blowjob", "hardcore", "camgirl", "camgirls", "escort", "escorts", "nsfw", "xvideos", "upskirt", "creampie",
    "adult-x", "free-bets", "sportsbook", "viagra", "cialis", "levitra", "xanax", "tramadol", "payday-loan", "payday-loans",
    "warez", "keygen", "malware", "phishing", "ransomware", "botnet", "spyware",
)
SOFT = (
    "adult", "adults", "sex", "sexy", "nude", "nudes", "erotic", "fetish", "amateur", "cam", "cams", "webcam", "dating", "hookup", "singles", "hot", "girls",
    "bet", "bets", "betting", "casino", "casinos", "poker", "slots", "roulette", "blackjack", "bingo", "lottery", "gambling", "jackpot", "wager", "odds", "win", "winner", "prize", "bonus",
    "pills", "pharmacy", "pharma", "drugs", "meds", "diet", "weight-loss", "loan", "loans", "payday", "credit", "debt", "cash", "money", "earn", "rich", "crypto", "forex",
    "free", "cheap", "discount", "replica", "deal", "deals", "promo", "offer", "offers", "click", "spam", "farm", "ads", "track", "popup", "traffic", "backlinks", "torrent", "torrents", "crack", "cracked", "serial", "download",
)
SOFT_LIMIT = 2
#: (verdict, host and path prefix)
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; '' without ://."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end; '' without ://."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Iterable[tuple[str, str]]) -> Column:
    """The longest rule whose host is this or a parent domain and whose path starts this path; else null."""
    found = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: len(r[1])):
        own, _, rest = rule.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith("/" + rest)
        found = F.when(fits, rule).otherwise(found)
    return found


@functools.lru_cache(maxsize=8)
def _automaton(strict: tuple[str, ...], soft: tuple[str, ...]) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for term in soft:
        a.add_word(term, (term, False))
    for term in strict:
        a.add_word(term, (term, True))
    a.make_automaton()
    return a


def _inner(c: str) -> bool:
    return c.isascii() and c.isalnum()


def rejected(url: str, strict: tuple[str, ...], soft: tuple[str, ...], limit: int) -> bool:
    """Whether the vocabulary rejects the URL; matching folds A-Z."""
    url, met = url.translate(str.maketrans(_UPPER, _LOWER)), set()
    for end, (term, hard) in _automaton(strict, soft).iter(url):
        start = end - len(term)
        if start >= 0 and _inner(url[start]) or end + 1 < len(url) and _inner(url[end + 1]):
            continue
        met.add(term)
        if hard or len(met) >= limit:
            return True
    return False


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, strict: Sequence[str] = STRICT, soft: Sequence[str] = SOFT, soft_limit: int = SOFT_LIMIT, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict) for every row of ``pages``.

    Null and malformed URLs have an empty host and path and no rule; null ones are allowed, as
    they hold no term. Repeated rows stay repeated; an empty table gives no rows; further
    columns are left out. A term given as strict and soft counts as strict. Very long URLs are
    searched whole.
    """
    strict, soft = tuple(strict), tuple(soft)

    @F.pandas_udf("boolean")
    def reject(urls: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for u in urls:
            yield u.map(lambda x: x is not None and rejected(x, strict, soft, soft_limit))

    verdicts = {rule: verdict for verdict, rule in rules}
    parts = pages.select(F.col(id_col).alias("page_id"), F.coalesce(F.col(url_col), F.lit("")).alias("url")).withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    ruled = parts.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    ruled = ruled.withColumn("rejected", reject(F.when(F.col("rule").isNull(), F.col("url"))))  # what a rule settles is not searched
    own = F.when(F.col("rejected"), "block").otherwise("allow")
    by_rule = F.when(F.col("rule").isin(*[r for r, v in verdicts.items() if v == "block"]), "block").otherwise("allow")
    return ruled.select("page_id", "host", "path", "rule", F.when(F.col("rule").isNull(), own).otherwise(by_rule).alias("verdict"))
