"""URL filter: allow and block rules first, then a weighted vocabulary matched by an Aho-Corasick automaton."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.sources.tables import table

#: The score from which the vocabulary rejects. A strict term has it by itself, each distinct soft one a part.
LIMIT, SOFT_WEIGHT = 2.0, 1.0
#: The default vocabulary, of words that URLs of gambling, adult, drug-sale and spam sites carry. Others are loaded by ``vocabulary``.
STRICT = (
    "bdsm blackjack bookmaker camgirls camsex casino casinos cialis cybersex dildo escort escorts fetish free-bets gangbang hardcore-sex hentai incest jerkoff levitra milf nudist "
    "onlinecasino pharmacy-online phentermine playboy poker-online porn porno pornography porntube pornstar roulette sexcam sexcams sexchat sexshop slot-machine sportsbook striptease "
    "tramadol viagra voyeur webcamsex xanax xnxx xvideos xxx cheap-pills cheap-viagra"
).split()
SOFT = (
    "adult ads adserver affiliate amateur babes bet bets betting bikini bingo bonus cams cash cheap cheats clearance click clickbank coupon coupons crack cracked dating deal deals "
    "discount download-free earn erotic free freebies gamble gambling giveaway girls hack hacked hot jackpot keygen lesbian loan loans lotto lottery naked nude offer offers payday pills "
    "poker popup prescription prize promo promos replica reseller scam serial sex sexy singles slots spam spins teen teens torrent torrents track tracker warez wager webcam weightloss win winner"
).split()
WEIGHTS = dict.fromkeys(SOFT, SOFT_WEIGHT) | dict.fromkeys(STRICT, LIMIT)


def vocabulary(rows: DataFrame, most: int = 1_000_000) -> dict[str, float]:
    """The weights of a table (term, weight), in lower case, of a term listed twice the greater; over ``most`` terms raise."""
    found = rows.select(F.lower(F.trim("term")).alias("term"), F.col("weight").cast("double").alias("weight")).where("term <> '' and weight > 0")
    listed = found.groupBy("term").agg(F.max("weight").alias("weight")).limit(most + 1).collect()
    if len(listed) > most:
        raise ValueError("the vocabulary has too many terms for an automaton in each task")
    return {r["term"]: r["weight"] for r in listed}


@dataclass(frozen=True)
class UrlRules:
    """``rules``: (host, path, verdict). ``weights``: the vocabulary; a term of ``limit`` or more is strict, and several soft ones reject together."""

    rules: tuple[tuple[str, str, str], ...] = (
        ("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")
    )
    weights: dict[str, float] = field(default_factory=lambda: dict(WEIGHTS), hash=False)
    limit: float = LIMIT
    by_host: dict[str, list[tuple[str, str]]] = field(init=False, compare=False)

    def __post_init__(self) -> None:
        hosts: dict[str, list[tuple[str, str]]] = {}
        for host, path, verdict in self.rules:
            hosts.setdefault(host, []).append((path, verdict))
        for paths in hosts.values():
            paths.sort(key=lambda x: -len(x[0]))
        object.__setattr__(self, "by_host", hosts)

    def found(self, host: str, path: str) -> tuple[str, str] | None:
        """The longest rule that fits, as (rule, verdict). Hosts are looked up suffix by suffix, so many rules cost no more."""
        best, rest = None, host
        while rest:
            for p, verdict in self.by_host.get(rest, ()):
                if path.startswith(p):
                    if not best or len(rest + p) > len(best[0]):
                        best = (rest + p, verdict)
                    break
            rest = rest.partition(".")[2]
        return best


def automaton(rules: UrlRules) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for term, weight in rules.weights.items():
        found.add_word(term, (weight, term))
    if len(found):
        found.make_automaton()
    return found


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    host, tail = rest[:end], rest[end:]
    stop = min((i for i in map(tail.find, "?#") if i >= 0), default=len(tail))
    return _lower(host), tail[:stop]


_LOWER = {c: c + 32 for c in range(65, 91)}


def _lower(text: str) -> str:
    return text.translate(_LOWER)


def vocabulary_hits(url: str, terms: ahocorasick.Automaton, limit: float = LIMIT) -> tuple[int, int, float]:
    """Strict hits, counted with repeats, distinct soft terms, and the weight of all distinct terms. A term counts where no ASCII letter or digit stands beside it."""
    low = _lower(url)
    strict, seen = 0, {}
    word = lambda i: 0 <= i < len(low) and low[i].isascii() and low[i].isalnum()
    if len(terms):
        for end, (weight, term) in terms.iter(low):
            if not word(end + 1) and not word(end - len(term)):
                strict += weight >= limit
                seen[term] = weight
    return strict, sum(w < limit for w in seen.values()), float(sum(seen.values()))


SCHEMA = "id long, host string, path string, rule string, verdict string, strict_hits int, soft_terms int, weight double"


def judged(pages: DataFrame, rules: UrlRules = UrlRules(), id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Each row's id, host, path, rule, verdict, strict_hits, soft_terms, weight. Row-local, with no shuffle.

    The longest fitting rule decides; without one, the vocabulary blocks a URL whose distinct terms weigh
    ``rules.limit`` or more, as one strict term does and several soft ones do, and allows any other. A null URL has neither host nor path and is
    allowed, as is one without ``://`` that holds no terms. Repeated rows are judged alike.
    """

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = automaton(rules)
        for batch in batches:
            rows = []
            for url in batch.column(1).to_pylist():
                host, path = split_url(url)
                rule = rules.found(host, path)
                strict, soft, weight = vocabulary_hits(url or "", terms, rules.limit)
                rows.append((host, path, *(rule or (None, "block" if weight >= rules.limit else "allow")), strict, soft, weight))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
            kinds = [pa.string()] * 4 + [pa.int32()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                names=["id", "host", "path", "rule", "verdict", "strict_hits", "soft_terms", "weight"]
            )

    return pages.selectExpr(f"cast(`{id_col}` as long) as id", f"`{url_col}` as url").mapInArrow(judge, SCHEMA)


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's verdict."""
    return judged(table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")


def _sql_values(terms: list[str], weight: float) -> str:
    return ", ".join(f"('{t}', {weight})" for t in terms)


#: Boundaries are doubled before terms are counted, as neighbours may share one.
OP10_SQL = rf"""
WITH u AS (SELECT page_id, row_number() OVER () AS row, translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
coalesce(regexp_extract(url, '^.*?://(.*)$', 1, 's'), '') AS rest FROM pages),
h AS (SELECT page_id, row, low, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
      regexp_extract(regexp_extract(rest, '^[^/?#]*(.*)$', 1, 's'), '^[^?#]*') AS path FROM u),
r(rule_host, rule_path, rule_verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com',
'/de/', 'block')),
m AS (SELECT row, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule, arg_max(rule_verdict, length(rule_host || rule_path)) AS rule_verdict
      FROM h JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY row),
t(term, weight) AS (VALUES {_sql_values(STRICT, LIMIT)}, {_sql_values(SOFT, SOFT_WEIGHT)}),
n AS (SELECT row, term, weight, len(regexp_extract_all(regexp_replace(low, '([^a-z0-9])', '\1\1', 'g'), '(^|[^a-z0-9])' || replace(term, '-', '--') || '($|[^a-z0-9])')) AS hits
FROM h JOIN t ON contains(low, term)),
w AS (SELECT row, sum(CASE WHEN weight >= {LIMIT} THEN hits ELSE 0 END)::INT AS strict_hits, count(*) FILTER (weight < {LIMIT})::INT AS soft_terms, sum(weight)::DOUBLE AS weight
FROM n WHERE hits > 0 GROUP BY row)
SELECT page_id, host, path, rule, coalesce(rule_verdict, CASE WHEN coalesce(weight, 0) >= {LIMIT} THEN 'block' ELSE 'allow' END) AS verdict, coalesce(strict_hits, 0)
AS strict_hits, coalesce(soft_terms, 0) AS soft_terms, coalesce(weight, 0) AS weight
FROM h LEFT JOIN m USING (row) LEFT JOIN w USING (row)
"""
