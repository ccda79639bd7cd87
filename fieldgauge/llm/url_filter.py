"""URL filters: rules by host and path, and exact membership in a list of any size by a Bloom filter cascade.

A Bloom filter errs for some keys that are not listed. The corpus says which keys can be asked for, so
the errors are known: a second filter holds them, a third the listed keys that the second one holds by
error, and so on until none is left. For keys of this corpus the cascade then never errs, and it is a
small literal of the plan: no join reaches the urls.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldgauge.llm.common import durable, free_name

A_TO_Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Characters of the longest name that the domain name system has; no listed domain is longer.
LONGEST_NAME = 253
#: Bits of all levels that go with each task (8 MB, for some four million listed keys); beyond, keys are joined with the list.
MOST_BITS = 1 << 26
#: Errors of all levels but the first.
LATER_RATE = 0.25


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null and where there is no ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substring_index(url, "://", 1))
    rest = F.coalesce(F.substring(url, F.length(rest) + 4, F.length(url)), F.lit(""))
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), A_TO_Z, A_TO_Z.lower()), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


@dataclass(frozen=True)
class Rule:
    """A verdict for a host with all its subdomains and for paths that start with ``path``."""

    verdict: str
    host: str
    path: str = "/"

    def __str__(self) -> str:
        return self.host + self.path


def decide(rules: list[Rule], host: Column, path: Column) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, null where none does; of rules of one name the first counts.

    Of rules that are equally long that of the longer host wins. The rules are one conditional expression,
    so they should be few (a thousand at most); long lists belong in the cascade.
    """
    name = verdict = F.lit(None).cast("string")
    for r in sorted(reversed(rules), key=lambda r: (len(str(r)), len(r.host))):
        fits = ((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path)
        name, verdict = F.when(fits, F.lit(str(r))).otherwise(name), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return name, verdict


def domains(host: Column) -> Column:
    """The host and its parent domains, each followed by a slash; names that no domain can have are left out."""
    end = F.reverse(F.substring(F.reverse(host), 1, LONGEST_NAME + 1))  # a longer host: only its end can be listed
    labels = F.split(end, r"\.")
    whole = F.length(host) <= LONGEST_NAME
    first = F.when(whole, 1).otherwise(2)
    names = F.transform(F.sequence(first, F.greatest(first, F.size(labels))), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    return F.transform(F.filter(names, lambda x: x != ""), lambda x: F.concat(x, F.lit("/")))


def keys_of(host: Column, path: Column) -> Column:
    """The keys under which a url can be listed: its domains and the page itself (host and path)."""
    page = F.when(F.length(path) > 1, F.array(F.concat(host, path))).otherwise(F.array().cast("array<string>"))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.concat(domains(host), page))


@dataclass
class Level:
    """Bits of one filter in words of 64, and how keys are hashed into them."""

    number: int
    bits: int
    hashes: int
    words: list[int] = field(default_factory=list)

    def positions(self, key: Column) -> list[Column]:
        """Double hashing: two hashes below 2**40 give all positions."""
        a, b = (F.pmod(F.xxhash64(F.lit(2 * self.number + i), key), F.lit(1 << 40)) for i in (0, 1))
        return [(a + i * b) % self.bits for i in range(self.hashes)]

    def holds(self, key: Column) -> Column:
        # a list that is parsed from one text is folded into a literal array when the plan is made
        words = F.split(F.lit(",".join(map(str, self.words))), ",").cast("array<bigint>")
        found = F.lit(True)
        for at in self.positions(key):
            found = found & (F.getbit(F.get(words, F.floor(at / 64).cast("int")), (at % 64).cast("int")) == 1)
        return found


def _level(keys: DataFrame, n: int, number: int, rate: float) -> Level:
    """A filter of the n keys whose share of errors is ``rate``; the driver gets one number for 64 bits."""
    bits = max(64, math.ceil(n * math.log(1 / rate) / math.log(2) ** 2))
    out = Level(number, bits, max(1, round(math.log2(1 / rate))))
    at = keys.select(F.explode(F.array(*out.positions(F.col("key")))).alias("at"))
    rows = at.groupBy(F.floor(F.col("at") / 64).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("at") % 64).cast("int"))).alias("bits")).collect()
    out.words = [0] * (bits // 64 + 1)
    for r in rows:
        out.words[r.word] = r.bits
    return out


@dataclass
class Cascade:
    """Levels that alternately hold listed keys and errors; exact for the keys it was built with."""

    levels: list[Level]

    def has(self, key: Column) -> Column:
        """Whether the key is listed: the first level that does not hold it decides."""
        out = F.lit(len(self.levels) % 2 == 1)
        for level in reversed(self.levels):
            out = F.when(level.holds(key), out).otherwise(F.lit(level.number % 2 == 0))
        return out

    @property
    def bits(self) -> int:
        return sum(x.bits for x in self.levels)


def cascade(universe: DataFrame, listed: DataFrame, most_bits: int = MOST_BITS) -> Cascade | None:
    """The cascade for the listed keys among all keys that will be asked for (columns ``key``, repeats allowed).

    None if it would have more than ``most_bits`` bits. The universe is counted approximately, which sizes the
    first level only, and then streamed through that level: what is shuffled is what the level holds, about
    twice as many keys as are listed. Null keys are never listed.
    """
    listed = durable(listed.where("key is not null").select("key").distinct())
    n = listed.count()
    if not n:
        return Cascade([])
    everything = universe.agg(F.approx_count_distinct("key")).first()[0]
    rate = min(0.5, max(n / max(everything, 1), 1e-6))
    if n * math.log(1 / rate) / math.log(2) ** 2 > most_bits:
        return None
    levels = [_level(listed, n, 1, rate)]
    held = durable(universe.select("key").where(levels[0].holds(F.col("key"))).distinct())
    other = held.join(listed, "key", "left_semi")  # listed keys of the corpus
    errors = durable(held.join(listed, "key", "left_anti"))
    while n := errors.count():
        level = _level(errors, n, len(levels) + 1, LATER_RATE)
        levels.append(level)
        if sum(x.bits for x in levels) > most_bits:
            return None
        errors, other = durable(other.where(level.holds(F.col("key")))), errors
    return Cascade(levels)


def with_membership(df: DataFrame, keys: str, listed: DataFrame, out_col: str = "listed", most_bits: int = MOST_BITS) -> DataFrame:
    """Adds whether any key of the array column ``keys`` is in ``listed`` (column ``key``), exactly.

    Null and empty arrays, and null keys, are not listed; an empty list lists nothing. A list whose cascade would
    exceed ``most_bits`` is joined instead: rows whose keys meet it are found by id, so no row is repeated.
    """
    made = cascade(df.select(F.explode(keys).alias("key")), listed, most_bits)
    if made is not None:
        return df.withColumn(out_col, F.coalesce(F.exists(keys, made.has), F.lit(False)))
    row, hit = free_name(df, "_row"), free_name(df, "_hit")
    rows = durable(df.withColumn(row, F.monotonically_increasing_id()))
    met = rows.select(F.col(row).alias(hit), F.explode(keys).alias("key")).join(listed.select("key").distinct(), "key", "left_semi").select(hit).distinct()
    return rows.join(met, rows[row] == met[hit], "left").withColumn(out_col, F.col(hit).isNotNull()).drop(row, hit)


def judged(pages: DataFrame, rules: list[Rule], listed: DataFrame, url_col: str = "url", most_bits: int = MOST_BITS) -> DataFrame:
    """The rows with host, path, rule, listed and verdict: that of the longest rule, else block if listed.

    Columns that have a result's name, in letters of any case, are replaced. Repeated rows are judged alike; a
    url that is null or has no host is allowed unless a rule says otherwise; no url is too long.
    """
    made, keys = {"host", "path", "rule", "listed", "verdict"}, free_name(pages, "_keys")
    own = [c for c in pages.columns if c.lower() not in made]
    host, path = host_and_path(F.col(url_col))
    split = pages.select(*own, host.alias("host"), path.alias("path"))
    split = with_membership(split.withColumn(keys, keys_of(F.col("host"), F.col("path"))), keys, listed, "listed", most_bits)
    name, verdict = decide(rules, F.col("host"), F.col("path"))
    return split.select(*own, "host", "path", name.alias("rule"), "listed", F.coalesce(verdict, F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"))


def kept(pages: DataFrame, rules: list[Rule], listed: DataFrame, url_col: str = "url") -> DataFrame:
    """The rows that are allowed, with the columns of ``pages``."""
    name = free_name(pages, "_judged")
    return judged(pages.select(F.struct(*pages.columns).alias(name), F.col(url_col).alias("_url")), rules, listed, "_url").where("verdict = 'allow'").select(f"{name}.*")


#: Rules of the registered query.
RULES = [Rule("allow", "org"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"), Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/")]
#: A name of two or more of these words, joined by dashes, is that of a domain made for spam.
SPAM_WORDS = ["ads", "adult", "bets", "bonus", "casino", "cheap", "farm", "free", "loans", "pills", "poker", "spam", "track", "win", "x"]


def spam_domains(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """``key``: the domains of the corpus whose first label is made of spam words alone, as a list for the cascade."""
    name = F.explode(domains(host_and_path(F.col(url_col))[0])).alias("key")
    word = "|".join(SPAM_WORDS)
    return pages.select(name).where(F.col("key").rlike(rf"^(?:{word})(?:-(?:{word}))+[./]")).distinct()


def filtered_urls(pages: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict and listed of each page."""
    return judged(pages.select("page_id", "url"), RULES, spam_domains(pages)).select("page_id", "host", "path", "rule", "verdict", "listed")


ORACLE = r"""
WITH p AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
q AS (SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
s AS (SELECT *, '.' || host AS h,
        len(list_filter(string_split(host, '.'), lambda x: regexp_full_match(x, '({words})(-({words}))+'))) > 0 AS listed FROM q),
t AS (SELECT *, CASE WHEN ends_with(h, '.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
        WHEN ends_with(h, '.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
        WHEN ends_with(h, '.com') AND starts_with(path, '/fr/') THEN 'com/fr/' WHEN ends_with(h, '.com') AND starts_with(path, '/de/') THEN 'com/de/'
        WHEN ends_with(h, '.org') AND starts_with(path, '/') THEN 'org/' END AS rule FROM s)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL OR listed THEN 'block' ELSE 'allow' END AS verdict, listed
FROM t
""".replace("{words}", "|".join(SPAM_WORDS))
