"""URL rules and an exact Bloom filter cascade, in DataFrame functions only.

A url's host stands after its first ``://`` up to ``/``, ``?``, ``#`` or the
end, A-Z lower-cased; its path from there up to ``?``, ``#`` or the end.  A null
url and one without ``://`` have an empty host and path.

A rule (action, host, path) fits its host and all subdomains if the url's path
starts with the rule's; the longest rule that fits decides.  Where none fits,
the block list decides: a url is blocked if its host or a domain above it is
listed.

Membership in the list is read off a cascade of Bloom filters.  Level 1 encodes
the listed keys; level 2 the keys of the corpus that pass level 1 without being
listed; level 3 the listed keys that pass level 2 as well; and so on, until no
key of the corpus is told wrongly.  All keys that will be asked for (every host
of the corpus, with the domains above it) are known when the cascade is built,
so its answers are exact, and asking needs no join: the filters are a few
literals in the query.

Keys are cut by hash into parts whose filters stay below ``PART_BITS``, the
proven bound of what one pass holds; with several parts, the urls pass them one
after another.  An empty list blocks nothing.  Listed nulls are ignored,
repeated ones count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import keep

#: (action, rule): the rule's host stands before its first slash.
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
#: Domains of the production block list.
LISTED = ("spam-farm.example.org", "link-mill.example.org", "spam-farm.example.net", "free-bets.example.net", "casino.invalid")
#: It has as many more, made by their number: most of a real list's domains are not in a corpus either.
MORE = 10_000
BITS, HASHES = 8, 4
PART_BITS = 1 << 25
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.coalesce(F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))), F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), path


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its action; nulls if none does."""
    name, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, rule in sorted(rules, key=lambda r: len(r[1])):
        domain, _, rest = rule.partition("/")
        fits = ((host == domain) | host.endswith(f".{domain}")) & path.startswith(f"/{rest}")
        name, action = F.when(fits, rule).otherwise(name), F.when(fits, act).otherwise(action)
    return name, action


def domains(host: Column) -> Column:
    """The host and all domains above it; none of an empty host."""
    parts = F.split(host, r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    return F.when(host != "", above).otherwise(F.array().cast("array<string>"))


def _positions(key: Column, level: int, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(level * HASHES + j)), F.lit(bits).cast("long")) for j in range(HASHES)]


class Level:
    """One Bloom filter, as a literal array of 64-bit words: at most PART_BITS reach the driver."""

    def __init__(self, keys: DataFrame, count: int, number: int) -> None:
        self.number, self.bits = number, 64 * (1 + count * BITS // 64)
        n = self.bits // 64
        at = keys.select(F.explode(F.array(*_positions(F.col("key"), number, self.bits))).alias("at"))
        word = at.select(F.expr("at div 64").alias("i"), F.expr("shiftleft(1L, cast(at % 64 as int))").alias("w"))
        empty = keys.sparkSession.range(n).select(F.col("id").alias("i"), F.lit(0).cast("long").alias("w"))
        words = word.union(empty).groupBy("i").agg(F.bit_or("w").alias("w"))
        row = words.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "w"))), lambda x: x["w"])).select("*")._jdf.first()
        self.words = Column(keys.sparkSession._jvm.org.apache.spark.sql.functions.lit(row.get(0)))  # one literal, however long

    def has(self, key: Column) -> Column:
        at = F.array(*_positions(key, self.number, self.bits))
        return F.forall(at, lambda p: F.getbit(F.get(self.words, F.shiftright(p, 6).cast("int")), F.pmod(p, F.lit(64)).cast("int")) == 1)


class Cascade:
    """Exact membership for the keys it was built over."""

    def __init__(self, universe: DataFrame, listed: DataFrame) -> None:
        """universe, listed: (key), repeated or not."""
        said = universe.select("key", F.lit(False).alias("listed")).union(listed.select("key", F.lit(True).alias("listed"))).filter("key is not null")
        self.keys = keep(said.groupBy("key").agg(F.bool_or("listed").alias("listed")), "keys")
        self.levels: list[Level] = []
        wrong, yes = self.keys.filter("listed"), True
        while count := wrong.count():
            level = Level(wrong, count, len(self.levels) + 1)
            self.levels.append(level)
            others = self.keys.filter(F.col("listed") != yes)
            for earlier in self.levels:
                others = others.filter(earlier.has(F.col("key")))
            wrong, yes = keep(others, "passing"), not yes

    def has(self, key: Column) -> Column:
        """Of the levels that a key passes in a row, the last one's kind decides."""
        out = F.lit(len(self.levels) % 2 == 1)
        for level in reversed(self.levels):
            out = F.when(~level.has(key), F.lit(level.number % 2 == 0)).otherwise(out)
        return out


def judge(pages: DataFrame, listed: DataFrame, rules=RULES, url: str = "url") -> DataFrame:
    """pages with host, path, rule, listed and verdict; columns of those names are replaced.

    listed: (key), the domains to block where no rule fits.
    """
    host, path = host_and_path(F.col(url))
    out = pages.withColumn("host", host).withColumn("path", path)
    rule, action = rule_of(F.col("host"), F.col("path"), rules)
    out = out.withColumns({"rule": rule, "listed": F.lit(False)})
    universe = out.select("host").distinct().select(F.explode(domains(F.col("host"))).alias("key")).distinct()
    # level 1 takes BITS for each listed key, the others together less than BITS / 16 for each key of the corpus
    parts = 1 + (listed.count() + universe.count() // 16) * BITS * 2 // PART_BITS
    for part in range(parts):
        own = lambda key, part=part: F.pmod(F.xxhash64(key, F.lit(0)), F.lit(parts)) == part
        cascade = Cascade(universe.filter(own(F.col("key"))), listed.filter(own(F.col("key"))))
        out = out.withColumn("listed", F.col("listed") | F.exists(domains(F.col("host")), lambda key: own(key) & cascade.has(key)))
        if parts > 1:
            out = keep(out, "judged")
    verdict = F.coalesce(action, F.when(F.col("listed"), "block").otherwise("allow"))
    return out.withColumn("verdict", verdict)


def block_list(spark: SparkSession, keys=LISTED, more: int = MORE) -> DataFrame:
    made = spark.range(more).select(F.concat(F.lit("listed-"), F.col("id").cast("string"), F.lit(".example.org")).alias("key"))
    return spark.createDataFrame([(k,) for k in keys], "key string").union(made)
