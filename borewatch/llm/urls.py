"""URL filters: host and path rules by longest fit, then pattern rules found by their rarest literal token.

DataFrame functions only. A pattern rule states, for each way in which it can match, the literal tokens that the URL
must hold then. It is filed under the rarest token of every way, by counts over the URLs at hand; a URL looks up its
tokens there, and only the rules it finds run their regular expression on it. No rule runs on every URL: one that states
no token is refused.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from borewatch.llm.common import ascii_lower, join_counted, materialise


@dataclass(frozen=True)
class Pattern:
    """A regular expression over the URL in lower case, the verdict it carries, and for each way to match the tokens that
    it can't match without."""

    name: str
    regex: str
    verdict: str
    ways: tuple[tuple[str, ...], ...]


HOST = r"://([^/?#]*[.\-])?"


def _site(name: str, *tokens: str, end: str = r"([.\-][^/?#]*)?([/?#]|$)") -> Pattern:
    return Pattern(name, HOST + "-".join(tokens) + end, "block", (tokens,))


#: Production rules: gambling, adult, pills, advertising and spam hosts, and addresses that hold no prose.
PATTERNS = (
    _site("casino", "casino"),
    _site("free-bets", "free", "bets"),
    _site("poker", "poker"),
    _site("slots", "slots"),
    _site("adult", "adult"),
    _site("porn", "porn"),
    _site("cheap-pills", "cheap", "pills"),
    _site("viagra", "viagra"),
    _site("ads-track", "ads", "track"),
    _site("spam-farm", "spam", "farm"),
    _site("doubleclick", "doubleclick"),
    Pattern("affiliate-link", r"[?&]aff(iliate)?_id=[0-9]+", "block", (("aff", "id"), ("affiliate", "id"))),
    Pattern("session-link", r"[?&]phpsessid=[0-9a-f]+", "block", (("phpsessid",),)),
    Pattern("cart", r"/(cart|checkout)/(add|step)[/?]", "block", (("cart",), ("checkout",))),
    Pattern("search-page", r"/search\?([^#]*&)?q=", "block", (("search", "q"),)),
    Pattern("archive", r"\.(zip|rar|7z)([?#]|$)", "block", (("zip",), ("rar",), ("7z",))),
)

#: Host and path rules: (host, path, verdict).
HOST_RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)


def host_of(url: Column) -> Column:
    """From the first `://` to the next `/`, `?`, `#` or the end, A-Z in lower case; empty without `://`."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """From the end of the host to the next `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens_of(url: Column) -> Column:
    """Runs of letters and digits of the URL in lower case, each once."""
    return F.array_distinct(F.array_remove(F.split(ascii_lower(url), "[^a-z0-9]+"), ""))


RULES = "rank int, name string, regex string, verdict string, ways array<array<string>>"


def pattern_table(spark: SparkSession, patterns: tuple[Pattern, ...] | DataFrame) -> DataFrame:
    """Pattern rules as a table (see RULES), from rules written here or from one that is kept elsewhere. The first rank
    that matches wins. Rules without a way, or with a way that states no token, are refused."""
    if isinstance(patterns, DataFrame):
        rules = patterns.select(*(c.split()[0] for c in RULES.split(", ")))
    else:
        rules = spark.createDataFrame(
            [(i, p.name, p.regex, p.verdict, [list(w) for w in p.ways]) for i, p in enumerate(patterns)], RULES
        )
    sound = F.coalesce((F.size("ways") > 0) & F.forall("ways", lambda w: F.coalesce(F.size(w) > 0, F.lit(False))), F.lit(False))
    bare = [r["name"] for r in rules.where(~sound).limit(5).collect()]
    if bare:
        raise ValueError(f"pattern rules without a literal token for each way to match: {bare}")
    return rules


def pattern_index(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Rows (token, rank, name, regex, verdict): each rule under the rarest token of every way, by counts over `urls`."""
    ways = rules.select("rank", "name", "regex", "verdict", F.posexplode("ways").alias("way", "tokens"))
    asked = materialise(ways.select("rank", "name", "regex", "verdict", "way", F.explode("tokens").alias("token")))
    seen = urls.select(F.explode(tokens_of(F.col("url"))).alias("token"))
    counts = join_counted(seen, asked.select("token").distinct(), ["token"], "left_semi").groupBy("token").agg(F.count("*").alias("n"))
    counted = asked.join(counts, "token", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rarest = counted.groupBy("rank", "name", "regex", "verdict", "way").agg(F.min_by("token", F.struct("n", "token")).alias("token"))
    return rarest.drop("way").distinct()


def candidates(urls: DataFrame, index: DataFrame) -> DataFrame:
    """(url, rank, name, regex, verdict): the rules whose token a URL holds, the only ones to run on it."""
    asks = urls.select("url", F.explode(tokens_of(F.col("url"))).alias("token"))
    found = join_counted(asks, index, ["token"], "inner").drop("token")
    # rules stand together, so an expression is compiled once for all the URLs of a task that it runs on
    return materialise(found.sortWithinPartitions("rank"))


def judge(
    pages: DataFrame,
    *,
    url: str = "url",
    page_id: str = "page_id",
    host_rules: tuple[tuple[str, str, str], ...] = HOST_RULES,
    patterns: tuple[Pattern, ...] | DataFrame = PATTERNS,
) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, pattern.

    A host rule fits its host and all subdomains where the path starts with the rule's; the longest text of host and
    path wins, then the longer host. Where none fits, the verdict is that of the first pattern rule (in their order)
    that matches, else `allow`. Null URLs, and those without `://`, have an empty host and path; patterns still look at
    what text there is. Each different URL is judged once, and pages that repeat it, or its id, read that judgement.
    Empty tables give no rows; other columns are not looked at. Pattern rules may be a table of any size (see RULES); both
    rule tables are joined by broadcast up to a counted size.
    """
    spark = pages.sparkSession
    narrow = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"))
    urls = materialise(
        narrow.where("url is not null").select("url").distinct().withColumns(
            {"host": host_of(F.col("url")), "path": path_of(F.col("url"))}
        )
    )
    site = spark.createDataFrame(
        [(h, p, v) for h, p, v in host_rules], "rule_host string, rule_path string, rule_verdict string"
    )
    labels = F.split("host", r"\.", -1)
    ends = F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels) - i + 1), ".")
    )
    ends = urls.where("host <> ''").select("url", "path", F.explode(ends).alias("rule_host"))
    fitting = join_counted(ends, site, ["rule_host"], "inner").where(F.expr("startswith(path, rule_path)"))
    rule = F.concat("rule_host", "rule_path")
    fitting = fitting.groupBy("url").agg(
        F.max_by(
            F.struct(rule.alias("rule"), F.col("rule_verdict").alias("verdict")),
            F.struct(F.length(rule), F.length("rule_host"), rule),
        ).alias("site")
    )
    index = materialise(pattern_index(urls, pattern_table(spark, patterns)))
    matching = candidates(urls.select("url"), index).where(F.expr("lower(url) rlike regex"))
    matching = matching.groupBy("url").agg(F.min_by(F.struct("name", "verdict"), "rank").alias("found"))
    judged = urls.join(fitting, "url", "left").join(matching, "url", "left")
    out = narrow.join(judged, "url", "left")
    return out.select(
        "page_id",
        F.coalesce("host", F.lit("")).alias("host"),
        F.coalesce("path", F.lit("")).alias("path"),
        F.col("site.rule").alias("rule"),
        F.coalesce("site.verdict", "found.verdict", F.lit("allow")).alias("verdict"),
        F.when(F.col("site.rule").isNull(), F.col("found.name")).alias("pattern"),
    )
