r"""URL rules, indexed by their rarest literal token.

A rule is a pattern over `host + path` of a URL: `||` at the start anchors at the host or at a dot
within it, `*` stands for any characters, and all else is literal. Its literal tokens are the runs of
[a-z0-9] (A-Z lower-cased) that other literal characters or the anchor delimit on both sides; such a run
must be a whole token of each URL that the rule fits. Each rule is filed under the one of its tokens that
is rarest in the URLs at hand (ties: the first in code point order). The tokens of a URL fetch the rules
filed under them, and only these run their regular expression. A rule without such a token is filed under
the empty token, which every URL has. The longest rule that fits wins (ties: the first in code point order).

URLs are judged once per distinct host and path, so that a URL shared by many rows is one row in the search.
The rule table is a parameter of the job, of any size: a DataFrame that `compiled` turns into expressions and
tokens. Only tokens under which a rule is filed are looked up, and the URLs of a frequent one (`com`, `www`, the empty
token) are spread over tasks, to each of which its rules go; so are the rows of a frequent URL when they get their verdicts. Built-in expressions only.

Defined results: a null url, or one without "://", has empty host and path; repeated rows are judged alike;
an empty table gives an empty result. Only the two named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfold.llm.common import is_small, rejoin, settle, spread

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Patterns that block a page where no other rule fits: link farms and machine-made pages.
DEFAULT_BLOCKS = ("||spam-*/", "||cheap-*/", "*/wp-login.php*", "*/cgi-bin/*", "*.exe", "*.zip")


def _lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty without ://."""
    return F.coalesce(_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to ? # or the end; empty without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def regex_of(pattern: Column) -> Column:
    """The regular expression of a pattern, to be searched in host + path."""
    anchored, body = pattern.startswith("||"), _body(pattern)
    escaped = F.regexp_replace(body, r"[\x21-\x29\x2B-\x2F\x3A-\x40\x5B-\x60\x7B-\x7E]", r"\\$0")
    literal = F.replace(escaped, F.lit("*"), F.lit("[\\s\\S]*"))
    return F.concat(F.when(anchored, r"^([^/]*\.)?").otherwise("^"), literal, F.when(anchored, "").otherwise(r"\z"))


def tokens_of(pattern: Column) -> Column:
    """The literal tokens that each URL the rule fits has whole; the empty one where there are none."""
    anchored, body = pattern.startswith("||"), _lower(_body(pattern))
    delimited = F.concat(F.when(anchored, ".").otherwise("/"), body, F.when(anchored, "*").otherwise("/"))
    found = F.array_distinct(F.regexp_extract_all(delimited, F.lit(r"(?<![a-z0-9*])[a-z0-9]+(?![a-z0-9*])"), F.lit(0)))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("")))


def _body(pattern: Column) -> Column:
    return F.regexp_replace(pattern, r"^\|\|", "")


def compiled(rules: DataFrame) -> DataFrame:
    """rules: rule (its name), pattern, verdict. Columns: rule, verdict, regex, weight (length of the name), tokens.

    A row with a null among them is no rule. Rows of one name are rules beside each other; where several of them
    fit, 'block' goes before 'allow'.
    """
    pattern = F.col("pattern")
    whole = rules.where(F.col("rule").isNotNull() & pattern.isNotNull() & F.col("verdict").isNotNull())
    return whole.select("rule", "verdict", regex_of(pattern).alias("regex"), F.length("rule").alias("weight"), tokens_of(pattern).alias("tokens"))


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """A short list of rules (name, pattern, verdict), compiled; long ones are read as a table and given to `compiled`."""
    return compiled(spark.createDataFrame(rules, "rule string, pattern string, verdict string"))


def _tokens(target: Column) -> Column:
    return F.array_distinct(F.concat(F.array(F.lit("")), F.split(_lower(target), "[^a-z0-9]+")))


def best_rules(targets: DataFrame, rules: DataFrame) -> DataFrame:
    """For each target that a rule fits: target, n, and best, an array with the best rule (rule, verdict) of each list, null where none fits.

    targets (settled): target (each once) and n, which is passed on. rules: those of all lists, with their list's place, 0 or 1.
    """
    words = targets.select("target", "n", F.explode(_tokens(F.col("target"))).alias("token"))
    counts = settle(words.groupBy("token").agg(F.count(F.lit(1)).alias("urls")))
    filed = rules.select("place", "rule", "regex", F.explode("tokens").alias("token"))
    rarest = filed.join(counts, "token", "left").groupBy("place", "rule", "regex").agg(F.min_by("token", F.struct(F.coalesce("urls", F.lit(0)), "token")).alias("token"))
    index = settle(rules.drop("tokens").join(rarest, ["place", "rule", "regex"]))
    used = settle(index.select("token").distinct())
    asked = words.join(F.broadcast(used), "token", "left_semi") if is_small(used) else words
    all_words = counts.agg(F.sum("urls")).first()[0] or 0
    hits = spread(asked, index, ["token"], counts, "urls", all_words, lot=F.xxhash64("target")).where(F.rlike("target", "regex"))
    order = F.struct("weight", _reverse_order("rule"), "verdict")
    best = [F.max_by(F.struct("rule", "verdict"), F.when(F.col("place") == k, order)) for k in range(2)]
    return hits.groupBy("target").agg(F.max("n").alias("n"), *(b.alias(f"best{k}") for k, b in enumerate(best))).select("target", "n", F.array("best0", "best1").alias("best"))


def _reverse_order(name: str) -> Column:
    """Orders names downwards: the complement of each character's code point."""
    return F.transform(F.split(F.col(name), ""), lambda c: -F.ascii(c))


def judge_urls(pages: DataFrame, rules: DataFrame, fallback: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: page_id, host, path, rule (of `rules`; else null), verdict.

    Where no row of `rules` fits, the longest of `fallback` decides (its name is fallback_rule), and else 'allow'.
    """
    own = settle(pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path")).withColumn("target", F.concat("host", "path")))
    targets = settle(own.groupBy("target").agg(F.count(F.lit(1)).alias("n")))
    both = rules.withColumn("place", F.lit(0)).unionByName(fallback.withColumn("place", F.lit(1)))
    judged = rejoin(own, settle(best_rules(targets, both)), ["target"], "n")
    first, second = (F.element_at("_group.best", k) for k in (1, 2))
    verdict = F.coalesce(first["verdict"], second["verdict"], F.lit("allow"))
    return judged.select("page_id", "host", "path", first["rule"].alias("rule"), verdict.alias("verdict"), F.when(first["rule"].isNull(), second["rule"]).alias("fallback_rule"))
