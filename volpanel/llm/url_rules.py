"""URL filter by association rules.

Spark's FP-growth mines combinations of URL tokens that go with blocked labels. Rules are pruned by support, a least
number of blocked pages, and by confidence, held against the share of blocked pages among all labelled ones. They are
matched by an inverted index: every rule is posted under the one of its tokens that the fewest URLs have, the distinct
token sets of the URLs are joined with the postings, and a rule matches a set that holds all its tokens. A list of stated
(host, path) rules takes precedence over mined ones.

URLs are reduced to distinct token sets before the join, so a host with a third of all pages meets the
postings once per distinct shape of its URLs. What was found goes back to the pages in salted parts.

Defined cases: a null URL or one without ``://`` has no host, path or tokens and is allowed; labels of one document are
combined, any bad one blocks; documents without a label don't train; without labelled or without blocked URLs, and in an
empty table, no rule is mined; repeated rows are judged each; of rules with equal confidence and support the smallest
pattern is named; whole URLs count, however long; other columns of the pages are left out.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from volpanel.llm.tables import ascii_lower, stage

BLOCKED = "class=block"
# Parts into which the pages of one token set are dealt when they are given its rule.
PARTS = 8


def host_of(url: Column) -> Column:
    """From the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def url_tokens(url: Column) -> Column:
    """Sorted distinct tokens: host, site, every label before the site, path words, extension, query keys, fragment."""
    host, path = host_of(url), path_of(url)
    labels = F.split(host, r"\.")
    site = F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1)
    words = F.filter(F.split(path, "/"), lambda s: s.rlike("^[A-Za-z_-]+$"))
    keys = F.transform(
        F.filter(F.split(F.regexp_extract(url, r"(?s)\?([^#]*)", 1), "&"), lambda s: F.length(s) > 0),
        lambda s: F.concat(F.lit("query="), F.regexp_extract(s, r"^([^=]*)", 1)),
    )
    extension = F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)
    fragment = F.regexp_extract(url, r"(?s)#(.*)$", 1)

    def named(prefix: str, value: Column) -> Column:
        return F.when(F.length(value) > 0, F.concat(F.lit(prefix), value))

    single = F.array(
        named("host=", host),
        named("site=", site),
        named("ext=", extension),
        named("frag=", fragment),
    )
    before = F.filter(F.slice(labels, 1, F.greatest(F.size(labels) - 2, F.lit(0))), lambda s: F.length(s) > 0)
    many = F.concat(
        F.transform(before, lambda s: F.concat(F.lit("label="), s)), F.transform(words, lambda s: F.concat(F.lit("path="), s)), keys
    )
    found = F.array_sort(F.array_distinct(F.array_compact(F.concat(single, many))))
    return F.when(F.length(host) > 0, found).otherwise(F.array().cast("array<string>"))


def mine_rules(
    labelled: DataFrame, tokens: str, blocked: str, least: int = 4, least_share: float = 0.001, lift: float = 1.5
) -> DataFrame:
    """Rules (rule_id, pattern, antecedent, confidence, support) whose consequent is the block class.

    ``labelled`` has an array of tokens and a boolean per URL. A rule needs ``least`` blocked pages, which keeps chance out of
    few labels, and ``least_share`` of all labelled ones, which bounds the token sets that are mined however many labels
    there are; its confidence is at least ``lift`` times the share of blocked pages, or 1 where that is more.
    """
    total, bad = labelled.agg(F.count(F.lit(1)), F.count_if(blocked)).first()
    need = max(least, math.ceil(least_share * total))
    confidence = min(1.0, lift * bad / total) if total else 1.0
    baskets = labelled.select(
        F.when(F.col(blocked), F.array_append(F.col(tokens), F.lit(BLOCKED))).otherwise(F.col(tokens)).alias("items")
    )
    # Half a page less, so that rounding of the share can't ask for one page more.
    support = min(1.0, (need - 0.5) / total) if total else 1.0
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(baskets)
    # With fewer labels than pages needed the capped share would let smaller counts pass.
    rules = model.associationRules.where((F.col("consequent")[0] == BLOCKED) & F.lit(bad >= need))
    antecedent = F.array_sort("antecedent")
    pattern = F.array_join(antecedent, " & ")
    return rules.select(
        F.sha2(pattern, 256).alias("rule_id"),
        pattern.alias("pattern"),
        antecedent.alias("antecedent"),
        "confidence",
        "support",
    )


def match_rules(sets: DataFrame, tokens: str, rules: DataFrame) -> DataFrame:
    """Best matching rule per distinct token set that has one: tokens, pattern, confidence.

    The best rule has the highest confidence, then support, then the smallest pattern.
    """
    distinct = sets.groupBy(F.col(tokens).alias("tokens")).agg(F.count(F.lit(1)).alias("rows"))
    entries = distinct.select("tokens", F.explode("tokens").alias("token"))
    # A rule that holds a token of no set has no place among the postings it could be found by, and matches nothing.
    terms = rules.select("rule_id", F.explode("antecedent").alias("token"))
    used = entries.join(terms.select("token").distinct(), "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("sets"))
    rarest = terms.join(used, "token").groupBy("rule_id").agg(F.min(F.struct("sets", "token"))["token"].alias("token"))
    postings = rules.join(rarest, "rule_id")
    held = F.size(F.array_except("antecedent", "tokens")) == 0
    best = F.min(F.struct((-F.col("confidence")).alias("c"), (-F.col("support")).alias("s"), "pattern")).alias("b")
    return (
        entries.join(postings, "token")
        .where(held)
        .groupBy("tokens")
        .agg(best)
        .select("tokens", F.col("b.pattern").alias("pattern"), (-F.col("b.c")).alias("confidence"))
    )


def stated_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """Longest of the stated rules, as ``host/path``, that fits the host or a parent of it and starts the path."""
    fitting = [
        F.when(
            ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path),
            F.lit(rule_host + rule_path),
        )
        for rule_host, rule_path in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r))
    ]
    return F.coalesce(*fitting) if fitting else F.lit(None).cast("string")


def judge_urls(
    pages: DataFrame,
    labelled: DataFrame,
    stated: dict[tuple[str, str], str],
    page_id: str = "page_id",
    url: str = "url",
    least: int = 4,
    least_share: float = 0.001,
    lift: float = 1.5,
) -> DataFrame:
    """Host, path, stated rule, mined pattern and verdict for every page.

    ``labelled`` has ``url`` and boolean ``blocked``; ``stated`` maps (host, path) to ``allow`` or ``block``.
    """
    train = labelled.where(F.col("blocked").isNotNull()).select(url_tokens(F.col("url")).alias("tokens"), "blocked")
    rules = stage(mine_rules(train, "tokens", "blocked", least, least_share, lift), "url-rules")
    rows = pages.select(
        F.col(page_id).alias("page_id"),
        host_of(F.col(url)).alias("host"),
        path_of(F.col(url)).alias("path"),
        url_tokens(F.col(url)).alias("tokens"),
        F.pmod(F.xxhash64(page_id, url), F.lit(PARTS)).alias("part"),
    )
    matched = match_rules(rows, "tokens", rules).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    matched = matched.withColumn("part", F.col("part").cast("bigint"))
    rule = stated_rule(F.col("host"), F.col("path"), list(stated))
    action = F.create_map(*[F.lit(x) for (h, p), v in stated.items() for x in (h + p, v)]) if stated else None
    mined = F.when(F.col("pattern").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))
    judged = rows.join(matched, ["tokens", "part"], "left").withColumn("rule", rule)
    verdict = F.coalesce(action[F.col("rule")], mined) if stated else mined
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "pattern")
