"""Operator 5: URL filter by rules and, where none fits, by gradient-boosted trees; DataFrame operations only.

Rules are hosts with a path, each to allow or to block; a rule fits its host and all subdomains if the path starts with
the rule's. The longest fitting rule decides. URLs that no rule fits are judged by boosted trees on lexical features:
lengths, depth, digit ratio, entropy, parameters and labels of the host, and how often labelled URLs of the same suffix
are blocked (smoothed grouped counts). The trees are trained from URLs that the rules label, at most SAMPLE of them by
hash: each level of a tree is one grouped sum of gradients over binned features, and a finished tree is an expression.

Null URLs and such without "://" have an empty host and path and no rule; they are judged by the trees like others. Without
labelled URLs of both kinds the trees give the only kind there is, or allow. Ties of gain go to the first feature and
lowest bin; repeated rows get equal verdicts. URLs of any length are judged whole. An empty table gives an empty table. Other columns are kept; of clashing
names the operator's own stay."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import carried, join_checked, lower_ascii, materialize, table

RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
SAMPLE = 20_000
TREES = 8
DEPTH = 3
BINS = 16
RATE = 0.4
RIDGE = 1.0
OWN = ["host", "path", "rule", "verdict", "p_block"]
#: Labelled URLs that a suffix's share is shrunk by.
SUFFIX_STRENGTH = 20.0
#: Fixed value: what entropy tells apart; all other characters count as one.
ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789-._/:?=&%#"
FEATURES = ("url_length", "host_length", "path_length", "depth", "digit_ratio", "entropy", "parameters", "host_labels", "hyphens", "longest_part", "suffix_share", "domain_share")


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null."""
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, or null."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        own, slash, rest = text.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def lexical(url: Column, host: Column, path: Column) -> list[Column]:
    """The first ten of FEATURES."""
    low = lower_ascii(F.coalesce(url, F.lit("")))
    n = F.length(low)
    count = lambda s, c: F.length(s) - F.length(F.replace(s, F.lit(c)))
    counts = F.transform(F.array(*(F.lit(c) for c in ALPHABET)), lambda c: F.length(low) - F.length(F.replace(low, c)))
    other = n - F.aggregate(counts, F.lit(0), lambda a, x: a + x)
    bits = F.aggregate(F.concat(counts, F.array(other)), F.lit(0.0), lambda a, x: a - F.when(x > 0, x / n * F.log2(x / n)).otherwise(0.0))
    digits = n - F.length(F.translate(low, "0123456789", ""))
    query = F.when(F.instr(low, "?") > 0, count(low, "&") + 1).otherwise(0)
    longest = F.array_max(F.transform(F.split(path, "/"), lambda p: F.length(p)))
    return [c.cast("double") for c in (n, F.length(host), F.length(path), count(path, "/"), F.when(n > 0, digits / n).otherwise(0.0), bits, query, count(host, ".") + 1, count(low, "-"), longest)]


def suffixes(host: Column) -> tuple[Column, Column]:
    """The last label and the last two labels."""
    return F.substring_index(host, ".", -1), F.substring_index(host, ".", -2)


def features(df: DataFrame, url: str = "url", rules=RULES) -> DataFrame:
    """__row (all columns), url, host, path, rule, ruled (the rule's verdict), __suffix, __domain and __x (array of the lexical features)."""
    rows = df.select(carried(df, OWN), F.col(url).alias("url"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    suffix, domain = suffixes(F.col("host"))
    return rows.withColumns({"rule": rule, "ruled": verdict, "__suffix": suffix, "__domain": domain, "__x": F.array(*lexical(F.col("url"), F.col("host"), F.col("path")))})


class Trees:
    """Boosted trees as an expression over an array column of features."""

    def __init__(self, base: float):
        self.base, self.trees = base, []

    def score(self, x: Column, trees: int | None = None) -> Column:
        total = F.lit(self.base)
        for tree in self.trees[:trees]:
            total = total + self._value(tree, x)
        return total

    def _value(self, node, x: Column) -> Column:
        if not isinstance(node, dict):
            return F.lit(float(node))
        return F.when(x[node["feature"]] <= node["most"], self._value(node["low"], x)).otherwise(self._value(node["high"], x))

    def leaf(self, tree, x: Column) -> Column:
        """The number of the leaf slot, for a tree under construction."""
        if not isinstance(tree, dict):
            return F.lit(None).cast("int")
        if "slot" in tree:
            return F.lit(tree["slot"])
        return F.when(x[tree["feature"]] <= tree["most"], self.leaf(tree["low"], x)).otherwise(self.leaf(tree["high"], x))


def fit(sample: DataFrame, n_features: int, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE) -> Trees:
    """sample: __x (array<double>) and y (0 or 1), bounded. Every level of a tree is one grouped sum."""
    n, ones = sample.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0))).first()
    share = (ones + 0.25) / (n + 1)
    model = Trees(math.log(share / (1 - share)))
    if not n or ones in (0, n):
        return model
    cuts = [F.percentile_approx(F.col("__x")[f], [i / bins for i in range(1, bins)], 2000) for f in range(n_features)]
    edges = [sorted(set(c or [])) for c in sample.agg(*cuts).first()]
    binned = F.array(*(F.lit(0) + sum((F.when(F.col("__x")[f] > e, 1).otherwise(0) for e in es), F.lit(0)) for f, es in enumerate(edges)))
    sample = materialize(sample.select("__x", "y", binned.alias("bins")), "binned")
    for _ in range(trees):
        p = 1 / (1 + F.exp(-model.score(F.col("__x"))))
        tree: dict | float = {"slot": 0, "value": 0.0}
        for _level in range(depth):
            rows = sample.select(model.leaf(tree, F.col("__x")).alias("slot"), (F.col("y") - p).alias("g"), (p * (1 - p)).alias("h"), F.posexplode("bins").alias("f", "bin")).where("slot is not null")
            sums: dict = {}
            for r in rows.groupBy("slot", "f", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect():  # 2**depth x features x bins at most
                sums.setdefault(r["slot"], {}).setdefault(r["f"], {})[r["bin"]] = (r["g"], r["h"])
            slots = iter(range(2 ** (_level + 1)))

            def split(node, sums=sums):
                if not isinstance(node, dict):
                    return node
                if "slot" not in node:
                    return node | {"low": split(node["low"]), "high": split(node["high"])}
                best = (1e-6, None)
                for f, by in sorted(sums.get(node["slot"], {}).items()):
                    g, h = sum(x for x, _ in by.values()), sum(x for _, x in by.values())
                    a = b = 0.0
                    for k in range(len(edges[f])):
                        a, b = a + by.get(k, (0, 0))[0], b + by.get(k, (0, 0))[1]
                        if b <= 1e-9 or h - b <= 1e-9:
                            continue
                        gain = a * a / (b + RIDGE) + (g - a) ** 2 / (h - b + RIDGE) - g * g / (h + RIDGE)
                        if gain > best[0] + 1e-9:
                            best = (gain, {"feature": f, "most": float(edges[f][k]), "low": {"slot": 0, "value": rate * a / (b + RIDGE)}, "high": {"slot": 0, "value": rate * (g - a) / (h - b + RIDGE)}})
                return best[1] or node["value"]

            def number(node, slots=slots):
                if isinstance(node, dict):
                    if "slot" in node:
                        return node | {"slot": next(slots)}
                    return node | {"low": number(node["low"]), "high": number(node["high"])}
                return node

            tree = number(split(tree))

        def close(node):
            if not isinstance(node, dict):
                return node
            return node["value"] if "slot" in node else node | {"low": close(node["low"]), "high": close(node["high"])}

        model.trees.append(close(tree))
    return model


def judge(df: DataFrame, url: str = "url", rules=RULES, sample: int = SAMPLE) -> DataFrame:
    """All columns, host, path, rule, verdict and p_block (the trees' probability, for every URL)."""
    rows = features(df, url, rules)
    labelled = rows.where("ruled is not null").select("__suffix", "__domain", "__x", F.when(F.col("ruled") == "block", 1).otherwise(0).alias("y"), F.xxhash64("url").alias("__o"))
    shares = {}
    for by, name in (("__suffix", "suffix_share"), ("__domain", "domain_share")):
        counts = labelled.groupBy(by).agg(F.sum("y").alias("y"), F.count(F.lit(1)).alias("n"))
        shares[by] = materialize(counts.select(by, F.col("y").alias(f"{name}_y"), F.col("n").alias(f"{name}_n")), "shares")
    whole = shares["__suffix"].agg(F.sum("suffix_share_y"), F.sum("suffix_share_n")).first()
    average = (whole[0] / whole[1]) if whole[1] else 0.0

    def with_shares(rows: DataFrame, own: Column) -> DataFrame:
        """own: the row's own label (or null), which is left out of its suffix's counts."""
        for by in shares:
            rows = join_checked(rows, shares[by], by)
        known = F.when(own.isNull(), 0).otherwise(1)
        found = [(F.coalesce(f"{n}_y", F.lit(0)) - F.coalesce(own, F.lit(0)) + SUFFIX_STRENGTH * average) / (F.coalesce(f"{n}_n", F.lit(0)) - known + SUFFIX_STRENGTH) for n in ("suffix_share", "domain_share")]
        return rows.withColumn("__x", F.concat("__x", F.array(*found)))

    some = labelled.orderBy("__o", "__suffix", "__domain", "y").limit(sample)
    model = fit(materialize(with_shares(some, F.col("y")).select("__x", "y"), "labelled"), len(FEATURES))
    own = F.when(F.col("ruled") == "block", 1).when(F.col("ruled") == "allow", 0)
    scored = with_shares(rows, own).withColumn("p_block", 1 / (1 + F.exp(-model.score(F.col("__x")))))
    verdict = F.coalesce("ruled", F.when(F.col("p_block") >= 0.5, "block").otherwise("allow"))
    return scored.withColumn("verdict", verdict).select("__row.*", *OWN)


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judge(table(spark, sf_dir, "pages").select("page_id", "url"))
    return found.select("page_id", "host", "path", "rule", "verdict")
