"""URL filters: host and path rules, then boosted trees on lexical features; DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

#: (verdict, host/path): a rule fits its host, all subdomains, and paths that start with its own.
RULES = (
    ("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEXICAL = ("length", "host_length", "depth", "digit_ratio", "entropy", "params", "hyphens", "labels")
FEATURES = (*LEXICAL, "tld_rate", "tld_rows", "domain_rate", "domain_rows")


def host_path(df: DataFrame, url: str = "url") -> DataFrame:
    """Adds host and path: after the first ``://``; both empty where there is none."""
    u = F.col(url).cast("string")
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.substring(u, at + 3, F.length(u))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return df.withColumns(
        {
            "host": F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER),
            "path": F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1),
        }
    )


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, null where none does. Of equal rules the first counts."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, text in sorted(reversed(rules), key=lambda r: len(r[1])):
        h, slash, p = text.partition("/")
        h = h.translate(str.maketrans(UPPER, LOWER))
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(slash + p)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def lexical(df: DataFrame, url: str = "url") -> DataFrame:
    """Adds the lexical features of ``url``, and tld and domain, whose statistics come from labelled rows."""
    u = F.coalesce(F.col(url).cast("string"), F.lit(""))
    n = F.greatest(F.length(u), F.lit(1)).cast("double")
    chars = F.array_distinct(F.filter(F.split(u, ""), lambda c: c != ""))
    count = lambda s, c: (F.length(s) - F.length(F.replace(s, c))).cast("double")
    entropy = F.aggregate(
        chars, F.lit(0.0), lambda acc, c: acc - (count(u, c) / n) * F.log2(count(u, c) / n)
    )
    labels = F.split("host", r"\.")
    return df.withColumns(
        {
            "length": F.length(u).cast("double"), "host_length": F.length("host").cast("double"),
            "depth": count(F.col("path"), F.lit("/")), "digit_ratio": (F.length(u) - F.length(F.translate(u, "0123456789", ""))) / n,
            "entropy": entropy, "params": count(u, F.lit("&")) + count(u, F.lit("=")), "hyphens": count(F.col("host"), F.lit("-")),
            "labels": F.size(labels).cast("double"),
            "tld": F.substring_index("host", ".", -1), "domain": F.substring_index("host", ".", -2),
        }
    )


#: Parts of the labelled sample: a row is learnt from with the suffix statistics of the other parts.
FOLDS = 5


def _totals(labelled: DataFrame, key: str) -> DataFrame:
    """Sum and count of y by host suffix; as many rows as the sample at most."""
    return labelled.groupBy(key).agg(F.sum("y").alias("s"), F.count("*").alias("n"))


def _rate(key: str, s: Column, n: Column, scale: float = 1.0) -> list[Column]:
    """Smoothed share of blocked rows and log count of a suffix."""
    return [((s + 1.0) / (n + 2.0)).alias(f"{key}_rate"), F.log1p(n * scale).alias(f"{key}_rows")]


def _with_statistics(df: DataFrame, labelled: DataFrame) -> DataFrame:
    """Adds the suffix statistics of ``labelled``; a suffix it does not hold is neutral."""
    for key in ("tld", "domain"):
        stats = _totals(labelled, key).select(key, *_rate(key, F.col("s"), F.col("n")))
        df = df.join(F.broadcast(stats), key, "left")  # at most `sample` rows: a proven bound
    return df.fillna(0.5, ["tld_rate", "domain_rate"]).fillna(0.0, ["tld_rows", "domain_rows"])


def _out_of_fold(labelled: DataFrame) -> DataFrame:
    """``labelled`` with suffix statistics of the other folds only, so that no row's label, or its copies', is in its features.

    Counts are scaled to the size of all folds, as rows to be judged see all of them.
    """
    out = labelled.withColumn("fold", F.pmod(F.xxhash64("url"), F.lit(FOLDS)))
    for key in ("tld", "domain"):
        own = out.groupBy(key, "fold").agg(F.sum("y").alias("s_own"), F.count("*").alias("n_own"))
        stats = own.join(_totals(labelled, key), key).select(
            key, "fold", *_rate(key, F.col("s") - F.col("s_own"), F.col("n") - F.col("n_own"), FOLDS / (FOLDS - 1))
        )
        out = out.join(F.broadcast(stats), [key, "fold"])  # at most `sample` rows: a proven bound
    return out


class Trees:
    """Trees as nested tuples (feature, cut, left, right) or floats, and the expression of their sum."""

    def __init__(self, base: float):
        self.base, self.trees = base, []

    def _expr(self, node) -> Column:
        if isinstance(node, float):
            return F.lit(node)
        f, cut, a, b = node
        return F.when(F.col(f) <= cut, self._expr(a)).otherwise(self._expr(b))

    def margin(self) -> Column:
        out = F.lit(self.base)
        for t in self.trees:
            out = out + self._expr(t)
        return out

    def probability(self) -> Column:
        return 1.0 / (1.0 + F.exp(-self.margin()))


def fit_trees(
    rows: DataFrame, features=FEATURES, trees: int = 8, depth: int = 3, rate: float = 0.4, bins: int = 16, l2: float = 1.0, least: float = 5.0,
    balanced: bool = False,
) -> Trees:
    """Histogram gradient boosting by aggregates over ``rows`` (features and y 0.0 or 1.0).

    Each level of a tree is one aggregate by (node, feature, bin): at most
    2^depth x features x bins rows reach the driver, whatever the input holds. If ``balanced``, both
    labels weigh the same in all, however many rows have them.
    """
    probs = [i / bins for i in range(1, bins)]
    found = rows.agg(
        F.avg("y").alias("share"), F.count("*").alias("n"), *[F.percentile_approx(f, probs, 1000).alias(f) for f in features]
    ).first()
    if not found.n or found.share in (0.0, 1.0):
        return Trees(0.0 if not found.n else (4.0 if found.share else -4.0))
    model = Trees(0.0 if balanced else math.log(found.share / (1 - found.share)))
    weight = F.when(F.col("y") == 1.0, 0.5 / found.share).otherwise(0.5 / (1 - found.share)) if balanced else F.lit(1.0)
    cuts = {f: sorted(set(found[f])) for f in features}
    coded = rows.select(
        "y", *features,
        *[sum(((F.col(f) > c).cast("int") for c in cuts[f]), F.lit(0)).alias(f"b_{f}") for f in features],
    )
    coded = written(coded, "coded")
    for _ in range(trees):
        frame = coded.withColumn("p", model.probability()).select(
            (weight * (F.col("p") - F.col("y"))).alias("g"), (weight * F.col("p") * (1 - F.col("p"))).alias("h"), *[f"b_{f}" for f in features]
        )
        splits: dict[int, tuple[str, int]] = {}
        leaves: dict[int, float] = {}

        def node_of(splits=splits) -> Column:
            def walk(k: int) -> Column:
                if k not in splits:
                    return F.lit(k)
                f, b = splits[k]
                return F.when(F.col(f"b_{f}") <= b, walk(2 * k)).otherwise(walk(2 * k + 1))

            return walk(1)

        level = [1]
        for _ in range(depth):
            packed = F.array(*[F.struct(F.lit(f).alias("f"), F.col(f"b_{f}").alias("b")) for f in features])
            hist = (
                frame.select(node_of().alias("k"), "g", "h", F.explode(packed).alias("x"))
                .groupBy("k", "x.f", "x.b").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()
            )
            table_: dict[int, dict[str, dict[int, tuple[float, float]]]] = {}
            for r in hist:
                table_.setdefault(r.k, {}).setdefault(r.f, {})[r.b] = (r.g, r.h)
            nxt = []
            for k in level:
                by = table_.get(k)
                if not by:
                    leaves.setdefault(k, 0.0)
                    continue
                g0, h0 = (sum(v[i] for v in by[features[0]].values()) for i in (0, 1))
                leaves[k] = round(-rate * g0 / (h0 + l2), 9)
                best, pick = 1e-3, None
                for f in features:
                    gl = hl = 0.0
                    for b in range(len(cuts[f])):
                        g, h = by[f].get(b, (0.0, 0.0))
                        gl, hl = gl + g, hl + h
                        gr, hr = g0 - gl, h0 - hl
                        if min(hl, hr) * 4 < least:
                            continue
                        gain = round(gl**2 / (hl + l2) + gr**2 / (hr + l2) - g0**2 / (h0 + l2), 6)
                        if gain > best:
                            best, pick = gain, (f, b, gl, hl, gr, hr)
                if pick:
                    splits[k] = pick[:2]
                    leaves[2 * k], leaves[2 * k + 1] = (round(-rate * g / (h + l2), 9) for g, h in (pick[2:4], pick[4:]))
                    nxt += [2 * k, 2 * k + 1]
            level = nxt
            if not level:
                break

        def tree(k: int):
            if k not in splits:
                return leaves.get(k, 0.0)
            f, b = splits[k]
            return (f, cuts[f][b], tree(2 * k), tree(2 * k + 1))

        model.trees.append(tree(1))
    return model


def url_filter(pages: DataFrame, labelled: DataFrame | None = None, rules=RULES, sample: int = 20_000, id_col: str = "page_id") -> DataFrame:
    """page_id, host, path, rule, verdict and score (probability of block) of every url.

    ``labelled`` has url and y (1.0: block); without it, the urls that a rule judges are the
    labelled ones. At most ``sample`` of them, first by a hash of the url, are learnt from. Suffix
    statistics of labelled urls are taken out of fold. Urls that rules label all lie under hosts
    that the rules name, so there the statistics of a suffix would only say the rule again: there are
    none, and the trees are fitted on and go by LEXICAL alone. How often rules block says nothing of urls
    they don't judge, so there both labels weigh the same. Null
    urls and those without ``://`` have empty host and path; they, like all others no rule fits,
    are judged by the trees. Without labelled rows everything is allowed (score 0.5 or less). Repeated rows and
    null ids are returned as they come; an empty table gives no rows; other columns are ignored.
    """
    base = host_path(pages.select(F.col(id_col).alias("page_id"), F.col("url").cast("string").alias("url")))
    rule, says = rule_of(F.col("host"), F.col("path"), rules)
    base = base.withColumns({"rule": rule, "says": says})
    if labelled is None:
        known = base.where("says is not null").select("url", (F.col("says") == "block").cast("double").alias("y"))
    else:
        known = labelled.select(F.col("url").cast("string").alias("url"), F.col("y").cast("double").alias("y")).where("y is not null")
    chosen = written(lexical(host_path(known.orderBy(F.xxhash64("url"), "url", "y").limit(sample))), "labelled")
    by_rules = labelled is None
    if by_rules:
        model, judged = fit_trees(chosen, LEXICAL, balanced=True), lexical(base)
    else:
        model, judged = fit_trees(_out_of_fold(chosen)), _with_statistics(lexical(base), chosen)
    scored = judged.withColumn("score", model.probability())
    verdict = F.coalesce("says", F.when(F.col("score") > 0.5, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages"))


QUERIES = {"op1_url_filter": op1_url_filter}
SQL: dict[str, str] = {}
