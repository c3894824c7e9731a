"""URL filter: longest-suffix rules first, gradient-boosted trees on lexical features for the rest.

The trees are fitted on the driver to a bounded sample of labelled URLs and
applied as nested CASE expressions, so no Python runs in tasks.
"""

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .samples import per_class

ALLOW, BLOCK = "allow", "block"
#: Labelled URLs of each class that fitting reads at most.
TRAIN_URLS = 3000
TREES, DEPTH, RATE, LEAST_LEAF, CUTS = 40, 3, 0.2, 10, 24
#: Share of the features that each tree may use, so that no one feature which tells the labels apart hides what the others say.
FEATURE_SHARE = 0.4
#: Characters whose shares make the entropy; others count as one class.
_ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789-._~/:?#=&%+"
#: Hash classes of host suffixes, for which shares of blocked URLs are kept.
SUFFIX_CLASSES = 64
FEATURES = ["length", "host_length", "path_length", "depth", "host_labels", "digit_share", "entropy", "parameters", "hyphens", "longest_word", "has_fragment", "suffix_blocked", "second_blocked", "section_blocked"]


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def rule(text: str) -> Rule:
    """``block example.com/en/`` as a Rule."""
    verdict, _, target = text.partition(" ")
    host, slash, path = target.partition("/")
    return Rule(verdict, host.lower(), slash + path)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty where it is null or has no ``://``."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def matching(rules: list[Rule], host: Column, path: Column) -> Column:
    """The longest rule that fits, as a struct of text and verdict; null without one.  Equal lengths: the first in the alphabet."""
    found = None
    for r in sorted(rules, key=lambda r: (-len(r.text), r.text)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        value = F.struct(F.lit(r.text).alias("rule"), F.lit(r.verdict).alias("verdict"))
        found = F.when(fits, value) if found is None else found.when(fits, value)
    return F.lit(None).cast("struct<rule:string,verdict:string>") if found is None else found


def _count(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def _class(text: Column) -> Column:
    return F.pmod(F.crc32(text), F.lit(SUFFIX_CLASSES)).cast("int")


def lexical(urls: DataFrame) -> DataFrame:
    """Adds the lexical features and the hash classes of suffixes to rows with url, host and path."""
    url = F.lower(F.coalesce("url", F.lit("")))
    n = F.greatest(F.length(url), F.lit(1)).cast("double")
    shares = [(_count(F.col("_url"), c).cast("double") / F.col("_n")) for c in _ALPHABET]
    terms = F.aggregate(F.array(*shares), F.lit(0.0), lambda a, p: a + F.when(p > 0, -p * F.log2(p)).otherwise(0.0))
    query = F.when(F.locate("?", url) > 0, F.substring_index(F.substring_index(url, "#", 1), "?", -1)).otherwise("")
    labels = F.split("host", r"\.")
    urls = urls.withColumns({"_url": url, "_n": n})
    return urls.withColumns(
        {
            "length": F.length("_url"),
            "host_length": F.length("host"),
            "path_length": F.length("path"),
            "depth": _count(F.col("path"), "/"),
            "host_labels": F.size(labels),
            "digit_share": _count(F.col("_url"), "0123456789") / F.col("_n"),
            "entropy": terms,
            "parameters": F.when(query == "", 0).otherwise(_count(query, "&") + 1),
            "hyphens": _count(F.col("_url"), "-_"),
            "longest_word": F.array_max(F.transform(F.split("_url", r"[^a-z]+"), F.length)),
            "has_fragment": (F.locate("#", F.col("_url")) > 0).cast("int"),
            "suffix_class": _class(F.substring_index("host", ".", -1)),
            "second_class": _class(F.substring_index("host", ".", -2)),
            "section_class": _class(F.split_part(F.col("path"), F.lit("/"), F.lit(2))),
        }
    ).drop("_url", "_n")


@dataclass
class Trees:
    """Trees as nested tuples ``(feature, cut, left, right)`` or leaf values, and all labelled rows' blocked shares by suffix class."""

    base: float
    trees: list
    shares: dict[str, dict[int, float]]


def _fit_tree(x: np.ndarray, gradient: np.ndarray, hessian: np.ndarray, depth: int, usable: np.ndarray):
    value = float(gradient.sum() / (hessian.sum() + 1.0)) * RATE
    if depth == 0 or len(x) < 2 * LEAST_LEAF:
        return value
    best, total_g, total_h = (1e-6, None, None), gradient.sum(), hessian.sum()
    for k in usable:
        values = np.unique(x[:, k])
        # Cuts lie half-way between values, so that a value never seen goes with the nearer ones.
        between = (values[1:] + values[:-1]) / 2
        for cut in between if len(between) <= CUTS else between[np.linspace(0, len(between) - 1, CUTS).astype(int)]:
            left = x[:, k] <= cut
            if LEAST_LEAF <= left.sum() <= len(x) - LEAST_LEAF:
                g, h = gradient[left].sum(), hessian[left].sum()
                gain = g**2 / (h + 1) + (total_g - g) ** 2 / (total_h - h + 1) - total_g**2 / (total_h + 1)
                if gain > best[0]:
                    best = gain, int(k), float(cut)
    if best[1] is None:
        return value
    left = x[:, best[1]] <= best[2]
    return best[1], best[2], _fit_tree(x[left], gradient[left], hessian[left], depth - 1, usable), _fit_tree(x[~left], gradient[~left], hessian[~left], depth - 1, usable)


def _apply_tree(tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    left, out = x[:, tree[0]] <= tree[1], np.empty(len(x))
    out[left], out[~left] = _apply_tree(tree[2], x[left]), _apply_tree(tree[3], x[~left])
    return out


def boost(x: np.ndarray, blocked: np.ndarray, weight: np.ndarray, seed: int = 11) -> tuple[float, list]:
    """Gradient boosting with logistic loss and second-order leaf values, a random part of the features for each tree; a row counts as its weight."""
    rng, part = np.random.default_rng(seed), max(1, round(FEATURE_SHARE * x.shape[1]))
    rate = min(max(float(np.average(blocked, weights=weight)), 0.01), 0.99)
    base, trees = float(np.log(rate / (1 - rate))), []
    margin = np.full(len(x), base)
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        trees.append(_fit_tree(x, weight * (blocked - p), weight * p * (1 - p), DEPTH, np.sort(rng.permutation(x.shape[1])[:part])))
        margin += _apply_tree(trees[-1], x)
    return base, trees


PARTS = ("suffix", "second", "section")
#: Folds of urls; a training row's shares are those of the other folds.
FOLDS = 5


def _statistics(rows: DataFrame) -> dict[str, np.ndarray]:
    """For each part, all labelled rows and the blocked ones by fold and class."""
    classes = F.array(*(F.col(f"{part}_class") for part in PARTS))
    counted = rows.select("blocked", "fold", F.posexplode(classes).alias("part", "class")).groupBy("part", "fold", "class").agg(F.count("*").alias("n"), F.sum("blocked").alias("b"))
    out = {part: np.zeros((2, FOLDS, SUFFIX_CLASSES)) for part in PARTS}
    for r in counted.collect():
        out[PARTS[r["part"]]][:, r["fold"], r["class"]] = r["n"], r["b"]
    return out


def learn(labelled: DataFrame) -> Trees | None:
    """Trees from rows with url, host, path and ``blocked`` (0 or 1); None where one of the classes is missing.

    Both classes weigh the same, whatever their sizes: rules say nothing of
    how common bad urls are where no rule applies, so without evidence a url
    scores one half.  Blocked shares by class of suffix count every row.  Only
    the trees are grown on at most TRAIN_URLS rows of each class.  A suffix's
    blocked share is smoothed, and each training row's fold is left out of it
    (were it the row's own label alone, the difference would tell the label).
    """
    labelled = lexical(labelled.where("blocked IS NOT NULL")).withColumn("fold", F.pmod(F.crc32("url"), F.lit(FOLDS)).cast("int"))
    found = _statistics(labelled)
    total, all_blocked = found[PARTS[0]].sum(axis=(1, 2))
    if not 0 < all_blocked < total:
        return None
    rows = per_class(labelled, "blocked", F.xxhash64("url"), TRAIN_URLS)
    blocked = np.array([r["blocked"] for r in rows], dtype=float)
    if len(set(blocked)) < 2:
        return None
    folds = np.array([r["fold"] for r in rows])
    overall, shares, columns = 0.5, {}, []
    of_blocked, of_allowed = total / 2 / all_blocked, total / 2 / (total - all_blocked)
    for part in PARTS:
        classes = np.array([r[f"{part}_class"] for r in rows])
        blocked_rows = found[part][1] * of_blocked
        weighted = np.stack([blocked_rows + (found[part][0] - found[part][1]) * of_allowed, blocked_rows])
        n, b = weighted.sum(axis=1)
        own_n, own_b = weighted[:, folds, classes]
        shares[part] = {int(k): float((b[k] + 2 * overall) / (n[k] + 2)) for k in np.flatnonzero(n)}
        columns.append((b[classes] - own_b + 2 * overall) / (n[classes] - own_n + 2))
    x = np.column_stack([[float(r[f] or 0) for r in rows] for f in FEATURES[:-3]] + columns)
    weight = np.where(blocked == 1, overall / blocked.mean(), (1 - overall) / (1 - blocked.mean()))
    base, trees = boost(x, blocked, weight)
    return Trees(base, trees, shares | {"": {-1: overall}})


def _as_expression(tree, features: list[str]) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(tree)
    return F.when(F.col(features[tree[0]]) <= F.lit(tree[1]), _as_expression(tree[2], features)).otherwise(_as_expression(tree[3], features))


def blocked_probability(urls: DataFrame, model: Trees, name: str = "blocked_score") -> DataFrame:
    """Adds the trees' probability to rows that ``lexical`` has prepared."""
    overall = model.shares[""][-1]
    for part in PARTS:
        table = F.create_map(*(F.lit(v) for item in model.shares[part].items() for v in item))
        urls = urls.withColumn(f"{part}_blocked", F.coalesce(F.try_element_at(table, F.col(f"{part}_class")), F.lit(overall)))
    margin = sum((_as_expression(t, FEATURES) for t in model.trees), F.lit(model.base))
    return urls.withColumn(name, F.lit(1.0) / (F.lit(1.0) + F.exp(-margin)))


def filter_urls(pages: DataFrame, rules: list[Rule], id_column: str = "page_id", url_column: str = "url") -> DataFrame:
    """``(page_id, host, path, rule, verdict, score)`` for every row.

    The longest rule whose host is the url's host or a parent domain of it,
    and whose path starts the url's path, decides.  Other urls are blocked
    where the trees, trained on the urls that a rule decides, give a
    probability (``score``) of one half or more.

    Host and path of a null url, or one without ``://``, are empty; it fits no
    rule.  Without rules of both verdicts among the data there is nothing to
    learn: urls without a rule are allowed, with score 0.  Repeated rows give
    repeated results; other columns are not read.
    """
    rows = pages.select(F.col(id_column).cast("long").alias("page_id"), F.col(url_column).cast("string").alias("url"))
    host, path = host_and_path(F.col("url"))
    rows = rows.withColumns({"host": host, "path": path})
    rows = rows.withColumn("match", matching(rules, F.col("host"), F.col("path")))
    labelled = rows.where("match IS NOT NULL").select("url", "host", "path", (F.col("match.verdict") == BLOCK).cast("int").alias("blocked"))
    model = learn(labelled)
    scored = rows.withColumn("score", F.lit(0.0)) if model is None else blocked_probability(lexical(rows), model, "score")
    verdict = F.coalesce("match.verdict", F.when(F.col("score") >= 0.5, BLOCK).otherwise(ALLOW))
    return scored.select(F.col("page_id").alias(id_column), "host", "path", F.col("match.rule").alias("rule"), verdict.alias("verdict"), "score")
