"""Quality classifier: a sparse rule ensemble compiled to Spark column expressions.

Shallow boosted trees are grown on text statistics; every path from a root to a
node becomes a conjunctive rule; logistic weights with an L1 penalty keep a few of
them; the kept rules become one native expression. Fitting sees a bounded sample
of labelled rows (`max_rows`, the rows with the smallest hash of their id);
scoring is a projection of the scan: no shuffle, no Python.

Edge cases: null or empty text has all statistics 0 and still gets a score; other
null columns and extra columns are carried through, whatever their names, but for one
named as the score, which is replaced; labels that are null take no part in fitting, and
of labels for one id the smaller counts; without both classes in the sample every text
gets the share of label 1 (0.5 without any label); very long texts are scored whole; an
empty table gives no rows.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyseal.llm.common import unused


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a text, each a native expression."""
    t = F.coalesce(text, F.lit(""))
    n = F.length(t).cast("double")

    def count(s: str) -> Column:
        return ((F.length(t) - F.length(F.replace(t, F.lit(s), F.lit("")))) / F.lit(float(len(s)))).cast("double")

    def share(x: Column, of: Column = n) -> Column:
        return F.when(of > 0, x / of).otherwise(0.0)

    spaces, lines = count(" "), count("\n")
    pieces, rows = F.split(t, " ", -1), F.split(t, "\n", -1)
    return {
        "chars": n,
        "space_share": share(spaces),
        "line_share": share(lines),
        "mean_piece": n / (spaces + lines + 1.0),
        "upper_share": share(F.regexp_count(t, F.lit(r"\p{Lu}")).cast("double")),
        "digit_share": share(F.regexp_count(t, F.lit("[0-9]")).cast("double")),
        "bang_share": share(count("!")),
        "mark_share": share(count("#") + count("$") + count("%") + count("&") + count("*")),
        "bar_share": share(count("|")),
        "stop_share": share(count(".")),
        "comma_share": share(count(",")),
        "angle_share": share(count("<") + count(">")),
        "brace_share": share(count("{") + count("}") + count(";")),
        "distinct_pieces": F.size(F.array_distinct(pieces)) / F.size(pieces),
        "distinct_lines": F.size(F.array_distinct(rows)) / F.size(rows),
    }


@dataclass(frozen=True)
class RuleModel:
    """bias + sum of weight where all of a rule's (statistic, above, bound) hold, through a logistic."""

    bias: float
    rules: tuple[tuple[float, tuple[tuple[str, bool, float], ...]], ...]

    def score(self, stat=F.col) -> Column:
        total = F.lit(self.bias)
        for weight, terms in self.rules:
            hold = None
            for name, above, bound in terms:
                x = stat(name) > F.lit(bound) if above else stat(name) <= F.lit(bound)
                hold = x if hold is None else hold & x
            total = total + F.when(hold, F.lit(weight)).otherwise(0.0)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def used(self) -> set[str]:
        return {name for _, terms in self.rules for name, _, _ in terms}

    def to_json(self) -> str:
        return json.dumps({"bias": self.bias, "rules": self.rules})

    @staticmethod
    def from_json(text: str) -> RuleModel:
        x = json.loads(text)
        return RuleModel(x["bias"], tuple((w, tuple(tuple(t) for t in terms)) for w, terms in x["rules"]))


def _grow(binned, edges, grad, hess, rows, depth, path, rules, least, names):
    """One regression tree by Newton gain; adds each path to rules and returns the leaf steps."""
    g, h = grad[rows].sum(), hess[rows].sum()
    best = (1e-6, None, None)
    if depth and len(rows) >= 2 * least:
        for k in range(binned.shape[1]):
            size = len(edges[k]) + 1
            gs = np.cumsum(np.bincount(binned[rows, k], grad[rows], size))[:-1]
            hs = np.cumsum(np.bincount(binned[rows, k], hess[rows], size))[:-1]
            ns = np.cumsum(np.bincount(binned[rows, k], minlength=size))[:-1]
            ok = (ns >= least) & (len(rows) - ns >= least)
            if not ok.any():
                continue
            gain = np.where(ok, gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g * g / (h + 1), -1)
            j = int(gain.argmax())
            if gain[j] > best[0]:
                best = (gain[j], k, j)
    if best[1] is None:
        return [(rows, -g / (h + 1))]
    _, k, j = best
    left = binned[rows, k] <= j
    out = []
    for above, side in ((False, rows[left]), (True, rows[~left])):
        terms = (*path, (names[k], above, float(edges[k][j])))
        rules.add(terms)
        out += _grow(binned, edges, grad, hess, side, depth - 1, terms, rules, least, names)
    return out


def _holds(x: np.ndarray, names: list[str], terms) -> np.ndarray:
    hold = np.ones(len(x), bool)
    for name, above, bound in terms:
        v = x[:, names.index(name)]
        hold &= v > bound if above else v <= bound
    return hold


def fit_rules(x: np.ndarray, y: np.ndarray, names: list[str], trees: int = 60, depth: int = 3, bins: int = 48, penalty: float = 2e-3, steps: int = 600) -> RuleModel:
    """Trees, then L1 logistic regression on their paths (accelerated proximal gradient)."""
    if len(y) == 0:
        return RuleModel(0.0, ())
    p = (y.sum() + 0.5) / (len(y) + 1.0)
    base = float(np.log(p / (1 - p)))
    if y.min() == y.max():
        return RuleModel(base, ())
    edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])) for k in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, k], "left") for k, e in enumerate(edges)], 1)
    f, rules, least = np.full(len(y), base), set(), max(3, len(y) // 400)
    for _ in range(trees):
        q = 1 / (1 + np.exp(-f))
        for rows, step in _grow(binned, edges, q - y, np.maximum(q * (1 - q), 1e-6), np.arange(len(y)), depth, (), rules, least, names):
            f[rows] += 0.2 * step
    table = {}
    for terms in sorted(rules, key=lambda t: (len(t), t)):  # of rules that hold for the same rows the shortest stays
        hold = _holds(x, names, terms)
        if 0 < hold.sum() < len(hold):
            table.setdefault(hold.tobytes(), (terms, hold))
    chosen = [t for t, _ in table.values()]
    a = np.stack([h for _, h in table.values()], 1).astype(np.float64) if table else np.zeros((len(y), 0))
    mean = a.mean(0)
    scale = np.maximum(a.std(0), 1e-9)
    z = (a - mean) / scale
    w, v, b, t = np.zeros(z.shape[1]), np.zeros(z.shape[1]), base, 1.0
    rate = 4.0 / max(np.linalg.norm(z, 2) ** 2 / len(y), 1e-9) if z.shape[1] else 0.0
    for _ in range(steps if z.shape[1] else 0):
        q = 1 / (1 + np.exp(-np.clip(z @ v + b, -40, 40)))
        step = v - rate * (z.T @ (q - y) / len(y))
        new = np.sign(step) * np.maximum(np.abs(step) - rate * penalty, 0)
        b -= 2.0 * float((q - y).mean())
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        v, w, t = new + (t - 1) / t2 * (new - w), new, t2
    kept = [(float(w[k] / scale[k]), chosen[k]) for k in np.flatnonzero(np.abs(w) > 1e-8)]
    return RuleModel(float(b - (w / scale * mean).sum()) if len(w) else base, tuple(kept))


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = 20_000, **options) -> RuleModel:
    """Fits on at most max_rows labelled rows; labels holds the rows that may be learnt from."""
    sample = (
        labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y"))
        .where("_id is not null and _y in (0, 1)").groupBy("_id").agg(F.min("_y").alias("_y"))
        .orderBy(F.xxhash64("_id"), "_id").limit(max_rows)
    )
    joined = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t")).join(F.broadcast(sample), "_id")
    stats = statistics(F.col("_t"))
    names = list(stats)
    rows = joined.select("_id", "_y", *[c.cast("double").alias(k) for k, c in stats.items()]).orderBy(F.xxhash64("_id"), "_id", *names).limit(max_rows).toPandas()
    return fit_rules(rows[names].to_numpy(np.float64), rows["_y"].to_numpy(np.float64), names, **options)


def score(docs: DataFrame, model: RuleModel, *, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with the score in 0 to 1 as one more column; the statistics are computed once, below the rules."""
    used = sorted(model.used())
    stats = statistics(F.col(text_col))
    made, own = F.struct(*[stats[k].cast("double").alias(k) for k in used]) if used else F.lit(0), unused([*docs.columns, score_col], "stats")
    # a generated row is made once, even where a filter on the score is pushed down
    return docs.select("*", F.explode(F.array(made)).alias(own)).withColumn(score_col, model.score(lambda k: F.col(own)[k])).drop(own)


def held_out(id_col: str = "doc_id", parts: int = 5, part: int = 0) -> Column:
    """crc32 of the id as text falls in one part; a null id counts as held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % parts == part, F.lit(True))


def train_on(spark, sf_dir: str) -> RuleModel:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality").where(~held_out())
    return fit(spark.read.parquet(f"{sf_dir}/documents.parquet"), labels)


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    scored = score(docs, train_on(spark, sf_dir))
    return scored.select("doc_id", held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))
