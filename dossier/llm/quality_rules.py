"""Quality classifier: a sparse ensemble of rules over text statistics.

Boosted shallow trees on labelled rows yield paths; each path is a conjunction of threshold
tests on statistics of the text. A logistic model with an L1 penalty weighs the rules, most
weights becoming zero, and the rest is compiled into one Spark column expression, so scoring
is a projection without Python.

The model is fitted on a bounded sample: the ``sample_rows`` labelled rows whose ids hash
lowest. Its size is a parameter and does not grow with the tables; every row is scored by
whole-text statistics.

Cases: null and empty texts have statistics of zero and get a score like any other; null
labels are not learned from; a label without a text, or without the other class, leaves the
base rate as score; repeated rows are scored alike, and of the documents of one id one is
learned from; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.llm.registry import query, table

SAMPLE_ROWS = 12_000

#: Character classes that are counted; a scan by pattern costs half of a translation.
_CLASSES = {"upper": "[A-Z]", "symbol": r"[*#$%&@^~=+<>{}\[\]\\_]", "mark": "[!?]", "stop": "[.,;:]"}


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(0.0)


def statistics(df: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """``keep`` and one double column per statistic; each whole text is split into words and
    into lines once. White space at an end of a text counts as one empty word."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    split = df.select(
        *keep,
        t.alias("t"),
        F.transform(F.split(t, "[\\x09-\\x0D\\x20]+"), lambda w: F.xxhash64(w)).alias("keys"),
        F.transform(F.split(t, "\n"), lambda x: F.xxhash64(x)).alias("all_lines"),
    )
    counts = {
        "chars": F.char_length("t"),
        "words": F.when(F.col("t") == "", 0).otherwise(F.size("keys")),
        "own": F.size(F.array_distinct("keys")),
        "lines": F.size("all_lines"),
        "own_lines": F.size(F.array_distinct("all_lines")),
        "bar": F.char_length("t") - F.char_length(F.replace("t", F.lit("|"), F.lit(""))),
    }
    counts |= {name: F.regexp_count("t", F.lit(pattern)) for name, pattern in _CLASSES.items()}
    raw = split.select(*keep, *(v.cast("double").alias(n) for n, v in counts.items()))
    c = F.col
    made = {
        "words": c("words"),
        "word_length": _share(c("chars"), c("words")),
        "own_share": _share(c("own"), c("words")),
        "own_root": _share(c("own"), F.sqrt(c("words"))),
        "upper_share": _share(c("upper"), c("chars")),
        "symbol_share": _share(c("symbol"), c("chars")),
        "mark_share": _share(c("mark"), c("words")),
        "bar_share": _share(c("bar"), c("words")),
        "stop_share": _share(c("stop"), c("words")),
        "line_words": _share(c("words"), c("lines")),
        "own_line_share": _share(c("own_lines"), c("lines")),
        "symbols": c("symbol"),
        "marks": c("mark"),
        "bars": c("bar"),
        "uppers": c("upper"),
    }
    return raw.select(*keep, *(v.alias(f"x_{k}") for k, v in made.items()))


@dataclass(frozen=True)
class Rule:
    """All of (statistic, is above, threshold) hold."""

    tests: tuple[tuple[str, bool, float], ...]

    def column(self) -> Column:
        out = F.lit(True)
        for name, above, at in self.tests:
            out = out & ((F.col(name) > at) if above else (F.col(name) <= at))
        return out

    def holds(self, x: np.ndarray, names: list[str]) -> np.ndarray:
        out = np.ones(len(x), bool)
        for name, above, at in self.tests:
            v = x[:, names.index(name)]
            out &= (v > at) if above else (v <= at)
        return out


@dataclass(frozen=True)
class RuleModel:
    base: float
    weights: tuple[tuple[Rule, float], ...]

    def score(self) -> Column:
        """Probability of label 1, over the columns of :func:`statistics`."""
        total = F.lit(self.base)
        for rule, weight in self.weights:
            total = total + F.when(rule.column(), weight).otherwise(0.0)
        return 1.0 / (1.0 + F.exp(-total))


def _cuts(x: np.ndarray, bins: int) -> list[np.ndarray]:
    """Thresholds half way between neighbouring quantiles of each statistic."""
    out = []
    for v in x.T:
        q = np.unique(np.quantile(v, np.linspace(0, 1, bins + 1)))
        out.append((q[1:] + q[:-1]) / 2)
    return out


def _tree_paths(binned, cuts, names, pull, depth, rng, share, least):
    """Paths of one regression tree fitted to ``pull``, and its predictions."""
    n, d = binned.shape
    rows = np.flatnonzero(rng.random(n) < share)
    fitted, paths = np.zeros(n), []
    width = max(map(len, cuts)) + 1

    def grow(inside: np.ndarray, sample: np.ndarray, tests: tuple) -> None:
        if tests:
            paths.append(tests)
        best = (1e-9, None, None)
        if len(tests) < depth and len(sample) >= 2 * least:
            flat = binned[sample] + np.arange(d) * width
            size = np.bincount(flat.ravel(), minlength=d * width).reshape(d, width).cumsum(1)
            total = np.bincount(flat.ravel(), np.repeat(pull[sample], d), d * width).reshape(d, width).cumsum(1)
            left_n, left = size[:, :-1], total[:, :-1]
            right_n, right = size[:, -1:] - left_n, total[:, -1:] - left
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = left**2 / left_n + right**2 / right_n - total[:, -1:] ** 2 / size[:, -1:]
            gain[(left_n < least) | (right_n < least)] = 0
            spot = np.unravel_index(np.argmax(gain), gain.shape)
            best = (gain[spot], int(spot[0]), int(spot[1]))
        if best[1] is None or best[0] <= 1e-9:
            fitted[inside] = pull[sample].mean() if len(sample) else 0.0
            return
        _, j, b = best
        at = float(cuts[j][b])
        for above in (False, True):
            side = lambda r: r[(binned[r, j] > b) == above]
            grow(side(inside), side(sample), (*tests, (names[j], above, at)))

    grow(np.arange(n), rows, ())
    return paths, fitted


def fit_rules(
    x: np.ndarray,
    y: np.ndarray,
    names: list[str],
    trees: int = 60,
    depth: int = 3,
    rate: float = 0.2,
    penalty: float = 4e-4,
    bins: int = 32,
    rounds: int = 600,
    seed: int = 7,
) -> RuleModel:
    """Boosted trees give the rules, proximal gradient steps their sparse weights."""
    if len(y) == 0 or y.min() == y.max():
        rate_ones = (y.sum() + 0.5) / (len(y) + 1)
        return RuleModel(float(np.log(rate_ones / (1 - rate_ones))), ())
    rng = np.random.default_rng(seed)
    cuts = _cuts(x, bins)
    binned = np.stack([np.searchsorted(c, v, "left") for c, v in zip(cuts, x.T)], 1)
    margin, seen = np.zeros(len(y)), {}
    least = max(2, len(y) // 500)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        paths, fitted = _tree_paths(binned, cuts, names, y - p, depth, rng, 0.5, least)
        margin += rate * 4 * fitted
        for tests in paths:
            rule = Rule(tuple(sorted(tests)))
            seen.setdefault(rule.holds(x, names).tobytes(), rule)
    rules = list(seen.values())
    z = np.stack([r.holds(x, names) for r in rules], 1).astype(np.float32)
    spread = z.std(0)
    keep = spread > 1e-3
    rules, z, spread = [r for r, k in zip(rules, keep) if k], z[:, keep], spread[keep]
    centre = z.mean(0)
    z = (z - centre) / spread
    # The largest eigenvalue bounds the step of the accelerated proximal gradient.
    v = rng.normal(size=z.shape[1]).astype(np.float32)
    for _ in range(20):
        v = z.T @ (z @ v)
        v /= np.linalg.norm(v)
    step = 4 * len(y) / float(np.linalg.norm(z @ v) ** 2) * 0.9
    w = np.zeros(z.shape[1], np.float32)
    ahead, t, base = w.copy(), 1.0, float(np.log(y.mean() / (1 - y.mean())))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(z @ ahead + base)))
        pull = z.T @ (p - y).astype(np.float32) / len(y)
        base -= 2.0 * float((p - y).mean())
        new = ahead - step * pull
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, w, t = new + (t - 1) / t_new * (new - w), new, t_new
    w = w / spread
    base -= float(w @ centre)
    return RuleModel(base, tuple((r, float(a)) for r, a in zip(rules, w) if a != 0))


def held_out(id_col: str) -> Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(3)) == 1


def learn(
    documents: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    sample_rows: int = SAMPLE_ROWS,
) -> RuleModel:
    """Model from the labelled rows that are not held out, a bounded sample of them.

    Labels do not depend on the order of the tables: ids are chosen by their hash."""
    usable = labels.filter(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    chosen = (
        usable.groupBy(id_col)
        .agg(F.max(label_col).alias("_label"))
        .orderBy(F.xxhash64(id_col), id_col)
        .limit(sample_rows)
    )
    # At most sample_rows ids and labels: a broadcast of bounded size.
    rows = documents.select(id_col, text_col).join(F.broadcast(chosen), id_col)
    found = statistics(rows, text_col, [id_col, "_label"])
    names = [c for c in found.columns if c.startswith("x_")]
    # One row for each id, however many documents bear it.
    single = found.groupBy(id_col, "_label").agg(F.min(F.struct(*names)).alias("x"))
    stats = single.select("_label", "x.*").toPandas()
    values = stats.sort_values(list(stats.columns))
    return fit_rules(values[names].to_numpy(float), values["_label"].to_numpy(float), names)


def score_quality(
    documents: DataFrame, model: RuleModel, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per row: id, held_out, score and predicted."""
    stats = statistics(documents.select(id_col, text_col), text_col, [id_col])
    scored = stats.select(id_col, held_out(id_col).alias("held_out"), model.score().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def good_documents(
    documents: DataFrame, model: RuleModel, text_col: str = "text"
) -> DataFrame:
    """The rows of ``documents`` with a score of at least one half, all columns kept."""
    whole = F.struct(*[documents[c] for c in documents.columns]).alias("_row")
    stats = statistics(documents.select(whole, documents[text_col].alias("_text")), "_text", ["_row"])
    # A filter would be pushed below the statistics and compute them anew for every rule.
    kept = F.explode(F.when(model.score() >= 0.5, F.array("_row"))).alias("_row")
    return stats.select(kept).select("_row.*")


@query("op5_quality_rules")
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return score_quality(documents, learn(documents, table(spark, sf_dir, "labels")))
