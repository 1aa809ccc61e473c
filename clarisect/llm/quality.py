"""Document quality by a sparse ensemble of rules, compiled into Spark column expressions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .trees import Node, boost, sigmoid

#: Rows of labels that the fit may use, about.
FIT_ROWS = 20_000
THRESHOLD = 0.7
#: Fixed value: white space between words.
SPACE = " \t\n\x0b\f\r"
#: Trees grown for rules, their depth, and the penalties tried, largest first.
TREES, DEPTH = 40, 3
PENALTIES = (0.03, 0.01, 0.003, 0.001, 0.0003)


def with_statistics(docs: DataFrame, text_col: str) -> DataFrame:
    """Adds a column ``__<name>`` for each statistic of a text, all inside the JVM; an empty text has 0 for each.
    No column of ``docs`` may start with two underscores.

    The steps are projections of their own, with plain columns, so that the optimizer computes the words, the
    lines and each statistic once, however many expressions use them.
    """
    text, words, lines, n, n_words, n_lines = (F.col(f"__{c}") for c in ("text", "words_list", "lines_list", "n", "n_words", "n_lines"))

    def share(part: Column, whole: Column) -> Column:
        return F.when(whole > 0, part / whole).otherwise(0.0).cast("double")

    def found(pattern: str) -> Column:
        return F.regexp_count(text, F.lit(pattern))

    own = docs.columns
    stats = {
        "words": n_words.cast("double"),
        "word_length": share(n, n_words),
        "distinct_words": share(F.size(F.array_distinct(words)), n_words),
        "repeated_next": share(found(r"(?<![^\s])([^\s]++)\s(?=\1(?![^\s]))"), n_words),
        "distinct_lines": share(F.size(F.array_distinct(lines)), n_lines),
        "line_share": share(n_lines, n_words),
        "upper": share(found(r"\p{Lu}"), n),
        "digits": share(found(r"[0-9]"), n),
        "marks": share(found(r"[^\p{L}\p{N}\s.,;:'\"()?-]"), n),
        "stops": share(found(r"[.,;:?]"), n_words),
        "bars": share(found(r"(?<![^\s])[^\p{L}\p{N}\s]+(?![^\s])"), n_words),
    }
    return (
        docs.select("*", F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text"))
        .select("*", F.length("__text").alias("__n"), F.btrim("__text", F.lit(SPACE)).alias("__trimmed"), F.split("__text", "\n").alias("__lines_list"))
        .select("*", F.split("__trimmed", r"[\x20\x09-\x0D]+").alias("__words_list"))
        .select("*", F.when(F.col("__trimmed") == "", 0).otherwise(F.size(words)).alias("__n_words"), F.size(lines).alias("__n_lines"))
        .select(*own, *[c.alias(f"__{name}") for name, c in stats.items()])
    )


NAMES = (
    "words", "word_length", "distinct_words", "repeated_next", "distinct_lines", "line_share", "upper", "digits", "marks", "stops", "bars",
)

#: A rule: for each feature it tests, (low, high) with low < value <= high; None is open.
Rule = tuple[tuple[int, float | None, float | None], ...]


def rules_of(tree: Node) -> set[Rule]:
    """The conjunctions along every path of a tree, inner nodes included."""
    out: set[Rule] = set()

    def walk(node: Node, bounds: dict) -> None:
        if bounds:
            out.add(tuple((f, *bounds[f]) for f in sorted(bounds)))
        if node.feature >= 0:
            low, high = bounds.get(node.feature, (None, None))
            walk(node.left, bounds | {node.feature: (low, node.threshold)})
            walk(node.right, bounds | {node.feature: (node.threshold, high)})

    walk(tree, {})
    return out


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    ok = np.ones(len(x), bool)
    for f, low, high in rule:
        if low is not None:
            ok &= x[:, f] > low
        if high is not None:
            ok &= x[:, f] <= high
    return ok


def lasso(r: np.ndarray, y: np.ndarray, penalty: float, start: np.ndarray | None = None, steps: int = 300) -> np.ndarray:
    """Logistic weights with an absolute penalty by accelerated proximal steps; the last weight is the free intercept."""
    a = np.hstack([r, np.ones((len(r), 1))])
    w = np.zeros(a.shape[1]) if start is None else start.copy()
    v, t = w.copy(), 1.0
    norm = np.ones(a.shape[1]) / np.sqrt(a.shape[1])
    for _ in range(20):
        norm = a.T @ (a @ norm)
        size = np.linalg.norm(norm)
        norm /= size or 1.0
    step = 4 * len(a) / max(size, 1e-9) * 0.95
    for _ in range(steps):
        new = v - step * (a.T @ (sigmoid(a @ v) - y)) / len(a)
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - step * penalty, 0)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v = new + (t - 1) / t_new * (new - w)
        w, t = new, t_new
    return w


class RuleEnsemble:
    """Rules, weights and intercept; ``probability`` is the compiled Spark expression."""

    def __init__(self, rules: list[Rule], weights: list[float], intercept: float):
        self.rules, self.weights, self.intercept = rules, weights, intercept

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, seed: int = 3) -> RuleEnsemble:
        """Rules from boosted trees, weights by lasso; the penalty is the largest that loses little on held-back rows."""
        if len(y) == 0 or len(np.unique(y)) < 2:
            mean = float(y.mean()) if len(y) else 0.5
            return cls([], [], float(np.log(np.clip(mean, 0.001, 0.999) / (1 - np.clip(mean, 0.001, 0.999)))))
        rules = sorted({r for tree in boost(x, y, TREES, DEPTH, seed=seed).trees for r in rules_of(tree)}, key=repr)
        hits = np.stack([holds(r, x) for r in rules], axis=1).astype(np.float64)
        kept, rules_kept, seen = [], [], set()
        for k, r in enumerate(rules):  # rules that hold for the same rows are one rule
            mark = hits[:, k].tobytes()
            if 0 < hits[:, k].mean() < 1 and mark not in seen:
                seen.add(mark)
                kept.append(k)
                rules_kept.append(r)
        hits = hits[:, kept]
        back = np.random.default_rng(seed).random(len(y)) < 0.2
        losses, w = [], None
        for penalty in PENALTIES:
            w = lasso(hits[~back], y[~back], penalty, w)
            p = np.clip(sigmoid(hits[back] @ w[:-1] + w[-1]), 1e-6, 1 - 1e-6)
            losses.append(-np.mean(y[back] * np.log(p) + (1 - y[back]) * np.log(1 - p)) if back.any() else 0.0)
        best = next(p for p, loss in zip(PENALTIES, losses) if loss <= min(losses) + 0.01)
        w = lasso(hits, y, best)
        used = [(r, v) for r, v in zip(rules_kept, w[:-1]) if abs(v) > 1e-3]
        return cls([r for r, _ in used], [float(v) for _, v in used], float(w[-1]))

    def probability(self, columns: list[Column]) -> Column:
        """The weights of the rules that hold, summed in an array: its function is evaluated beside the generated code
        of the statistics, whose methods would else grow past what the JVM compiles."""
        terms = []
        for rule, weight in zip(self.rules, self.weights):
            test = None
            for f, low, high in rule:
                for c in ([columns[f] > low] if low is not None else []) + ([columns[f] <= high] if high is not None else []):
                    test = c if test is None else test & c
            terms.append(F.when(test, F.lit(weight)).otherwise(F.lit(0.0)))
        total = F.aggregate(F.array(*terms), F.lit(self.intercept), lambda a, x: a + x) if terms else F.lit(self.intercept)
        return 1 / (1 + F.exp(-total))


def held_out(id_col: str) -> Column:
    """Ids whose labels the fit never sees."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = FIT_ROWS) -> RuleEnsemble:
    """Fits on about ``rows`` labelled documents at most that are not held out, chosen by a cut-off of their id's hash."""
    usable = (
        labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
        .select(F.col(id_col).alias("__id"), F.col(label_col).cast("double").alias("__y"))
    )
    share = min(1.0, rows / max(1, usable.count()))
    chosen = usable.where(F.shiftrightunsigned(F.xxhash64("__id"), 11) < F.lit(int(share * 2**53)))
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text"))
    found = with_statistics(texts.join(F.broadcast(chosen), "__id"), "text").select(*[f"__{n}" for n in NAMES], "__y").toArrow()  # the sample's size bounds the broadcast
    x = np.stack([found.column(f"__{n}").to_numpy() for n in NAMES], axis=1) if found.num_rows else np.zeros((0, len(NAMES)))
    y = found.column("__y").to_numpy() if found.num_rows else np.zeros(0)
    order = np.lexsort([*x.T, y])
    return RuleEnsemble.fit(x[order], y[order])


def score_quality(docs: DataFrame, model: RuleEnsemble, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Adds ``held_out, score, predicted`` to the rows of ``docs``, replacing columns of these names.

    A null text counts as empty and is scored; a null id is never held out; repeated rows score alike; an
    empty table gives an empty result. Without usable labels of both kinds the score is the labels' mean, 0.5
    with none. Write the scores before filtering by them: Spark would compute a filter's statistics a second time.
    """
    own = [c for c in docs.columns if c not in ("held_out", "score", "predicted")]
    rows = docs.select(*[F.col(f"`{c}`").alias(f"c_{c}") for c in own])
    scored = with_statistics(rows, f"c_{text_col}").withColumn("score", model.probability([F.col(f"__{n}") for n in NAMES]))
    return scored.select(*[F.col(f"`c_{c}`").alias(c) for c in own], "score", held_out(f"c_{id_col}").alias("held_out"), (F.col("score") >= threshold).cast("int").alias("predicted"))


def op4_quality(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return score_quality(docs.select("doc_id", "text"), fit_quality(docs, labels)).select("doc_id", "held_out", "score", "predicted")
