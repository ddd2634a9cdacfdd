"""Quality rules as a learned decision list, with DataFrame functions only.

Statistics of a text are array expressions within its row, so texts are never shuffled. Sequential covering grows a
conjunction of thresholds condition by condition for information gain, prunes it on rows held out for that, drops
what it covers and starts the next; each step is one grouped count over the labelled rows' binned statistics. The
list becomes one conditional expression."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved

SPACE = r"[\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
FEATURES = ("n_words", "word_length", "symbol_share", "repeat_share", "dup_line_share", "upper_share")
Condition = tuple[str, bool, float]  # feature, True: above the threshold, else at most


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, whatever the number of uses inside."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeat_words(words: Column, n: int = 8) -> Column:
    """Words of an array that lie in n-word windows found twice or more in it."""
    def covered(starts: Column) -> Column:
        parts = F.transform(starts, lambda p, j: F.least(F.lit(n), F.coalesce(F.get(starts, j + 1) - p, F.lit(n))))
        return F.aggregate(parts, F.lit(0), lambda a, x: a + x)

    def twins(grams: Column) -> Column:
        def same(g: Column, at: Column) -> Column:
            return F.coalesce(F.get(grams, at)["h"] == g["h"], F.lit(False))

        return F.sort_array(F.transform(F.filter(grams, lambda g, j: same(g, j - 1) | same(g, j + 1)), lambda g: g["i"]))

    def of(w: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(w) - n)
        grams = F.transform(at, lambda i: F.struct(F.xxhash64(F.slice(w, i + 1, n)).alias("h"), i.alias("i")))
        return F.when(F.size(w) < n, F.lit(0)).otherwise(let(F.sort_array(grams), lambda g: let(twins(g), covered)))

    return of(words)


def statistics(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_upper) of every document row.

    A null text counts as empty. Windows are told apart by a 64-bit hash within one text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.filter(F.split(text, SPACE + "+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    by_words = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeat_words(w).cast("long").alias("n_repeat_words")))
    by_lines = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    return docs.select(
        F.col(id_col), by_words.alias("w"), by_lines.alias("l"),
        F.length(F.regexp_replace(text, SPACE + "+", "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.length(text) - F.length(F.regexp_replace(text, r"\p{Lu}+", ""))).cast("long").alias("n_upper"),
    ).select(id_col, "w.n_words", "word_chars", "n_symbols", "l.n_dup_lines", "w.n_repeat_words", "l.n_lines", "n_upper")


def features(stats: DataFrame) -> dict[str, Column]:
    """FEATURES from the columns of statistics(); shares of nothing are 0."""
    def share(a: str, b: str) -> Column:
        return F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))

    return {
        "n_words": F.col("n_words").cast("double"), "word_length": share("word_chars", "n_words"),
        "symbol_share": share("n_symbols", "word_chars"), "repeat_share": share("n_repeat_words", "n_words"),
        "dup_line_share": share("n_dup_lines", "n_lines"), "upper_share": share("n_upper", "word_chars"),
    }


def _meets(rule: list[tuple[int, bool, int]]) -> Column:
    out = F.lit(True)
    for f, above, cut in rule:
        bin_ = F.get("bins", F.lit(f))
        out = out & ((bin_ > cut) if above else (bin_ <= cut))
    return out


def learn(labelled: DataFrame, bad: str = "bad", *, most_rules: int = 8, most_conditions: int = 4, bins: int = 24) -> list[list[Condition]]:
    """Ordered rules, each a conjunction of thresholds, for rows whose boolean column `bad` is true.

    labelled has the columns of statistics(). Every labelled row takes part. Bin b of a feature
    holds the values above b of its cuts, so "bin > c" is "value > cuts[c]". A third, chosen by a hash, is for pruning;
    a rule whose precision there is under a half ends the list. Without rows, or with one class, there are no rules."""
    cols = features(labelled)
    rows = labelled.select(F.col(bad).alias("bad"), *(c.alias(k) for k, c in cols.items())).where(F.col("bad").isNotNull())
    at = [k / bins for k in range(1, bins)]
    found = rows.agg(*(F.percentile_approx(k, at, 10_000).alias(k) for k in FEATURES)).collect()[0]
    if found[0] is None:
        return []
    cuts = {k: sorted(set(found[k])) for k in FEATURES}
    binned = [F.size(F.filter(F.array(*map(F.lit, cuts[k])), _below(F.col(k)))) for k in FEATURES]
    part = F.pmod(F.xxhash64(*FEATURES), F.lit(3))
    table = saved(rows.select("bad", F.array(*binned).alias("bins"), (part == 0).alias("prune")).groupBy("bad", "bins", "prune").count(), "rules")
    rules: list[list[tuple[int, bool, int]]] = []

    def counts(where: Column, key: Column) -> list:
        good, ill = (F.sum(F.when(F.col("bad") == b, F.col("count")).otherwise(0)) for b in (False, True))
        for rule in rules:
            where = where & ~_meets(rule)
        return table.where(where).select(key.alias("k"), "bad", "count").groupBy("k").agg(ill.alias("ill"), good.alias("good")).collect()

    while len(rules) < most_rules:
        rule: list[tuple[int, bool, int]] = []
        while len(rule) < most_conditions:
            exploded = counts_by_bin(counts, ~F.col("prune") & _meets(rule))
            best = best_condition(exploded, [len(cuts[k]) for k in FEATURES])
            if best is None:
                break
            rule.append(best[0])
            if best[1] == 0:
                break
        if not rule:
            break
        tests = [rule[:k] for k in range(1, len(rule) + 1)]
        held = counts(F.col("prune"), F.array(*(_meets(t) for t in tests)))
        worth = []
        for k in range(len(tests)):
            ill, good = (sum(r[c] for r in held if r["k"][k]) for c in ("ill", "good"))
            worth.append(((ill - good) / (ill + good) if ill + good else -1, ill, k))
        value, ill, k = max(worth, key=lambda w: (w[0], w[1]))
        if value <= 0:
            break
        rules.append(tests[k])
    return [[(FEATURES[f], above, float(cuts[FEATURES[f]][cut])) for f, above, cut in rule] for rule in rules]


def _below(value: Column):
    return lambda t: t < value


def counts_by_bin(counts: Callable, where: Column) -> dict[tuple[int, int], tuple[int, int]]:
    """(bad, good) rows of each (feature, bin); at most features x bins rows come back."""
    keys = F.explode(F.transform("bins", lambda b, f: F.struct(f.alias("f"), b.alias("b"))))
    return {(r["k"]["f"], r["k"]["b"]): (r["ill"], r["good"]) for r in counts(where, keys)}


def best_condition(by_bin: dict[tuple[int, int], tuple[int, int]], n_cuts: list[int]):
    """The condition of highest gain (covered bad rows times what they gain in log precision) and the good rows left."""
    best = None
    for f, n in enumerate(n_cuts):
        per = [by_bin.get((f, b), (0, 0)) for b in range(n + 1)]
        ill, good = sum(p[0] for p in per), sum(p[1] for p in per)
        if not ill or not good:
            return None
        before = math.log2(ill / (ill + good))
        low_ill = low_good = 0
        for cut in range(n):
            low_ill, low_good = low_ill + per[cut][0], low_good + per[cut][1]
            for above, p, q in ((False, low_ill, low_good), (True, ill - low_ill, good - low_good)):
                if p and (gain := p * (math.log2(p / (p + q)) - before)) > (best[2] if best else 1e-9):
                    best = ((f, above, cut), q, gain)
    return best[:2] if best else None


def verdict(rules: list[list[Condition]], cols: dict[str, Column]) -> Column:
    """True where no rule of the list holds: the list as one ordered conditional expression."""
    out = None
    for rule in rules:
        holds = F.lit(True)
        for name, above, cut in rule:
            holds = holds & ((cols[name] > cut) if above else (cols[name] <= cut))
        out = F.when(holds, False) if out is None else out.when(holds, False)
    return F.lit(True) if out is None else out.otherwise(True)


def op3(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's row for each document. The list is learned from the labelled documents that pass the base rule,
    quality 0 being bad; labels that are null, or of no document, don't count."""
    stats = saved(statistics(docs), "statistics")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    marks = labels.where("quality in (0, 1)").select("doc_id", (F.col("quality") == 0).alias("bad"))
    rules = learn(stats.where(~failed).join(marks, "doc_id"))
    return stats.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & verdict(rules, features(stats))).alias("kept"),
    )
