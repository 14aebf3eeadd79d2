"""Quality rules: decision lists learned by sequential covering.

Every document is described by shares and counts that Spark computes from its
whole text (`FEATURES`).  From labelled documents an ordered list of rules is
learned: each is a conjunction of thresholds, grown condition by condition by
information gain on two thirds of the labelled rows that no earlier rule
covers, then pruned on the other third.  The list becomes one Spark CASE
expression; documents that no rule covers are kept.

Only training is bounded: it uses at most `sample_rows` labelled rows (a
parameter).  The rules are applied to every document.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import aside, small_enough

#: Thresholds tried per feature: quantiles of the labelled rows.
CUTS = 64


def _left(text: Column, without: str) -> Column:
    """Characters of `text` that are left when all runs of `without` are taken out."""
    return F.length(F.regexp_replace(text, without, ""))


def features(text: Column) -> dict[str, Column]:
    """The statistics of a text as Spark expressions; all are 0 for a null or empty one.

    Word and line shares are over white-space separated words and over lines
    that aren't blank; character shares are over all characters.
    """
    text = F.coalesce(text.cast("string"), F.lit(""))
    chars = F.greatest(F.length(text), F.lit(1))
    word = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    n = F.size(word)
    line = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    per_word = F.greatest(n, F.lit(1))
    return {
        "n_words": n.cast("double"),
        "word_length": _left(text, r"\s+") / per_word,
        "letter_share": (F.length(text) - _left(text, r"\p{L}+")) / chars,
        "upper_share": (F.length(text) - _left(text, r"\p{Lu}+")) / chars,
        "digit_share": (F.length(text) - _left(text, r"\p{Nd}+")) / chars,
        "symbol_share": _left(text, r"[\p{L}\p{M}\p{N}\s]+") / chars,
        "distinct_word_share": F.size(F.array_distinct(word)) / per_word,
        "repeated_line_share": (F.size(line) - F.size(F.array_distinct(line))) / F.greatest(F.size(line), F.lit(1)),
        "sentence_ends": (F.length(text) - _left(text, r"[.!?]+")) / per_word,
        "lines_per_word": F.size(line) / per_word,
    }


FEATURES = ("n_words", "word_length", "letter_share", "upper_share", "digit_share", "symbol_share", "distinct_word_share", "repeated_line_share", "sentence_ends", "lines_per_word")


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.feature] >= self.threshold if self.above else x[self.feature] < self.threshold

    def column(self) -> Column:
        return F.col(self.feature) >= F.lit(self.threshold) if self.above else F.col(self.feature) < F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<'} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def covers(rule: Rule, x: dict[str, np.ndarray]) -> np.ndarray:
    """Which rows all conditions of the rule hold for."""
    out = np.ones(len(next(iter(x.values()))), bool)
    for c in rule:
        out &= c.holds(x)
    return out


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, most: int) -> Rule:
    """Adds the condition of greatest information gain until no good row is covered or nothing gains."""
    rule, inside = [], np.ones(len(bad), bool)
    while len(rule) < most:
        p, n = int(bad[inside].sum()), int((~bad[inside]).sum())
        if not p or not n:
            break
        before, best = np.log2(p / (p + n)), (1e-9, None)
        for name, values in x.items():
            v, b = values[inside], bad[inside]
            order = np.argsort(v, kind="stable")
            v, b = v[order], b[order]
            cut = np.unique(np.searchsorted(v, np.unique(np.quantile(v, np.linspace(0, 1, CUTS + 2)))))
            cut = cut[(cut > 0) & (cut < len(v))]
            if not len(cut):
                continue
            low_p = np.concatenate(([0], np.cumsum(b)))[cut]
            for above, cp, cn in ((False, low_p, cut - low_p), (True, p - low_p, n - (cut - low_p))):
                gain = np.where(cp > 0, cp * (np.log2(np.maximum(cp, 1e-12) / np.maximum(cp + cn, 1)) - before), -1)
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (float(gain[k]), Condition(name, above, float((v[cut[k] - 1] + v[cut[k]]) / 2)))
        if best[1] is None:
            break
        rule.append(best[1])
        inside &= best[1].holds(x)
    return tuple(rule)


def _prune(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """The beginning of the rule that is worth most, (p - n) / (p + n), on rows it wasn't grown on; the shortest of equals."""

    def worth(r: Rule) -> float:
        c = covers(r, x)
        p, n = int((c & bad).sum()), int((c & ~bad).sum())
        return (p - n) / (p + n) if p + n else -1.0

    return max((rule[:k] for k in range(1, len(rule) + 1)), key=lambda r: (worth(r), -len(r)), default=())


def tightest(rule: Rule) -> Rule:
    """The same rule with one condition for each feature and direction."""
    out: dict[tuple[str, bool], Condition] = {}
    for c in rule:
        k = (c.feature, c.above)
        if k not in out or (c.threshold > out[k].threshold) == c.above:
            out[k] = c
    return tuple(out.values())


def learn(x: dict[str, np.ndarray], bad: np.ndarray, max_rules: int = 12, max_conditions: int = 4, min_precision: float = 0.9, min_cover: int = 5) -> list[Rule]:
    """An ordered list of rules for the rows marked `bad`; empty where one class is missing.

    Learning stops when the next rule's precision on its pruning rows is below
    `min_precision` or it covers fewer than `min_cover` bad rows.  The model's
    size is bounded by `max_conditions` a rule and `max_rules`, which keep the
    list readable and the CASE expression short; thresholds are tried at CUTS
    quantiles of the rows still covered.  These bound what is learned from the
    sample, not which documents are judged.
    """
    rules: list[Rule] = []
    left = np.ones(len(bad), bool)
    third = (np.arange(len(bad)) * 2654435761 % (1 << 32)) % 3 == 0
    while len(rules) < max_rules:
        grow, prune = left & ~third, left & third
        if not bad[grow].any() or bad[grow].all() or not prune.any():
            break
        part = lambda at: {k: v[at] for k, v in x.items()}
        rule = tightest(_prune(_grow(part(grow), bad[grow], max_conditions), part(prune), bad[prune]))
        inside = covers(rule, x) & left if rule else np.zeros(len(bad), bool)
        p, n = int((inside & prune & bad).sum()), int((inside & prune & ~bad).sum())
        if not rule or p < (p + n) * min_precision or not p or int((inside & bad).sum()) < min_cover:
            break
        rules.append(rule)
        left &= ~inside
    return rules


def labelled(docs: DataFrame, labels: DataFrame, sample_rows: int) -> DataFrame:
    """Features and `bad` of up to about `sample_rows` labelled documents, picked by a hash of the id."""
    ids = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("bigint").alias("rule_doc_id"))
    ids = ids.agg(F.min("quality").alias("quality"), F.max("quality").alias("most")).where("quality = most").drop("most")
    n = ids.count()
    if n > sample_rows:
        ids = ids.where(F.pmod(F.xxhash64("rule_doc_id"), F.lit(1 << 30)) < int((1 << 30) * sample_rows / n))
    ids = F.broadcast(ids) if small_enough(ids, 4_000_000) else ids
    rows = docs.select(F.col("doc_id").cast("bigint").alias("rule_doc_id"), F.col("text").alias("rule_text")).join(ids, "rule_doc_id")
    return rows.select("rule_doc_id", (F.col("quality") == 0).alias("bad"), *(c.alias(k) for k, c in features(F.col("rule_text")).items()))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = 50_000, **how) -> list[Rule]:
    """Learns the rules from the documents whose label `quality` is 0 (bad) or not (good).

    Labels with a null id or quality, or that contradict each other, are left
    out; without labels, or with one class alone, there are no rules.
    """
    rows = labelled(docs, labels, sample_rows).toPandas().sort_values(["rule_doc_id", *FEATURES], kind="stable")
    if rows.empty:
        return []
    return learn({k: rows[k].to_numpy(float) for k in FEATURES}, rows["bad"].to_numpy(bool), **how)


def judged(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """`docs` with the columns rule_no (int, from 1; null where no rule covers the row) and rule (its text).

    Each row is judged by its own text; null and empty texts have all features
    0.  Columns named rule_no or rule are replaced; all others stay, whatever
    their names.
    """
    if not rules:
        return docs.withColumns({"rule_no": F.lit(None).cast("int"), "rule": F.lit(None).cast("string")})
    kept = [c for c in docs.columns if c not in ("rule_no", "rule")]
    used = {c.feature for r in rules for c in r}
    wide = docs.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row"), *(c.alias(k) for k, c in features(docs["text"]).items() if k in used))
    no = text = None
    for k, rule in enumerate(rules, 1):
        cond = rule[0].column()
        for c in rule[1:]:
            cond &= c.column()
        no = F.when(cond, F.lit(k)) if no is None else no.when(cond, F.lit(k))
    numbered = wide.select("row", no.cast("int").alias("rule_no"))
    text = F.element_at(F.array(*(F.lit(" and ".join(map(str, r))) for r in rules)), F.col("rule_no"))
    return numbered.select(*(F.col("row").getField(c).alias(c) for c in kept), "rule_no", F.when(F.col("rule_no").isNotNull(), text).alias("rule"))


def decisions(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """(doc_id, keep, rule_no, rule) for every row of `docs`: the decision and the rule behind it.

    Each row is judged by its own text: null and empty texts have all features
    0, repeated rows are judged alike, a null doc_id is passed through.  Without
    usable labels every row is kept.  An empty table gives no rows; extra
    columns are ignored.
    """
    return judged(docs.select("doc_id", "text"), fit(docs, labels, **how)).select("doc_id", F.col("rule_no").isNull().alias("keep"), "rule_no", "rule")


def accepted(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """The rows of `docs` that no rule rejects, with their columns; awkward rows are judged as in `decisions`."""
    docs, back = aside(docs, "rule_no", "rule")
    return judged(docs, fit(docs, labels, **how)).where("rule_no is null").select(*(F.col(f"`{c}`") for c in docs.columns)).transform(back)
