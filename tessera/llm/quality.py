"""Quality by weak supervision: rules vote good or bad or abstain, and expectation-maximisation weighs them.

Each rule looks at one figure of a text; several see the same damage in different ways, and each is wrong at times. For
each of two hidden classes the model holds how often each rule votes bad when it votes (its accuracy follows from
that); abstentions tell nothing. EM starts at the share of bad votes and fits the model to the counts of vote patterns
over all documents, of which there are at most 3 to the number of rules, whatever the number of documents. A document
is kept if its posterior probability of being good is at least one half: no rule has to pass. Which class is the bad
one is settled by a weak prior, worth `PRIOR` votes a rule.

Nulls: a null text has no words and all figures zero. Empty tables give an empty result; repeated rows are judged
alike. A null id stays null. Other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import stored

FIGURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_distinct", "n_upper", "n_digits", "n_shouts", "n_symbol_words", "n_symbol_lines"]
#: Fixed values of the base test.
SYMBOLS = b"#*$%&|<>"
LEAST_WORDS, MOST_REPEATED = 50, 50

_SPACE = b" \t\n\v\f\r"
_CONTINUED = bytes(range(0x80, 0xC0))
_UPPER, _DIGITS = bytes(range(65, 91)), bytes(range(48, 58))


def repeated(ids: np.ndarray, kinds: int, k: int = 3) -> int:
    """Words in windows of k words that are found twice or more."""
    n = len(ids)
    if n <= k:
        return 0
    code = ids[: n - k + 1]
    for j in range(1, k):
        if kinds > 2_000_000:  # else the products fit in 63 bits
            code = np.unique(code, return_inverse=True)[1]
        code = code * kinds + ids[j : n - k + 1 + j]
    order = np.argsort(code, kind="stable")
    same = code[order][1:] == code[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(code), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for j in range(k):
        covered[j : n - k + 1 + j] |= twice
    return int(covered.sum())


def figures_of(text: bytes | None) -> list[int]:
    b = text or b""
    words = b.split()
    kinds: dict[bytes, int] = {}
    ids = np.fromiter((kinds.setdefault(w, len(kinds)) for w in words), np.int64, len(words))
    lines = [x for x in b.split(b"\n") if x.strip(_SPACE)]
    less = lambda drop: len(b) - len(b.translate(None, drop))
    symbols, held = less(SYMBOLS), lambda parts: sum(x.translate(None, SYMBOLS) != x for x in parts)
    marked = [held(words), held(lines)] if symbols else [0, 0]
    return [len(words), len(b.translate(None, _SPACE + _CONTINUED)), symbols, len(lines), len(lines) - len(set(lines)), repeated(ids, len(kinds)), len(kinds), less(_UPPER), less(_DIGITS), less(b"!?"), *marked]


def figures(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([figures_of(t.as_py()) for t in b.column(1)], np.int64).reshape(-1, len(FIGURES))
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(found[:, k]) for k in range(len(FIGURES))]], ["id", *FIGURES])

    return base.mapInArrow(made, f"id {base.schema['id'].dataType.simpleString()}, " + ", ".join(f"{f} long" for f in FIGURES))


#: Of the prior: how many votes of each rule it counts as, and the share of bad ones among them, for either class.
PRIOR, BAD_IN_GOOD, BAD_IN_BAD = 20.0, 0.05, 0.3


def rules() -> dict[str, tuple[Column, Column]]:
    """By name: votes bad where the first holds, good where the second does, else abstains."""
    per_word = lambda c: F.col(c) / F.greatest(F.col("n_words"), F.lit(1))
    per_char = lambda c: F.col(c) / F.greatest(F.col("word_chars"), F.lit(1))
    per_line = lambda c: F.col(c) / F.greatest(F.col("n_lines"), F.lit(1))
    n, some, length = F.col("n_words"), F.col("n_words") >= 20, per_word("word_chars")
    return {
        "length": (n < 20, n >= LEAST_WORDS),
        "brevity": (n < 100, n >= 200),
        "symbols": (per_word("n_symbols") > 0.1, per_word("n_symbols") < 0.01),
        "symbol_words": (per_word("n_symbol_words") > 0.15, per_word("n_symbol_words") < 0.02),
        "symbol_lines": (per_line("n_symbol_lines") > 0.5, per_line("n_symbol_lines") < 0.1),
        "capitals": (some & (per_char("n_upper") > 0.3), per_char("n_upper") < 0.1),
        "shouting": (some & (per_word("n_shouts") > 0.3), per_word("n_shouts") < 0.1),
        "repetition": (some & (per_word("n_repeat_words") > 0.3), per_word("n_repeat_words") < 0.1),
        "lines": ((F.col("n_lines") >= 3) & (per_line("n_dup_lines") > 0.3), (F.col("n_lines") >= 3) & (per_line("n_dup_lines") < 0.1)),
        "variety": (some & (n < 2000) & (per_word("n_distinct") < 0.2), some & (per_word("n_distinct") > 0.4)),
        "word_length": (some & ((length < 3) | (length > 10)), (length >= 4) & (length <= 7)),
        "digits": (per_char("n_digits") > 0.1, per_char("n_digits") < 0.02),
    }


def fit(votes: np.ndarray, counts: np.ndarray, rounds: int = 500) -> dict:
    """EM over vote patterns (rows of 0 abstain, 1 good, 2 bad) and their counts."""
    given, against = (votes > 0).astype(float), (votes == 2).astype(float)
    bad = against.sum(1) / np.maximum(given.sum(1), 1)
    prior, p = 0.5, np.zeros((2, votes.shape[1]))
    for _ in range(rounds):
        mass = np.stack([(1 - bad) * counts, bad * counts])
        prior = (mass[1].sum() + 0.5) / (counts.sum() + 1)
        p = (mass @ against + PRIOR * np.array([[BAD_IN_GOOD], [BAD_IN_BAD]])) / (mass @ given + PRIOR)
        score = np.log(p) @ against.T + np.log1p(-p) @ (given - against).T
        new = 1 / (1 + np.exp(np.clip(score[0] - score[1] + np.log((1 - prior) / prior), -500, 500)))
        if np.abs(new - bad).max() < 1e-9:
            break
        bad = new
    return {"prior_bad": prior, "bad_votes": p, "good": 1 - bad, "accuracy": (1 - prior) * (1 - p[0]) + prior * p[1]}


def judge(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, the figures, the number of bad votes, base_failed, posterior (of being good) and kept, by row."""
    spark, given = docs.sparkSession, rules()
    known = figures(docs, id_col=id_col, text_col=text_col)
    known = known.withColumn("n_bad_votes", sum((F.coalesce(bad, F.lit(False)).cast("int") for bad, _ in given.values()), F.lit(0)))
    code = sum((F.when(bad, 2).when(good, 1).otherwise(0) * 3**i for i, (bad, good) in enumerate(given.values())), F.lit(0))
    known = stored(known.withColumn("pattern", code.cast("int")), "figures")
    seen = sorted((r["pattern"], r["count"]) for r in known.groupBy("pattern").count().collect())  # at most 3^12 rows
    patterns = np.array([p for p, _ in seen], np.int64)
    votes = np.stack([patterns // 3**i % 3 for i in range(len(given))], axis=1)
    model = fit(votes, np.array([n for _, n in seen], float)) if seen else {"good": []}
    table = spark.createDataFrame([(int(p), float(g)) for p, g in zip(patterns, model["good"], strict=True)], "of int, posterior double")
    short = F.col("n_words") < LEAST_WORDS
    failed = short | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    out = known.join(F.broadcast(table), F.col("pattern") == F.col("of")).withColumn("base_failed", failed)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= 0.5)).select("id", *FIGURES, "n_bad_votes", "base_failed", "posterior", "kept")
