"""Operator 4 [native]: weak supervision over quality rules.

Each rule looks at evidence of its own and votes bad (-1) or good (1), or abstains (0). How often good and bad texts get each
vote is estimated without labels by expectation-maximisation from assumed accuracies (``ASSUMED``, worth ``WORTH`` texts in
each round as well), and a text's posterior probability of being good replaces an all-must-pass filter: a vote against that
texts get which all other rules call good weighs little and is outvoted. Texts that fail the base test are decided
by it and do not take part in the estimate.

All other texts vote; the driver gets a count for each combination of votes, of which there are at most 3**len(RULES),
however many texts there are, and runs the iterations on those counts. The verdict is an expression again. Everything
that touches rows is a DataFrame function.

Defined results: a null or empty text has no words, fails the base test and is not kept; rows are independent, so repeated rows
get equal results; an empty table gives no rows (the estimates are then the assumed ones); a row keeps its other columns,
and a column ``_quality`` that it has already is overwritten only in ``measured``'s own result; texts are whole.
Repeated windows are found by 64-bit hashes.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import SPACE, let, stored, table, words

#: Positions that fit below a hash in one long; texts of more words are sorted by (hash, position) pairs.
BITS = 20


def _runs(sorted_: Column, key) -> Column:
    """Elements of a sorted array whose key equals a neighbour's."""
    same = lambda x, i: F.coalesce(key(x) == key(F.get(sorted_, i)), F.lit(False))
    return F.filter(sorted_, lambda x, i: same(x, i - 1) | same(x, i + 1))


def repeat_words(w: Column) -> Column:
    """Words of ``w`` within 3-word windows that stand there twice or more.

    Windows are hashed; sorting long keys (high bits of the hash, then the position) finds the few windows that may
    repeat, and those alone are compared by their whole hashes.
    """
    low = (1 << BITS) - 1

    def of(h: Column) -> Column:
        keys = F.transform(h, lambda x, i: x.bitwiseAND(F.lit(~low)).bitwiseOR(i.cast("long")))
        short = let(F.sort_array(keys), lambda s: F.transform(_runs(s, lambda x: F.shiftright(x, BITS)), lambda x: x.bitwiseAND(F.lit(low)).cast("int")))
        maybe = F.when(F.size(h) <= low, short).otherwise(F.sequence(F.lit(0), F.size(h) - 1))
        pairs = let(maybe, lambda m: F.sort_array(F.transform(m, lambda p: F.struct(F.get(h, p).alias("h"), p.alias("p")))))
        at = let(pairs, lambda e: F.transform(_runs(e, lambda x: x["h"]), lambda x: x["p"]))
        return let(at, lambda p: F.size(F.array_distinct(F.concat(p, F.transform(p, lambda x: x + 1), F.transform(p, lambda x: x + 2)))))

    hashes = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
    return F.when(F.size(w) < 4, F.lit(0)).otherwise(let(hashes, of))


#: Signs that end a clause, before white space or the end; and words without a letter or digit.
STOPS = r"[.?!:](?=[\x20\x09-\x0D]|\z)"
BARE = r"(?<![^\x20\x09-\x0D])[^\p{L}\p{N}\x20\x09-\x0D]+(?![^\x20\x09-\x0D])"


def measures(text: Column) -> Column:
    """A struct of the counts that the rules use."""
    t = F.coalesce(text, F.lit(""))
    drop = lambda x, pattern: F.char_length(x) - F.char_length(F.regexp_replace(x, pattern, ""))
    by_lines = F.filter(F.split(t, "\n", -1), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    lines = let(by_lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    of_words = let(words(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"), repeat_words(w).cast("long").alias("n_repeat_words")))
    signs = {"n_symbols": drop(t, "[#*$%&|<>]+"), "n_upper": drop(t, "\\p{Lu}+"), "n_shouts": drop(t, "!+"), "n_stops": F.regexp_count(t, F.lit(STOPS)), "n_bare": F.regexp_count(t, F.lit(BARE))}
    parts = F.struct(of_words.alias("w"), lines.alias("l"), *(x.cast("long").alias(c) for c, x in signs.items()))
    return let(parts, lambda p: F.struct(*(p["w"][c].alias(c) for c in ("n_words", "word_chars", "n_repeat_words")), *(p["l"][c].alias(c) for c in ("n_lines", "n_dup_lines")), *(p[c].alias(c) for c in signs)))


def _vote(bad: Column, good: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0)


#: name -> vote, from the measures by name. Shares are of the characters in words, of words, or of lines.
RULES = {
    "symbols": lambda m: _vote(100 * m("n_symbols") > 4 * m("word_chars"), 1000 * m("n_symbols") <= 2 * m("word_chars")),
    "capitals": lambda m: _vote(100 * m("n_upper") > 30 * m("word_chars"), (1000 * m("n_upper")).between(3 * m("word_chars"), 80 * m("word_chars"))),
    "shouting": lambda m: _vote(100 * m("n_shouts") > 4 * m("word_chars"), 200 * m("n_shouts") <= m("word_chars")),
    "repeated_lines": lambda m: _vote((m("n_dup_lines") >= 2) & (100 * m("n_dup_lines") > 20 * m("n_lines")), (m("n_lines") >= 4) & (m("n_dup_lines") == 0)),
    "repeated_words": lambda m: _vote(100 * m("n_repeat_words") > 20 * m("n_words"), 100 * m("n_repeat_words") <= 5 * m("n_words")),
    "word_length": lambda m: _vote((m("word_chars") > 7 * m("n_words")) | (m("word_chars") < 3 * m("n_words")), (10 * m("word_chars")).between(40 * m("n_words"), 62 * m("n_words"))),
    "sentences": lambda m: _vote((200 * m("n_stops") < m("n_words")) | (4 * m("n_stops") > m("n_words")), (40 * m("n_stops") >= m("n_words")) & (6 * m("n_stops") <= m("n_words"))),
    "bare_signs": lambda m: _vote(100 * m("n_bare") > 8 * m("n_words"), 100 * m("n_bare") <= m("n_words")),
}
#: Assumed shares of the votes -1, 0 and 1 on good and on bad texts, how many texts they count for, and the assumed share of good texts.
ASSUMED, WORTH, GOOD = {True: (0.05, 0.35, 0.6), False: (0.4, 0.3, 0.3)}, 2, 0.85


def measured(docs: DataFrame) -> DataFrame:
    """``docs`` with the measures in one struct column ``_quality`` (a column of that name is overwritten)."""
    return docs.withColumn("_quality", measures(F.col("text")))


def votes(m: Column) -> list[Column]:
    return [rule(lambda c: m[c]).cast("int").alias(name) for name, rule in RULES.items()]


def estimate(counts: list[tuple[tuple[int, ...], int]], rounds: int = 100) -> tuple[float, list[dict[int, float]]]:
    """(log odds of good, per rule the log-likelihood ratio of each vote) by expectation-maximisation on vote counts."""
    total = sum(n for _, n in counts)
    prior = math.log(GOOD / (1 - GOOD))
    ratios = [{v: math.log(ASSUMED[True][v + 1] / ASSUMED[False][v + 1]) for v in (-1, 0, 1)} for _ in RULES]
    for _ in range(rounds if total else 0):
        logits = {v: max(-500.0, min(500.0, prior + sum(ratios[r][x] for r, x in enumerate(v)))) for v, _ in counts}
        good = {v: 1 / (1 + math.exp(-x)) for v, x in logits.items()}
        n_good = sum(n * good[v] for v, n in counts)
        prior = math.log((n_good + 1) / (total - n_good + 1))
        for r, ratio in enumerate(ratios):
            for vote in (-1, 0, 1):
                a = sum(n * good[v] for v, n in counts if v[r] == vote)
                b = sum(n * (1 - good[v]) for v, n in counts if v[r] == vote)
                a, b = a + WORTH * ASSUMED[True][vote + 1], b + WORTH * ASSUMED[False][vote + 1]
                ratio[vote] = math.log(a / (n_good + WORTH)) - math.log(b / (total - n_good + WORTH))
    return prior, ratios


def fitted(docs: DataFrame, m: Column) -> tuple[float, list[dict[int, float]]]:
    """The estimate from all rows of ``docs``, whose measures are ``m`` (which is computed once for each row)."""
    names = list(RULES)
    ballot = let(m, lambda x: F.struct(base_failed(x).alias("failed"), *votes(x)))
    rows = docs.select(ballot.alias("v")).groupBy("v").count().collect()  # at most 2 * 3**len(RULES) rows
    return estimate(sorted((tuple(r.v[c] for c in names), r["count"]) for r in rows if not r.v.failed))


def base_failed(m: Column) -> Column:
    return (m["n_words"] < 50) | (100 * m["n_repeat_words"] > 50 * m["n_words"])


def posterior(m: Column, model: tuple[float, list[dict[int, float]]]) -> Column:
    logit = F.lit(model[0])
    for vote, ratio in zip(votes(m), model[1], strict=True):
        logit = logit + F.when(vote == -1, ratio[-1]).when(vote == 1, ratio[1]).otherwise(ratio[0])
    return 1 / (1 + F.exp(-logit))


def verdict(m: Column, model: tuple[float, list[dict[int, float]]]) -> Column:
    """Whether a text with these measures is kept."""
    return ~base_failed(m) & (posterior(m, model) >= 0.5)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = stored(measured(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"), "quality")
    m = F.col("_quality")
    model = fitted(docs, m)
    good = posterior(m, model)
    return docs.select("doc_id", *(m[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), base_failed(m).alias("base_failed"), verdict(m, model).alias("kept"), good.alias("good"))
