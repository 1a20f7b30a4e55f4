"""Quality rules by weak supervision, in DataFrame expressions only.

Each rule looks at one measure of a text and votes good, bad or abstains.  Rules are noisy on purpose: sound texts
fail some of them, and several rules look at each kind of junk.  The table of vote patterns (at most 3^rules rows,
however large the corpus) is counted over all documents, and expectation-maximisation on it estimates how each rule
votes on good and on bad documents.  The posterior probability of the pattern, not a demand that all rules pass,
decides: one bad vote of a rule that often errs drops nothing, several that rarely err do.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import free_prefix
from .common import WORD, only, write_once

GOOD, ABSTAIN, BAD = 1, 0, -1
SPACES = r"[\x20\x09-\x0D]+"
#: The characters that count as symbols.
SYMBOLS = "#*$%&|<>"
RULES = ("case", "capitals", "shouts", "symbols", "runs", "letters", "lines", "repeats", "doubled", "lengths", "sentences")
#: What is believed before any document, in documents: votes bad, none and good of a rule on good and on bad ones, and
#: good and bad documents.  Ten documents' worth, whatever the corpus, so that data decide as soon as there are some.
VOTES_OF_GOOD, VOTES_OF_BAD, DOCUMENTS = (0.5, 4.5, 5.0), (3.0, 4.0, 3.0), (9.0, 1.0)
#: Where the estimate starts: with this many bad votes a document is thought bad, with fewer good, by these odds.
SUSPECT, SURE = 2, 0.9


def once(value: Column, use) -> Column:
    """use(x) with x bound to the value, which is computed a single time."""
    return F.element_at(F.transform(F.array(value), use), 1)


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACES), lambda w: w != "")


def repeated_words(words: Column) -> Column:
    """Words that stand in a three-word window found twice or more: windows are sorted by hash and place, those
    with an equal neighbour count, and the places they cover are added up.  n log n in the words."""

    def sized(w: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
        return F.when(F.size(w) < 3, F.lit(0)).otherwise(once(windows, covered))

    def covered(h: Column) -> Column:
        some = F.size(F.array_distinct(h)) < F.size(h)
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(some, once(ordered, places)).otherwise(F.lit(0))

    def places(s: Column) -> Column:
        same = lambda e, i: F.coalesce(F.get(s, i - 1)["h"] == e["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == e["h"], F.lit(False))
        at = F.sort_array(F.transform(F.filter(s, same), lambda e: e["i"]))
        return once(at, lambda p: F.aggregate(F.transform(p, lambda x, i: F.when(i == 0, F.lit(3)).otherwise(F.least(F.lit(3), x - F.get(p, i - 1)))), F.lit(0), lambda a, x: a + x))

    return once(words, sized)


def measured(docs: DataFrame, text_col: str, held: str) -> DataFrame:
    """docs with a struct ``held`` of the measures of each whole text."""
    t = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD))
    again = once(lines, lambda x: F.struct(F.size(x).alias("all"), (F.size(x) - F.size(F.array_distinct(x))).alias("again")))
    doubled = lambda w: F.size(F.filter(w, lambda x, i: (i > 0) & (x == F.get(w, i - 1))))
    of_words = once(words_of(t), lambda w: F.struct(F.size(w).alias("n"), repeated_words(w).alias("again"), doubled(w).alias("doubled")))
    rows = docs.withColumns({held + "_l": again, held + "_w": of_words})
    without = lambda pattern: F.length(F.regexp_replace(t, pattern, ""))
    values = {
        "n_words": F.col(held + "_w.n"),
        "word_chars": without(SPACES),
        "n_symbols": F.length(t) - F.length(F.translate(t, SYMBOLS, "")),
        "n_dup_lines": F.col(held + "_l.again"),
        "n_repeat_words": F.col(held + "_w.again"),
        "n_lines": F.col(held + "_l.all"),
        "n_upper": F.regexp_count(t, F.lit(r"\p{Lu}")),
        "n_capitals": F.regexp_count(t, F.lit(r"\p{Lu}{2,}")),
        "n_shouts": F.length(t) - F.length(F.translate(t, "!", "")),
        "n_runs": F.regexp_count(t, F.lit(f"[{SYMBOLS}]+")),
        "n_letters": F.length(t) - without(r"\p{L}+"),
        "n_doubled": F.col(held + "_w.doubled"),
        "n_stops": F.regexp_count(t, F.lit(r"[.?;:](?=\s|$)")),
    }
    return rows.withColumn(held, F.struct(*[c.cast("long").alias(n) for n, c in values.items()])).drop(held + "_l", held + "_w")


def measures(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and a struct ``m`` of the measures of its whole text; one pass over the scan."""
    rows = only(docs, id_col, text_col)
    held = free_prefix(rows) + "m"
    return measured(rows, text_col, held).select(F.col(f"`{id_col}`"), F.col(held).alias("m" if id_col.lower() != "m" else held))


def votes(held: str) -> dict[str, Column]:
    """Each rule votes bad beyond one limit and good beyond another, and abstains between them.  Rules for what is
    seldom found at all, shouting and runs of symbols, say nothing for a text without it."""
    m = measure(held)
    n, c, stops = m("n_words"), m("word_chars"), m("n_stops")

    def vote(bad: Column, good: Column | None = None) -> Column:
        own = F.when(n == 0, ABSTAIN).when(bad, BAD)
        return (own if good is None else own.when(good, GOOD)).otherwise(ABSTAIN).cast("int")

    return {
        "case": vote(m("n_upper") * 12 > c, m("n_upper") * 25 <= c),
        "capitals": vote(m("n_capitals") * 20 > n, m("n_capitals") * 100 <= n),
        "shouts": vote(m("n_shouts") * 20 > n),
        "symbols": vote(m("n_symbols") * 20 > n, m("n_symbols") * 200 <= n),
        "runs": vote(m("n_runs") * 25 > n),
        "letters": vote(m("n_letters") * 100 < c * 90, m("n_letters") * 100 >= c * 94),
        "lines": vote(m("n_dup_lines") * 5 > m("n_lines"), (m("n_dup_lines") == 0) & (m("n_lines") > 2)),
        "repeats": vote(m("n_repeat_words") * 20 > n, m("n_repeat_words") * 100 <= n),
        "doubled": vote(m("n_doubled") * 50 > n, m("n_doubled") * 200 <= n),
        "lengths": vote((c * 10 < n * 42) | (c > n * 7), (c * 10 >= n * 46) & (c <= n * 6)),
        "sentences": vote((stops * 40 < n) | (stops * 5 > n), (stops * 25 >= n) & (stops * 7 <= n)),
    }


def measure(held: str):
    return lambda name: F.col(f"{held}.{name}")


def base_failed(held: str) -> Column:
    m = measure(held)
    return (m("n_words") < 50) | (m("n_repeat_words") * 100 > m("n_words") * 50)


def estimate(patterns: dict[tuple[int, ...], int], rounds: int = 200) -> tuple[dict[tuple[int, ...], float], list[dict[int, tuple[float, float]]], float]:
    """By expectation-maximisation over counted vote patterns: the posterior probability of "good" for each pattern,
    for each rule the share of each vote among good and among bad documents, and the share of good documents.

    A rule's accuracies are whatever the documents say, but for the small prior counts; votes are taken as
    independent within each class.  Patterns with SUSPECT bad votes or more start as bad."""
    if not patterns:
        return {}, [], 1.0
    total, rules = sum(patterns.values()), len(next(iter(patterns)))
    belief = {p: 1 - SURE if p.count(BAD) >= SUSPECT else SURE for p in patterns}
    for _ in range(rounds):
        good = (sum(n * belief[p] for p, n in patterns.items()) + DOCUMENTS[0]) / (total + sum(DOCUMENTS))
        table = []
        for j in range(rules):
            of = {v: [VOTES_OF_GOOD[i], VOTES_OF_BAD[i]] for i, v in enumerate((BAD, ABSTAIN, GOOD))}
            for p, n in patterns.items():
                of[p[j]][0] += n * belief[p]
                of[p[j]][1] += n * (1 - belief[p])
            sums = [sum(x[k] for x in of.values()) for k in (0, 1)]
            table.append({v: (x[0] / sums[0], x[1] / sums[1]) for v, x in of.items()})
        weigh = [{v: math.log(x / y) for v, (x, y) in of.items()} for of in table]
        new = {}
        for p in patterns:
            z = math.log(good / (1 - good)) + sum(w[v] for w, v in zip(weigh, p))
            new[p] = 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))
        moved = max(abs(new[p] - belief[p]) for p in patterns)
        belief = new
        if moved < 1e-9:
            break
    return belief, table, good


def judge(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """doc_id, the measures, base_failed, bad_votes, quality (posterior) and kept, for every row.

    A null text has no words; texts without words fail the base rule.  Repeated rows are judged alike; an empty
    table gives no rows; further columns are left out.  Documents that fail the base rule take no part in the
    estimate; their quality is 0.  The measures of each row, a few numbers, are written once to the shared folder, so
    that counting the patterns and judging read texts once.
    """
    rows = write_once(measures(docs, id_col=id_col, text_col=text_col), "quality")
    held = rows.columns[1]
    voted, quality = with_quality(rows, beliefs(rows, held), held)
    bad = sum((F.when(v == BAD, 1).otherwise(0) for v in votes(held).values()), F.lit(0))
    own = [F.col(f"`{id_col}`"), *[F.col(f"{held}.{c}") for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]]
    return voted.select(*own, base_failed(held).alias("base_failed"), bad.alias("bad_votes"), quality.alias("quality"), (quality >= threshold).alias("kept"))


def beliefs(rows: DataFrame, held: str) -> dict[tuple[int, ...], float]:
    """The posterior of each vote pattern among rows with measures; collects twice 3^rules rows at most."""
    # the base rule is a key of the counts, not a filter below them: a filter would work out the measures once more
    counted = rows.select(*[v.alias(k) for k, v in votes(held).items()], base_failed(held).alias("failed")).groupBy(*RULES, "failed").count().collect()
    return estimate({tuple(r[n] for n in RULES): r["count"] for r in counted if not r["failed"]})[0]


def with_quality(rows: DataFrame, belief: dict[tuple[int, ...], float], held: str) -> tuple[DataFrame, Column]:
    """rows joined with the posterior of their votes, and the quality by it: 0 where the base rule fails."""
    prefix = free_prefix(rows)
    names, value = [f"{prefix}{k}" for k in RULES], prefix + "posterior"
    table = rows.sparkSession.createDataFrame([(*p, q) for p, q in sorted(belief.items())], ", ".join(f"{n} int" for n in names) + f", {value} double")
    voted = rows.withColumns(dict(zip(names, votes(held).values())))
    return voted.join(F.broadcast(table), names, "left"), F.when(base_failed(held), 0.0).otherwise(F.coalesce(F.col(value), F.lit(0.0)))


def keep_good(docs: DataFrame, *, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows that judge() keeps, with all their columns, whatever these are called.

    Null and empty texts fail the base rule and go; repeated rows stay or go alike; an empty table stays empty.  The
    rows are written once with their measures, so that texts are measured once and never shuffled."""
    held = free_prefix(docs) + "measures"
    rows = write_once(measured(docs, text_col, held), "quality")
    voted, quality = with_quality(rows, beliefs(rows, held), held)
    return voted.where(quality >= threshold).select(*[F.col(f"`{c}`") for c in docs.columns])
