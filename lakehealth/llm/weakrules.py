"""Quality rules as weak supervision: rules vote or abstain, expectation-maximisation weighs their votes.

Every rule looks at a few counts of a text and says good (1), bad (-1) or nothing (0). Most are triggers, which
say bad or nothing: that a text has no symbols is no sign that it is prose. Two look for signs of prose and say
good. How far a rule can be trusted is not given: its accuracy, the chance that a vote it casts is right, is
estimated from how the rules agree with each other over all documents, with a class that nobody has labelled as
the hidden variable. A document's verdict is the posterior probability that it is good, not that every rule
passed: a trigger that often contradicts the others loses its weight. The balance of the two classes is given and
not estimated, since an estimated one would let the many good documents outvote rules that rarely speak.

Only built-in column functions are used, so everything stays in the JVM:

* counts come from one projection of the text. Repeated five-word windows are looked for by hash first; a
  text without two equal hashes has none, and any other is settled by comparing the windows themselves.
* documents with the same votes have the same posterior. There are at most 3 ** rules vote patterns, whatever the
  input, so the counts per pattern fit one row, on which the steps run as one expression.
* the posterior goes back to the documents by a join with that bounded table.

Edge cases: a null or empty text has no words, so the base rules fail it; texts are used whole; equal rows are
judged alike and all returned; an empty table gives no rows; columns to carry along come back in the struct ``row``,
so their names cannot clash.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakehealth.llm.common import cut

# Fixed values -------------------------------------------------------------------------------------
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"
SYMBOLS = r"[^#*$%&|<>]+"        # everything that is no symbol
NO_LETTER = r"[^\p{L}]+"
NO_CAPITAL = r"[^\p{Lu}]+"
CLOSED = r"[.!?…:;\"'”»)][\x20\x09-\x0D]*\z"  # a line that ends like a sentence
WINDOW = 5
BASE_FAILED = "n_words < 10 OR 100 * n_repeat_words > 20 * n_words"
# --------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Rule:
    """Conditions, as SQL over the counts, under which a rule votes; it abstains where neither holds."""
    name: str
    good: str
    bad: str


RULES = [
    Rule("symbols", "FALSE", "100 * n_symbols > 10 * n_words"),
    Rule("letters", "FALSE", "100 * n_letters < 75 * word_chars"),
    Rule("capitals", "FALSE", "100 * n_capitals > 40 * n_letters"),
    Rule("word_length", "FALSE", "word_chars < 2 * n_words OR word_chars > 12 * n_words"),
    Rule("repeats", "FALSE", "100 * n_repeat_words > 10 * n_words"),
    Rule("lines", "FALSE", "100 * n_dup_lines > 30 * n_lines"),
    Rule("vocabulary", "FALSE", "n_distinct * n_distinct < 9 * n_words"),
    Rule("sentences", "FALSE", "100 * n_closed_lines < 20 * n_lines"),
    Rule("prose", "n_words > 0 AND 100 * n_letters >= 85 * word_chars AND 100 * n_capitals <= 30 * n_letters "
                  "AND 100 * n_closed_lines >= 50 * n_lines AND 100 * n_symbols <= 5 * n_words", "FALSE"),
    Rule("wording", "n_distinct * n_distinct >= 25 * n_words AND 10 * word_chars BETWEEN 30 * n_words AND 90 * n_words "
                    "AND n_words > 0 AND 100 * n_symbols <= 5 * n_words AND 100 * n_capitals <= 30 * n_letters", "FALSE"),
]
#: Where the steps start: a vote is right with this chance; and how likely a document is good before any vote.
START, BALANCE = 0.8, 0.5
#: Votes' worth of belief in the start accuracy.
BELIEF = 10.0
#: No rule is trusted further than this.
SUREST = 0.99
STEPS = 30
#: Least posterior of a document that is kept.
KEEP = 0.5

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_distinct", "n_letters",
          "n_capitals", "n_lines", "n_closed_lines"]


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, also inside lambdas that use it for every element."""
    return F.transform(F.array(value), use)[0]


def repeated_words(words: Column) -> Column:
    """Words that lie in a window of ``WINDOW`` words which the text holds twice or more."""
    starts = F.when(F.size(words) >= WINDOW, F.sequence(F.lit(0), F.size(words) - WINDOW)).otherwise(
        F.array().cast("array<int>"))

    def parts(i: Column) -> list[Column]:
        return [F.get(words, i + k) for k in range(WINDOW)]

    def cover(places: Column) -> Column:
        return F.aggregate(
            places, F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
            lambda seen, i: F.struct((seen["n"] + F.least(F.lit(WINDOW), i - seen["last"])).alias("n"), i.alias("last")),
            lambda seen: seen["n"])

    def twice(sorted_windows: Column) -> Column:
        """Those of the sorted ``struct<w, i>`` that stand beside an equal ``w``."""
        same = lambda x, other: F.coalesce(other["w"] == x["w"], F.lit(False))
        marked = F.transform(sorted_windows, lambda x, k: F.struct(
            x["i"].alias("i"), (same(x, F.get(sorted_windows, k - 1)) | same(x, F.get(sorted_windows, k + 1))).alias("on")))
        return F.filter(marked, lambda x: x["on"])

    def exact(hashes: Column) -> Column:
        """Windows of equal hash, then of those the ones with equal words."""
        hashed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("w"), i.alias("i"))))
        return bound(hashed, lambda a: bound(
            F.sort_array(F.transform(twice(a), lambda x: F.struct(F.concat_ws(" ", *parts(x["i"])).alias("w"), x["i"].alias("i")))),
            lambda b: cover(F.sort_array(F.transform(twice(b), lambda x: x["i"])))))

    hashes = F.transform(starts, lambda i: F.xxhash64(*parts(i)))
    return bound(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(exact(h)))


def counts(docs: DataFrame, carry: list[str]) -> DataFrame:
    """``row struct<carry>`` and the counts (``COUNTS``) of every document's whole text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    row = F.struct(*(F.col(f"`{c}`") for c in carry)).alias("row")
    read = docs.select(row, text.alias("text")).select(
        "row", "text", F.array_remove(F.split("text", SPACE), "").alias("words"),
        F.filter(F.split("text", "\n"), lambda line: line.rlike(WORD)).alias("lines"))
    left = lambda pattern: F.length(F.regexp_replace("text", pattern, ""))
    long = {
        "n_words": F.size("words"),
        "word_chars": F.length(F.array_join("words", "")),
        "n_symbols": left(SYMBOLS),
        "n_dup_lines": F.size("lines") - F.size(F.array_distinct("lines")),
        "n_repeat_words": bound(F.col("words"), repeated_words),
        "n_distinct": F.size(F.array_distinct("words")),
        "n_letters": left(NO_LETTER),
        "n_capitals": left(NO_CAPITAL),
        "n_lines": F.size("lines"),
        "n_closed_lines": F.size(F.filter("lines", lambda line: line.rlike(CLOSED))),
    }
    return read.select("row", *(long[name].cast("long").alias(name) for name in COUNTS))


def votes(rules: list[Rule]) -> Column:
    """The rules' votes as an array of 1, 0 and -1; bad goes before good."""
    return F.array(*(F.when(F.expr(r.bad), -1).when(F.expr(r.good), 1).otherwise(0) for r in rules))


def posterior(accuracy: Column, vote: Column, rules: int) -> Column:
    """Chance that a document with these votes is good, given each rule's accuracy."""
    def weight(j: Column) -> Column:
        a = F.get(accuracy, j)
        return F.get(vote, j) * F.log(a / (1 - a))
    odds = F.aggregate(F.sequence(F.lit(0), F.lit(rules - 1)), F.lit(math.log(BALANCE / (1 - BALANCE))),
                       lambda total, j: total + weight(j))
    return F.round(1 / (1 + F.exp(-odds)), 9)


def estimate(patterns: Column, rules: int, steps: int = STEPS) -> Column:
    """Each rule's accuracy after ``steps`` steps over ``patterns array<struct<vote, n>>``."""
    def step(accuracy: Column, _: Column) -> Column:
        expected = F.transform(patterns, lambda p: bound(posterior(accuracy, p["vote"], rules), lambda g: F.struct(
            p["vote"].alias("vote"), p["n"].alias("n"), g.alias("good"))))

        def maximise(shared: Column) -> Column:
            def total(j: Column, part: Callable[[Column, Column], Column]) -> Column:
                return F.aggregate(shared, F.lit(0.0), lambda s, x: s + part(x, F.get(x["vote"], j)))

            def share(j: Column) -> Column:
                right = total(j, lambda x, v: x["n"] * F.when(v == 1, x["good"]).when(v == -1, 1 - x["good"]).otherwise(0.0))
                cast = total(j, lambda x, v: F.when(v != 0, x["n"]).otherwise(0.0))
                return (right + BELIEF * START) / (cast + BELIEF)
            return F.transform(F.sequence(F.lit(0), F.lit(rules - 1)),
                               lambda j: F.least(F.greatest(share(j), F.lit(1 - SUREST)), F.lit(SUREST)))
        return bound(expected, maximise)

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.array_repeat(F.lit(START), rules), step)


def fit(voted: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """One row ``patterns, accuracy`` from all documents' ``vote``s."""
    by_pattern = voted.groupBy("vote").agg(F.count("*").cast("double").alias("n"))
    packed = by_pattern.agg(F.sort_array(F.collect_list(F.struct("vote", "n"))).alias("patterns"))  # <= 3 ** rules
    return cut(packed.select("patterns", estimate(F.col("patterns"), len(rules)).alias("accuracy")))


def judge(docs: DataFrame, carry: list[str], rules: list[Rule] = RULES, keep: float = KEEP) -> DataFrame:
    """``row struct<carry>``, the counts, ``vote``, ``posterior``, ``base_failed`` and ``kept`` of every document."""
    rated = cut(counts(docs, carry).withColumn("vote", votes(rules)))  # numbers and ``row``, no text unless carried
    model = fit(rated, rules)
    chances = model.select(F.explode("patterns").alias("p"), "accuracy").select(
        F.col("p.vote").alias("vote"), posterior(F.col("accuracy"), F.col("p.vote"), len(rules)).alias("posterior"))
    return (rated.join(F.broadcast(chances), "vote")
            .withColumn("base_failed", F.expr(BASE_FAILED))
            .withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= keep)))


def accuracies(docs: DataFrame, rules: list[Rule] = RULES) -> DataFrame:
    """``rule, accuracy``: what the votes say about each rule."""
    names = F.array(*(F.lit(r.name) for r in rules))
    rated = counts(docs, []).select(votes(rules).alias("vote"))
    return fit(rated, rules).select(F.posexplode(names).alias("j", "rule"), "accuracy").select(
        "rule", F.get("accuracy", F.col("j")).alias("accuracy"))


def oracle_sql(rules: list[Rule] = RULES, steps: int = STEPS, keep: float = KEEP) -> str:
    """The same for a SQL engine with lists and recursion: counts, votes and the steps over the patterns."""
    vote = ", ".join(f"CASE WHEN {r.bad} THEN -1 WHEN {r.good} THEN 1 ELSE 0 END" for r in rules)
    k = len(rules)
    start = ", ".join([f"{START}::DOUBLE"] * k)
    share = (f"(list_sum(list_transform(r, lambda x: x.n * CASE x.vote[j] WHEN 1 THEN x.good WHEN -1 THEN 1 - x.good "
             f"ELSE 0.0::DOUBLE END)) + {BELIEF * START}) / "
             f"(list_sum(list_transform(r, lambda x: CASE WHEN x.vote[j] <> 0 THEN x.n ELSE 0.0::DOUBLE END)) + {BELIEF})")

    def chance(vote: str) -> str:
        return (f"round(1 / (1 + exp(-({math.log(BALANCE / (1 - BALANCE))} + list_sum(list_transform(range(1, {k + 1}), "
                f"lambda j: {vote}[j] * ln(accuracy[j] / (1 - accuracy[j]))))))), 9)")

    return rf"""
        WITH RECURSIVE t AS (
            SELECT row_number() OVER () AS rid, doc_id, coalesce("text", '') AS body FROM documents),
        w AS (SELECT rid, unnest(regexp_extract_all(body, '[^\x20\x09-\x0D]+')) AS word,
                     generate_subscripts(regexp_extract_all(body, '[^\x20\x09-\x0D]+'), 1) AS i FROM t),
        five AS (
            SELECT rid, i, concat_ws(' ', word, lead(word, 1) OVER o, lead(word, 2) OVER o, lead(word, 3) OVER o,
                                     lead(word, 4) OVER o) AS win, lead(i, 4) OVER o AS last
            FROM w WINDOW o AS (PARTITION BY rid ORDER BY i)),
        often AS (SELECT rid, i FROM five WHERE last IS NOT NULL
                  QUALIFY count(*) OVER (PARTITION BY rid, win) > 1),
        covered AS (SELECT rid, count(DISTINCT i + s) AS n_repeat_words
                    FROM often, (SELECT unnest(range(0, 5)) AS s) GROUP BY rid),
        per_word AS (SELECT rid, count(*) AS n_words, sum(length(word)) AS word_chars, count(DISTINCT word) AS n_distinct
                     FROM w GROUP BY rid),
        l AS (SELECT rid, unnest(string_split(body, chr(10))) AS line FROM t),
        per_line AS (
            SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines,
                   count(*) FILTER (regexp_matches(line, '{CLOSED.replace("'", "''")}')) AS n_closed_lines
            FROM l WHERE regexp_matches(line, '{WORD}') GROUP BY rid),
        c AS (
            SELECT t.rid, doc_id, coalesce(n_words, 0) AS n_words, CAST(coalesce(word_chars, 0) AS BIGINT) AS word_chars,
                   length(regexp_replace(body, '{SYMBOLS}', '', 'g')) AS n_symbols,
                   coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
                   coalesce(n_distinct, 0) AS n_distinct,
                   length(regexp_replace(body, '{NO_LETTER}', '', 'g')) AS n_letters,
                   length(regexp_replace(body, '{NO_CAPITAL}', '', 'g')) AS n_capitals,
                   coalesce(n_lines, 0) AS n_lines, coalesce(n_closed_lines, 0) AS n_closed_lines
            FROM t LEFT JOIN per_word USING (rid) LEFT JOIN per_line USING (rid) LEFT JOIN covered USING (rid)),
        v AS (SELECT *, [{vote}] AS vote FROM c),
        p AS (SELECT list({{'vote': vote, 'n': n}} ORDER BY vote) AS patterns
              FROM (SELECT vote, CAST(count(*) AS DOUBLE) AS n FROM v GROUP BY vote)),
        em AS (
            SELECT 0 AS i, [{start}] AS accuracy
            UNION ALL
            SELECT i + 1, list_transform(range(1, {k + 1}), lambda j: least(greatest({share}, 1 - {SUREST}), {SUREST}))
            FROM (SELECT i, list_transform(patterns, lambda p: {{'vote': p.vote, 'n': p.n, 'good': {chance('p.vote')}}}) AS r
                  FROM em, p WHERE i < {steps}))
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
               ({BASE_FAILED}) AS base_failed,
               NOT ({BASE_FAILED}) AND {chance('v.vote')} >= {keep} AS kept
        FROM v JOIN em ON em.i = {steps}"""
