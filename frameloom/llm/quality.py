"""Quality rules as a short-circuit cascade of DataFrame expressions.

Each rule has a metric, built in one or more stages, and a test that rejects. On a sample the work of every stage and
the rows that every rule rejects are counted; rules then run in descending order of rejections per cost, each judged by
what is left to reject and to compute after the rules before it. A stage is only computed for rows that no earlier rule
has rejected. The verdict does not depend on the order.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_BLANK = "[\\\\x20\\\\x09-\\\\x0D]+"
_SPACE = "\\t\\n\\u000B\\u000C\\r"


@dataclass(frozen=True)
class Stage:
    """One column: its SQL expression over earlier columns, {t} being the text, and the work of that for a row, as an SQL
    expression too, in character visits. Columns start with an underscore and are dropped at the end."""

    column: str
    sql: str
    cost: str


@dataclass(frozen=True)
class Rule:
    """reject: SQL condition on the stages' columns."""

    name: str
    stages: tuple[Stage, ...]
    reject: str


#: Costs: weights of character visits by kind of work. A regular expression's split or match counts 8 a character, a
#: translation 4, a hash or a copy of a word 12, sorting 6 a comparison.
_WORDS = (
    Stage("_w", f"CASE WHEN trim(BOTH ' {_SPACE}' FROM {{t}}) = '' THEN CAST(array() AS array<string>) ELSE split(trim(BOTH ' {_SPACE}' FROM {{t}}), '{_BLANK}') END", "8 * length({t})"),
    Stage("_n", "CAST(size(_w) AS BIGINT)", "1"),
)
#: _r from _w and _n: the words in 3-word windows that the text holds twice or more. Windows are compared by 64-bit hash;
#: equal ones are found by sorting, so the work is n log n.
_REPEATS = (
    Stage("_h", "CASE WHEN _n > 3 THEN slice(zip_with(zip_with(_w, slice(_w, 2, _n), (a, b) -> xxhash64(a, b)), slice(_w, 3, _n), (x, c) -> xxhash64(x, c)), 1, CAST(_n - 2 AS INT)) END", "48 * _n"),
    Stage("_s", "CASE WHEN size(array_distinct(_h)) < size(_h) THEN sort_array(transform(_h, (x, i) -> struct(x AS h, i AS i))) END", "12 * _n + 6 * _n * log2(_n + 2)"),
    Stage("_p", "sort_array(array_distinct(flatten(zip_with(slice(_s, 1, size(_s) - 1), slice(_s, 2, size(_s)), (a, b) -> CASE WHEN a.h = b.h THEN array(a.i, b.i) ELSE CAST(array() AS array<int>) END))))", "12 * _n"),
    Stage("_r", "CASE WHEN _n IS NULL THEN NULL ELSE coalesce(aggregate(zip_with(_p, slice(_p, 2, size(_p)), (a, b) -> least(3, coalesce(b - a, 3))), CAST(0 AS BIGINT), (s, x) -> s + x), 0L) END", "_n"),
)
_LINES = (Stage("_l", "filter(split({t}, '\\n', -1), x -> x RLIKE '[^\\\\x20\\\\x09-\\\\x0D]')", "8 * length({t})"),)
_SAME_LINES = (*_LINES, Stage("_d", "CAST(size(_l) - size(array_distinct(_l)) AS BIGINT)", "length({t})"))
_CHARS = (Stage("_c", f"CAST(length(translate({{t}}, ' {_SPACE}', '')) AS BIGINT)", "4 * length({t})"),)
_SYMBOLS = (Stage("_y", "CAST(length({t}) - length(translate({t}, '#*$%&|<>', '')) AS BIGINT)", "4 * length({t})"),)
_BANGS = (Stage("_e", "length({t}) - length(translate({t}, '!', ''))", "4 * length({t})"),)
_DIGITS = (Stage("_g", "length({t}) - length(translate({t}, '0123456789', ''))", "4 * length({t})"),)
_BULLETS = (*_LINES, Stage("_b", "size(filter(_l, x -> x RLIKE '^[\\\\x20\\\\x09-\\\\x0D]*[-*\\u2022]'))", "16 * size(_l)"))
_ELLIPSES = (*_LINES, Stage("_o", "size(filter(_l, x -> x RLIKE '([.][.][.]|\\u2026)[\\\\x20\\\\x09-\\\\x0D]*$'))", "8 * length({t})"))

RULES = (
    Rule("few_words", _WORDS, "_n < 50"),
    Rule("repeated_words", _WORDS + _REPEATS, "100 * _r > 50 * _n"),
    Rule("symbols", _WORDS + _SYMBOLS, "100 * _y > 10 * _n"),
    Rule("shouting", _WORDS + _BANGS, "100 * _e > 30 * _n"),
    Rule("word_length", _WORDS + _CHARS, "_c > 15 * _n OR _c < 2 * _n"),
    Rule("digits", _CHARS + _DIGITS, "100 * _g > 30 * _c"),
    Rule("repeated_lines", _SAME_LINES, "100 * _d > 60 * size(_l)"),
    Rule("bullet_lines", _BULLETS, "100 * _b > 90 * size(_l)"),
    Rule("cut_lines", _ELLIPSES, "100 * _o > 30 * size(_l)"),
)


def _run(df: DataFrame, rules, text: str, made: tuple[str, ...] = ()) -> DataFrame:
    """Add _verdict: the name of the first rule that rejects, else null. Whatever a rule makes is made only for rows
    that none before it has rejected; a column that is there already (made, or an earlier rule's) isn't made again."""
    have = set(made)
    df = df.withColumn("_verdict", F.lit(None).cast("string"))
    for k, rule in enumerate(rules):
        for stage in rule.stages:
            if stage.column not in have:
                sql = stage.sql.replace("{t}", text)
                df = df.withColumn(stage.column, F.expr(f"CASE WHEN _verdict IS NULL THEN {sql} END" if k else sql))
                have.add(stage.column)
        df = df.withColumn("_verdict", F.expr(f"CASE WHEN _verdict IS NOT NULL THEN _verdict WHEN {rule.reject} THEN '{rule.name}' END"))
    return df


def _with_stages(df: DataFrame, stages, text: str) -> DataFrame:
    for stage in dict.fromkeys(stages):
        df = df.withColumn(stage.column, F.expr(stage.sql.replace("{t}", text)))
    return df


def sample_costs(docs: DataFrame, text_col: str, rules, sample_rows: int) -> list[dict]:
    """On about sample_rows rows of docs: rows `n` by the set of rules that reject them (bits of `mask`), and the sum of
    each stage's cost over them. At most 2^rules small rows; the sample is drawn before anything moves."""
    total = docs.count()
    sample = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    if total > sample_rows:
        sample = sample.sample(withReplacement=False, fraction=sample_rows / total, seed=17)
    stages = list(dict.fromkeys(s for r in rules for s in r.stages))
    mask = sum((F.when(F.expr(r.reject), F.lit(1 << k)).otherwise(F.lit(0)) for k, r in enumerate(rules)), F.lit(0))
    costs = [F.expr(f"CAST({s.cost.replace('{t}', '_text')} AS DOUBLE)").alias(f"cost{s.column}") for s in stages]
    rows = _with_stages(sample, stages, "_text").select(mask.alias("mask"), *costs)
    found = rows.groupBy("mask").agg(F.count("*").alias("n"), *(F.round(F.sum(f"cost{s.column}")).alias(s.column) for s in stages))
    return [r.asDict() for r in found.collect()]


def order_by_rate(rules, counted: list[dict], made: tuple[str, ...] = ()) -> list[Rule]:
    """Rules by rejections per cost, chosen one after another: of the rows left, how many a rule rejects, over what the
    stages cost on them that aren't made yet. Ties keep the given order."""
    left, have, rest, out = counted, set(made), list(enumerate(rules)), []
    while rest:

        def rate(item, left=left, have=have):
            k, rule = item
            cost = sum(row[s.column] for row in left for s in rule.stages if s.column not in have)
            return sum(row["n"] for row in left if row["mask"] >> k & 1) / max(cost, 1.0), -k

        best = max(rest, key=rate)
        rest.remove(best)
        out.append(best[1])
        have = have | {s.column for s in best[1].stages}
        left = [row for row in left if not row["mask"] >> best[0] & 1]
    return out


def order_rules(docs: DataFrame, text_col: str = "text", rules=RULES, sample_rows: int = 1000, made: tuple[str, ...] = ()) -> list[Rule]:
    """The cascade's order for docs, from a sample of about sample_rows rows; without rows the given order."""
    return order_by_rate(rules, sample_costs(docs, text_col, rules, sample_rows), made)


def _verdicts(df: DataFrame, own: list) -> DataFrame:
    """own columns, kept and rejected_by. They come out of a generator of one row, through which a later filter on them
    isn't pushed: pushed down it would repeat the metrics' expressions many times over."""
    made = F.inline(F.array(F.struct(F.col("_verdict").isNull().alias("kept"), F.col("_verdict").alias("rejected_by"))))
    return df.select(*own, made)


def quality_cascade(docs: DataFrame, text_col: str = "text", rules=RULES, sample_rows: int = 1000) -> DataFrame:
    """docs with columns kept (boolean) and rejected_by (a rule's name, else null) after its own.

    Edge cases: null, empty and blank texts have no words and fail few_words; repeated rows are judged one by one; a
    table's other columns pass through, and columns of its own that are called kept or rejected_by, in any case, are
    replaced; an empty table gives an empty result.
    """
    ordered = order_rules(docs, text_col, rules, sample_rows)
    own = [c for c in docs.columns if c.lower() not in ("kept", "rejected_by")]
    # one struct, so that no column of docs can be taken for one of the metrics
    df = docs.select(F.struct(*(F.col(f"`{c}`") for c in own)).alias("_own"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    return _verdicts(_run(df, ordered, "_text"), [F.col("_own.*")])


def quality_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 1000) -> DataFrame:
    """The cascade's verdict beside the base metrics. Those are wanted for all rows here, so the base rules cost nothing
    more and come first; what the other rules need is made only for rows that pass those."""
    base_stages = _WORDS + _CHARS + _SYMBOLS + _SAME_LINES + _REPEATS
    made = tuple(s.column for s in base_stages)
    ordered = order_rules(docs, text_col, RULES, sample_rows, made)
    df = _with_stages(docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_text")), base_stages, "_text")
    out = _run(df, ordered, "_text", made)
    failed = F.expr("_n < 50 OR 100 * _r > 50 * _n")
    base = (("n", "n_words"), ("c", "word_chars"), ("y", "n_symbols"), ("d", "n_dup_lines"), ("r", "n_repeat_words"))
    return _verdicts(out, [F.col(id_col), *(F.col(f"_{m}").alias(name) for m, name in base), failed.alias("base_failed")])
