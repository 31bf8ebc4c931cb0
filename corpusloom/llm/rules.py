"""Quality rules kept in a bitmask ledger, with DataFrame expressions only.

`measure` takes the measurements of each text once; `ledger` evaluates every rule of the rule book once and stores
the failures as bits of one long beside the measurements. A policy is a mask of the rules that count; versions of a
policy are applied, and rules taken out of it, by bitwise operations on the stored bits alone, never on the texts.

Words are `[^\\x20\\x09-\\x0D]+`. Null and empty texts have no words and every measurement is 0. Repeated rows have
equal ledgers; ids are carried along unread and may be null. Columns of the input other than id and text do not
take part and cannot clash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.ordered import stored

_SPACES = "[\\x20\\x09-\\x0D]+"


@dataclass(frozen=True)
class Rule:
    """failed: SQL condition over the measurements, true where a text fails."""

    name: str
    failed: str


#: Bit k of a ledger is rule k. New rules go to the end, so that stored ledgers keep their meaning.
RULES: tuple[Rule, ...] = (
    Rule("too_few_words", "n_words < 50"),
    Rule("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule("many_symbols", "10 * n_symbols > 3 * n_words"),
    Rule("long_words", "word_chars > 40 * n_words"),
    Rule("short_words", "2 * word_chars < 3 * n_words"),
    Rule("duplicate_lines", "2 * n_dup_lines > n_lines"),
    Rule("shouting", "2 * n_upper > word_chars"),
    Rule("some_symbols", "100 * n_symbols > 3 * n_words"),
    Rule("some_duplicate_lines", "10 * n_dup_lines > 3 * n_lines"),
)

#: Policies by version: the names of the rules that count.
POLICIES: dict[str, tuple[str, ...]] = {
    "v1": ("too_few_words", "repeated_words"),
    "v2": ("too_few_words", "repeated_words", "many_symbols", "long_words", "short_words", "duplicate_lines", "shouting"),
    "v3-strict": tuple(r.name for r in RULES),
}


def mask(names) -> int:
    """The bits of rules."""
    at = {r.name: k for k, r in enumerate(RULES)}
    return sum(1 << at[n] for n in names)


def _once(value: Column, then) -> Column:
    """then(value), with value evaluated once a row: it is bound to a lambda's variable."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _repeated(words: Column) -> Column:
    """Words inside 3-word windows that are found twice or more."""

    def covered(starts: Column) -> Column:
        gaps = F.transform(
            F.slice(starts, 2, F.size(starts)), lambda p, k: F.least(F.lit(3), p - F.get(starts, k))
        )
        return F.aggregate(gaps, F.lit(3).cast("bigint"), lambda n, g: n + g)

    def places(windows: Column) -> Column:
        """First words of windows equal to a neighbour in sorted order."""
        same = lambda k, w: F.coalesce(F.get(windows, k)["w"] == w, F.lit(False))
        hits = F.filter(windows, lambda x, k: same(k - 1, x["w"]) | same(k + 1, x["w"]))
        return F.sort_array(F.transform(hits, lambda x: x["i"]))

    three = F.transform(
        F.slice(words, 3, F.size(words)),
        lambda w, i: F.struct(F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), w).alias("w"), i.alias("i")),
    )
    distinct = lambda ws: F.size(F.array_distinct(F.transform(ws, lambda x: x["w"])))
    repeated = lambda ws: _once(
        places(ws), lambda s: F.when(F.size(s) > 0, covered(s)).otherwise(F.lit(0).cast("bigint"))
    )
    counted = _once(
        three,
        lambda ws: F.when(distinct(ws) == F.size(ws), F.lit(0).cast("bigint")).otherwise(_once(F.sort_array(ws), repeated)),
    )
    return F.when(F.size(words) >= 3, counted).otherwise(F.lit(0).cast("bigint"))


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`id_col` and the measurements of each row, from one pass over the text and without a shuffle.

    n_words, word_chars (code points in words), n_upper (A-Z), n_symbols (of `#*$%&|<>`), n_lines (with a word),
    n_dup_lines (with a word, equal to an earlier line), n_repeat_words (inside 3-word windows found twice or more).
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    long = lambda c: c.cast("bigint")
    bare = docs.select(F.col(id_col), text.alias("_text"))
    return bare.select(
        F.col(id_col),
        _once(
            F.filter(F.split(F.col("_text"), _SPACES), lambda w: w != ""),
            lambda ws: F.struct(
                long(F.size(ws)).alias("n_words"),
                F.aggregate(ws, F.lit(0).cast("bigint"), lambda n, w: n + F.length(w)).alias("word_chars"),
                _repeated(ws).alias("n_repeat_words"),
            ),
        ).alias("_w"),
        _once(
            F.filter(F.split(F.col("_text"), "\n"), lambda x: F.regexp_replace(x, _SPACES, "") != ""),
            lambda ls: F.struct(
                long(F.size(ls)).alias("n_lines"), long(F.size(ls) - F.size(F.array_distinct(ls))).alias("n_dup_lines")
            ),
        ).alias("_l"),
        long(F.length("_text") - F.length(F.translate("_text", "#*$%&|<>", ""))).alias("n_symbols"),
        long(F.length("_text") - F.length(F.translate("_text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).alias("n_upper"),
    ).select(id_col, "_w.*", "_l.*", "n_symbols", "n_upper")


def ledger(measured: DataFrame) -> DataFrame:
    """`measured` with fail_bits: bit k is set where rule k fails."""
    bits = F.lit(0).cast("bigint")
    for k, rule in enumerate(RULES):
        bits = bits.bitwiseOR(F.when(F.expr(rule.failed), F.lit(1 << k)).otherwise(F.lit(0)).cast("bigint"))
    return measured.withColumn("fail_bits", bits)


def verdict(version: str, bits: str = "fail_bits") -> Column:
    """True where no rule of the policy fails; from stored bits alone."""
    return F.col(bits).bitwiseAND(F.lit(mask(POLICIES[version])).cast("bigint")) == 0


def tally(ledgers: DataFrame) -> DataFrame:
    """(fail_bits, n), stored: at most 2 ** len(RULES) rows, of which `ablations` makes its tables without measuring a text again."""
    return stored(ledgers.groupBy("fail_bits").agg(F.count("*").alias("n")))


def ablations(ledgers: DataFrame, version: str) -> DataFrame:
    """For each rule of a policy: n_failed, n_only (fail it alone), n_kept_without it, n_kept with all rules.

    Ledgers (or their `tally`) are counted by their bits first, at most 2 ** len(RULES) rows, and only those are combined with rules.
    """
    m = mask(POLICIES[version])
    counts = ledgers.groupBy(F.col("fail_bits").bitwiseAND(F.lit(m).cast("bigint")).alias("bits")).agg((F.sum("n") if "n" in ledgers.columns else F.count("*")).alias("n"))
    rules = F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(mask([n])).cast("bigint").alias("bit")) for n in POLICIES[version]])
    each = counts.select("bits", "n", F.explode(rules).alias("r"))
    hit = lambda c: F.sum(F.when(c, F.col("n")).otherwise(F.lit(0))).alias
    return each.groupBy(F.col("r.rule").alias("rule")).agg(
        hit(F.col("bits").bitwiseAND(F.col("r.bit")) != 0)("n_failed"),
        hit(F.col("bits") == F.col("r.bit"))("n_only"),
        hit(F.col("bits").bitwiseAND(F.bitwise_not(F.col("r.bit"))) == 0)("n_kept_without"),
        hit(F.col("bits") == 0)("n_kept"),
    )
