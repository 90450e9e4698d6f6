"""Quality rules with host verdicts, in DataFrame functions only.

Every document gets its rule counts in one narrow pass, within its own row. Failures are then
summed by host, the rates shrunk by a beta prior fitted to all hosts (method of moments), and
the verdicts joined back. A host may hold any share of the rows: sums are partial before the
shuffle, and the join spreads every host over ``salts`` keys.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
_BLANK = " \t\n\x0b\x0c\r"


def _without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def _twice(rows: str, key: str) -> Column:
    """Of a sorted array of structs, those whose key equals a neighbour's."""
    at = lambda i: F.get(F.col(rows), i)[key]
    return F.filter(rows, lambda x, i: F.coalesce(x[key] == at(i - 1), F.lit(False)) | F.coalesce(x[key] == at(i + 1), F.lit(False)))


def rule_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", width: int = 5) -> DataFrame:
    """(doc_id, host, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words).

    n_repeat_words counts the words inside windows of ``width`` words found twice or more:
    windows are sorted by hash in their row, and only equal hashes are compared as words."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"), text.alias("text"))
    rows = rows.select("doc_id", "host", "text", F.regexp_extract_all("text", F.lit(WORD), 0).alias("words"))
    lines = F.filter(F.split("text", "\n"), lambda x: _without(x, _BLANK) != "")
    n = F.size("words")
    window = lambda i: F.slice("words", i + 1, width)
    places = F.when(n >= width, F.sequence(F.lit(0), n - width)).otherwise(F.array().cast("array<int>"))
    rows = rows.select(
        "doc_id", "host", "words", lines.alias("lines"), F.length(_without(F.col("text"), _BLANK)).cast("long").alias("word_chars"),
        (F.length("text") - F.length(_without(F.col("text"), SYMBOLS))).cast("long").alias("n_symbols"), F.sort_array(F.transform(places, lambda i: F.struct(F.xxhash64(window(i)).alias("h"), i.alias("i")))).alias("hashed"),
    )
    same = F.sort_array(F.transform(_twice("hashed", "h"), lambda x: F.struct(F.array_join(window(x["i"]), " ").alias("w"), x["i"].alias("i"))))
    rows = rows.select("doc_id", "host", n.cast("long").alias("n_words"), "word_chars", "n_symbols", "lines", same.alias("same"))
    found = F.sort_array(F.transform(_twice("same", "w"), lambda x: x["i"]))
    covered = F.aggregate(found, F.struct(F.lit(0).alias("n"), F.lit(-width).alias("last")), lambda a, i: F.struct((a["n"] + F.least(F.lit(width), i - a["last"])).alias("n"), i.alias("last")), lambda a: a["n"])
    n_lines = F.size("lines")
    return rows.select("doc_id", "host", "n_words", "word_chars", "n_symbols", n_lines.cast("long").alias("n_lines"), (n_lines - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), covered.cast("long").alias("n_repeat_words"))


@dataclass(frozen=True)
class HostLimits:
    """A host whose shrunk failure rate of any rule is over ``reject`` loses all its documents.
    Where a soft rule's shrunk rate is ``habit`` times the mean of all hosts or more, and
    ``least_habit`` at least, failing it is that host's habit (a site about code is full of symbols) and costs nothing; elsewhere
    documents that fail it go. A rule whose hosts don't differ by more than chance, by ``sure`` standard
    deviations, gives no verdict on hosts."""

    reject: float = 0.5
    habit: float = 1.25
    least_habit: float = 0.05
    sure: float = 3.0
    symbols_per_word: float = 0.25
    dup_line_share: float = 0.5


RULES = ("base", "symbols", "dup_lines")


def beta_prior(hosts: int, rows: int | None, squares: float | None, failed: int | None, spread: float | None, sure: float) -> tuple[float, float | None]:
    """(mean, weight) of the beta prior of the hosts' rates, by moments weighted with the hosts' rows: squares is the sum
    of n^2 and spread that of x^2 / n over hosts with x of n rows failing.

    What chance alone makes rates of finite hosts differ is taken out: of the spread around the mean, in units of p (1 -
    p), hosts - 1 are expected without any difference, with a standard deviation of sqrt(2 (hosts - 1)). Unless it
    is over that by ``sure`` deviations, hosts don't differ for sure, and the weight is None: no verdicts."""
    mean = (failed or 0) / rows if rows else 0.0
    if not 0 < mean < 1 or hosts < 2:
        return mean, None
    excess = (spread - failed * failed / rows) / (mean * (1 - mean)) - (hosts - 1)
    room = rows - squares / rows - (hosts - 1)
    if room <= 0 or excess <= sure * (2 * (hosts - 1)) ** 0.5:
        return mean, None
    return mean, max(room / excess - 1, 1.0)


def judge(counts: DataFrame, limits: HostLimits = HostLimits(), salts: int = 32) -> DataFrame:
    """counts with base_failed and kept. counts is read twice, so give a written table.

    A null host is a host of its own. Without rows there are no hosts and no verdicts."""
    failed = {
        "base": (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")),
        "symbols": F.col("n_symbols") > limits.symbols_per_word * F.col("n_words"),
        "dup_lines": F.col("n_dup_lines") > limits.dup_line_share * F.col("n_lines"),
    }
    rows = counts.withColumns({f"f_{r}": c for r, c in failed.items()})
    hosts = written(rows.groupBy("host").agg(F.count("*").alias("n"), *(F.count_if(f"f_{r}").alias(f"n_{r}") for r in RULES)), "hosts")
    n = F.col("n").cast("double")
    sums = [c for r in RULES for c in (F.sum(f"n_{r}"), F.sum(F.col(f"n_{r}") * F.col(f"n_{r}") / n))]
    k, total, squares, *sums = hosts.agg(F.count("*"), F.sum("n"), F.sum(n * n), *sums).first()
    shrunk, means = [], {}
    for i, r in enumerate(RULES):
        means[r], weight = beta_prior(k, total, squares, *sums[2 * i : 2 * i + 2], limits.sure)
        rate = F.lit(None).cast("double") if weight is None else (F.col(f"n_{r}") + F.lit(means[r] * weight)) / (F.col("n") + F.lit(weight))
        shrunk.append(rate.alias(f"rate_{r}"))
    verdict = hosts.select("host", *shrunk).select(
        "host", (F.greatest(*(f"rate_{r}" for r in RULES)) > limits.reject).alias("rejected"), *((F.col(f"rate_{r}") >= max(limits.habit * means[r], limits.least_habit)).alias(f"habit_{r}") for r in RULES[1:])
    )
    verdict = verdict.select(F.col("host").alias("of"), "rejected", *(f"habit_{r}" for r in RULES[1:]), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("s"))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int"))
    joined = rows.join(verdict, F.col("host").eqNullSafe(F.col("of")) & (F.col("salt") == F.col("s")), "left")
    soft = [F.col(f"f_{r}") & ~F.coalesce(F.col(f"habit_{r}"), F.lit(False)) for r in RULES[1:]]
    kept = ~(F.col("f_base") | F.coalesce(F.col("rejected"), F.lit(False)) | F.coalesce(soft[0] | soft[1], F.lit(False)))
    return joined.select(*counts.columns, F.col("f_base").alias("base_failed"), kept.alias("kept"))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", limits: HostLimits = HostLimits()) -> DataFrame:
    """One row per row of docs with its counts, base_failed and kept. Null and empty texts have no
    words and fail the base rule; a null host is a host of its own; repeated rows each count; an
    empty table gives no rows; other columns are ignored. A long text is judged whole, in its row."""
    return judge(written(rule_counts(docs, id_col, text_col, host_col), "rule-counts"), limits)
