"""Quality rules judged by host.

Each document is measured; a few rules mark what looks wrong.  The base rule
rejects by itself.  The other rules are hints that one document cannot prove
(a table has many symbols, a poem repeats lines), so the host decides: its
rate of failures for each rule is shrunk towards the rate of all hosts by a
beta prior fitted to the hosts (empirical Bayes), and where the shrunk rate
passes ``HOST_RATE`` the host is held to break that rule.  A document goes if
the base rule fails, or if it fails a rule that its host is held to break.
So a host's verdict never rejects a document that passes all rules.

Null text has no words, fails the base rule and goes.  A null host is a host
of its own.  Repeated rows count each.  An empty table gives an empty table.
Only the named columns are read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sondage.llm.base import bound_batches, cut, texts_by_bytes

SYMBOLS = "#*$%&|<>"
#: A host breaks a rule when more than this share of its documents fails it, after shrinking.
HOST_RATE = 0.5
#: Hosts that break a rule are broadcast up to this many (a few MB), and joined under salts beyond it.
BROADCAST_HOSTS = 20_000
SALTS = 32


def repeated_words(words: list[bytes], window: int = 3) -> int:
    """Words inside a window of words that occurs twice or more, each counted once."""
    grams = list(zip(*(words[k:] for k in range(window))))
    if len(set(grams)) == len(grams):
        return 0
    count, total, free = Counter(grams), 0, 0
    for at, g in enumerate(grams):
        if count[g] > 1:
            total += at + window - max(free, at)
            free = at + window
    return total


def repeated_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = text.split(b"\n")
    if len(set(lines)) == len(lines):
        return 0
    seen, n = set(), 0
    for line in lines:
        if line in seen:
            n += bool(line.split())
        seen.add(line)
    return n


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measure(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", whole_row: bool = False) -> DataFrame:
    """``doc_id, host`` and the measures of each text; ``_row``, the whole row, if asked for."""
    bound_batches(df.sparkSession)
    cols = [df[id_col].alias("doc_id"), df[host_col].alias("host"), df[text_col].alias("_text")]
    rows = df.select(*cols, *[F.struct(*[df[c] for c in df.columns]).alias("_row")] * whole_row)
    passed = ["doc_id", "host"] + ["_row"] * whole_row
    symbols, blanks = [c.encode() for c in SYMBOLS], [c.encode() for c in " \t\n\v\f\r"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, texts in texts_by_bytes(b, "_text"):
                out = []
                for t in texts:
                    words = t.split()  # at ASCII white space
                    chars = len(t.decode()) - sum(map(t.count, blanks))
                    out.append((len(words), chars, sum(map(t.count, symbols)), repeated_lines(t), repeated_words(words)))
                cols = [pa.array(c, pa.int64()) for c in zip(*out)]
                yield pa.RecordBatch.from_arrays([*[b.column(c).slice(at, len(texts)) for c in passed], *cols], [*passed, *MEASURES])

    return rows.mapInArrow(run, T.StructType([rows.schema[c] for c in passed] + [T.StructField(n, T.LongType()) for n in MEASURES]))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def host_rules() -> dict[str, Column]:
    """Rules that the host's rate confirms or not."""
    return {
        "symbols": 10 * F.col("n_symbols") > F.col("n_words"),
        "repeats": 100 * F.col("n_repeat_words") > 20 * F.col("n_words"),
        "lines": 10 * F.col("n_dup_lines") > F.col("n_words"),
        "length": (F.col("word_chars") > 12 * F.col("n_words")) | (F.col("word_chars") < 2 * F.col("n_words")),
    }


def beta_prior(n: float, mean: float | None, spread: float | None, noise: float | None) -> tuple[float, float]:
    """(alpha, beta) by moments over ``n`` hosts; spread: weighted variance of their rates, noise: its share by chance."""
    if not n or mean is None or not 0 < mean < 1:
        return (1.0, 1.0) if mean is None else (1.0 + mean, 2.0 - mean)  # nothing to fit: weak, near the mean
    own = (spread or 0.0) - (noise or 0.0)
    size = mean * (1 - mean) / own - 1 if own > 0 else 1e6  # hosts differ by chance only: shrink to the mean
    size = min(max(size, 2.0), 1e6)
    return mean * size, (1 - mean) * size


def host_verdicts(measured: DataFrame, rate: float = HOST_RATE) -> DataFrame:
    """``host``, documents, and per rule ``<rule>_rate`` (shrunk) and ``<rule>_broken``."""
    rules = host_rules()
    hosts = measured.groupBy("host").agg(
        F.count("*").alias("docs"), *[F.sum(r.cast("long")).alias(f"{n}_failed") for n, r in rules.items()])
    share = {n: F.col(f"{n}_failed") / F.col("docs") for n in rules}
    means = hosts.agg(F.count("*").alias("n"), *[(F.sum(f"{n}_failed") / F.sum("docs")).alias(n) for n in rules]).first()
    # one row: the moments of the rates, each host weighted by its documents
    moments = hosts.agg(*[x for n in rules if means[n] is not None for x in (
        (F.sum(F.col("docs") * F.pow(share[n] - means[n], 2)) / F.sum("docs")).alias(f"{n}_spread"),
        (F.count("*") * F.lit(means[n] * (1 - means[n])) / F.sum("docs")).alias(f"{n}_noise"))] or [F.lit(0)]).first().asDict()
    for n in rules:
        a, b = beta_prior(means["n"], means[n], moments.get(f"{n}_spread"), moments.get(f"{n}_noise"))
        hosts = hosts.withColumn(f"{n}_rate", (F.col(f"{n}_failed") + a) / (F.col("docs") + a + b))
        hosts = hosts.withColumn(f"{n}_broken", F.col(f"{n}_rate") > rate)
    return hosts


def _broken(verdicts: DataFrame) -> DataFrame:
    """``_host, host_broken`` (names of rules) of the hosts that break any."""
    names = F.array_compact(F.array(*[F.when(F.col(f"{n}_broken"), F.lit(n)) for n in host_rules()]))
    return verdicts.select(F.col("host").alias("_host"), names.alias("host_broken")).filter(F.size("host_broken") > 0)


def _with_verdict(rows: DataFrame, measured: DataFrame, rate: float) -> DataFrame:
    """``rows`` with ``host_broken`` and ``kept``; the verdicts come from ``measured``."""
    broken = cut(_broken(host_verdicts(measured, rate)), "hosts")
    if broken.count() <= BROADCAST_HOSTS:
        joined = rows.join(F.broadcast(broken), rows["host"].eqNullSafe(broken["_host"]), "left")
    else:  # a host may hold a third of all rows: its verdict is joined under several salts
        salted = broken.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn("_at", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
        joined = rows.join(salted, rows["host"].eqNullSafe(salted["_host"]) & (rows["_at"] == salted["_salt"]), "left")
    fails = F.lit(False)
    for n, rule in host_rules().items():
        fails = fails | (rule & F.array_contains("host_broken", n))
    joined = joined.withColumn("host_broken", F.coalesce("host_broken", F.array().cast("array<string>")))
    return joined.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~fails)


def judge(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", rate: float = HOST_RATE) -> DataFrame:
    """One row per row: ``doc_id``, measures, ``base_failed``, ``kept``, and ``host_broken``, the host's broken rules."""
    measured = cut(measure(df, id_col, text_col, host_col), "measures")
    return _with_verdict(measured, measured, rate).select("doc_id", *MEASURES, "base_failed", "kept", "host_broken")


def keep_good(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", rate: float = HOST_RATE) -> DataFrame:
    """The rows that are kept, with all their columns; texts stay in their tasks."""
    measured = cut(measure(df, id_col, text_col, host_col), "measures")
    rows = measure(df, id_col, text_col, host_col, whole_row=True)
    return _with_verdict(rows, measured, rate).filter("kept").select("_row.*")
