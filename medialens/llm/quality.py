"""Quality rules from cross-document line frequency (native).

Lines are normalised and hashed; for each host the number of distinct documents of a line is
counted; lines above the limit are removed, and documents that lose too much are rejected.

Which documents are distinct: those whose whole texts differ. Copies of one document count once, so a group
of copies does not turn its own text into "frequent lines"; documents that differ at all count once each,
however much of a template they share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medialens.functions.vectors import bound
from medialens.llm.runtime import SPACE_CLASS, col, fresh, within_rows, written

#: A line is frequent if more distinct documents of one host than this have it.
MAX_DOCS_PER_HOST = 20
#: A document is depleted if frequent lines held more than this share of its words, in percent.
MAX_REMOVED_PERCENT = 50
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = "#*$%&|<>"
_SPACES = " \t\n\x0b\x0c\r"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE_CLASS + "+"), "")


def lines_of(text: Column) -> Column:
    """The \\n-split lines; white space around them kept."""
    return F.split(text, "\n")


def single_spaced(line: Column) -> Column:
    """A line with single spaces between its words and none around them."""
    return F.btrim(F.regexp_replace(line, SPACE_CLASS + "+", " "))


def line_key(spaced: Column) -> Column:
    """60 bits of the MD5 of a single-spaced line in lower case."""
    return F.conv(F.substring(F.md5(F.lower(spaced)), 1, 15), 16, 10).cast("bigint")


def _has_word(line: Column) -> Column:
    return F.length(F.btrim(line, F.lit(_SPACES))) > 0


def base_measures(df: DataFrame, text: str) -> DataFrame:
    """df with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and base_failed.

    A null text counts as empty: all zero, failed. One pass over each text, no shuffle: the
    3-word windows of a text are hashed and sorted within its row, so a text of n words takes
    n log n steps however often it repeats itself.
    """
    body, words, lines, windows, ordered, places = fresh(df, "body", "words", "lines", "windows", "ordered", "places")
    q = "`{}`".format
    step = df.withColumn(body, F.coalesce(col(text), F.lit("")))
    step = step.withColumns(
        {
            words: words_of(F.col(body)),
            lines: F.filter(lines_of(F.col(body)), _has_word),
            # a look at each character through translate() costs several times as much
            "n_symbols": (F.size(F.split(F.col(body), f"[{SYMBOLS}]")) - 1).cast("bigint"),
        }
    )
    step = step.withColumns(
        {
            "n_words": F.size(words).cast("bigint"),
            "word_chars": F.length(F.array_join(words, "")).cast("bigint"),
            "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(F.col(lines)))).cast("bigint"),
            windows: F.expr(f"slice(transform({q(words)}, (w, i) -> xxhash64(w, get({q(words)}, i + 1), get({q(words)}, i + 2))), 1, greatest(size({q(words)}) - 2, 0))"),
        }
    ).drop(words, lines, body)
    # most texts repeat no window: a set of the hashes tells, and only the others are sorted
    numbered = f"transform(if(size(array_distinct({q(windows)})) < size({q(windows)}), {q(windows)}, slice({q(windows)}, 1, 0)), (x, i) -> struct(x AS h, i AS i))"
    step = step.withColumn(ordered, F.expr(f"sort_array({numbered})")).drop(windows)
    step = step.withColumn(places, F.expr(f"sort_array(transform(filter({q(ordered)}, (e, j) -> e.h = get({q(ordered)}, j + 1).h OR e.h = get({q(ordered)}, j - 1).h), e -> e.i))")).drop(ordered)
    covered = F.expr(f"aggregate(transform({q(places)}, (p, j) -> least(3, coalesce(get({q(places)}, j + 1) - p, 3))), 0, (a, x) -> a + x)")
    step = step.withColumn("n_repeat_words", covered.cast("bigint")).drop(places)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return step.withColumn("base_failed", failed)


def line_occurrences(df: DataFrame, doc_id: str, text: str, host: str) -> DataFrame:
    """A row for each line with a word: doc_id, text_key, host, line, pos, words."""
    base = df.select(
        col(doc_id).alias("doc_id"),
        F.xxhash64(col(text)).alias("text_key"),
        col(host).cast("string").alias("host"),
        F.transform(lines_of(F.coalesce(col(text), F.lit(""))), lambda x, i: F.struct(single_spaced(x).alias("line"), i.alias("pos"))).alias("lines"),
    )
    # a line with a word has one space fewer than words
    words = lambda line: F.size(F.split(line, " ")).alias("words")
    lines = F.transform(F.filter("lines", lambda s: s["line"] != ""), lambda s: F.struct(line_key(s["line"]).alias("line"), s["pos"].alias("pos"), words(s["line"])))
    base = base.select("doc_id", "text_key", "host", lines.alias("lines"))
    # outer, as Spark would compute the lines once more in a filter on their number ahead of a plain explode
    base = base.select("doc_id", "text_key", "host", F.explode_outer("lines").alias("l")).filter("l IS NOT NULL")
    return base.select("doc_id", "text_key", "host", F.col("l.line").alias("line"), F.col("l.pos").alias("pos"), F.col("l.words").alias("words"))


def frequent_lines(occurrences: DataFrame, max_docs: int = MAX_DOCS_PER_HOST) -> DataFrame:
    """host, line, n_docs of the lines in more than max_docs distinct documents of a host.

    Two partial aggregations, so neither a hot host nor a hot line gathers its rows in one task.
    """
    once = occurrences.groupBy("host", "line", "text_key").agg(F.count(F.lit(1)).alias("n"))
    return once.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n_docs")).filter(F.col("n_docs") > max_docs)


def removed_lines(df: DataFrame, doc_id: str, text: str, host: str, max_docs: int = MAX_DOCS_PER_HOST) -> DataFrame:
    """doc_id, text_key, removed: array of (pos, words) of the frequent lines of each document.

    The positions of one text gather in one row (bounded by its lines); repeated rows count once.
    """
    # written once and read twice: splitting and hashing the lines costs far more than their hashes take on disk
    rows = written(line_occurrences(df, doc_id, text, host), "lines")
    frequent = frequent_lines(rows, max_docs).select(F.col("host").alias("f_host"), F.col("line").alias("f_line"))
    # written, so that a larger side is shuffled anew: only then can Spark split the rows of one line over tasks
    frequent = written(frequent, "frequent-lines")
    frequent = F.broadcast(frequent) if within_rows(frequent) else frequent.hint("merge")
    hit = rows.join(frequent, (F.col("line") == F.col("f_line")) & F.col("host").eqNullSafe(F.col("f_host")), "left_semi")
    return hit.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("pos", "words")).alias("removed"))


def quality_report(df: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", max_docs: int = MAX_DOCS_PER_HOST, max_removed_percent: int = MAX_REMOVED_PERCENT) -> DataFrame:
    """Measures and verdict of each row: doc_id, the base measures, base_failed, kept,
    n_frequent_lines and n_frequent_words (long).

    kept is false if the base rule fails or the frequent lines held more than
    max_removed_percent of the words. Null texts are empty texts (rejected); null hosts are one host of
    their own; repeated rows get equal verdicts; an empty table gives an empty report; other columns of
    df do not matter. Only measures and hashes are shuffled, never texts.
    """
    measures = base_measures(df.select(col(doc_id).alias("doc_id"), col(text).alias("text"), F.xxhash64(col(text)).alias("text_key")), "text").drop("text")
    lost = removed_lines(df, doc_id, text, host, max_docs).select(
        F.col("doc_id").alias("r_id"), F.col("text_key").alias("r_key"), F.size("removed").cast("bigint").alias("r_lines"), F.aggregate("removed", F.lit(0).cast("bigint"), lambda a, s: a + s["words"]).alias("r_words")
    )
    both = measures.join(lost, (F.col("text_key") == F.col("r_key")) & F.col("doc_id").eqNullSafe(F.col("r_id")), "left")
    words = F.coalesce("r_words", F.lit(0).cast("bigint"))
    return both.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        (~F.col("base_failed") & ~(100 * words > max_removed_percent * F.col("n_words"))).alias("kept"),
        F.coalesce("r_lines", F.lit(0).cast("bigint")).alias("n_frequent_lines"),
        words.alias("n_frequent_words"),
    )


def apply_quality(df: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", max_docs: int = MAX_DOCS_PER_HOST, max_removed_percent: int = MAX_REMOVED_PERCENT, length: str | None = "n_chars") -> DataFrame:
    """The rows that quality_report keeps, all columns as they were, without their frequent lines.

    `length`, if df has it, is set anew to the code points of the text that is left.
    """
    key, removed, r_id, r_key, lines, words = fresh(df, "key", "removed", "r_id", "r_key", "lines", "lost_words")
    lost = removed_lines(df, doc_id, text, host, max_docs).select(F.col("doc_id").alias(r_id), F.col("text_key").alias(r_key), F.col("removed").alias(removed))
    out_cols = df.columns
    tagged = df.select(*[col(c) for c in out_cols], F.xxhash64(col(text)).alias(key))
    measured = base_measures(tagged.select(*[col(c).alias(f"c{i}") for i, c in enumerate(out_cols)], F.col(key)), f"c{out_cols.index(text)}")
    # most words that the frequent lines may have held; none can be few enough if the base rule fails
    spare = F.when(F.col("base_failed"), F.lit(-1)).otherwise(max_removed_percent * F.col("n_words"))
    measured = measured.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(out_cols)], F.col(key), spare.alias(words))
    both = measured.join(lost, (F.col(key) == F.col(r_key)) & col(doc_id).eqNullSafe(F.col(r_id)), "left")
    gone = F.coalesce(F.aggregate(F.col(removed), F.lit(0).cast("bigint"), lambda a, s: a + s["words"]), F.lit(0))
    # one comparison over both sides: a filter on the measures alone would be pushed down and compute them many times
    both = both.filter(100 * gone <= F.col(words))
    places = F.col(removed)["pos"]
    # the places that stay by one hashed difference, not by a look at all removed places for each line
    stay = lambda ls: F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), places)
    left = bound(lines_of(col(text)), lambda ls: F.array_join(F.transform(stay(ls), lambda i: F.get(ls, i)), "\n"))
    both = both.withColumn(lines, F.when(F.col(removed).isNull(), col(text)).otherwise(left))
    return both.select(*[F.col(lines).alias(c) if c == text else F.length(F.col(lines)).cast(df.schema[c].dataType).alias(c) if c == length else col(c) for c in out_cols])
