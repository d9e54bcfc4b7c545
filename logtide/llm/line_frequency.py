"""Quality rules by the frequency of lines across documents, in DataFrame functions only.

A line is normalised (lower case, single spaces, no outer spaces) and hashed. For every host
(the ``source``) the distinct documents that hold a line are counted; copies of
a text count once. A line in more than MIN_DOCS documents and MAX_SHARE of its host's documents is
removed. A document is rejected if it fails a base rule, or if fewer than
MIN_LEFT of its words are left.

Rows that meet in an exchange are keys and counts: line rows are (host, text, line), so
that neither a large host nor a frequent line is one group, and are summed before they
move. A host has at most 1/MAX_SHARE times its documents' mean number of lines as
frequent lines.

Cases: a null text is an empty one, without words, and fails; a null source is a host of
its own. Rows that repeat a doc_id are judged one by one. An empty table gives no rows.
Other columns are ignored by the report and kept by the filter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from logtide.functions.bind import bind
from logtide.plans.common import materialize

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
MIN_DOCS = 20
MAX_SHARE = 0.05
MIN_LEFT = 0.5
MIN_WORDS = 50
MAX_REPEATED = 50  # percent of words in repeated windows
WINDOW = 3


def _words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE, -1), lambda w: w != "")


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def _normal(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(line), SPACE, " "))


def _neighbours(ordered: Column, key: str) -> Column:
    """Of a sorted array of structs, the elements whose key another one has too."""
    return bind(ordered, lambda all_: F.filter(
        all_, lambda x, i: (F.get(all_, i - 1)[key] == x[key]) | (F.get(all_, i + 1)[key] == x[key])
    ))


def repeated_words(words: Column) -> Column:
    """How many words stand in WINDOW-word windows that the text has twice or more; ``words`` is a bound array.

    Windows are sorted by hash, and the few that share one by their words.
    """
    def windows(w: Column) -> Column:
        hashes = F.transform(w, lambda x: F.xxhash64(x))
        return bind(hashes, lambda h: F.transform(
            F.sequence(F.lit(1), F.size(h) - (WINDOW - 1)),
            lambda i: F.xxhash64(*[F.element_at(h, i + k) for k in range(WINDOW)]),
        ))

    def exact(w: Column, shared: Column) -> Column:
        spelled = F.transform(shared, lambda x: F.struct(
            F.array_join(F.slice(w, x["at"], WINDOW), " ").alias("key"), x["at"].alias("at")))
        starts = F.transform(_neighbours(F.array_sort(spelled), "key"), lambda x: x["at"])
        covered = F.flatten(F.transform(starts, lambda s: F.array(*[s + k for k in range(WINDOW)])))
        return F.size(F.array_distinct(covered))

    def counted(w: Column, keys: Column) -> Column:
        placed = F.transform(keys, lambda k, i: F.struct(k.alias("key"), (i + 1).alias("at")))
        return exact(w, _neighbours(F.array_sort(placed), "key"))

    return F.when(F.size(words) < WINDOW, 0).otherwise(bind(
        windows(words),
        lambda keys: F.when(F.size(F.array_distinct(keys)) == F.size(keys), 0).otherwise(counted(words, keys)),
    ))


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with struct columns that name host and text: two hashes make a key of 128 bits."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.withColumns({
        "_host": F.coalesce(F.col("source").cast("string"), F.lit("\0")),
        "_text": text, "_t1": F.xxhash64(text), "_t2": F.xxhash64(F.lit(1), text),
    })


def frequent_lines(
    docs: DataFrame, min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE
) -> tuple[DataFrame, DataFrame]:
    """The lines above the limit (_host, _line), and the written lines per text with their words."""
    keyed = _keyed(docs.select("source", "text"))
    line = F.explode(F.transform(_lines(F.col("_text")), lambda x: bind(_normal(x), lambda n: F.struct(
        F.xxhash64(n).alias("line"), F.regexp_count(n, F.lit(r"[^\x20\x09-\x0D]+")).alias("words")))))
    each = keyed.select("_host", "_t1", "_t2", line.alias("_l")).select(
        "_host", "_t1", "_t2", F.col("_l.line").alias("_line"), F.col("_l.words").alias("_words")
    )
    # Copies of a text add up in _words; the number of copies divides them again.
    lines = materialize(
        each.groupBy("_host", "_t1", "_t2", "_line").agg(F.sum("_words").alias("_words")), "host-lines"
    )
    sizes = keyed.select("_host", "_t1", "_t2").distinct().groupBy("_host").agg(F.count(F.lit(1)).alias("_docs"))
    held = lines.groupBy("_host", "_line").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > min_docs)
    above = held.join(sizes, "_host").where(F.col("_n") > max_share * F.col("_docs")).select("_host", "_line")
    return materialize(above, "frequent-lines"), lines


def base_counts(text: Column) -> Column:
    """The base rules' counts as a struct; the words of a text are split once."""
    of_words = bind(_words(text), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"), repeated_words(w).cast("long").alias("n_repeat_words")))
    repeats = bind(_lines(text), lambda x: F.size(x) - F.size(F.array_distinct(x)))
    return bind(of_words, lambda w: F.struct(
        w["n_words"].alias("n_words"),
        F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        repeats.cast("long").alias("n_dup_lines"),
        w["n_repeat_words"].alias("n_repeat_words"),
    ))


def _failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > MAX_REPEATED * n_words)


def quality_report(docs: DataFrame, min_left: float = MIN_LEFT, **limits) -> DataFrame:
    """Per row the base counts, base_failed, words_removed and kept."""
    above, lines = frequent_lines(docs, **limits)
    removed = lines.join(above, ["_host", "_line"]).groupBy("_host", "_t1", "_t2").agg(
        F.sum("_words").alias("_words")
    )
    keyed = _keyed(docs.select("doc_id", "source", "text"))
    copies = keyed.groupBy("_host", "_t1", "_t2").agg(F.count(F.lit(1)).alias("_copies"))
    removed = removed.join(copies, ["_host", "_t1", "_t2"]).select(
        "_host", "_t1", "_t2", F.expr("_words div _copies").alias("words_removed")
    )
    counted = keyed.select("doc_id", "_host", "_t1", "_t2", base_counts(F.col("_text")).alias("_c")).select(
        "doc_id", "_host", "_t1", "_t2", "_c.*"
    )
    failed = _failed(F.col("n_words"), F.col("n_repeat_words"))
    left = F.col("n_words") - F.col("words_removed")
    return counted.join(removed, ["_host", "_t1", "_t2"], "left").withColumn(
        "words_removed", F.coalesce("words_removed", F.lit(0).cast("long"))
    ).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & (left >= min_left * F.col("n_words"))).alias("kept"), "words_removed",
    )


def keep_good_documents(docs: DataFrame, min_left: float = MIN_LEFT, **limits) -> DataFrame:
    """The documents that pass, without their frequent lines, with the columns of docs."""
    above, lines = frequent_lines(docs, **limits)
    gone = materialize(
        lines.join(above, ["_host", "_line"]).groupBy("_host", "_t1", "_t2").agg(F.collect_list("_line").alias("_gone")),
        "lines-to-remove",
    )
    # Columns of docs travel as one struct, so that none of their names meets one used here.
    named = docs.select(F.struct(F.col("*")).alias("_doc")).select("_doc", "_doc.source", "_doc.text")
    counted = _keyed(named).drop("source", "text").withColumn("_c", base_counts(F.col("_text"))).where(
        ~_failed(F.col("_c.n_words"), F.col("_c.n_repeat_words"))
    )
    stays = F.array_join(F.filter(
        F.split("_text", "\n", -1), lambda x: ~F.array_contains("_gone", F.xxhash64(_normal(x)))), "\n")
    # What is removed grows with the corpus: one plan at every size.
    left = counted.join(gone.hint("merge"), ["_host", "_t1", "_t2"], "left").withColumn(
        "_left", F.when(F.col("_gone").isNotNull(), stays)
    ).where(F.col("_left").isNull() | (F.size(_words(F.col("_left"))) >= min_left * F.col("_c.n_words")))
    text = F.coalesce(F.col("_left"), F.col("_doc.text")).alias("text")
    return left.select(*[text if c == "text" else F.col("_doc")[c].alias(c) for c in docs.columns])
