"""Quality rules with cross-document line frequency, in DataFrame functions only.

Lines are normalised (trimmed, lower case, runs of white space to one space,
runs of digits to 0) and hashed.  A line of a host is boilerplate where more
than ``max(min_documents, max_share * documents)`` of the host's distinct
documents hold it: it is removed from all of them.  A document that keeps less
than ``min_left`` of its words is depleted and rejected, as are those that fail
the base rules on the number of words and on repeated word triples.

Exact copies count as one document when lines are counted, so a text that was
copied often isn't boilerplate because of it.  Only hashes, counts and ids are
shuffled for the verdicts; the texts move only if the cleaned text is used.

Defined results: a null text counts as empty (no words, rejected); a null host
is a host of its own; rows may repeat, each gets a row; other columns of the
input pass through whatever their names, but for those named in STATS and
clean_text, which are replaced; a null id is an id like any other; a line in
just as many documents as the limit stays; an empty table gives no rows.

The limit is a share of the host's documents (with a floor for small hosts), so
that the verdict on a line doesn't depend on how much of a host was crawled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Columns that quality() adds.
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_removed_words", "n_removed_lines", "base_failed", "kept")
WHITE = "\\t\\n\\u000B\\u000C\\r "
_KEY = ("_id", "_host", "_text")


def _words(text: str) -> str:
    """SQL for the array of words of a text, empty for one without words."""
    inner = f"trim(BOTH '{WHITE}' FROM {text})"
    return f"CASE WHEN {inner} = '' THEN CAST(array() AS ARRAY<STRING>) ELSE split({inner}, '[\\\\x20\\\\x09-\\\\x0D]+') END"


def _let(value: str, name: str, body: str) -> str:
    """SQL that evaluates value once and uses it in body under a name."""
    return f"transform(array({value}), {name} -> {body})[0]"


def repeated_words(words: str) -> Column:
    """Words that lie in three-word windows which the array holds twice or more.

    The windows' hashes are sorted with their places; equal neighbours are
    repeats, and each repeated place adds the words that the one before it
    doesn't cover.
    """
    windows = _let(
        f"transform({words}, w -> xxhash64(w))",
        "h",
        "transform(slice(h, 1, greatest(size(h) - 2, 0)), (x, i) -> struct(xxhash64(x, get(h, i + 1), get(h, i + 2)) AS g, i AS p))",
    )
    places = _let(
        f"sort_array({windows})",
        "s",
        "sort_array(transform(filter(s, (x, i) -> get(s, i - 1).g <=> x.g OR get(s, i + 1).g <=> x.g), x -> x.p))",
    )
    return F.expr(
        f"aggregate({places}, struct(-3 AS l, 0L AS n), (a, p) -> struct(p AS l, a.n + least(3, p - a.l) AS n), a -> a.n)"
    )


def _normal(line: str) -> str:
    return f"regexp_replace(regexp_replace(lower(trim(BOTH '{WHITE}' FROM {line})), '[\\\\x20\\\\x09-\\\\x0D]+', ' '), '[0-9]+', '0')"


def _prepared(docs: DataFrame, doc_id: str, text: str, host: str) -> DataFrame:
    return docs.withColumns(
        {
            "_id": F.col(doc_id),
            "_host": F.coalesce(F.col(host).cast("string"), F.lit("")),
            "_body": F.coalesce(F.col(text), F.lit("")),
            "_text": F.xxhash64(F.coalesce(F.col(text), F.lit(""))),
        }
    )


def boilerplate(docs: DataFrame, doc_id: str, text: str, host: str, min_documents: int, max_share: float) -> tuple[DataFrame, DataFrame]:
    """Lines of all documents, and those (host, line) that stand in more distinct documents than the limit."""
    rows = _prepared(docs, doc_id, text, host)
    lines = rows.select(
        *_KEY,
        F.posexplode(
            F.expr(
                f"transform(filter(split(_body, '\\n'), l -> trim(BOTH '{WHITE}' FROM l) <> ''), "
                f"l -> struct(xxhash64({_normal('l')}) AS line, size({_words('l')}) AS words))"
            )
        ).alias("place", "l"),
    ).select(*_KEY, "place", "l.line", "l.words")
    in_host = rows.groupBy("_host").agg(F.countDistinct("_text").alias("documents"))
    seen = lines.groupBy("_host", "line", "_text").agg(F.lit(1).alias("one"))
    counted = seen.groupBy("_host", "line").agg(F.count("*").alias("n")).where(F.col("n") > min_documents)
    frequent = counted.join(in_host, "_host").where(F.col("n") > F.col("documents") * max_share).select("_host", "line")
    return lines, frequent


def quality(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    host: str = "source",
    min_documents: int = 10,
    max_share: float = 0.05,
    min_left: float = 0.5,
    min_words: int = 50,
    max_repeat_percent: int = 50,
) -> DataFrame:
    """The documents with their counts, the verdict and, in clean_text, the text without boilerplate lines."""
    # columns whose names begin like those used inside are set aside under others
    aside = {c: f"given{i}" for i, c in enumerate(docs.columns) if c.startswith("_")}
    while set(aside.values()) & {c.lower() for c in docs.columns}:
        aside = {c: f"given_{n}" for c, n in aside.items()}
    docs, doc_id, text, host = docs.withColumnsRenamed(aside), *(aside.get(c, c) for c in (doc_id, text, host))
    lines, frequent = boilerplate(docs, doc_id, text, host, min_documents, max_share)
    removed = (
        lines.join(frequent, ["_host", "line"])
        .dropDuplicates([*_KEY, "place"])  # rows that repeat an id and its text count once
        .groupBy(*_KEY)
        .agg(F.sum("words").alias("_gone_words"), F.count("*").alias("_gone_lines"), F.collect_set("line").alias("_gone"))
    )
    base = _prepared(docs, doc_id, text, host).withColumn("_words", F.expr(_words("_body")))
    flat = f"filter(split(_body, '\\n'), l -> trim(BOTH '{WHITE}' FROM l) <> '')"
    counted = base.withColumns(
        {
            "n_words": F.expr("CAST(size(_words) AS BIGINT)"),
            "word_chars": F.expr(f"CAST(length(translate(_body, '{WHITE}', '')) AS BIGINT)"),
            "n_symbols": F.expr("CAST(length(_body) - length(translate(_body, '#*$%&|<>', '')) AS BIGINT)"),
            "n_dup_lines": F.expr(f"CAST({_let(flat, 'a', 'size(a) - size(array_distinct(a))')} AS BIGINT)"),
            "n_repeat_words": repeated_words("_words"),
        }
    ).drop("_words")
    left_lines = f"filter(split(_body, '\\n'), l -> trim(BOTH '{WHITE}' FROM l) = '' OR NOT array_contains(_gone, xxhash64({_normal('l')})))"
    removed = removed.withColumnsRenamed({c: f"_gone{c}" for c in _KEY})
    same = F.col("_id").eqNullSafe(F.col("_gone_id")) & (F.col("_host") == F.col("_gone_host")) & (F.col("_text") == F.col("_gone_text"))
    out = counted.join(removed, same, "left").withColumns(
        {
            "n_removed_lines": F.coalesce(F.col("_gone_lines"), F.lit(0)),
            "n_removed_words": F.coalesce(F.col("_gone_words"), F.lit(0)),
            "clean_text": F.expr(f"CASE WHEN _gone IS NULL THEN _body ELSE array_join({left_lines}, '\\n') END"),
            "base_failed": (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words")),
        }
    )
    left = F.col("n_words") - F.col("n_removed_words")
    return out.withColumn("kept", ~F.col("base_failed") & (left >= F.lit(min_left) * F.col("n_words"))).drop(
        *_KEY, *(f"_gone{c}" for c in _KEY), "_body", "_gone", "_gone_words", "_gone_lines"
    ).withColumnsRenamed({n: c for c, n in aside.items()})
