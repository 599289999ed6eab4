"""Quality rules: document statistics and lines that many documents of a host share.

Native DataFrame expressions only.  A document's own statistics are computed in its row.
For the cross-document part, lines are normalised (A-Z lower-cased, digits as 0, white
space collapsed) and hashed with their host; per line and host the distinct documents are
counted, and so are the *families* among them.  A document's family for a line comes from
its other lines: of their first and last three words one piece is drawn by hash, a line with
the chance of its share of the words (an exponential race).  Copies and near copies draw the
same piece and unrelated texts do not, however many there are.  A line is furniture when more
than ``max_docs`` documents of the host have it, of at least a quarter as many families:
large groups of near copies do not make their own prose look like furniture (removing copies
is the business of other operators), and the other furniture of a page may hold up to three
quarters of its remaining words.  Texts of one line only are of one family.

Furniture lines are removed: the kept rows carry their other lines in order.  A document is
depleted, and rejected, when fewer than ``min_share`` of its words are left.

Null and blank texts have no words, fail the base rule and are not kept.  A null host is a
host of its own.  Repeated rows are judged alike and count as documents of one family.
Extra columns are not looked at; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import SPACE, SPACE_RUN, ascii_lower, let, word_array
from tidemark.session import join_checked, settle

SYMBOLS = "#*$%&|<>"
MAX_DOCS = 20
MIN_SHARE = 0.5
MIN_WORDS = 50
FAMILY_SHARE = 4  # a line of fewer than 1/4 as many families as documents is the prose of near copies


def _text() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def repeated_words(words: Column) -> Column:
    """Words covered by 3-word windows that occur twice or more in ``words``.

    The windows are hashed with their positions and sorted, so equal ones are neighbours;
    the covered words are then counted along the sorted positions.
    """
    n = F.size(words)
    spots = F.when(n >= 3, F.sequence(F.lit(1), n - 2)).otherwise(F.array().cast("array<int>"))
    hashes = F.transform(
        spots, lambda i: F.xxhash64(F.get(words, i - 1), F.get(words, i), F.get(words, i + 1))
    )

    def repeats(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(
            let(placed, covered)
        )

    def covered(placed: Column) -> Column:
        def twice(x: Column, k: Column) -> Column:
            return (F.get(placed, k - 1)["h"] == x["h"]) | (F.get(placed, k + 1)["h"] == x["h"])

        at = F.sort_array(
            F.transform(F.filter(placed, lambda x, k: F.coalesce(twice(x, k), F.lit(False))), lambda x: x["i"])
        )
        return F.aggregate(
            at,
            F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("sum")),
            lambda acc, i: F.struct(i.alias("last"), (acc["sum"] + F.least(F.lit(3), i - acc["last"])).alias("sum")),
            lambda acc: acc["sum"],
        )

    return let(hashes, repeats)


def normal_line(line: Column) -> Column:
    spaced = F.btrim(F.regexp_replace(ascii_lower(line), SPACE_RUN, " "))
    return F.translate(spaced, "123456789", "000000000")


def _drawn(line: Column) -> Column:
    """Struct (rank, piece): the piece a line takes part with in the draw of its text."""
    rank = lambda piece: -F.log((F.shiftrightunsigned(piece, 11).cast("double") + 1) / float(2**53 + 1))
    ends = F.array(F.xxhash64(F.substring_index(line, " ", 3)), F.xxhash64(F.substring_index(line, " ", -3)))
    return let(
        F.array_min(F.transform(ends, lambda x: F.struct(rank(x).alias("rank"), x.alias("piece")))),
        lambda x: F.struct((x["rank"] / _words(line)).alias("rank"), x["piece"].alias("piece")),
    )


def _words(line: Column) -> Column:
    """Words of a normalised line."""
    return (F.length(line) - F.length(F.translate(line, " ", "")) + 1).cast("long")


def _with_family(lines: Column) -> Column:
    """Array of (line, family): the family is the piece that the other lines draw."""

    def drawn(draws: Column) -> Column:
        first = F.array_min(draws)
        return let(
            F.struct(first.alias("first"), F.array_min(F.array_remove(draws, first)).alias("next")),
            lambda x: F.transform(
                lines,
                lambda line, i: F.struct(
                    line.alias("line"),
                    F.coalesce(F.when(F.get(draws, i) == x["first"], x["next"]["piece"]).otherwise(x["first"]["piece"]), F.lit(0)).alias("family"),
                ),
            ),
        )

    return let(F.transform(lines, _drawn), drawn)


def _key(host: Column, line: Column) -> Column:
    return F.xxhash64(host.isNull(), host, line)


def _lines(docs: DataFrame, families: bool = False) -> DataFrame:
    """key (host and line hash), words and document key of each distinct line of a text, and its family if asked for."""
    kept = F.filter(F.split(_text(), "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    lines = F.array_distinct(F.transform(kept, normal_line))
    alone = lambda x: F.transform(x, lambda line: F.struct(line.alias("line")))
    return (
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.xxhash64(_text()).alias("text_hash"),
            F.col("source").cast("string").alias("host"),
            let(lines, _with_family if families else alone).alias("lines"),
        )
        # explode() alone would put a filter before it that works out all lines a second time
        .select("doc_id", "text_hash", "host", F.explode_outer("lines").alias("x"))
        .where("x is not null")
        .select(
            "doc_id",
            "text_hash",
            *(["x.family"] if families else []),
            _key(F.col("host"), F.col("x.line")).alias("key"),
            _words(F.col("x.line")).alias("words"),
        )
    )


def furniture(docs: DataFrame, max_docs: int = MAX_DOCS) -> DataFrame:
    """Keys of lines over the limits, one row each."""
    return (
        _lines(docs, families=True)
        .groupBy("key", "family")
        .agg(F.count("*").alias("docs"))
        .groupBy("key")
        .agg(F.sum("docs").alias("docs"), F.count("*").alias("families"))
        .where((F.col("docs") > max_docs) & (FAMILY_SHARE * F.col("families") >= F.col("docs")))
        .select("key")
    )


def depletion(docs: DataFrame, max_docs: int = MAX_DOCS, keys: bool = False) -> DataFrame:
    """doc_id, text_hash, removed: share of the words on furniture lines, where there are any; with ``keys`` also gone, their keys."""
    marked = join_checked(
        _lines(docs), settle(furniture(docs, max_docs).withColumn("marked", F.lit(True))), ["key"], "left", even=True
    )
    return (
        marked.groupBy("doc_id", "text_hash")
        .agg(
            F.sum(F.when(F.col("marked"), F.col("words")).otherwise(0)).alias("lost"),
            F.sum("words").alias("all"),
            *([F.collect_set(F.when(F.col("marked"), F.col("key"))).alias("gone")] if keys else []),
        )
        .where("lost > 0")
        .select("doc_id", "text_hash", (F.col("lost") / F.col("all")).alias("removed"), *(["gone"] if keys else []))
    )


def base_statistics() -> Column:
    """Struct of n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of ``text``."""
    text = _text()
    filled = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    by_words = let(
        word_array(F.col("text").cast("string")),
        lambda w: F.struct(F.size(w).cast("long").alias("n"), repeated_words(w).cast("long").alias("repeat")),
    )
    return F.struct(
        by_words.alias("words"),
        F.length(F.translate(text, SPACE, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(filled, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    )


def judge(docs: DataFrame, max_docs: int = MAX_DOCS, min_share: float = MIN_SHARE) -> DataFrame:
    """doc_id, text_hash, the statistics, base_failed, removed and kept of every document."""
    own = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64(_text()).alias("text_hash"),
        base_statistics().alias("s"),
    ).select(
        "doc_id", "text_hash", F.col("s.words.n").alias("n_words"), "s.word_chars", "s.n_symbols", "s.n_dup_lines",
        F.col("s.words.repeat").alias("n_repeat_words"),
    ).withColumn(
        "base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    )
    lost = depletion(docs, max_docs).withColumnsRenamed({"doc_id": "_id", "text_hash": "_hash"})
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash"))
    return (
        own.join(lost, same, "left")
        .withColumn("removed", F.coalesce("removed", F.lit(0.0)))
        .withColumn("kept", ~F.col("base_failed") & (1 - F.col("removed") >= min_share))
        .drop("_id", "_hash")
    )


def kept_rows(docs: DataFrame, max_docs: int = MAX_DOCS, min_share: float = MIN_SHARE) -> DataFrame:
    """Rows of ``docs`` that are kept, with all their columns; ``text`` is without the furniture lines.

    The base rule is judged in the row; only ids and keys of furniture lines are joined.
    """
    lost = depletion(docs, max_docs, keys=True).withColumnsRenamed({"doc_id": "_id", "text_hash": "_hash"})
    side = settle(lost)
    marked = docs.select(
        F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64(_text()).alias("hash"),
        base_statistics().alias("s"),
    )
    n, repeat = F.col("s.words.n"), F.col("s.words.repeat")
    sound = marked.where((n >= MIN_WORDS) & (100 * repeat <= 50 * n)).select("row", "id", "hash")
    same = F.col("id").eqNullSafe(F.col("_id")) & (F.col("hash") == F.col("_hash"))
    left = sound.join(F.broadcast(side.df) if side.small else side.df, same, "left").where(
        1 - F.coalesce("removed", F.lit(0.0)) >= min_share
    )
    host, text = F.col("row.source").cast("string"), F.col("row.text").cast("string")
    rest = F.filter(F.split(text, "\n"), lambda x: ~F.array_contains("gone", _key(host, normal_line(x))))
    cleaned = F.when(F.col("gone").isNull(), text).otherwise(F.array_join(rest, "\n"))
    return left.select(F.col("row").withField("text", cleaned).alias("row")).select("row.*")
