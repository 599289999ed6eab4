"""Fill-in-middle transformation by a counted-quantifier pattern.

A text is cut into units: a word with the white space before it, or white space at the end.
``regexp_count`` gives their number n; two draws from the hash of seed and doc_id give the
cuts a <= b.  A pattern made for the row, ``((?:unit){a}+)((?:unit){b-a}+)(.*)``, captures
prefix, middle and suffix in one match, and the replacement puts them behind their marks in
the order of the form.  Possessive quantifiers walk the text once: nothing is tried again,
and a text of any length needs no stack.

Everything is a column expression of one narrow pass.

Null texts count as empty, and empty texts stay plain.  Texts with a mark of their own stay
plain, so an output can always be taken apart again.  A null doc_id draws like an empty one;
repeated rows give equal outputs.  Other columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKS = (PREFIX, SUFFIX, MIDDLE)
_SPACE, _SOLID = "[\\x20\\x09-\\x0D]", "[^\\x20\\x09-\\x0D]"
UNIT = f"{_SPACE}*+{_SOLID}++|{_SPACE}++"
SEED = 42
PERCENT = 50  # of the texts are transformed
SPM_PERCENT = 80  # of those have the suffix first


def draws(doc_id: Column, seed: int, many: int) -> list[Column]:
    """Unsigned 32-bit integers from the leading digits of a hash of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(many)]


def cut_pattern(a: Column, b: Column) -> Column:
    """Pattern of one row: a units, b - a units, the rest."""
    times = lambda n: F.concat(F.lit(f"((?:{UNIT}){{"), n.cast("string"), F.lit("}+)"))
    return F.concat(F.lit("\\A"), times(a), times(b - a), F.lit("((?s:.*+))"))


def _psm(p: str, m: str, s: str) -> str:
    return f"{PREFIX}{p}{SUFFIX}{s}{MIDDLE}{m}"


def _spm(p: str, m: str, s: str) -> str:
    return f"{SUFFIX}{s}{PREFIX}{p}{MIDDLE}{m}"


def restore(output: Column, form: Column) -> Column:
    """The text an output was made from.

    The first mark of each kind is the one that was put in: no text with a mark is cut, and
    a mark cannot begin in one part and end in the next.
    """
    group = "((?s:.*?))"
    back = lambda order, to: F.regexp_replace(output, F.lit(f"\\A{order}\\z"), F.lit(to))
    return (
        F.when(form == "psm", back(_psm(group, group, group), "$1$3$2"))
        .when(form == "spm", back(_spm(group, group, group), "$2$3$1"))
        .otherwise(output)
    )


def transform(
    docs: DataFrame, seed: int = SEED, percent: int = PERCENT, spm_percent: int = SPM_PERCENT
) -> DataFrame:
    """doc_id, n, form (plain, psm, spm), prefix_chars, middle_chars, output of every text.

    The lengths count code points and are null for plain texts.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    h = draws(F.col("doc_id"), seed, 4)
    base = docs.select(
        F.col("doc_id"),
        text.alias("text"),
        F.regexp_count(text, F.lit(UNIT)).cast("long").alias("n"),
        F.array(*h).alias("h"),
    )
    marked = F.lit(False)
    for m in MARKS:
        marked = marked | F.contains("text", F.lit(m))
    form = (
        F.when((F.col("text") == "") | marked | (F.pmod(F.col("h")[2], F.lit(100)) >= percent), "plain")
        .when(F.pmod(F.col("h")[3], F.lit(100)) < spm_percent, "spm")
        .otherwise("psm")
    )
    cut = [F.pmod(F.col("h")[i], F.col("n") + 1) for i in range(2)]
    formed = base.select(
        "doc_id", "text", "n", form.alias("form"), F.least(*cut).alias("a"), F.greatest(*cut).alias("b")
    )
    order = F.when(F.col("form") == "spm", _spm("$1", "$2", "$3")).otherwise(_psm("$1", "$2", "$3"))
    moved = F.regexp_replace("text", cut_pattern(F.col("a"), F.col("b")), order)
    output = F.when(F.col("form") == "plain", F.col("text")).otherwise(moved)
    made = formed.select("doc_id", "n", "form", output.alias("output"))
    at = lambda mark: F.locate(mark, F.col("output")).cast("long")
    prefix = F.when(F.col("form") == "spm", at(MIDDLE) - at(PREFIX) - len(PREFIX)).otherwise(
        at(SUFFIX) - at(PREFIX) - len(PREFIX)
    )
    middle = F.char_length("output").cast("long") - at(MIDDLE) - len(MIDDLE) + 1
    cut_up = F.col("form") != "plain"
    return made.select(
        "doc_id",
        "n",
        "form",
        F.when(cut_up, prefix).alias("prefix_chars"),
        F.when(cut_up, middle).alias("middle_chars"),
        "output",
    )


def digests(made: DataFrame) -> DataFrame:
    """``made`` with hashes of the outputs and of the texts taken back out of them."""
    return made.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )
