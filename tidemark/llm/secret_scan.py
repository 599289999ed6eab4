"""Secret scan: candidates by rule, false positives removed by a random forest.

Native expressions only.  Words (between ASCII white space) are cut at ``,;&?|{}`` into parts,
and every known token format and every run of 16 or more ``[A-Za-z0-9+/_-]`` with a digit in
a part is a candidate, together with its part and the neighbouring words; ``=`` and ``:`` end
a run, so a name and its value are two.  Features: length and make-up, transitions between character
classes, share covered by dictionary pieces, path marks, and the neighbouring words.  The
forest is fitted by Spark ML on a bounded sample of labelled findings (``MAX_LABELLED``,
chosen by hash) and turned into column expressions, so that scoring and redaction happen
in the row: texts are never shuffled.

Where no labels are given, weak ones are derived from all documents: findings in a known
format, or assigned in quotes or in the same part to a name that says so, are secrets;
identifiers in prose are not.

Null and empty texts have no candidates.  Texts are scanned whole.  Repeated rows are
scanned alike.  Without labelled findings of both kinds every finding's score is the share
of secrets among the labelled ones (1 if there are none).  An empty table gives an empty
result.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ascii_lower, let, word_array

MAX_LABELLED = 20_000  # bound of the forest's sample
TREES = 25
DEPTH = 6

# Formats of well-known tokens.
FORMATS = (
    "AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[0-9A-Za-z_-]{35}"
    "|eyJ[A-Za-z0-9_-]{8,}[.]eyJ[A-Za-z0-9_-]{8,}[.][A-Za-z0-9_-]+|sk_live_[0-9a-zA-Z]{16,}"
)
RUN = "[A-Za-z0-9+/_-]{16,}(?:={1,2}(?![A-Za-z0-9+/_=\"'-]))?"
CUTS = "[,;&?|{}]+"
# Names that secrets are assigned to, and words of examples.
NAMES = "token|secret|passw|pwd|apikey|api_key|api-key|auth|credential|private|access_key|bearer"
EXAMPLES = "example|sample|dummy|test|fake|placeholder|changeme|xxxx"
# Dictionary pieces that prose and identifiers are made of.
PIECES = (
    "tion|ment|ing|and|the|for|with|that|from|have|this|able|ness|ever|under|over|inter|name|file|data|user|"
    "page|list|item|node|test|config|index|value|class|path|home|time|date|type|server|client|model|table|ent|"
    "est|ers|ere|her|ter|con|pro|per|and|all|out|one|two|our|est|ist|ion|ble|ies|ous"
)

FEATURES = (
    "length", "digits", "uppers", "hex", "distinct", "transitions", "dictionary", "vowels", "paths", "format",
    "named", "assigned", "quoted", "example", "sentence",
)


def candidates(text: Column) -> Column:
    """Array of (at, value, before2, before, word, after) of a text's candidate words."""
    return let(word_array(text), _candidates)


def _candidates(words: Column) -> Column:
    spots = F.filter(
        F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i"))),
        lambda x: (F.octet_length(x["w"]) >= 16)
        & (x["w"].rlike("[0-9]") & x["w"].rlike(RUN) | x["w"].rlike(FORMATS)),
    )

    def near(i: Column) -> Column:
        return F.coalesce(F.get(words, i), F.lit(""))

    def values(part: Column) -> Column:
        """The part's known formats, and the runs of what is left of it."""
        runs = F.regexp_extract_all(F.regexp_replace(part, FORMATS, " "), F.lit(RUN), F.lit(0))
        known = F.regexp_extract_all(part, F.lit(FORMATS), F.lit(0))
        return F.array_distinct(F.concat(known, F.filter(runs, lambda v: v.rlike("[0-9]"))))

    parts = F.flatten(
        F.transform(
            spots, lambda x: F.transform(F.split(x["w"], CUTS), lambda part: F.struct(x["i"].alias("i"), part.alias("part")))
        )
    )
    return F.flatten(
        F.transform(
            parts,
            lambda x: F.transform(
                values(x["part"]),
                lambda v: F.struct(
                    x["i"].cast("long").alias("at"),
                    v.alias("value"),
                    near(x["i"] - 2).alias("before2"),
                    near(x["i"] - 1).alias("before"),
                    x["part"].alias("word"),
                    near(x["i"] + 1).alias("after"),
                ),
            ),
        )
    )


def _count(v: Column, pattern: str) -> Column:
    return F.size(F.regexp_extract_all(v, F.lit(pattern), F.lit(0))).cast("double")


def _flag(c: Column) -> Column:
    return F.when(c, 1.0).otherwise(0.0)


def features(c: Column) -> Column:
    """Array of doubles in the order of ``FEATURES``; every one is 0 for a null."""
    v, n = c["value"], F.greatest(F.length(c["value"]).cast("double"), F.lit(1.0))
    low = ascii_lower(v)
    lead = ascii_lower(F.concat_ws(" ", c["before2"], c["before"], c["word"]))
    covered = n - F.length(F.regexp_replace(low, PIECES, ""))
    return F.array(
        n,
        _count(v, "[0-9]") / n,
        _count(v, "[A-Z]") / n,
        _flag(v.rlike("^[0-9a-fA-F]+$") & v.rlike("[a-fA-F]")),
        F.size(F.array_distinct(F.split(v, ""))).cast("double"),
        _count(v, "(?<=[A-Za-z])[0-9]|(?<=[0-9])[A-Za-z]|(?<=[a-z])[A-Z]") / n,
        covered / n,
        _count(low, "[aeiou]") / n,
        _count(c["word"], "[/.@:]"),
        _flag(v.rlike(FORMATS)),
        _flag(lead.rlike(NAMES)),
        _flag(c["before"].rlike("[=:]$") | c["word"].rlike("[=:][\"']?[A-Za-z0-9]")),
        _flag(c["word"].rlike("[\"'`]")),
        _flag(F.concat_ws(" ", lead, ascii_lower(c["after"])).rlike(EXAMPLES)),
        _flag(c["before"].rlike("^[a-zà-ÿ]+$") & c["after"].rlike("^[a-zà-ÿ]+[.,]?$")),
    )


def weak_label(c: Column) -> Column:
    """1.0 for a finding confirmed by its assignment or format, 0.0 for one in plain prose."""
    name = ascii_lower(F.concat_ws(" ", c["before2"], c["before"], c["word"]))
    assigned = (c["before"].rlike("[=:]$") | c["word"].rlike("[=:][\"']")) & c["word"].rlike("[\"']")
    head = ascii_lower(F.split_part(c["word"], c["value"], F.lit(1)))
    own = head.rlike(f"(?:{NAMES})[a-z0-9_.-]*[\"']?[=:][\"']?$") & ~c["value"].startswith("//")
    return F.when(c["value"].rlike(FORMATS) | own | (name.rlike(NAMES) & assigned), 1.0).when(~assigned, 0.0)


def labelled_findings(docs: DataFrame) -> DataFrame:
    """Candidates of all documents that carry a weak label: finding struct and label."""
    found = docs.select(F.explode(candidates(F.col("text").cast("string"))).alias("finding"))
    return found.withColumn("label", weak_label(F.col("finding"))).where("label is not null")


def _tree(node: object, f: Column) -> Column:
    """Column expression of one fitted tree: its vote for a secret."""
    if node.subtreeDepth() == 0:
        return F.lit(float(node.prediction()))
    split = node.split()
    return F.when(
        F.get(f, F.lit(split.featureIndex())) <= F.lit(float(split.threshold())), _tree(node.leftChild(), f)
    ).otherwise(_tree(node.rightChild(), f))


class Forest:
    """Fitted forest as a column expression: the share of trees that vote for a secret."""

    def __init__(self, labelled: DataFrame, limit: int = MAX_LABELLED, trees: int = TREES, depth: int = DEPTH) -> None:
        order = F.xxhash64("finding")
        sample = labelled.select("finding", "label").orderBy(order, "finding").limit(limit).coalesce(1)
        rows = sample.select(features(F.col("finding")).alias("f"), "label")
        rows = rows.select(array_to_vector("f").alias("features"), "label").persist()
        shares = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
        self.fallback = 1.0 if not shares else shares.get(1.0, 0) / sum(shares.values())
        self.nodes = []
        if len(shares) == 2:
            model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=11, subsamplingRate=0.8).fit(rows)
            self.nodes = [t._java_obj.rootNode() for t in model.trees]
        rows.unpersist()

    def score(self, f: Column) -> Column:
        if not self.nodes:
            return F.lit(self.fallback)
        votes = [_tree(n, f) for n in self.nodes]
        total = votes[0]
        for v in votes[1:]:
            total = total + v
        return total / float(len(votes))


def findings(text: Column, forest: Forest) -> Column:
    """Array of a text's findings (at, value, score, secret)."""
    described = F.transform(candidates(text), lambda c: F.struct(c.alias("c"), features(c).alias("f")))
    scored = F.transform(described, lambda d: F.struct(d["c"].alias("c"), forest.score(d["f"]).alias("s")))
    return F.transform(
        scored,
        lambda d: F.struct(
            d["c"]["at"].alias("at"), d["c"]["value"].alias("value"), d["s"].alias("score"), (d["s"] >= 0.5).alias("secret")
        ),
    )


def scan(docs: DataFrame, labelled: DataFrame | None = None, limit: int = MAX_LABELLED) -> DataFrame:
    """doc_id, at (word position), value, score and secret of every candidate of every text."""
    forest = Forest(labelled_findings(docs) if labelled is None else labelled, limit)
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.explode(findings(F.col("text").cast("string"), forest)).alias("x"),
    ).select("doc_id", "x.at", "x.value", "x.score", "x.secret")


def redact(docs: DataFrame, labelled: DataFrame | None = None, mark: str = "[secret]") -> DataFrame:
    """All rows and columns of ``docs`` with the secrets in ``text`` replaced by ``mark``."""
    forest = Forest(labelled_findings(docs) if labelled is None else labelled)
    text = F.col("text").cast("string")
    secrets = F.filter(findings(text, forest), lambda x: x["secret"])
    # Longest first: a value that lies in another must not break that one up.
    longest = F.sort_array(F.transform(secrets, lambda x: F.struct(F.length(x["value"]).alias("n"), x["value"].alias("value"))), asc=False)
    clean = F.aggregate(longest, text, lambda t, x: F.replace(t, x["value"], F.lit(mark)))
    return docs.withColumn("text", clean)
