"""Secret scan with a random forest that removes false positives (operator 4), in DataFrame and Spark ML functions only.

1. *Candidates.* Words (between white space) that look like a credential: a provider's fixed form, a run
   of ``MIN_CHARS`` or more characters that mixes digits and letters, or a value assigned to a name such as ``token``.
2. *Features* of each candidate's value and place: its length, the changes between character
   classes along it, shares of digits, capitals and other characters, the variety of its characters, how much of its letters
   common words of the corpus cover (*dictionary*), the names in the row's path, and what the words beside it say.
3. *Labelled findings* train a random forest of fixed size. Findings may be given; else rules label the clear ones:
   fixed forms and long mixed values assigned to a secret's name are secrets; addresses,
   numbers, hashes named as such and placeholders are not.
4. The forest scores every candidate; ``secret`` marks those of ``THRESHOLD`` or more.

At most about ``SAMPLE`` findings train (a hash picks them); the dictionary holds the ``WORDS`` most frequent
words (``LEAST_COUNT`` times or more), counted over the whole corpus. With findings of one class only, or none, the rules alone decide and the
rest scores 0.5. Null and empty texts have no candidates. Repeated rows give the same findings once per row;
ties in the dictionary go by the word. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

MIN_CHARS = 16
SAMPLE = 20_000
WORDS = 20_000
LEAST_COUNT = 10       # occurrences that make a dictionary word
TREES, DEPTH = 24, 7
THRESHOLD = 0.5

#: fixed values: forms of well-known credentials
FORMS = (r"AKIA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36}|github_pat_\w{40,}|glpat-[\w-]{20}|xox[abprs]-[\w-]{10,}"
         r"|sk_live_\w{16,}|sk-[A-Za-z0-9_-]{32,}|AIza[\w-]{35}|eyJ[\w-]{10,}\.[\w-]{10,}\.[\w-]*|npm_\w{36}|SG\.[\w-]{20,}\.[\w-]{20,}")
#: fixed values: names that secrets and other long values are assigned to, and marks of made-up ones
NAMES = r"(?i)(?:api|access|auth|client|private|secret|signing)?[_-]?(?:key|token|secret|passw(?:or)?d|pwd|passphrase|credential|bearer)s?"
OTHER = r"(?i)(?:commit|sha\d*|md5|hash|digest|checksum|revision|etag|uuid|guid|isbn|doi|order|phone|tel|id)"
MADE_UP = r"(?i)example|sample|dummy|placeholder|changeme|your[_-]|xxxx|test|fake|redacted|\*\*\*|<.*>|\$\{"
TEST_PATH = r"(?i)(?:^|[/_.-])(?:tests?|examples?|samples?|fixtures?|mocks?|docs?)(?:[/_.-]|$)"
ADDRESS = r"^[^@\s]+@[^@\s]+\.\w+$|^(?i:https?|ftp|www)\b.*|^\d{1,3}(?:\.\d{1,3}){3}(?::\d+)?$"

FEATURES = ("chars", "changes", "digits", "capitals", "others", "variety", "covered", "hex_only", "form", "named",
            "other_name", "quoted", "assigned", "made_up", "address", "test_path", "path_depth", "prose_before", "prose_after")


def _share(col: Column, chars: str) -> Column:
    """Share of a string's characters that a character class leaves."""
    return F.length(F.regexp_replace(col, f"[^{chars}]", "")) / F.greatest(F.length(col), F.lit(1))


def candidates(docs: DataFrame, id_col: str, text_col: str, path_col: str | None) -> DataFrame:
    """(doc_id, place, word, value, name, before, after, path): the words worth a look, by word place."""
    words = F.array_remove(F.split(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "[ \\t\\n\\x0B\\f\\r]+"), "")
    path = F.col(path_col).cast("string") if path_col else F.lit(None).cast("string")
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(path, F.lit("")).alias("path"),
                       words.alias("words"))
    mixed = rf"^(?=[^0-9]*[0-9])(?=[^A-Za-z]*[A-Za-z]).{{{MIN_CHARS},}}$"
    assigned = r"[=:]\s*[\"']?\S{8,}$"

    def looks(i: Column) -> Column:
        w = F.get(F.col("words"), i)
        sign = F.get(F.col("words"), i - 1)
        after_name = (sign.rlike(r"[=:]$") & F.get(F.col("words"), i - 2).rlike(NAMES)) | sign.rlike(NAMES + r"[\"']?[=:]+$")
        return (F.length(w) >= 8) & ((F.length(w) >= MIN_CHARS) & w.rlike(mixed) | w.rlike(FORMS)
                                     | w.rlike(NAMES + r"[\"']?" + assigned) | F.coalesce(after_name, F.lit(False)))

    places = F.filter(F.sequence(F.lit(0), F.size("words") - 1), looks)
    # no plain explode: its inferred filter on the array would look at all words twice
    found = (rows.select("*", F.explode_outer(F.when(F.size("words") > 0, places)).alias("place"))
             .where("place IS NOT NULL").select("doc_id", "path", F.col("place").cast("bigint").alias("place"), F.get("words", F.col("place")).alias("word"),
                     F.concat_ws(" ", F.get("words", F.col("place") - 3), F.get("words", F.col("place") - 2),
                                 F.get("words", F.col("place") - 1)).alias("before"),
                     F.concat_ws(" ", F.get("words", F.col("place") + 1), F.get("words", F.col("place") + 2)).alias("after")))
    inside = F.regexp_extract("word", r"^[\"'(\[{]*([A-Za-z_.-]{2,40})[\"']?[=:]+[\"']?(.*)$", 1)
    value = F.when(inside != "", F.regexp_extract("word", r"^[\"'(\[{]*[A-Za-z_.-]{2,40}[\"']?[=:]+[\"']?(.*)$", 1)).otherwise(F.col("word"))
    return (found.withColumn("name", F.when(inside != "", inside).otherwise(
                F.regexp_extract("before", r"([A-Za-z_.-]+)[\"']?\s*[=:]+$", 1)))
            .withColumn("value", F.regexp_replace(value, r"^[\"'(\[{<]+|[\"')\]}>.,;:!?]+$", "")))


def dictionary(docs: DataFrame, text_col: str, size: int = WORDS) -> DataFrame:
    """(run): the most frequent words of three letters or more, counted over all texts."""
    words = F.explode(F.split(F.lower(F.col(text_col).cast("string")), r"[^a-z]+")).alias("run")
    return docs.select(words).where(F.length("run") >= 3).groupBy("run").agg(F.count("*").alias("n")).where(
        F.col("n") >= LEAST_COUNT).orderBy(F.col("n").desc(), "run").limit(size).select("run")


def with_features(found: DataFrame, words: DataFrame) -> DataFrame:
    """Candidates with their ``FEATURES`` as doubles."""
    keyed = found.withColumn("_cand", F.xxhash64("value"))
    # letters of each different value that dictionary words cover
    runs = (keyed.select("_cand", "value").dropDuplicates(["_cand"])
            .select("_cand", F.explode(F.split(F.lower("value"), r"[^a-z]+")).alias("run")).where(F.length("run") >= 3))
    # `words` has a fixed number of rows, so the broadcast is bounded
    covered = (runs.join(F.broadcast(words.withColumn("_known", F.lit(1))), "run", "left").groupBy("_cand")
               .agg(F.sum(F.when(F.col("_known") == 1, F.length("run")).otherwise(0)).alias("_covered")))
    letters = F.length(F.regexp_replace("value", "[^A-Za-z]", ""))
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(
        "value", "[^A-Za-z0-9]", "-"), "[a-z]", "a"), "[A-Z]", "B"), "[0-9]", "0")
    flags = {
        "chars": F.least(F.length("value"), F.lit(400)),
        "changes": (F.regexp_count(classes, F.lit(r"(.)(?!\1)")) - 1) / F.greatest(F.length("value"), F.lit(1)),
        "digits": _share(F.col("value"), "0-9"), "capitals": _share(F.col("value"), "A-Z"),
        "others": 1 - _share(F.col("value"), "A-Za-z0-9"),
        "variety": F.size(F.array_distinct(F.split("value", ""))) / F.greatest(F.length("value"), F.lit(1)),
        "covered": F.coalesce(F.col("_covered"), F.lit(0)) / F.greatest(letters, F.lit(1)),
        "hex_only": F.col("value").rlike(r"^(?:[0-9a-f]+|[0-9A-F]+)$"), "form": F.col("value").rlike(f"^(?:{FORMS})$"),
        "named": F.col("name").rlike(NAMES), "other_name": F.concat_ws(" ", "before", "name").rlike(r"\b" + OTHER + r"\b"),
        "quoted": F.col("word").rlike("[\"']"), "assigned": (F.col("name") != "") | F.col("before").rlike("[=:]$"),
        "made_up": F.concat_ws(" ", "before", "value").rlike(MADE_UP), "address": F.col("value").rlike(ADDRESS),
        "test_path": F.col("path").rlike(TEST_PATH), "path_depth": F.least(F.size(F.split("path", "/")), F.lit(20)),
        "prose_before": _share(F.col("before"), "a-z"), "prose_after": _share(F.col("after"), "a-z"),
    }
    return keyed.join(covered, "_cand", "left").select(
        "doc_id", "place", "value", "name", "before", "after", "path",
        *[F.coalesce(flags[f].cast("double"), F.lit(0.0)).alias(f) for f in FEATURES])


def rule_label() -> Column:
    """1 for a clear secret, 0 for a clear false positive, else null."""
    strong = (F.col("form") == 1) | (F.col("named") == 1) & (F.col("chars") >= MIN_CHARS) & (F.col("digits") > 0)
    weak = ((F.col("address") == 1) | (F.col("made_up") == 1) | (F.col("covered") >= 0.8)
            | (F.col("other_name") == 1) & (F.col("named") == 0) | (F.col("assigned") == 0) & (F.col("others") > 0.2))
    return F.when(weak, 0).when(strong, 1)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source",
         findings: DataFrame | None = None, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, place, value, name, score, secret): every candidate with the forest's probability.

    ``findings``: optional labelled findings, like candidates (value, name, before, after, path, word)
    with ``label`` 0 or 1; else clear candidates are labelled by ``rule_label``."""
    words = written(dictionary(docs, text_col), "dictionary")
    found = written(with_features(candidates(docs, id_col, text_col, path_col), words), "secret-candidates")
    if findings is None:
        labelled = found.withColumn("label", rule_label().cast("double")).where("label IS NOT NULL")
    else:
        given = findings.withColumn("doc_id", F.lit(0).cast("bigint")).withColumn("place", F.lit(0).cast("bigint"))
        labels = given.select(F.xxhash64("value", "before").alias("_k"), F.col("label").cast("double").alias("label")).dropDuplicates(["_k"])
        labelled = with_features(given, words).withColumn("_k", F.xxhash64("value", "before")).join(labels, "_k").drop("_k")
    # equal findings count once; each class is thinned to half of the sample
    different = labelled.select("label", *FEATURES, F.xxhash64("value", "before").alias("_k")).dropDuplicates(["_k"])
    different = written(different, "labelled-findings")
    sizes = {r.label: r.n for r in different.groupBy("label").agg(F.count("*").alias("n")).collect()}
    result = ["doc_id", "place", "value", "name"]
    if not (sizes.get(0.0) and sizes.get(1.0)):
        scored = found.select(*result, F.coalesce(rule_label().cast("double"), F.lit(0.5)).alias("score"))
    else:
        keep = F.when(F.col("label") == 1, F.lit(min(1.0, sample / 2 / sizes[1.0]))).otherwise(F.lit(min(1.0, sample / 2 / sizes[0.0])))
        picked = different.where(F.pmod("_k", F.lit(1_000_000)) < keep * 1_000_000).withColumn(
            "weight", F.when(F.col("label") == 1, 1 / sizes[1.0]).otherwise(1 / sizes[0.0]) * 1000)
        vector = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
        forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=7, weightCol="weight", labelCol="label")
        model = forest.fit(vector.transform(picked))
        scored = model.transform(vector.transform(found)).select(
            *result, F.element_at(vector_to_array("probability"), 2).alias("score"))
    return scored.withColumn("secret", F.col("score") >= threshold)
