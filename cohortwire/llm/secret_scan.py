"""Secret scan: pattern candidates, and a random forest that removes false positives.

Everything is DataFrame and SQL functions and MLlib.  Texts are split at the candidates' pattern once; a candidate's
neighbours are the ends of the pieces beside it.  The forest sees length, character transitions, coverage by a
dictionary of the corpus's own words, path and neighbouring words, and is trained from labelled findings.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, written

#: Words that stand beside secrets, in false findings, and in paths of test data.
KEY_WORDS = "key token secret password passwd pwd auth credential bearer api private access"
FALSE_WORDS = "example sample dummy fake test placeholder changeme xxxx sha1 sha256 md5 checksum commit uuid digest order invoice card phone"
TEST_PATHS = "test spec example sample mock fixture doc"
#: What stands before a value that is given to a key, and before a password in an address.
ASSIGNED = r"(?i:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|auth|bearer)[\"']?(?:\s{0,3}[=:]\s{0,3}|\s)[\"']?"
IN_ADDRESS = r"://[^\s/:@]++:"
#: The forms of candidates, each of which may have one of the above before it: a value given to a key, a password in an
#: address, keys of providers, signed tokens, private keys, and runs of 16 or more key characters with a digit.  None has
#: a largest length; what repeats is possessive, so a text is gone through once.
FORMS = [
    ASSIGNED + r"(?=[^\s\"',;]*[^\sa-z\"',;])[^\s\"',;]{6,}",
    IN_ADDRESS + r"[^\s/@]{3,}+(?=@)",
    r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{12,}|gh[pousr]_[A-Za-z0-9]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk-[A-Za-z0-9]{16,})",
    r"(?<![A-Za-z0-9])eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]*",
    r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----[A-Za-z0-9+/=\s]*+",
    r"(?<![A-Za-z0-9_+/=-])(?=[A-Za-z_+/=-]*+[0-9])[A-Za-z0-9_+/=-]{16,}",
]
CANDIDATE = "|".join(FORMS)
CONTEXT_CHARS = 48
#: Labelled rows that the forest reads at most, about.
TRAINING_ROWS = 20_000
#: A word of the dictionary stands at least so often in the corpus, as a word of letters of its own.
DICTIONARY_COUNT = 5
FEATURES = [
    "n_chars", "upper_lower", "letter_digit", "other_chars", "digit_share", "upper_share", "different_share", "repeated_share",
    "dictionary_share", "hex_only", "separators", "test_path", "key_word", "false_word", "assigned", "quoted",
]


def _any(words: str) -> str:
    return "(?i)(" + "|".join(words.split()) + ")"


def candidates(docs: DataFrame, path: str = "source") -> DataFrame:
    """doc_id, start (code points), candidate, before, after, path: a row per candidate, all occurrences."""
    text = F.coalesce(F.col("text"), F.lit(""))
    where = F.col(path).cast("string") if path in docs.columns else F.lit("")
    found = docs.select("doc_id", F.coalesce(where, F.lit("")).alias("path"), text.alias("text"))
    found = found.select("doc_id", "path", "text", F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)).alias("c")).filter(F.size("c") > 0)
    # A match and the piece before it, one after the other, cover the text: their lengths summed give the places.
    pieces = F.transform(F.split("text", CANDIDATE, -1), lambda p: F.struct(F.left(p, F.lit(CONTEXT_CHARS)).alias("head"), F.right(p, F.lit(CONTEXT_CHARS)).alias("tail"), F.length(p).alias("n")))
    found = found.select("doc_id", "path", "c", pieces.alias("p"), F.monotonically_increasing_id().alias("row"))
    piece = F.transform("c", lambda c, i: F.struct(c.alias("whole"), F.col("p")[i]["tail"].alias("tail"), F.col("p")[i]["n"].alias("n"), F.col("p")[i + 1]["head"].alias("after")))
    each = found.select("doc_id", "path", "row", F.posexplode(piece).alias("i", "m")).select("doc_id", "path", "row", "i", "m.*")
    before = Window.partitionBy("row").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    each = each.withColumn("end", F.sum(F.col("n") + F.length("whole")).over(before))
    each = each.withColumn("candidate", F.regexp_replace("whole", f"^(?:{ASSIGNED}|{IN_ADDRESS})(?=.)", ""))
    return each.select(
        "doc_id", (F.col("end") - F.length("candidate")).cast("long").alias("start"), "candidate",
        F.right(F.concat("tail", F.left("whole", F.length("whole") - F.length("candidate"))), F.lit(CONTEXT_CHARS)).alias("before"), "after", "path",
    )


def dictionary(docs: DataFrame, least: int = DICTIONARY_COUNT) -> DataFrame:
    """word: the words of three to twenty letters that stand alone at least `least` times in docs, lower-cased.

    Letters within a run of other key characters, such as those of a random key, are no words.
    """
    words = docs.select(F.explode(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}0-9_+/=-]+")).alias("word"))
    words = words.filter(F.length("word").between(3, 20) & F.col("word").rlike(r"^\p{L}+$"))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).select("word")


def with_features(found: DataFrame, words: DataFrame) -> DataFrame:
    """candidates() with the forest's features, all doubles without nulls.  words: dictionary()."""
    keyed = found.withColumn("candidate_key", F.sha2(F.col("candidate").cast("binary"), 256))
    # Different candidates' runs of letters meet the dictionary, however often a candidate occurs.
    runs = keyed.select("candidate_key", "candidate").distinct().select("candidate_key", F.explode(F.regexp_extract_all(F.lower("candidate"), F.lit(r"\p{L}{3,20}"), F.lit(0))).alias("word"))
    covered = runs.join(words, "word").groupBy("candidate_key").agg(F.sum(F.length("word")).alias("covered"))
    keyed = keyed.join(covered, "candidate_key", "left")
    n = F.length("candidate")
    share = lambda pattern: F.regexp_count("candidate", F.lit(pattern)) / n
    near = F.concat_ws(" ", "before", "after")
    flag = lambda column, pattern: column.rlike(pattern).cast("double")
    columns = {
        "n_chars": n.cast("double"),
        "upper_lower": share("[A-Z](?=[a-z])|[a-z](?=[A-Z])"),
        "letter_digit": share("[A-Za-z](?=[0-9])|[0-9](?=[A-Za-z])"),
        "other_chars": share("[^A-Za-z0-9]"),
        "digit_share": share("[0-9]"),
        "upper_share": share("[A-Z]"),
        "different_share": F.size(F.array_distinct(F.split("candidate", ""))) / n,
        "repeated_share": share(r"(.)(?=\1)"),
        "dictionary_share": F.coalesce("covered", F.lit(0)) / n,
        "hex_only": flag(F.col("candidate"), "^[0-9a-fA-F]+$"),
        "separators": share("[_/-]"),
        "test_path": flag(F.col("path"), _any(TEST_PATHS)),
        "key_word": flag(F.col("before"), _any(KEY_WORDS)),
        "false_word": flag(F.concat_ws(" ", near, F.col("candidate")), _any(FALSE_WORDS)),
        "assigned": flag(F.col("before"), r"[=:]\s*[\"']?$"),
        "quoted": flag(F.col("before"), r"[\"']$"),
    }
    return keyed.withColumns({k: F.coalesce(v, F.lit(0.0)).cast("double") for k, v in columns.items()}).drop("candidate_key", "covered")


#: Kinds of planted findings: (label, what stands before, value), SQL over h (64 hex digits, different for each row), d
#: (16 digits), w1 and w2 (words of the text).  Labels come from the planting, not from the forest's features.
KINDS = {
    "hex_token": (1, "token = \"", "substring(h, 1, 40)"),
    "hex_key": (1, "api_key: ", "substring(h, 1, 32)"),
    "base64_secret": (1, "secret=", "base64(unhex(h))"),
    "provider": (1, "", "concat('AKIA', upper(translate(substring(h, 1, 16), '01', 'XY')))"),
    "personal_token": (1, "use ", "concat('ghp_', substring(translate(base64(unhex(h)), '+/=', 'aZ9'), 1, 36))"),
    "password": (1, "password = ", "concat(w1, '!', substring(d, 1, 4), upper(substring(h, 1, 3)))"),
    "address": (1, "see https://user:", "substring(translate(base64(unhex(h)), '+/=', 'xyz'), 1, 14)"),
    "bare_base64": (1, "with ", "substring(translate(base64(unhex(h)), '+/=', 'pqr'), 1, 40)"),
    "number": (0, "", "d"),
    "long_number": (0, "order ", "concat(d, substring(d, 1, 8))"),
    "compound": (0, "", "concat(w1, '-', w2, '-', w1, '-', substring(d, 1, 2))"),
    "identifier": (0, "call ", "concat(w1, '_', w2, '_', w2, '_', substring(d, 1, 3))"),
    "checksum": (0, "sha256: ", "h"),
    "commit": (0, "commit ", "substring(h, 1, 40)"),
    "uuid": (0, "uuid ", "concat(substring(h, 1, 8), '-', substring(h, 9, 4), '-', substring(h, 13, 4), '-', substring(h, 17, 4), '-', substring(h, 21, 12))"),
    "repeated": (0, "key=", "concat(repeat(substring(w1, 1, 1), 18), '1')"),
    "placeholder": (0, "password: ", "concat('your_', w1, '_here1')"),
    "path": (0, "", "concat(w1, '/', w2, '/', w1, w2, '/', substring(d, 1, 2))"),
    "date": (0, "at ", "concat('2024-', substring(d, 1, 2), '-', substring(d, 3, 2), 'T', substring(d, 5, 2), '-00-', substring(d, 7, 2))"),
}


def planted_findings(docs: DataFrame, words: DataFrame, kinds: dict | None = None, rows: int = TRAINING_ROWS, salt: int = 0) -> DataFrame:
    """Findings with features and `label` for training: values of known kinds in the midst of docs' own words.

    About `rows` texts of docs, those of smallest hash, each get one value of a kind.  A planted value that the
    pattern doesn't find gives no row.
    """
    kinds = KINDS if kinds is None else kinds
    texts = docs.filter(F.length("text") > 40).select("doc_id", "text")
    there = texts.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    share = F.pmod(F.xxhash64("text", F.lit(salt)), F.lit(1 << 30)) / float(1 << 30)
    some = texts.filter(share * there < rows).dropDuplicates(["text"])
    some = some.select("doc_id", F.sha2(F.concat_ws("|", F.lit(str(salt)), F.col("doc_id").cast("string"), F.left("text", F.lit(200))), 256).alias("h"), F.split(F.left("text", F.lit(400)), r"\s+").alias("w"))
    word = lambda k: F.coalesce(F.nullif(F.left(F.regexp_replace(F.get("w", F.lit(k)), r"[^\p{L}]", ""), F.lit(12)), F.lit("")), F.lit("word"))
    some = some.withColumn("d", F.right(F.concat(F.lit("0" * 15), F.translate("h", "abcdef", "")), F.lit(16))).withColumn("w1", word(1)).withColumn("w2", word(2))
    names = list(kinds)
    kind = F.element_at(F.array(*[F.lit(k) for k in names]), (F.pmod(F.xxhash64("h"), F.lit(len(names))) + 1).cast("int"))
    some = some.withColumn("kind", kind)
    pick = lambda part: F.coalesce(*[F.when(F.col("kind") == k, part(*kinds[k])) for k in names])
    some = some.withColumn("lead", pick(lambda label, lead, value: F.lit(lead))).withColumn("value", pick(lambda label, lead, value: F.expr(value))).withColumn("label", pick(lambda label, lead, value: F.lit(float(label))))
    before = F.concat(F.array_join(F.slice("w", 1, 6), " "), F.lit(" "), F.col("lead"))
    after = F.concat(F.when(F.col("lead").contains("//"), "@host ").when(F.col("lead").endswith('"'), '" ').otherwise(" "), F.array_join(F.slice("w", 7, 6), " "))
    planted = some.select("h", "kind", "label", F.length(before).cast("long").alias("at"), F.col("value").alias("planted"), F.concat(before, "value", after).alias("text"))
    planted = written(planted, "planted")
    found = candidates(planted.withColumnRenamed("h", "doc_id")).withColumnRenamed("doc_id", "h").join(planted.drop("text"), "h")
    found = found.filter((F.col("start") == F.col("at")) & (F.col("candidate") == F.col("planted")))
    return with_features(written(found.drop("planted", "at"), "planted-candidates"), words)


def train(labelled: DataFrame, rows: int = TRAINING_ROWS, trees: int = 40, depth: int = 8):
    """A forest from findings with features and `label` (0, 1; null: not used), or the one label there is, or None."""
    usable = labelled.filter(F.col("label").isNotNull()).select(F.xxhash64("candidate", "before", "after").alias("hash"), F.col("label").cast("double").alias("label"), *FEATURES)
    sizes = {r["label"]: r["n"] for r in usable.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return next(iter(sizes), None)
    share = F.pmod("hash", F.lit(1 << 30)) / float(1 << 30)
    sample = usable.filter(share * sum(sizes.values()) < rows)
    if len({r["label"] for r in sample.select("label").distinct().collect()}) < 2:
        sample = usable
    assembled = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(sample.orderBy("hash"))
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=7, labelCol="label", featuresCol="features")
    return forest.fit(assembled)


def scored(found: DataFrame, model, threshold: float = 0.5) -> DataFrame:
    """found with score (probability of a secret) and is_secret; without a model, or one that has seen a single label,
    every candidate is reported."""
    if model is None or isinstance(model, float):
        return found.withColumn("score", F.lit(1.0)).withColumn("is_secret", F.lit(True))
    out = model.transform(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(found))
    score: Column = vector_to_array("probability")[1]
    return out.withColumn("score", score).withColumn("is_secret", F.col("score") >= threshold)


def scan(docs: DataFrame, labelled: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """doc_id, start, n_chars, secret_sha256, score, is_secret: a row per candidate of every whole text.

    labelled: findings with candidates()' columns and `label`; by default values of known kinds that are planted among
    docs' own words (planted_findings()).  Null or empty texts have no candidate; if there is nothing to train from,
    or labels of one kind only, every candidate is reported with score 1; repeated rows are each scanned; an empty
    table gives no rows; a missing or null source counts as an empty path; other columns are ignored.  Secrets
    themselves aren't returned.
    """
    words = written(dictionary(docs), "secret-words")
    raw = written(candidates(docs), "raw-candidates")  # features read the candidates twice, the texts once
    found = written(with_features(raw, words), "secret-candidates")
    known = written(planted_findings(docs, words) if labelled is None else with_features(labelled, words), "labelled-findings")
    out = scored(found, train(known), threshold).select(
        "doc_id", "start", F.length("candidate").cast("long").alias("n_chars"),
        F.sha2(F.col("candidate").cast("binary"), 256).alias("secret_sha256"), "score", "is_secret",
    )
    out = written(out, "secrets")
    for x in (words, raw, found, known):
        dropped(x)
    return out
