"""Secret scan with a random forest that removes false positives.

Candidates are the values assigned to a name such as ``password`` or ``token``, of
any length and any characters up to the next quote, space or name that is assigned
itself; the password of an address; and outside of those the runs of twelve or more
key characters that are no plain word (a digit, or letters of both cases mixed), and
words of eight or more characters with a digit soon after such a name. A candidate
carries what stands close to it, not its word or the words around, so a word of a
megabyte with many assignments is as many small rows. Each gets features of
its length and characters, of the transitions between kinds of characters, how much
of it words of the corpus cover, the name of the path, and the words around it. A
random forest trained on labelled findings decides. All of it is DataFrame work.

Labelled findings come from the corpus where a candidate settles its own label (a
vendor's signature, or an address, date or number), at most ``FIT_ROWS``, those of the
least hashes, together with seed findings of both kinds, so that a forest always exists.
Features hold none of the signatures.

Defined cases: a null, empty or blank text has no candidates; each occurrence is a
candidate of its own, ``at`` counts words from 0; repeated rows are found each; a
null doc_id or path is kept; an empty table gives no findings; whole texts are
scanned; other columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievebase.llm.common import least_hashes, materialize, words_of

FIT_ROWS = 20_000
TREES, DEPTH = 40, 7
DICTIONARY_WORDS = 1000
DICTIONARY_LETTERS = 4
SEEDS = 400

RUN = r"[A-Za-z0-9+/_\-]{12,}={0,2}"
NAME = r"(?i)(pass(word|wd|phrase)?|pwd|secret|token|api[_\-]?key|access[_\-]?key|auth|credential|private[_\-]?key)s?[\"']?"
ASSIGNED_IN_WORD = NAME + r"\s*(:=|=>|=|:)[\"']?$"
SIGN = r"(:=|=>|=|:)"
QUOTE = "[\"'`]"
#: The next assignment in a word, with what separates it from the one before: letters of a longer name, a sign or two.
NEXT_NAME = rf"[&;,?|]{{1,2}}[\w.\-]{{0,40}}?{NAME}{SIGN}"
#: An assigned value: up to the next quote (a backslash before it is not of the value), the next assignment or the end.
VALUE = rf"(?:(?!{NEXT_NAME})[^\"'`])+?(?=\\*[\"'`]|{NEXT_NAME}|$)"
OPENING = rf"{SIGN}\\*{QUOTE}?"
#: An assignment in a word: the name, the sign with an opening quote, the value.
ASSIGNMENT = f"({NAME})({OPENING})({VALUE})"
_OPENING_GROUP, _VALUE_GROUP = 4, 6
#: A word that follows an assignment: brackets and a quote, then the value.
NEXT_WORD = rf"^([(\[{{]*\\*{QUOTE}?)({VALUE})"
#: The password of an address.
IN_ADDRESS = r"://[^/\s:@]+:([^/\s@]+)@"
NAME_WORD = "^" + r"[\"'{(]?[\w.\-]*" + NAME + "$"
NAMED = r"(?i)([\w.\-]*(pass(word|wd|phrase)?|pwd|secret|token|api[_\-]?key|access[_\-]?key|auth|credential|private[_\-]?key)s?)$"
AHEAD = 40  # characters before a run that count as close
EXAMPLE = r"(?i)(example|sample|dummy|placeholder|changeme|fake|test|fixture|your)"
#: What is assigned to such names without being a secret: words, literals of languages, references.
PLAIN_VALUES = [
    "required", "optional", "string", "true", "false", "null", "None", "nil", "undefined", "str,", "self.password", "request.token", "the", "is", "invalid", "bearer", "basic", "this",
    "${PASSWORD}", "$TOKEN", "{{secret}}", "<password>", "os.environ[", "getenv(", "*****", "config.secret;", "int", "yes", "no", "and", "xxxx", "|", "{", "[", "...", "1", "0", "-",
]
#: Forms that settle a label by themselves.
SIGNATURES = [r"^AKIA[0-9A-Z]{16}$", r"^gh[pousr]_[A-Za-z0-9]{36,}$", r"^sk_live_[A-Za-z0-9]{20,}$", r"^xox[abpr]-[A-Za-z0-9\-]{12,}$"]
BENIGN_WORDS = [r"^\S+@\S+\.\S+$", r"^\(?\+?[0-9][0-9() ./\-]{8,}[.,;:]?$", r"^[0-9]{4}-[0-9]{2}-[0-9]{2}", r"^(https?://|www\.)", r"^[A-Za-z]+(-[A-Za-z]+)+-?[0-9]{0,2}$"]

FEATURES = (
    "length", "digit_share", "upper_share", "lower_share", "other_share", "changes", "distinct_share", "entropy", "hex_only",
    "word_share", "assigned", "named_near", "quoted", "example_near", "example_path",
)


VALUES = "array<struct<value:string,head:string,assigned:boolean>>"


def candidates(docs: DataFrame, path: str = "source") -> DataFrame:
    """doc_id, path, at, part, value, head (what stands close before the value in its word), assigned, and what is known of
    its word and the words around: benign, named_words, example_words."""
    words = words_of(F.col("text"))
    around = F.transform(
        "words",
        lambda w, i: F.struct(
            w.alias("word"), i.alias("at"), F.get("words", i - 1).alias("before"), F.get("words", i - 2).alias("before2"), F.get("words", i + 1).alias("after")
        ),
    )
    wanted = lambda s: s["word"].rlike(f"{RUN}|{ASSIGNMENT}|{IN_ADDRESS}") | _assigned_before(s["before"], s["before2"]) | _after_name(s)
    rows = docs.select("doc_id", F.col(path).alias("path"), words.alias("words")).select("doc_id", "path", F.explode(F.filter(around, wanted)).alias("w")).select("doc_id", "path", "w.*")
    values = with_surroundings(rows).withColumn("values", _values()).select("doc_id", "path", "at", *SURROUNDINGS, F.posexplode("values").alias("part", "v"))
    return values.select("doc_id", "path", "at", "part", *SURROUNDINGS, "v.*")


SURROUNDINGS = ("benign", "named_words", "example_words")


def with_surroundings(rows: DataFrame) -> DataFrame:
    """What later steps ask of a word and the words around it, as flags."""
    benign = F.lit(False)
    for form in BENIGN_WORDS:
        benign |= F.col("word").rlike(form)
    near = F.concat_ws(" ", "before2", "before", "after")
    return rows.withColumn("benign", benign).withColumn("named_words", near.rlike(NAME)).withColumn("example_words", near.rlike(EXAMPLE))


def _after_name(w: Column) -> Column:
    """A word with a digit and a letter, of eight or more characters, one or two words after a name."""
    named = F.coalesce(w["before"].rlike(NAMED), F.lit(False)) | F.coalesce(w["before2"].rlike(NAMED), F.lit(False))
    return named & (F.length(w["word"]) >= 8) & w["word"].rlike("[0-9]") & w["word"].rlike("[A-Za-z]")


def _values() -> Column:
    """The candidates of a word as (value, head, assigned): what the word before assigns, assignments in the word, passwords of
    addresses, and runs in what is left; else the word itself if it stands after a name."""
    word, none = F.col("word"), F.array().cast(VALUES)
    made = lambda value, head, assigned: F.struct(value.alias("value"), head.alias("head"), F.lit(assigned).alias("assigned"))
    first, opening = F.regexp_extract(word, NEXT_WORD, 2), F.regexp_extract(word, NEXT_WORD, 1)
    follows = _assigned_before(F.col("before"), F.col("before2")) & (F.length(first) > 0)
    after = F.when(follows, F.array(made(first, opening, True))).otherwise(none)

    def listed(text: Column, pattern: str, value: int, *head: int, assigned: bool) -> Column:
        parts = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(value)).alias("v"), *[F.regexp_extract_all(text, F.lit(pattern), F.lit(k)).alias(f"h{k}") for k in head])
        return F.transform(parts, lambda p: made(p["v"], F.concat(F.lit(""), *[p[f"h{k}"] for k in head]), assigned))

    inside = listed(word, ASSIGNMENT, _VALUE_GROUP, 1, _OPENING_GROUP, assigned=True)
    left = F.regexp_replace(word, ASSIGNMENT, " ")
    left = F.when(follows, F.regexp_replace(left, NEXT_WORD, "$1 ")).otherwise(left)
    address = listed(left, IN_ADDRESS, 1, assigned=True)
    left = F.regexp_replace(left, IN_ADDRESS, " ")
    runs = F.filter(listed(left, f"(.{{0,{AHEAD}}}?)({RUN})", 2, 1, assigned=False), lambda v: v["value"].rlike("[0-9]|[a-z][A-Z]|[A-Z]{2}[a-z]"))
    found = F.concat(after, inside, address, runs)
    whole = F.when(_after_name(F.struct("word", "before", "before2")), F.array(made(word, F.lit(""), False))).otherwise(none)
    return F.when(F.size(found) > 0, found).otherwise(whole)


def _assigned_before(before: Column, before2: Column) -> Column:
    """Whether the words before assign a value to a name."""
    near = F.coalesce(before.rlike(ASSIGNED_IN_WORD), F.lit(False))
    return near | F.coalesce(before.rlike(f"^{SIGN}$") & before2.rlike(NAME_WORD), F.lit(False))


def dictionary(docs: DataFrame) -> list[str]:
    """The most frequent words of letters, lowered, counted by documents over the whole corpus; a list of fixed length."""
    words = F.array_distinct(words_of(F.lower("text")))
    rows = docs.select(F.explode(words).alias("word")).filter(F.col("word").rlike(rf"^\p{{L}}{{{DICTIONARY_LETTERS},}}$"))
    return [r["word"] for r in rows.groupBy("word").count().orderBy(F.desc("count"), "word").limit(DICTIONARY_WORDS).collect()]


def with_features(found: DataFrame, words: list[str]) -> DataFrame:
    value = F.col("value")
    size = F.length(value)
    share = lambda kinds: F.length(F.regexp_replace(value, f"[^{kinds}]+", "")) / size
    kinds = value
    for pattern, mark in (("[a-z]+", "a"), ("[A-Z]+", "A"), ("[0-9]+", "0"), (r"[^a-zA-Z0]+", "-")):
        kinds = F.regexp_replace(kinds, pattern, mark)
    letters = F.split(value, "")
    counts = F.transform(F.array_distinct(letters), lambda c: F.size(F.filter(letters, lambda x: x == c)) / size)
    entropy = -F.aggregate(counts, F.lit(0.0), lambda a, p: a + p * F.log2(p))
    covered = F.length(F.regexp_replace(F.lower(value), "|".join(sorted(words, key=lambda w: (-len(w), w))) or r"\b\B", ""))
    number = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    return found.select(
        "*", size.cast("double").alias("length"), share("0-9").alias("digit_share"), share("A-Z").alias("upper_share"),
        share("a-z").alias("lower_share"), (1 - share("A-Za-z0-9")).alias("other_share"), (F.length(kinds) / size).alias("changes"),
        (F.size(F.array_distinct(letters)) / size).alias("distinct_share"), entropy.alias("entropy"),
        number(value.rlike("^([0-9a-f]+|[0-9A-F]+)$")).alias("hex_only"), (1 - covered / size).alias("word_share"),
        number(F.col("head").rlike(NAME) | F.col("named_words")).alias("named_near"), number(F.col("head").rlike("[\"']$")).alias("quoted"),
        number(F.col("head").rlike(EXAMPLE) | F.col("example_words") | value.rlike(EXAMPLE)).alias("example_near"), number(F.col("path").rlike(EXAMPLE)).alias("example_path"),
    ).withColumn("assigned", number(F.col("assigned")))


def own_labels(found: DataFrame) -> DataFrame:
    """Candidates whose form or surroundings settle their label."""
    secret = F.lit(False)
    for form in SIGNATURES:
        secret |= F.col("value").rlike(form)
    keyed = F.col("assigned") & F.col("value").rlike("^[0-9a-fA-F]{16,}$")
    sample = F.col("value").rlike(EXAMPLE)
    label = F.when(sample | (F.col("benign") & ~F.col("assigned")), 0.0).when(secret | keyed, 1.0)
    return found.withColumn("label", label).filter("label is not null")


def seed_findings(spark: SparkSession) -> DataFrame:
    """Labelled findings of known kinds, derived from hashes of numbers: keys under names, and harmless long runs."""
    rows = spark.range(SEEDS).select("id", F.sha2(F.col("id").cast("string"), 256).alias("h"), F.sha2(F.concat(F.lit("x"), "id"), 256).alias("g"))
    digits, upper = F.regexp_replace("h", "[a-f]", ""), F.upper(F.translate(F.substring("h", 1, 16), "01", "QZ"))
    mixed = F.substring(F.base64(F.unhex("g")), 1, 32)
    letters = F.translate("g", "0123456789", "ghiklmnopr")
    size = lambda least, kinds: least + F.pmod(F.xxhash64("h", F.lit(least)), F.lit(kinds)).cast("int")
    short = F.concat(F.substring(letters, 1, size(3, 6)), F.substring(digits, 1, size(1, 4)))
    signs = F.concat(
        F.initcap(F.substring(letters, 1, size(2, 4))), F.substring(F.lit("!&@.$#%*+?"), size(1, 10), F.lit(1)), F.substring(digits, 1, size(1, 3)),
        F.substring(letters, 10, size(2, 5)), F.substring(F.lit("$.@&!-_^~,"), size(1, 10), F.lit(1)), F.substring(digits, 4, size(0, 3)),
    )
    plain = F.element_at(F.array(*[F.lit(w) for w in PLAIN_VALUES]), size(1, len(PLAIN_VALUES)))
    kinds = [
        (1.0, F.substring("h", 1, 20), "password=", "the", ""), (1.0, F.substring("h", 1, 40), '"', "=", "token"), (1.0, F.concat(F.lit("AKIA"), upper), "", "the", "of"),
        (1.0, mixed, "api_key=", "with", ""), (1.0, mixed, "", "=", "secret"), (1.0, F.concat(F.lit("ghp_"), F.substring("g", 1, 36)), "", "of", ""),
        (1.0, short, "password=", "with", ""), (1.0, short, '"', "=", "password"), (1.0, signs, "password=", "the", ""), (1.0, signs, 'pwd="', "of", ""), (1.0, signs, "", "password:", "the"),
        (0.0, plain, "", "password:", "the"), (0.0, plain, "token=", "with", ""), (0.0, plain, '"', "=", "secret"), (0.0, plain, "", "auth:", "of"),
        (0.0, F.concat(F.lit("2024-0"), F.substring(digits, 1, 1), F.lit("-1"), F.substring(digits, 2, 1), F.lit("-log")), "", "on", "the"),
        (0.0, F.substring(digits, 1, 14), "+", "phone", "call"), (0.0, F.concat(F.lit("version-"), F.substring(digits, 1, 2), F.lit("-release")), "", "the", "in"),
        (0.0, F.concat(F.lit("your_example_key_"), F.substring(digits, 1, 2)), "token=", "set", ""), (0.0, F.concat(F.lit("chapter_"), F.substring(digits, 1, 3), F.lit("_section")), "", "see", "of"),
        (0.0, F.concat(F.lit("/images/photo/"), F.substring(digits, 1, 4)), "", "at", ""), (0.0, F.substring("h", 1, 40), "", "commit", "at"),
    ]
    parts = F.array(*[F.struct(F.lit(y).alias("label"), v.alias("value"), F.lit(h).alias("head"), F.lit(b).alias("before"), F.lit(b2).alias("before2")) for y, v, h, b, b2 in kinds])
    found = rows.select(F.explode(parts).alias("k")).select("k.*")
    found = found.select("*", F.concat("head", "value").alias("word"), F.lit("the").alias("after"), F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("path"), F.lit(0).alias("at"), F.lit(0).alias("part"))
    assigned = F.col("head").rlike(ASSIGNED_IN_WORD) | _assigned_before(F.col("before"), F.col("before2"))
    return with_surroundings(found).withColumn("assigned", assigned)


def train(labelled: DataFrame, words: list[str]) -> RandomForestClassificationModel:
    """A forest from labelled findings (candidate columns and ``label``)."""
    assembler = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=7, labelCol="label", featuresCol="features")
    return forest.fit(assembler.transform(with_features(labelled, words)).select("features", "label"))


def secret_findings(docs: DataFrame, labelled: DataFrame | None = None, path: str = "source", threshold: float = 0.5) -> DataFrame:
    """Accepted findings: doc_id, at, part (number of the value in its word), value_sha256, preview, length, probability."""
    words = dictionary(docs)
    found = materialize(candidates(docs, path), "candidates")
    if labelled is None:
        columns = [c for c in found.columns] + ["label"]
        own = least_hashes(own_labels(found), F.xxhash64("doc_id", "at", "part", "value"), FIT_ROWS)
        labelled = own.select(*columns).unionByName(seed_findings(docs.sparkSession).select(*columns))
    model = train(materialize(labelled, "labelled"), words)
    scored = model.transform(VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(with_features(found, words)))
    scored = scored.withColumn("probability", vector_to_array("probability")[1]).filter(F.col("probability") >= threshold)
    preview = F.concat(F.substring("value", 1, 4), F.lit("..."))
    return scored.select("doc_id", "at", "part", F.sha2("value", 256).alias("value_sha256"), preview.alias("preview"), F.length("value").alias("length"), "probability")
