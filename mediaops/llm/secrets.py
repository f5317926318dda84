"""Secret scans: candidate strings, judged by a random forest.

Candidates are long unbroken runs with a digit or a change from lower to upper
case in them, tokens of several such runs with dots between, and whatever a
credential's name or a URL assigns, of any length and with any signs. Most are card
numbers, identifiers, serials or placeholders; a forest trained on labelled findings
removes those. It sees a candidate's length, its transitions between kinds of
characters, how much of it a dictionary of the corpus's own words covers, the path
it was found in and the words beside it. DataFrame functions and JVM-side forests
only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, text_of

RUN = r"[A-Za-z0-9+/_\-]{12,}"
DOTTED = rf"{RUN}(?:\.[A-Za-z0-9+/_\-]{{6,}})*"
KEYWORDS = r"(?i)secret|token|passw|pwd|api.?key|apikey|auth|credential|bearer|private"
PLACEHOLDERS = r"(?i)example|sample|dummy|placeholder|changeme|your[_-]?|xxxx|test"
MIN_WORD_COUNT = 5  # occurrences that put a word in the dictionary
MAX_FINDINGS = 20_000  # labelled findings of either class used for training, chosen by hash
PLANTED = 24_000  # findings that ``planted_findings`` makes
TREES, DEPTH, SEED = 32, 9, 42

FEATURES = [
    "length", "runs_share", "digit_share", "upper_share", "lower_share", "hex_share", "distinct_share", "entropy", "coverage",
    "path_test", "path_config", "near_keyword", "assigned", "quoted", "near_placeholder", "alone", "numbers_beside", "in_url", "signs_share",
]


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """row, doc_id, path, word_no, run_no, candidate, before, prefix, suffix, after: every candidate of a text, whole.

    ``before`` holds the two words in front, ``prefix`` and ``suffix`` the rest of
    the candidate's own word. What a credential's name or a URL assigns is taken
    whole, and runs inside it are not taken again; of a word's other runs each
    counts at its own place. ``row`` numbers rows of the input."""
    words = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(path_col).cast("string"), F.lit("")).alias("path"),
        F.split(text_of(text_col), r"[\x20\x09-\x0D]+").alias("words"),
    )

    def word(i: Column, by: int) -> Column:
        j = i + by
        return F.when((j >= 0) & (j < F.size("words")), F.get("words", j)).otherwise("")

    def may_hold(w: Column, i: Column) -> Column:
        after_sign = word(i, -1).rlike(r"[=:][\"'`]?$") & F.concat_ws(" ", word(i, -2), word(i, -1)).rlike(KEYWORDS)
        return w.rlike(RUN) | w.rlike(rf"{KEYWORDS}") & w.rlike("[=:].") | w.rlike("://[^/@]*:[^/@]+@") | after_sign | word(i, -1).rlike("(?i)^bearer$")

    hits = F.filter(F.transform("words", lambda w, i: F.when(may_hold(w, i), i)), lambda i: i.isNotNull())
    around = F.transform(hits, lambda i: F.struct(i.alias("word_no"), word(i, 0).alias("word"), F.concat_ws(" ", word(i, -2), word(i, -1)).alias("before"), word(i, 1).alias("after")))
    found = words.select("row", "doc_id", "path", F.explode(around).alias("w")).select("row", "doc_id", "path", "w.*")

    w, none = F.col("word"), F.lit("")
    named = F.regexp_extract("word", rf"(?i)(?:{KEYWORDS[4:]})[A-Za-z0-9_.\-]*[\"'`]?(?:=|:(?!//))+[\"'`]?([^\"'`\s,;|]{{3,}})", 1)
    in_url = F.regexp_extract("word", "://[^/:@]*:([^/@]{3,})@", 1)
    follows = F.col("before").rlike(rf"{KEYWORDS}") & F.col("before").rlike(r"[=:][\"'`]?$") | F.col("before").rlike("(?i) bearer$")
    after = F.when(follows, F.regexp_extract("word", r"^[\"'`(\[]*([^\"'`\s,;|]{3,}?)(?:[\"'`)\],;.!?]|!!)*$", 1)).otherwise(none)
    assigned = F.when(in_url != "", in_url).when(named != "", named).otherwise(after)
    runs = F.filter(F.regexp_extract_all("word", F.lit(DOTTED), 0), lambda r: r.rlike("[0-9]|[a-z][A-Z]"))

    def add(acc: Column, r: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)
        at = F.call_function("locate", r, F.col("word"), F.coalesce(last["at"] + F.length(last["run"]), F.lit(1)))
        return F.concat(acc, F.array(F.struct(at.alias("at"), r.alias("run"))))

    at_assigned = F.call_function("locate", F.col("assigned"), w)
    placed = F.aggregate("runs", F.array().cast("array<struct<at:int,run:string>>"), add)
    outside = F.filter(placed, lambda x: (F.col("assigned") == "") | (x["at"] + F.length(x["run"]) <= at_assigned) | (x["at"] >= at_assigned + F.length("assigned")))
    whole = F.when(F.col("assigned") != "", F.array(F.struct(at_assigned.alias("at"), F.col("assigned").alias("run")))).otherwise(F.array().cast("array<struct<at:int,run:string>>"))
    every = found.withColumn("assigned", assigned).withColumn("runs", runs).select(
        "row", "doc_id", "path", "word_no", "word", "before", "after", F.posexplode(F.array_sort(F.concat(whole, outside))).alias("run_no", "r")
    )
    return every.select(
        "row", "doc_id", "path", "word_no", "run_no", F.col("r.run").alias("candidate"), "before", "after",
        F.substring(w, F.lit(1), F.col("r.at") - 1).alias("prefix"), F.substring(w, F.col("r.at") + F.length("r.run"), F.length("word")).alias("suffix"),
    )


def dictionary(docs: DataFrame, text_col: str = "text", least: int = MIN_WORD_COUNT) -> DataFrame:
    """word: lower-case words of three letters or more that the corpus holds ``least`` times, over whole texts."""
    words = docs.select(F.explode(F.split(F.lower(text_of(text_col)), r"[^a-z]+")).alias("word")).filter(F.length("word") >= 3)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).select("word")


def with_features(found: DataFrame, words: DataFrame) -> DataFrame:
    """``found`` with one double column for each of FEATURES."""
    c = F.col("candidate")
    n = F.length(c)
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "[a-z]", "a"), "[A-Z]", "A"), "[0-9]", "9")
    chars = F.array_distinct(F.split(c, "(?!^)(?!$)"))
    share = F.transform(chars, lambda x: (n - F.length(F.replace(c, x, F.lit("")))) / n)
    entropy = F.aggregate(share, F.lit(0.0), lambda s, p: s - p * F.log2(p))
    near = F.concat_ws(" ", "before", "prefix")

    def flag(x: Column) -> Column:
        return F.when(x, 1.0).otherwise(0.0)

    parts = found.select("candidate").distinct().select("candidate", F.explode(F.array_distinct(F.split(F.lower(c), "[^a-z]+"))).alias("word")).filter(F.length("word") >= 3)
    covered = parts.join(words, "word").groupBy("candidate").agg(F.sum(F.length("word")).alias("covered"))
    out = found.join(covered, "candidate", "left").select(
        *found.columns,
        n.cast("double").alias("length"),
        (F.length(F.regexp_replace(kinds, r"(.)\1+", "$1")) / n).alias("runs_share"),
        *((F.regexp_count(c, F.lit(p)) / n).alias(f"{name}_share") for name, p in (("digit", "[0-9]"), ("upper", "[A-Z]"), ("lower", "[a-z]"), ("hex", "[0-9a-f]"))),
        (F.size(chars) / n).alias("distinct_share"),
        entropy.alias("entropy"),
        F.least(F.lit(1.0), F.coalesce(F.col("covered"), F.lit(0)) / n).alias("coverage"),
        flag(F.col("path").rlike("(?i)test|example|sample|mock|docs?/")).alias("path_test"),
        flag(F.col("path").rlike(r"(?i)config|\.env|secret|\.ya?ml|\.json|\.ini|\.properties")).alias("path_config"),
        flag(near.rlike(KEYWORDS)).alias("near_keyword"),
        flag(near.rlike(r"[=:]\s*[\"']?$")).alias("assigned"),
        flag(F.col("prefix").rlike("[\"'`]$") & F.col("suffix").rlike("^[\"'`]")).alias("quoted"),
        flag(F.concat_ws(" ", near, "candidate", "after").rlike(PLACEHOLDERS)).alias("near_placeholder"),
        flag((F.col("prefix") == "") & (F.col("suffix") == "")).alias("alone"),
        flag(F.concat_ws(" ", "before", "after").rlike("[0-9]")).alias("numbers_beside"),
        flag(F.col("prefix").rlike("://[^/@]*:$") & F.col("suffix").rlike("^@")).alias("in_url"),
        (F.regexp_count(c, F.lit("[^A-Za-z0-9]")) / n).alias("signs_share"),
    )
    return out


def bootstrap_label(candidate: str = "candidate") -> Column:
    """Labels of featured findings that need no judge: 1 for published key formats and for hexadecimal values assigned
    to a credential's name, 0 for plain numbers, dates, dictionary words with a number and placeholders, else null."""
    c, near = F.col(candidate), F.concat_ws(" ", "before", "prefix")
    # Published key formats.
    formats = [r"^(AKIA|ASIA)[0-9A-Z]{16}$", r"^gh[pousr]_[A-Za-z0-9]{36}$", r"^xox[abprs]-[A-Za-z0-9-]{10,}$", r"^sk_(live|test)_[A-Za-z0-9]{16,}$", r"^AIza[A-Za-z0-9_-]{35}$", r"^eyJ[A-Za-z0-9_-]{16,}$"]
    known = reduce(lambda a, b: a | b, [c.rlike(p) for p in formats])
    assigned = near.rlike(KEYWORDS) & near.rlike(r"[=:]\s*[\"']?$") & c.rlike("^[0-9a-f]{16,}$") & c.rlike("[a-f]")
    words = c.rlike(r"^[A-Za-z]+([_\-/][A-Za-z]+)*[_\-/]?[0-9]{1,4}$") & (F.col("coverage") >= 0.5)
    plain = c.rlike(r"^[0-9_+/\-]+$") | words | c.rlike(PLACEHOLDERS)
    return F.when(known | assigned, 1).when(plain, 0)


def _snippets(spark: SparkSession, words: list[str], n: int, seed: int) -> DataFrame:
    """doc_id, text, source, value, label: made-up keys and passwords (label 1) and strings that look like them (0),
    each in a place where such a one stands, among the corpus's own words."""
    i = F.col("id")

    def pick(what: str, of: int) -> Column:
        return F.pmod(F.xxhash64(F.lit(f"{what}{seed}"), i), F.lit(of)).cast("int")

    def one(what: str, *of: Column | str) -> Column:
        return F.get(F.array(*(x if isinstance(x, Column) else F.lit(x) for x in of)), pick(what, len(of)))

    def text(*parts: Column | str) -> Column:
        return F.concat(*(x if isinstance(x, Column) else F.lit(x) for x in parts))

    known = F.array(*map(F.lit, words))
    hexes = F.concat(*(F.sha2(F.concat(F.lit(f"{x}{seed}:"), i.cast("string")), 256) for x in "ab"))
    parts = spark.range(n).select(i, hexes.alias("hexes"), *(F.get(known, pick(f"word{k}", len(words))).alias(k) for k in "abcde"), pick("kind", 10).alias("kind"), (pick("number", 9000) + 10).cast("string").alias("number"))
    parts = parts.withColumn("letters", F.regexp_replace(F.base64(F.unhex("hexes")), "[+/=]", "")).withColumn("digits", F.translate("hexes", "abcdef", ""))
    parts = parts.withColumn("sign", one("sign", "!", "@", "#", "$", "&", "_", "-", "")).withColumn("quote", one("quote", '"', '"', "'", ""))
    parts = parts.withColumn("name", one("name", "token", "password", "passwd", "pwd", "secret", "api_key", "apikey", "auth_token", "client_secret", "private_key", "credential"))
    a, b, c, d, number, sign, letters, digits = map(F.col, ("a", "b", "c", "d", "number", "sign", "letters", "digits"))
    cut_of = lambda x, begin, size: F.substring(x, begin, size)
    values = parts.select(
        "*",
        one("secret", cut_of("hexes", 1, 40), cut_of("hexes", 1, 32), cut_of(F.base64(F.unhex("hexes")), 1, 44), cut_of(letters, 1, 24), text(F.initcap(a), number, sign), text(a, cut_of(digits, 1, 2)),
            text(F.initcap(a), F.initcap(b), F.initcap(c), F.initcap(d)), text(cut_of(letters, 1, 5), sign, cut_of(letters, 9, 4), sign, cut_of(digits, 1, 2))).alias("secret"),
        # recognisable wherever they stand
        one("key", text("AKIA", cut_of(F.upper(letters), 1, 16)), text("ghp_", cut_of(letters, 1, 36)), text("sk_live_", cut_of(letters, 1, 24)),
            text("eyJ", cut_of(letters, 1, 20), ".eyJ", cut_of(letters, 21, 30), ".", cut_of(letters, 52, 30))).alias("key"),
        # assigned to a credential's name, and none
        one("harmless", text("your_", a, "_key_here1"), "changeme123", "xxxxxxxxxxxx1", text("get_", a, "_", b, "()"), text("example-", cut_of("hexes", 1, 12)), a, text(a, "_", b, "_", c), "true", "null", "required").alias("harmless"),
        one("plain", cut_of(digits, 1, 16), cut_of(digits, 1, 13), text("20", cut_of(digits, 1, 2), "-05-17T", cut_of(digits, 3, 6)), text(a, "-", b, "-", number), text(a, F.initcap(b), F.initcap(c)),
            text("ORD-", number, "-", cut_of(digits, 1, 6)), text("src/", a, "/", b, "/", c, "_", number), text(F.upper(a), "_", F.upper(b), "_", number), text(a, F.initcap(b), number)).alias("plain"),
        F.concat_ws("-", cut_of("hexes", 1, 8), cut_of("hexes", 9, 4), cut_of("hexes", 13, 4), cut_of("hexes", 17, 4), cut_of("hexes", 21, 12)).alias("uuid"),
    )
    kind, value, name, quote = F.col("kind"), F.col("value"), F.col("name"), F.col("quote")
    valued = values.withColumn(
        "value", F.when((kind <= 2) | (kind == 4), F.col("secret")).when(kind == 3, F.col("key")).when(kind == 5, F.col("harmless")).when(kind == 6, cut_of("hexes", 1, 40)).when(kind == 7, F.col("uuid")).otherwise(F.col("plain"))
    ).withColumn("given", one("form", text(name, " = ", quote, value, quote), text(name, "=", quote, value, quote), text(name, ": ", value), text("| ", name, " = ", quote, value, quote), text('"', name, '":"', value, '",')))
    placed = valued.withColumn(
        "placed",
        F.when((kind <= 2) | (kind == 5), F.col("given")).when(kind == 3, one("where", value, text("Authorization: Bearer ", value), text('"', value, '"')))
        .when(kind == 4, one("where", text("https://user:", value, "@", a, ".org/", b), text("postgres://", a, ":", value, "@db:5432/x")))
        .when(kind == 6, text(one("where", "commit ", "sha1: ", "digest = ", "etag: ", "tree "), value)).when(kind == 7, text(one("where", "id=", "uuid: ", "request ", "session ", "trace="), value))
        .otherwise(text(one("where", "", "", "number ", "ref: ", "see ", "name = "), value)),
    ).withColumn("text", F.concat_ws(" ", "b", "c", "placed", "d", "e")).withColumn("loud", pick("loud", 5) == 0)
    return cut(placed.select(
        i.alias("doc_id"), F.when(F.col("loud"), F.regexp_replace(F.upper("text"), "([A-Z]) ", "$1!! ")).otherwise(F.col("text")).alias("text"),
        one("path", "", "", "src0", "src1", "config/app.yaml", "tests/data.py", "docs/readme.md", "src/main.py", ".env").alias("source"),
        F.when(F.col("loud"), F.upper(value)).otherwise(value).alias("value"), (kind <= 4).cast("int").alias("label"),
    ))


def planted_findings(spark: SparkSession, words: DataFrame, n: int = PLANTED, seed: int = SEED) -> DataFrame:
    """Labelled findings: ``n`` made-up snippets whose truth is known from how they were made, not from what a
    finding looks like. At most 1024 words of the dictionary are used, chosen by hash."""
    known = [r.word for r in words.orderBy(F.xxhash64("word", F.lit(seed)), "word").limit(1024).collect()] or ["word"]
    made = _snippets(spark, known, n, seed)
    found = candidates(made).join(made.select("doc_id", "value", F.col("label")), "doc_id")
    # a finding is the planted value, with the signs that may stand at its ends
    mine = F.col("value").startswith(F.col("candidate")) | F.col("candidate").startswith(F.col("value"))
    return with_features(found.filter(mine).drop("value"), words)


def judge(found: DataFrame, findings: DataFrame) -> DataFrame:
    """Add ``probability`` to featured candidates by a forest trained on ``findings`` (features and label 0 or 1).

    At most MAX_FINDINGS of either class are used. Without findings of both classes
    the probability is the share of ones among them, 0.5 without any."""
    key = F.xxhash64("candidate", "before", F.lit(SEED))
    sample = reduce(DataFrame.unionByName, [findings.filter(F.col("label") == y).orderBy(key, "candidate", "before", "after").limit(MAX_FINDINGS) for y in (0, 1)])
    sample = cut(sample.select("label", "candidate", "before", "after", *FEATURES))
    ones, n = sample.agg(F.sum("label"), F.count(F.lit(1))).first()
    if not n or ones in (0, n):
        return found.withColumn("probability", F.lit(ones / n if n else 0.5))
    assemble = VectorAssembler(inputCols=FEATURES, outputCol="_features")
    rows = assemble.transform(sample.coalesce(1).sortWithinPartitions(key, "candidate", "before", "after"))
    forest = RandomForestClassifier(featuresCol="_features", labelCol="label", probabilityCol="_p", rawPredictionCol="_r", predictionCol="_y", numTrees=TREES, maxDepth=DEPTH, seed=SEED).fit(rows)
    return forest.transform(assemble.transform(found)).withColumn("probability", vector_to_array("_p")[1]).drop("_features", "_p", "_r", "_y")


def scan_secrets(docs: DataFrame, findings: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source", words: DataFrame | None = None) -> DataFrame:
    """One row per candidate: doc_id, path, word_no, run_no, candidate, FEATURES, label, probability, is_secret.

    ``findings``, if given, has the columns of ``with_features`` and a label; else
    candidates that bootstrap_label can tell train the forest for the others.
    ``words`` is the dictionary, by default that of ``docs``. A
    null text has no candidates, a null path is empty, rows with a null identifier
    are scanned too, repeated rows are reported each. Texts are scanned whole, in
    words parted by white space. An empty table gives no rows; further columns are
    ignored."""
    found = cut(candidates(docs, id_col, text_col, path_col))
    # the dictionary is read once; only candidates' parts are looked up in it
    featured = cut(with_features(found, dictionary(docs, text_col) if words is None else words).withColumn("label", bootstrap_label()))
    judged = judge(featured, findings if findings is not None else featured.filter("label is not null"))
    return judged.select("doc_id", "path", "word_no", "run_no", "candidate", *FEATURES, "label", "probability", (F.col("probability") >= 0.5).alias("is_secret"))


def op5_secret_scan(spark, sf_dir: str) -> DataFrame:
    """Candidates of all documents, judged by a forest of planted findings; the secret itself leaves as a digest and a masked form."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    words = cut(dictionary(docs))
    found = scan_secrets(docs, planted_findings(spark, words), words=words)
    masked = F.concat(F.substring("candidate", 1, 4), F.lit("..."), F.length("candidate").cast("string"))
    return found.select("doc_id", "path", "word_no", "run_no", masked.alias("masked"), F.sha2(F.col("candidate"), 256).alias("candidate_sha256"), F.round("coverage", 6).alias("coverage"), F.round("probability", 6).alias("probability"), "is_secret")
