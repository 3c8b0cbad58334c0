"""Secret scans: a random forest drops the false positives of a broad pattern,
by DataFrame and SQL functions and Spark's own forest only.

Candidates are runs of key characters, at least LONG long, and the values, at
least SHORT long and of any signs, that are assigned to a name of a secret.
Each is described by its length, the transitions between character classes, how
likely its letter pairs are in the corpus, how much of it words of the corpus
cover, whether it stands in a path or an address, and the words around it, by
name and hashed. The forest learns from labelled findings (text, before, after,
label) and decides on each candidate.

The words and letter pairs are counted over the whole corpus that is scanned.
"""

from __future__ import annotations

from math import log10

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm.frames import same
from seqloom.session import materialize

LONG, SHORT = 16, 8
KEY = r"[A-Za-z0-9+/_\-.@~%]"
#: Words that name secrets.
NAMES = r"token|secret|passw(?:or)?d|pwd|api[_-]?key|access[_-]?key|auth|bearer|credential|private|signature|client[_-]?id"
#: How a value is assigned to the name before it.
ASSIGN = r"[:=][ \t]{0,3}[\"']?"
VALUE = rf"[^\s\"'<>,;(){{}}\[\]]{{{SHORT},}}"
#: A long run from its first character, or an assignment behind a name.
CANDIDATE = rf"(?=[:=])(?<=(?i:{NAMES})[\"' ]{{0,2}}){ASSIGN}{VALUE}|(?<!{KEY}){KEY}{{{LONG},}}={{0,2}}"
TREES, TREE_DEPTH, SEED = 30, 8, 13
THRESHOLD = 0.5
AROUND = 48
#: Labelled findings are taken up to so many, those of smallest hash.
SAMPLE = 20_000
#: Buckets of the hashed neighbouring words, on each side.
NEIGHBOURS = 16
#: A letter run of the corpus counts as a word when it occurs so often.
WORD_COUNT = 5
#: Words of the corpus that the default findings are made of.
VOCABULARY = 256
MARK = "[SECRET]"
#: Up to so many documents with secrets, or words, are broadcast; beyond, a shuffle join finds them.
PICK = 1_000_000
LETTERS = "[a-z]{3,}"
CLASSES = {"l": "[a-z]", "u": "[A-Z]", "d": "[0-9]", "s": "[^A-Za-z0-9]"}


def dictionary(docs: DataFrame) -> tuple[DataFrame, list[float]]:
    """((word, n) of the letter runs of all texts; the log10 share of each pair
    of letters among the pairs that start alike, 27 x 27, 26 for any other
    character)."""
    runs = docs.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(f"({LETTERS})"), F.lit(1))).alias("word"))
    words = materialize(runs.groupBy("word").agg(F.count("*").alias("n")), "words")
    # a run of letters that goes on for more than a word's length says nothing of words
    letters = words.where(F.length("word") <= 32).select("n", F.split("word", "").alias("c"))
    pairs = letters.select("n", F.explode(F.zip_with(F.slice("c", 1, F.size("c") - 1), F.slice("c", 2, F.size("c") - 1), lambda x, y: code(x) * 27 + code(y))).alias("pair"))
    found = {r.pair: r.n for r in pairs.groupBy("pair").agg(F.sum("n").alias("n")).collect()}
    table = []
    for i in range(27):
        total = sum(found.get(i * 27 + j, 0) for j in range(26))
        table += [log10((found.get(i * 27 + j, 0) + 0.5) / (total + 13.5)) for j in range(27)]
    return words.where(F.col("n") >= WORD_COUNT), table


def code(c: Column) -> Column:
    """0 to 25 for a to z, 26 for all else."""
    return F.when(c.between("a", "z") & (F.length(c) == 1), F.ascii(c) - 97).otherwise(26)


def covered(found: DataFrame, words: DataFrame) -> DataFrame:
    """found with words: the share of text that letter runs of the corpus cover."""
    texts = found.select("text").distinct()
    runs = texts.select("text", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(f"({LETTERS})"), F.lit(1))).alias("run"))
    runs = materialize(runs, "runs")
    wanted = runs.select(F.col("run").alias("_run")).distinct()
    wanted = F.broadcast(wanted) if wanted.count() <= PICK else wanted
    words = words.join(wanted, F.col("word") == F.col("_run"), "left_semi").select("word")
    share = runs.join(words, F.col("run") == F.col("word")).groupBy(F.col("text").alias("_text")).agg(F.sum(F.length("run")).alias("letters"))
    out = found.join(share, F.col("text") == F.col("_text"), "left")
    return out.select(*found.columns, (F.coalesce("letters", F.lit(0)) / F.length("text")).alias("words"))


def features(pairs: list[float]) -> dict[str, Column]:
    """The forest's inputs, from text (the candidate), before and after (what
    stands around it) and words (see covered)."""
    text, before, after = F.col("text"), F.col("before"), F.col("after")
    n = F.length(text).cast("double")
    part = lambda pattern: (n - F.length(F.regexp_replace(text, pattern, ""))) / n
    count = lambda pattern: F.regexp_count(text, F.lit(pattern)).cast("double")
    last = F.lower(before)
    table = F.split(F.lit(",".join(map(str, pairs))), ",").cast("array<double>")  # one literal, once it is folded
    letters = F.split(F.lower(text), "")
    steps = F.zip_with(F.slice(letters, 1, F.greatest(F.size(letters) - 1, F.lit(0))), F.slice(letters, 2, F.greatest(F.size(letters) - 1, F.lit(0))), lambda x, y: F.get(table, code(x) * 27 + code(y)))
    bucket = lambda word: F.pmod(F.xxhash64(F.lower(word)), F.lit(NEIGHBOURS))
    near = bucket(F.regexp_extract(before, r"([A-Za-z_]+)[^A-Za-z_]*$", 1))
    then = bucket(F.regexp_extract(after, r"^[^A-Za-z_]*([A-Za-z_]+)", 1))
    out = {
        "length": n,
        "digits": part("[0-9]"),
        "upper": part("[A-Z]"),
        "lower": part("[a-z]"),
        "hex": part("[0-9a-fA-F]"),
        "signs": part("[A-Za-z0-9]"),
        "distinct": F.size(F.array_distinct(F.split(text, ""))) / n,
        "longest_letters": F.coalesce(F.array_max(F.transform(F.regexp_extract_all(text, F.lit("([A-Za-z]+)"), F.lit(1)), F.length)), F.lit(0)) / n,
        "vowels": part("[aeiouAEIOU]"),
        "pairs": F.aggregate(steps, F.lit(0.0), lambda s, x: s + x) / F.greatest(n - 1, F.lit(1.0)),
        "words": F.col("words"),
        "path": count(r"[/.:@]") / n,
        "address": (text.rlike(r"@|^[0-9.:\-]+$") | text.rlike(r"(?i)https?:|www\.|\.(com|org|net|html?|php)\b")).cast("double"),
        "named": last.rlike(rf"(?:{NAMES})[\"' ]*[:=]*[\"' ]*$").cast("double"),
        "near_name": last.rlike(NAMES).cast("double"),
        "assigned": last.rlike(r"[:=]\s*[\"']?$").cast("double"),
        "quoted": (before.rlike(r"[\"'`]$") & after.rlike(r"^[\"'`]")).cast("double"),
        "in_words": (before.rlike(r"[A-Za-z,]\s$") & after.rlike(r"^[\s.,]")).cast("double"),
    }
    out |= {f"{x}{y}": count(f"{a}(?={b})") / n for x, a in CLASSES.items() for y, b in CLASSES.items()}
    out |= {f"before{i}": (near == i).cast("double") for i in range(NEIGHBOURS)}
    return out | {f"after{i}": (then == i).cast("double") for i in range(NEIGHBOURS)}


def frequent_words(words: DataFrame, most: int = VOCABULARY) -> list[str]:
    """The most frequent words of 3 to 12 letters; a few plain ones where there are none."""
    rows = words.where(F.length("word").between(3, 12)).orderBy(F.desc("n"), "word").limit(most).collect()
    return [r.word for r in rows] or ["the", "and", "with", "from", "this"]


def synthetic_findings(spark: SparkSession, vocabulary: list[str], n: int = 6000) -> DataFrame:
    """Labelled findings made from hashes and from words of the corpus: the
    default training table. Keys and passwords of several alphabets and lengths
    with naming or neutral neighbours are real; long words, numbers, addresses,
    paths, dates, versions, rules and words behind a name are not."""
    h = lambda salt: F.sha2(F.concat(F.col("id").cast("string"), F.lit(salt)), 256)
    pick = lambda salt, *xs: F.element_at(F.array(*[x if isinstance(x, Column) else F.lit(x) for x in xs]), (F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(len(xs))) + 1).cast("int"))
    held = F.split(F.lit(" ".join(vocabulary)), " ")
    word = lambda salt: F.get(held, F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(len(vocabulary))).cast("int"))
    size = lambda salt, a, b: (F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(b - a)) + a).cast("int")
    digits = lambda salt: F.translate(h(salt), "abcdef", "135790")
    base = F.regexp_replace(F.base64(F.unhex(h("b"))), "=+$", "")
    key = pick("kind", F.substring(h("h"), 1, 40), F.substring(h("h"), 1, 32), h("h"), F.upper(F.substring(h("h"), 1, 40)), base.substr(F.lit(1), size("n", 20, 43)),
               F.concat(F.lit("AK"), F.lit("IA"), F.upper(F.translate(base, "+/", "XY")).substr(1, 16)), F.concat(F.lit("gh"), F.lit("p_"), F.translate(base, "+/", "ab").substr(1, 36)),
               F.concat_ws(".", base.substr(1, 20), F.reverse(base).substr(1, 24), base.substr(5, 30)),
               F.upper(F.translate(base, "+/0123456789", "XYABCDEFGHIJ")).substr(F.lit(1), size("o", 16, 33)), F.translate(base, "+/0123456789", "xyabcdefghij").substr(F.lit(1), size("o", 20, 41)))
    mixed = F.translate(base, "+/", "!$")
    password = pick("pw", mixed.substr(F.lit(1), size("p", 8, 16)), F.concat(word("x"), pick("ps", "!", "#", "$", "&", "*", "_"), F.substring(h("q"), 1, 4)), F.concat(F.initcap(word("x")), F.substring(digits("y"), 1, 4), pick("ps", "!", "#", "$", "&", "*")), F.concat(mixed.substr(1, 5), pick("ps", "!", "#", "$", "&", "*"), F.reverse(mixed).substr(F.lit(1), size("q", 3, 12))))
    password = F.when(F.length(password) < SHORT, F.concat(password, F.substring(h("z"), 1, 6))).otherwise(password)
    name = pick("name", "token", "secret", "password", "api_key", "access_key", "auth", "TOKEN", "Bearer", "client_secret")
    secret_before = pick("sb", F.concat(word("1"), F.lit(" "), name, F.lit(' = "')), F.concat(name, F.lit("=")), F.concat(word("1"), F.lit(" "), name, F.lit(": ")), F.concat(name, F.lit(" = '")), F.concat(F.lit("Authorization: "), name, F.lit(" ")))
    secret_after = F.when(secret_before.endswith('"'), '" ').when(secret_before.endswith("'"), "' ").otherwise(pick("sa", " ", "\n", ", "))
    named = pick("pb", F.concat(name, F.lit("=")), F.concat(name, F.lit(' = "')), F.concat(word("1"), F.lit(" "), name, F.lit(": ")))
    short = F.pmod(F.xxhash64("id", F.lit("short")), F.lit(4)) == 0  # a quarter are passwords behind a name
    key, secret_before = F.when(short, password).otherwise(key), F.when(short, named).otherwise(secret_before)
    yes = F.struct(key.alias("text"), secret_before.alias("before"), F.concat(secret_after, word("2")).alias("after"), F.lit(1.0).alias("label"))
    several = F.concat(*[word(f"w{i}") for i in range(7)])
    no_text = pick("no", several, F.initcap(several), F.upper(several), F.substring(digits("d"), 1, 16), F.substring(digits("d"), 1, 20),
                   F.concat(word("m"), F.substring(digits("e"), 1, 2), F.lit("@"), word("n"), F.lit(".example.com")),
                   F.concat(F.lit("https://www."), word("m"), F.lit(".com/"), word("n"), F.lit("/"), F.substring(digits("e"), 1, 6), F.lit(".html")),
                   F.concat_ws("/", F.lit("usr"), word("m"), word("n"), word("o"), F.concat(word("p"), F.substring(digits("e"), 1, 2))),
                   F.concat(F.lit("2021-0"), F.substring(digits("e"), 1, 1), F.lit("-11T10:"), F.substring(digits("e"), 1, 2), F.lit(":00.000")),
                   F.concat(word("m"), F.lit("-"), word("n"), F.lit("_"), word("o"), F.lit("-"), word("p"), F.substring(digits("e"), 1, 1)),
                   F.lit("----------------1"), F.lit("================"), F.concat_ws(".", *[F.substring(digits(s), 1, 3) for s in "qrst"]), F.repeat(F.substring(digits("e"), 1, 1), 18))
    no_before = pick("nb", F.concat(word("1"), F.lit(" ")), F.concat(word("1"), F.lit(", ")), F.lit("\n"), F.concat(word("1"), F.lit(" | ")), F.concat(F.lit("the "), name, F.lit(" of ")), F.concat(word("1"), F.lit(" ("), ))
    plain = pick("np", F.concat(word("m"), word("n")), F.concat(word("m"), F.lit("_"), word("n"), F.lit("_"), word("o")), F.concat(word("m"), F.lit("."), word("n"), F.lit("."), word("o")), F.concat(F.lit("$"), word("m"), F.lit("_"), word("n")), F.concat(word("m"), F.lit("-"), word("n"), F.lit("."), word("o")))
    plain = F.when(F.length(plain) < SHORT, F.concat(plain, word("p"))).otherwise(plain)
    no_text, no_before = F.when(short, plain).otherwise(no_text), F.when(short, named).otherwise(no_before)
    no = F.struct(no_text.alias("text"), no_before.alias("before"), F.concat(pick("na", " ", ". ", "\n", ", ", ") "), word("2")).alias("after"), F.lit(0.0).alias("label"))
    return spark.range(n).select(F.explode(F.array(yes, no)).alias("x")).select("x.*")


def trained(findings: DataFrame, words: DataFrame, pairs: list[float], sample: int = SAMPLE) -> RandomForestClassificationModel | None:
    """The forest, from labelled findings (text, before, after, label); null
    without both kinds of label."""
    rows = findings.where("text is not null and label is not null and length(text) > 0").select("text", F.coalesce("before", F.lit("")).alias("before"), F.coalesce("after", F.lit("")).alias("after"), F.col("label").cast("double").alias("label"))
    rows = rows.orderBy(F.xxhash64("text", "before", "after"), "text", "before", "after", "label").limit(sample)
    rows = materialize(rows, "findings")
    if rows.select("label").distinct().count() < 2:
        return None
    f = features(pairs)
    rows = covered(rows, words).orderBy("text", "before", "after", "label").select("label", *[e.cast("double").alias(k) for k, e in f.items()])
    rows = materialize(VectorAssembler(inputCols=list(f), outputCol="features").transform(rows).select("label", "features"), "vectors")
    return RandomForestClassifier(numTrees=TREES, maxDepth=TREE_DEPTH, seed=SEED, featureSubsetStrategy="onethird").fit(rows)


#: Candidates whose places are summed up together.
BLOCK = 256


def places(gaps: Column, found: Column) -> Column:
    """For each candidate the code points before it, from the lengths of the gaps
    and of the candidates. Sums go block by block, so that a text with many
    candidates takes time in proportion to them."""
    step = F.zip_with(F.transform(F.slice(gaps, 1, F.size(found)), F.length), F.transform(found, F.length), lambda g, f: F.struct(g.alias("gap"), f.alias("size")))
    none = F.array().cast("array<int>")

    def inner(at: Column, block: Column) -> Column:
        begin = F.struct(at.alias("at"), none.alias("out"))
        return F.aggregate(F.slice(step, block * BLOCK + 1, F.lit(BLOCK)), begin, lambda s, x: F.struct((s["at"] + x["gap"] + x["size"]).alias("at"), F.concat(s["out"], F.array(s["at"] + x["gap"])).alias("out")))

    def outer(s: Column, block: Column) -> Column:
        got = inner(s["at"], block)
        return F.struct(got["at"].alias("at"), F.concat(s["out"], F.array(got["out"])).alias("out"))

    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<array<int>>").alias("out"))
    blocks = F.sequence(F.lit(0), F.floor((F.size(found) - 1) / BLOCK).cast("int"))
    return F.flatten(F.aggregate(blocks, begin, outer)["out"])


def candidates(docs: DataFrame, *keep: str) -> DataFrame:
    """keep, start (code points before it), text, before, after of every
    candidate. Before and after are up to AROUND characters, no further than the
    next candidate but one."""
    src = docs.where(F.col("text").rlike(CANDIDATE))
    src = src.select(*keep, F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0)).alias("_found"), F.split("text", CANDIDATE, -1).alias("_gaps"))
    src = src.select(*keep, "_found", "_gaps", places(F.col("_gaps"), F.col("_found")).alias("_start"))
    rows = src.select(*keep, F.explode(F.transform(F.col("_start"), lambda at, i: F.struct(
        at.alias("at"), F.get("_found", i).alias("text"),
        F.concat(F.right(F.coalesce(F.get("_found", i - 1), F.lit("")), F.lit(AROUND)), F.right(F.get("_gaps", i), F.lit(AROUND))).alias("before"),
        F.concat(F.left(F.get("_gaps", i + 1), F.lit(AROUND)), F.left(F.coalesce(F.get("_found", i + 1), F.lit("")), F.lit(AROUND))).alias("after")))).alias("x"))
    # of an assignment the value is the candidate
    head = F.regexp_extract("x.text", rf"^{ASSIGN}", 0)
    n = F.length(head)
    text = F.substring("x.text", n + 1, F.length("x.text"))
    return rows.select(*keep, (F.col("x.at") + n).cast("long").alias("start"), text.alias("text"), F.right(F.concat("x.before", head), F.lit(AROUND)).alias("before"), F.left("x.after", F.lit(AROUND)).alias("after"))


def judged(found: DataFrame, forest: RandomForestClassificationModel | None, words: DataFrame, pairs: list[float], threshold: float = THRESHOLD) -> DataFrame:
    """found with score and is_secret."""
    if forest is None:
        return found.select("*", F.lit(0.5).alias("score"), F.lit(0.5 >= threshold).alias("is_secret"))
    f = features(pairs)
    rows = covered(found, words)
    rows = rows.select(*found.columns, *[e.cast("double").alias(f"_f_{k}") for k, e in f.items()])
    rows = VectorAssembler(inputCols=[f"_f_{k}" for k in f], outputCol="_vector").transform(rows)
    forest = forest.copy().setFeaturesCol("_vector").setProbabilityCol("_probability").setRawPredictionCol("").setPredictionCol("")
    score = vector_to_array("_probability")[1]
    return forest.transform(rows).select(*found.columns, score.alias("score"), (score >= threshold).alias("is_secret"))


def found_in(docs: DataFrame, findings: DataFrame | None, threshold: float, *keep: str) -> DataFrame:
    """All candidates of docs, judged."""
    words, pairs = dictionary(docs)
    if findings is None:
        findings = synthetic_findings(docs.sparkSession, frequent_words(words))
    forest = trained(findings, words, pairs)
    return judged(materialize(candidates(docs, *keep), "candidates"), forest, words, pairs, threshold)


def scanned(docs: DataFrame, findings: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each candidate: doc_id, start, length, score, is_secret,
    secret_sha256.

    Null and empty texts have no candidates; rows with a null id are scanned
    like any other and repeated rows each for themselves; an empty table gives
    no rows; other columns are not looked at. Without findings of both kinds
    every candidate counts as a secret.
    """
    out = found_in(docs.select("doc_id", "text"), findings, threshold, "doc_id")
    return out.select("doc_id", "start", F.length("text").cast("long").alias("length"), "score", "is_secret", F.sha2("text", 256).alias("secret_sha256"))


def redacted(docs: DataFrame, findings: DataFrame | None = None, threshold: float = THRESHOLD, mark: str = MARK) -> DataFrame:
    """docs with every secret in text replaced by mark, and n_chars, where docs
    has it, set anew; all rows stay, rows without secrets as they are. The cases
    are those of scanned()."""
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("_key"))
    found = found_in(keyed, findings, threshold, "doc_id", "_key").where("is_secret")
    spans_ = found.groupBy(F.col("doc_id").alias("_id"), F.col("_key").alias("_text_key")).agg(F.array_sort(F.collect_set(F.struct("start", F.length("text").cast("long").alias("length")))).alias("_spans"))
    spans_ = materialize(spans_, "secrets")
    spans_ = F.broadcast(spans_) if spans_.count() <= PICK else spans_
    rows = docs.join(spans_, same(F.col("doc_id"), F.col("_id")) & (F.xxhash64("text") == F.col("_text_key")), "left")
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    text = F.col("text")
    step = lambda s, x: F.struct((x["start"] + x["length"]).alias("at"), F.concat(s["out"], text.substr(s["at"] + 1, x["start"] - s["at"]), F.lit(mark)).alias("out"))
    finish = lambda s: F.concat(s["out"], text.substr(s["at"] + 1, F.length(text).cast("long")))
    clean = F.when(F.col("_spans").isNull(), text).otherwise(F.aggregate("_spans", start, step, finish))
    made = {"text": clean} | ({"n_chars": F.length(clean).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    changed = F.col("_spans").isNotNull()
    return rows.select(*[F.when(changed, made[c]).otherwise(F.col(c)).alias(c) if c in made else c for c in docs.columns])
