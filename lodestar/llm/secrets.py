"""Secret scans: a random forest removes the false positives among candidates, in DataFrame functions only.

Candidates are found in the whole text: runs of credential characters of ``LEAST`` or more with a digit, values of any
length that are assigned to a credential word or quoted behind one, the password of an address (scheme://user:password@),
words of ten or more characters that mix both cases, digits and signs, and private-key blocks. Features are their length,
transitions between characters (how seldom each pair of neighbours is among the dictionary's words, and changes of kind),
dictionary coverage, marks of paths and addresses, and the neighbouring words: those behind the candidate, and before it
back to the candidate before, whose value counts as a neighbour too. The dictionary is a parameter; ``WORDS``, its
default, is a list of common words of code, paths and forms made for this module. The forest is trained by Spark ML on
labelled findings (``labelled_findings`` makes a bounded, fixed set; callers may pass their own table of text, start, stop,
label) and then written out as a column expression over the features, so that scanning is one projection of the text: no
shuffle, no key, nothing to skew. Its work is linear in the text and, but for positions (n * sqrt(n) at most), in the
number of candidates.

Defined results: a null or empty text has no findings; null and repeated doc_ids are kept, each row has its own
findings; overlapping candidates don't occur; an empty table gives an empty one; columns other than doc_id and text
are not looked at by ``findings`` and are kept by ``redacted``. Positions are code points from 0, stop exclusive.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.rules import let

LEAST = 12
TREES, DEPTH, SEED = 15, 6, 5
#: Labelled findings that the forest is trained on.
TRAIN_ROWS = 4000
THRESHOLD = 0.5
MARK = "[SECRET]"
#: Code points on either side that neighbouring words are taken from.
NEAR = 40
_RUN = "[A-Za-z0-9_+/.~@%-]"
CREDENTIAL = r"(pass(word|wd|phrase)?|pwd|secret|token|api[_-]?key|access[_-]?key|auth(orization)?|bearer|credential|private[_-]?key)"
#: Private-key blocks, to their end line or as far as their lines go.
BLOCK = r"-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY(?: BLOCK)?-----(?:[\sA-Za-z0-9+/=:,.()@<>_\\-]*?-----END [A-Z0-9 ]{0,40}PRIVATE KEY(?: BLOCK)?-----|(?:\s{1,4}[A-Za-z0-9+/=]{16,}){0,400})"
_NAME, _SIGN = rf"(?i:{CREDENTIAL})[\"'\]]{{0,2}}\s{{0,3}}", r"(?::=|=>|={1,3}|:)\s{0,3}"
#: Values of any length and characters: quoted behind a credential word, assigned to one, or with a digit or sign behind "is".
ASSIGNED = (
    rf"(?<=\")(?<={_NAME}(?:(?i:is)\s{{1,3}}|{_SIGN})?\")[^\"\n]++(?:(?<=\\)\"[^\"\n]++){{0,100}}(?=\")"
    rf"|(?<=')(?<={_NAME}(?:(?i:is)\s{{1,3}}|{_SIGN})?')[^'\n]++(?:(?<=\\)'[^'\n]++){{0,100}}(?=')"
    # The short looks behind come first, as the long ones are slow and most words are not behind a sign.
    rf"|(?<=[:=>\s])(?=[^\s\"':=])(?:(?<=[:=>]\s{{0,3}})(?!(?i:bearer|basic)\s)(?<={_NAME}{_SIGN})|(?<=[rRcC]\s)(?<=(?i:bearer|basic)\s)(?<={_NAME}{_SIGN}(?i:bearer|basic)\s)|(?<=[iI][sS]\s{{1,3}})(?<={_NAME}(?i:is)\s{{1,3}})(?=\S*[0-9!#$%&*@^+]))\S+?(?=[.,;)\]}}\"']*(?:\s|$))"
)
#: The password of an address, between the user's name and the @.
ADDRESS = r"(?<=:)(?=[^\s/@\"']{1,200}@)(?<=://[^\s/:@]{0,64}:)[^\s/@\"']+"
#: Words of both cases, digits and signs that are no path, address or assignment.
MIXED = r"(?:\A|(?<=[\s\"'(]))(?=[A-Za-z0-9!#$%&*?^+~]{10})(?=[A-Za-z0-9+~]*[!#$%&*?^])(?=[A-Z0-9!#$%&*?^+~]*[a-z])(?=[a-z0-9!#$%&*?^+~]*[A-Z])(?=[A-Za-z!#$%&*?^+~]*[0-9])[A-Za-z0-9!#$%&*?^+~]{10,}(?![^\s\"').,;])"
RUN = rf"(?<!{_RUN})(?=[A-Za-z_+/.~@%-]*[0-9]){_RUN}{{{LEAST},}}+={{0,2}}"
# None but a block begins right behind a letter or digit, which rules out most places at once.
CANDIDATE = f"{BLOCK}|(?<![A-Za-z0-9])(?:{ASSIGNED}|{ADDRESS}|{MIXED}|{RUN})"

WORDS = (
    "account address admin alpha archive article asset backup banner batch beta blog book build cache cart catalog chapter class client code color "
    "commit common config content count course data debug default demo dev doc download draft east edition error event example file final folder format "
    "group header home house image index info input issue item java job label layer level library line list local main manual master "
    "media message model module month name network news node north number object order output package page part patch path photo plan player "
    "point post price print prod product profile project public query record region release report request resource result review sample scene "
    "schema script section select series server service session setup shop site size source south stable state static status store story string style "
    "system table target task team temp test text thread time title total train update upload user utils value version video view web week west "
    "widget window world year"
).split()
PUBLIC = r"(commit|sha-?(1|256|512)|md5|checksum|digest|hash|etag|uuid|guid|revision|build|version|isbn|doi|order|invoice|tracking|card|phone|tel|ip|example|sample|placeholder|dummy|https?:)"

FEATURES = ("length", "transitions", "kinds", "digits", "upper", "letters", "hex", "words", "longest_run", "path", "address", "dashes", "credential_before", "public_before", "assigned", "quoted", "prefix", "signs", "empty", "block", "in_address")
#: Values that stand for a secret or for none: words of code and forms, references, masks.
EMPTY = r"(?i)^(null|none|nil|true|false|yes|no|undefined|empty|required|optional|string|str|text|int|invalid|incorrect|wrong|missing|expired|disabled|enabled|hidden|redacted|secret|password|token|changed|\[secret\]|your.*|my.*|enter.*|example.*|[*x.•_-]+|[$%{<].*|(os|process|env|self|this|config|settings|getenv)\b.*|[a-z_.]+\(.*|[0-9])$"


def _share(value: Column, pattern: str) -> Column:
    return F.lit(1.0) - F.length(F.regexp_replace(value, pattern, "")) / F.length(value)


def pair_costs(dictionary: tuple[str, ...] = WORDS) -> list[float]:
    """Bits of each pair of neighbours, by 28 * first + second: 1 to 26 for letters, 27 for digits, 0 for others. Pairs of
    letters cost what their share among the dictionary's pairs says (with 0.2 added to each count), those of two
    digits 3.3, others 5."""
    costs = np.full((28, 28), 5.0)
    counts = np.full((26, 26), 0.2)
    for word in dictionary:
        codes = [ord(c) - 97 for c in word if "a" <= c <= "z"]
        for a, b in zip(codes, codes[1:]):
            counts[a, b] += 1
    costs[1:27, 1:27] = -np.log2(counts / counts.sum(axis=1, keepdims=True))
    costs[27, 27] = 3.3
    return [round(float(x), 3) for x in costs.ravel()]


def transitions(value: Column, dictionary: tuple[str, ...] = WORDS) -> Column:
    """Mean bits of the pairs of neighbours."""
    table = F.expr("array(" + ", ".join(f"{x}D" for x in pair_costs(dictionary)) + ")")

    def mean(codes: Column) -> Column:
        n = F.size(codes)
        costs = F.zip_with(F.slice(codes, 1, n - 1), F.slice(codes, 2, n - 1), lambda a, b: table[a * 28 + b])
        return F.when(n < 2, F.lit(5.0)).otherwise(F.aggregate(costs, F.lit(0.0), lambda s, x: s + x) / (n - 1))

    code = lambda c: F.when(c.between("a", "z"), F.ascii(c) - 96).when(c.between("0", "9"), F.lit(27)).otherwise(F.lit(0))
    return let(F.transform(F.split(F.lower(value), ""), code), mean)


def features(value: Column, before: Column, after: Column, dictionary: tuple[str, ...] = WORDS) -> list[Column]:
    """Of a candidate, the text before it and the text behind it, in the order of FEATURES."""
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[a-z]+", "a"), "[A-Z]+", "A"), "[0-9]+", "9")
    flag = lambda column, pattern: F.when(column.rlike(pattern), 1.0).otherwise(0.0)
    return [
        F.length(value).cast("double"),
        transitions(value, dictionary),
        (F.length(shape) - 1) / F.length(value),
        _share(value, "[0-9]"),
        _share(value, "[A-Z]"),
        _share(value, "[A-Za-z]"),
        flag(value, "^([0-9a-f]+|[0-9A-F]+)$"),
        _share(F.lower(value), "(" + "|".join(sorted(dictionary, key=len, reverse=True)) + ")"),
        F.array_max(F.transform(F.split(value, "[^A-Za-z]+"), lambda x: F.length(x))) / F.length(value),
        flag(value, r"/.*/|\.[a-z]{2,4}$|^/"),
        flag(value, r"@|^\d+(\.\d+){2,}|^\d{12,19}$|%"),
        F.size(F.split(value, "-")) - F.lit(1.0),
        flag(before, rf"(?i){CREDENTIAL}[\"']?\s*(is|[:=]|=>)?\s*[\"']?$"),
        flag(before, rf"(?i)(^|[^a-z]){PUBLIC}[^A-Za-z0-9]{{0,4}}$"),
        flag(before, r"[:=]\s*[\"']?$"),
        F.when(before.rlike("[\"']$") & after.rlike("^[\"']"), 1.0).otherwise(0.0),
        flag(value, r"^(AKIA[A-Z0-9]{16}|ASIA[A-Z0-9]{16}|gh[pousr]_|github_pat_|xox[abpr]-|sk_live_|rk_live_|sk-|AIza|glpat-|eyJ)"),
        _share(value, r"[^A-Za-z0-9\s]"),
        flag(value, EMPTY),
        flag(value, "^-----BEGIN [A-Z0-9 ]*PRIVATE KEY"),
        F.when(before.rlike("://[^\\s/:@]*:$") & after.rlike("^@"), 1.0).otherwise(0.0),
    ]


def labelled_findings(spark: SparkSession, rows: int = TRAIN_ROWS) -> DataFrame:
    """text, start, stop, label: the same findings at every call, half of them secrets, each in a made-up line."""
    key = F.col("id").cast("string")
    digest = lambda salt: F.sha2(F.concat(F.lit(salt), key), 512)
    base = F.regexp_replace(F.base64(F.unhex(digest("b"))), "[=\\s]", "")
    letters = F.regexp_replace(base, "[^A-Za-z]", "")
    upper = F.regexp_replace(F.upper(base), "[^A-Z0-9]", "")
    word = lambda salt: F.element_at(F.split(F.lit(" ".join(WORDS)), " "), (F.pmod(F.xxhash64(F.lit(salt), "id"), F.lit(len(WORDS))) + 1).cast("int"))
    number = lambda salt, most: F.pmod(F.xxhash64(F.lit(salt), "id"), F.lit(most)).cast("string")
    hex_ = lambda n: F.substring(digest("h"), 1, n)
    cat = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y for y in x])
    mark = lambda x: cat("\x01", x, "\x02")
    some = lambda n: F.substring(base, 1, n)
    uuid = cat(hex_(8), "-", F.substring(digest("h"), 9, 4), "-4", F.substring(digest("h"), 13, 3), "-a", F.substring(digest("h"), 16, 3), "-", F.substring(digest("h"), 20, 12))
    pick_of = lambda *x: F.element_at(F.array(*[F.lit(y) for y in x]), (F.pmod(F.xxhash64(F.lit("o"), "id"), F.lit(len(x))) + 1).cast("int"))
    secret = [
        cat("password=", mark(hex_(18))), cat("token = \"", mark(hex_(40)), "\""), cat(word("p"), " ", mark(cat("AKIA", F.substring(upper, 1, 16)))), mark(cat("AKIA", F.substring(upper, 3, 16))),
        cat("secret: ", mark(some(40))), cat("api_key = '", mark(some(32)), "'"), mark(cat("ghp_", F.regexp_replace(some(40), "[+/]", "x"))), cat("Bearer ", mark(some(60))), cat("pwd=", mark(some(14))), cat("key ", mark(cat("sk_live_", hex_(24)))),
        cat("password=", mark(cat(word("a"), number("n", 99)))), cat("pwd: ", mark(cat(F.initcap(word("a")), number("n", 9), "!", F.substring(letters, 1, 4)))), cat("password = \"", mark(cat(F.substring(base, 1, 5), "&", number("n", 99), "x!", F.substring(base, 9, 3))), "\""),
        cat("password=\"", mark(cat(F.lower(F.substring(letters, 1, 3)), word("a"), word("b"), word("c"))), "\""), cat("api_key=\"", mark(F.substring(letters, 1, 30)), "\""), cat("passwd: ", mark(F.substring(letters, 1, 20))), cat("secret = '", mark(F.lower(F.substring(letters, 1, 8))), "'"),
        cat("password is ", mark(cat(word("a"), number("n", 999)))), cat("DB_PASSWORD=", mark(cat(F.substring(base, 1, 4), "#", F.substring(base, 7, 4), "$"))), mark(cat("-----BEGIN RSA PRIVATE KEY-----\n", some(64), "\n-----END RSA PRIVATE KEY-----")), mark("-----BEGIN PRIVATE KEY-----"),
        cat(word("p"), "://", word("u"), ":", mark(cat(F.substring(base, 1, 4), number("n", 99), F.substring(letters, 3, 5))), "@", word("h"), ".", word("g"), ".net/", word("b")), cat("redis://:", mark(F.substring(letters, 1, 12)), "@", word("h"), ":6379"),
        mark(cat(F.substring(letters, 1, 3), number("n", 9), "$", F.lower(F.substring(letters, 4, 2)), "!", number("m", 9), F.upper(F.substring(letters, 6, 2)), "#", F.substring(letters, 9, 3))), cat("export API_TOKEN=", mark(F.substring(base, 1, 24))),
        cat("password=", mark(cat(F.lower(F.substring(letters, 1, 2)), word("a"), number("n", 9)))), cat("passwd=", mark(cat(F.lower(F.substring(letters, 1, 6)), number("n", 9)))), cat("password=", mark(cat(word("a"), word("b"), number("n", 99)))),
    ]
    plain = [
        cat("commit ", mark(hex_(40))), cat("sha256: ", mark(hex_(64))), cat("uuid ", mark(uuid)), mark(cat("/", word("a"), "/", word("b"), "/", word("c"), number("n", 999), ".", hex_(2))), mark(cat("https-", word("a"), ".", word("b"), number("n", 99), ".com/", word("c"), "/", number("m", 99999))),
        mark(cat(word("a"), "_", word("b"), "_", word("c"), "_", number("n", 9999))), mark(cat(word("a"), ".", number("n", 99), "@mail", number("m", 9), ".", word("b"), ".com")), cat("+1 (", number("n", 999), ") ", mark(cat("555-2486-", number("m", 99999)))),
        mark(cat("4", F.lpad(number("n", 999999999), 9, "3"), F.lpad(number("m", 999999), 6, "1"))), mark(cat(F.lpad(number("a", 255), 3, "1"), ".", F.lpad(number("b", 255), 3, "1"), ".", F.lpad(number("c", 255), 3, "1"), ".", number("d", 255))),
        mark(cat(word("a"), "-", word("b"), "-", number("n", 99), ".", number("m", 99), ".", number("o", 99))), cat("the ", word("u"), " header: ", mark(cat(word("a"), "-", word("b"), "-", number("n", 9999)))), cat("md5 ", mark(hex_(32))), cat("password: ", mark(word("a"))), cat("token = ", mark(word("a"))), cat("auth: ", mark(pick_of("null", "true", "none", "required", "false", "disabled", "string", "incorrect", "expired"))), cat("password=", mark(cat("${", F.upper(word("a")), "_PASSWORD}"))), cat("password: \"", mark(pick_of("********", "your password", "<password>", "xxxxxxxx", "required", "example")), "\""),
        cat("secret = ", mark(cat("os.environ[", word("a"), "]"))), cat("token: ", mark(F.substring(number("n", 9), 1, 1))), cat("token = ", mark(cat("get_", word("a"), "()"))), cat("the pass: ", mark(cat(word("a"), "ed"))),
        cat(word("p"), "://", word("u"), ":", mark(pick_of("password", "${PASS}", "<password>", "****", "8080", "pass")), "@", word("h"), ".com"), mark(cat(F.initcap(word("a")), "&", F.initcap(word("b")), number("n", 99), "!")), mark(cat(F.initcap(word("a")), "?", word("b"), number("m", 999), "&", word("c"))),
        mark(cat("20", number("a", 99), "-", number("b", 12), "-", number("c", 28), "T", number("d", 99), "Z", hex_(3))),
    ]
    pick = lambda options: F.element_at(F.array(*options), (F.pmod(F.col("id").bitwiseAND(0xFFFFFF) / 2, F.lit(len(options))) + 1).cast("int"))
    line = cat(word("x"), " ", word("y"), " ", F.when(F.col("id") % 2 == 0, pick(secret)).otherwise(pick(plain)), " ", word("z"), " ", word("w"))
    made = spark.range(rows).select("id", line.alias("line"), (F.col("id") % 2 == 0).cast("double").alias("label"))
    return made.select(F.translate("line", "\x01\x02", "").alias("text"), (F.instr("line", "\x01") - 1).alias("start"), (F.instr("line", "\x02") - 2).alias("stop"), "label")


def featured(labelled: DataFrame, dictionary: tuple[str, ...] = WORDS) -> DataFrame:
    """label and a column for each feature."""
    value = F.expr("substring(text, start + 1, stop - start)")
    before, after = F.expr(f"right(substring(text, 1, start), {NEAR})"), F.expr(f"substring(text, stop + 1, {NEAR})")
    return labelled.select("label", *[c.cast("double").alias(n) for n, c in zip(FEATURES, features(value, before, after, dictionary))])


def fitted(labelled: DataFrame, trees: int = TREES, depth: int = DEPTH, seed: int = SEED, dictionary: tuple[str, ...] = WORDS):
    """Spark ML's forest."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    table = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(featured(labelled, dictionary).coalesce(1)).select("label", "features")
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt", minInstancesPerNode=3).fit(table)


def train(labelled: DataFrame, trees: int = TREES, depth: int = DEPTH, seed: int = SEED, dictionary: tuple[str, ...] = WORDS) -> list:
    """The forest as nested tuples: a leaf's share of secrets, or (feature, threshold, below or equal, above)."""
    return written_out(fitted(labelled, trees, depth, seed, dictionary))


def written_out(model) -> list:
    def grown(node):
        if node.subtreeDepth() == 0:
            stats = list(node.impurityStats().stats())
            return stats[1] / (stats[0] + stats[1]) if len(stats) > 1 and sum(stats) else float(node.prediction())
        split = node.split()
        return (split.featureIndex(), split.threshold(), grown(node.leftChild()), grown(node.rightChild()))

    return [grown(t._java_obj.rootNode()) for t in model.trees]


def probability(forest: list, feature: Callable[[int], Column]) -> Column:
    """The trees' mean, as an expression over the features."""

    def grown(node) -> Column:
        return F.lit(float(node)) if isinstance(node, float) else F.when(feature(node[0]) <= node[1], grown(node[2])).otherwise(grown(node[3]))

    total = F.lit(0.0)
    for tree in forest:
        total = total + grown(tree)
    return total / len(forest)


def scan(text: Column, forest: list, threshold: float = THRESHOLD, dictionary: tuple[str, ...] = WORDS) -> Column:
    """Struct of items, an array of (gap, value, score, is_secret) of a text's candidates in order, gap being the text
    since the candidate before, and tail, the text behind the last; null without candidates."""

    def judged(x: Column) -> Column:
        before = F.right(F.concat(F.right(x["previous"], F.lit(NEAR)), F.right(x["gap"], F.lit(NEAR))), F.lit(NEAR))
        near = features(x["value"], before, F.left(x["after"], F.lit(NEAR)), dictionary)
        score = let(F.array(*[c.cast("double") for c in near]), lambda f: probability(forest, lambda i: f[i]))
        return let(score, lambda s: F.struct(x["gap"].alias("gap"), x["value"].alias("value"), s.alias("score"), (s >= threshold).alias("is_secret")))

    def placed(values: Column) -> Column:
        n = F.size(values)

        def around(gaps: Column) -> Column:
            rows = F.arrays_zip(values.alias("value"), F.slice(gaps, 1, n).alias("gap"), F.slice(gaps, 2, n).alias("after"), F.concat(F.array(F.lit("")), F.slice(values, 1, n - 1)).alias("previous"))
            return F.struct(F.transform(rows, judged).alias("items"), F.element_at(gaps, -1).alias("tail"))

        return let(F.split(text, CANDIDATE), around)

    return let(F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)), lambda v: F.when(F.size(v) > 0, placed(v)))


def sums_before(lengths: Column, group: int = 128) -> Column:
    """For each of an array of numbers the sum of those before it. Arrays that grow step by step are copied at each step,
    so they grow within groups only, and over the groups' sums."""
    running = lambda x, start: F.aggregate(x, F.struct(start.alias("at"), F.expr("cast(array() as array<long>)").alias("out")), lambda s, v: F.struct((s["at"] + v).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")))["out"]
    zero = F.lit(0).cast("long")

    def joined(groups: Column) -> Column:
        starts = running(F.transform(groups, lambda x: F.aggregate(x, zero, lambda s, v: s + v)), zero)
        return F.flatten(F.zip_with(groups, starts, lambda x, start: running(x, start)))

    return let(F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / group).cast("int")), lambda g: F.slice(lengths, g * group + 1, group)), joined)


def findings(documents: DataFrame, forest: list, threshold: float = THRESHOLD, dictionary: tuple[str, ...] = WORDS) -> DataFrame:
    """doc_id, start, stop, value, score, is_secret: one row for each candidate."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), scan(F.col("text"), forest, threshold, dictionary)["items"].alias("items")).where("items is not null")
    lengths = F.transform("items", lambda x: (F.length(x["gap"]) + F.length(x["value"])).cast("long"))
    rows = docs.select("doc_id", F.explode(F.arrays_zip("items", sums_before(lengths).alias("at"))).alias("f"))
    start, item = (F.col("f.at") + F.length("f.items.gap")).cast("int"), F.col("f.items")
    return rows.select("doc_id", start.alias("start"), (start + F.length(item["value"])).alias("stop"), item["value"].alias("value"), F.round(item["score"], 6).alias("score"), item["is_secret"].alias("is_secret"))


def redacted(documents: DataFrame, forest: list, threshold: float = THRESHOLD, dictionary: tuple[str, ...] = WORDS) -> DataFrame:
    """documents with each secret in text replaced by MARK; other text and columns stay as they are."""
    text = documents["text"]

    def cut(found: Column) -> Column:
        parts = F.transform(found["items"], lambda x: F.concat(x["gap"], F.when(x["is_secret"], F.lit(MARK)).otherwise(x["value"])))
        return F.array_join(F.concat(parts, F.array(found["tail"])), "")

    return documents.withColumn("text", F.coalesce(let(scan(text, forest, threshold, dictionary), cut), text))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings(spark.read.parquet(f"{sf_dir}/documents.parquet"), train(labelled_findings(spark)))
