"""Secret scans: candidates by pattern, false positives removed by a random forest.

Candidates are long runs of key characters with a digit, those of letters alone after a secret word and an
assignment, private-key blocks up to their END line and values after a password word in any letter case. Features of a candidate: its length and share of digits, letter-case and class transitions, distinct
characters, coverage by dictionary words, path context, and neighbouring words. The forest is trained
(MLlib, in the JVM) on labelled findings, exported as nested CASE expressions and applied to each
candidate inside its row. A cheap search first rules out texts without any: the scan is one narrow pass with no shuffle, join or Python.

Defined cases: null and empty texts have no candidates; repeated candidates are findings of their own,
in order; very long texts are scanned whole; an empty table gives an empty result. ``scan_secrets`` adds
column ``findings`` (replacing one of that name) and ``redact_secrets`` rewrites the text; other columns are kept, whatever
their names; a score equal to the threshold counts as a secret.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeline.llm.common import Hidden

RUN = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{16,}={0,2}"
#: Loops are possessive: no length limit, and neither stack nor going back over a text.
LABEL = r"[A-Z0-9 ]{0,40}PRIVATE KEY(?: BLOCK)?-----"
PEM = f"-----BEGIN {LABEL}[^-]*+(?:-(?!----(?:BEGIN|END) )[^-]*+)*+-----END {LABEL}"
#: The short looks ahead and back come first, as they fail soon at most places.
PASSWORD = r"(?<=[:=>\"' ])(?=[^\s\"']{6})(?<=(?i:password|passwd|pwd)[\"' ]{0,2}(?::=|=>|[:=])[\"' ]{0,2})[^\s\"']{6,}"
ASSIGNED = r"(?<=[:=>\"'`\s])(?=[A-Za-z0-9+/_-]{16})(?<=(?i:secret|token|api[ _-]?key|auth|credential|access[ _-]?key|private[ _-]?key)[A-Za-z0-9_-]{0,12}[\"'`]?\s{0,2}(?::=|=>|[:=])\s{0,2}[\"'`]?|(?i:bearer)\s)[A-Za-z0-9+/_-]{16,}={0,2}"
CANDIDATE = f"{PEM}|{PASSWORD}|{ASSIGNED}|{RUN}"
#: Every candidate's text has one of these: a long run, a key's label or a password word. Most texts have none, and are searched no further.
ANY = "(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16}|PRIVATE KEY|[Pp](?i:assw|wd)"
#: Words that make a candidate look like prose, a path or a placeholder.
DICTIONARY = ["the", "and", "ing", "tion", "example", "test", "user", "name", "data", "file", "home", "page", "index", "image", "version", "release", "build", "docs", "your", "here", "key", "static", "assets", "content", "article", "sample", "dummy", "changeme", "placeholder", "xxxx", "abcd", "1234"]
SECRET_WORDS = r"(?i)(token|secret|passw|pwd|api.?key|apikey|auth|credential|bearer|access.?key|private)"
PUBLIC_WORDS = r"(?i)(commit|sha1|sha256|md5|checksum|digest|hash|uuid|guid|isbn|order|invoice|phone|card|account|iban|integrity|etag|revision)"
FEATURES = ["length", "digits", "transitions", "distinct", "coverage", "path", "secret_near", "public_near", "assigned", "hex", "only_digits", "block"]
MASK = "[SECRET]"


def features(cand: Column, before: Column, after: Column) -> dict[str, Column]:
    n = F.length(cand).cast("double")
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(cand, "[a-z]", "a"), "[A-Z]", "b"), "[0-9]", "0"), "[^ab0]", "-")
    runs = F.length(F.regexp_replace(kinds, r"(.)\1*", "$1"))
    rest = F.regexp_replace(F.lower(cand), "|".join(DICTIONARY), "")
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    return {
        "length": F.least(n, F.lit(200.0)),
        "digits": F.length(F.regexp_replace(cand, "[^0-9]", "")) / n,
        "transitions": (runs - 1) / n,
        "distinct": F.size(F.array_distinct(F.split(cand, ""))) / F.least(n, F.lit(64.0)),
        "coverage": (n - F.length(rest)) / n,
        "path": flag(F.substring(cand, 1, 1).isin("/") | before.rlike(r"[/.?&]$") | (F.length(F.regexp_replace(cand, "[^/]", "")) >= 2) | before.rlike(r"://\S*$")),
        "secret_near": flag(before.rlike(SECRET_WORDS)),
        "public_near": flag(before.rlike(PUBLIC_WORDS) | after.rlike(PUBLIC_WORDS)),
        "assigned": flag(before.rlike(r"[:=]\s*[\"'`]?$")),
        "hex": flag(cand.rlike(r"^[0-9a-fA-F]+$")),
        "only_digits": flag(cand.rlike(r"^[0-9+/_-]+$")),
        "block": flag(cand.startswith("-----BEGIN ")),
    }


def labelled_findings(spark: SparkSession, n: int = 4000) -> DataFrame:
    """Labelled findings (candidate, before, after, label), made from numbered digests: keys and passwords in
    assignments against digests, identifiers, numbers, paths, placeholders and joined words."""
    h = "sha2(cast({} as string), 256)"
    a, b = h.format("id"), h.format("id + 1000000")
    mixed = f"substring(regexp_replace(concat(base64(unhex({a})), base64(unhex({b}))), '[=]', ''), 1, 20 + id % 24)"
    word = "element_at(array('{}'), cast(1 + pmod(id * {} + {}, {}) as int))"
    some = lambda words, k, c: word.format("','".join(words), k, c, len(words))
    prose = some(["the tion and ", "le de ouvi ", "under Stelle war ", "la ciónque ", "in that, ", "ers. "], 7, 3)
    keys = some(["token", "secret", "api_key", "auth_token", "client_secret", "access_key", "password", "API key", "bearer"], 5, 1)
    publics = some(["commit ", "sha256: ", "md5=", "checksum ", "uuid ", "order ", "invoice no. ", "card ", "etag: "], 5, 2)
    sign = some([" = \"", ": ", "=", " := \"", "\": \""], 3, 1)
    kinds = [
        (f"substring({a}, 1, 32 + 8 * (id % 3))", f"concat({prose}, {keys}, {sign})", 1), (mixed, f"concat({prose}, {keys}, {sign})", 1),
        (f"concat('AKIA', upper(substring({a}, 1, 16)))", f"concat({prose}, {keys}, {sign})", 1), (f"concat('ghp_', {mixed})", prose, 1),
        (f"concat(substring(base64(unhex({a})), 1, 8 + id % 6), '9!')", "concat('user x password', '=')", 1), (mixed, prose, 1),
        (f"substring({a}, 1, 40)", f"concat({prose}, {publics})", 0), (f"lpad(cast(pmod(id * 7919317, 10000000) * 9973 as string), 16 + id % 4, '4')", prose, 0),
        (f"concat('/static/assets/', substring({a}, 1, 12), '/index')", prose, 0), ("concat('example_placeholder_key_', id % 10)", f"concat({keys}, {sign})", 0),
        ("concat('thetionandthehome', id % 100, 'ing')", prose, 0), (f"concat(substring({a},1,8),'-',substring({a},9,4),'-',substring({a},13,4),'-',substring({a},17,12))", f"concat({prose}, {publics})", 0),
        (f"concat('en/', id, '/', substring({a}, 1, 10), '/page')", "concat('see https://www.site.org/')", 0), (f"substring({a}, 1, 64)", f"concat({prose}, {publics})", 0),
        ("concat('xxxxxxxxxxxxxxxxxxxx1234', id % 10)", f"concat({keys}, {sign})", 0), ("concat('your_api_key_goes_here_', id % 10)", f"concat({keys}, {sign})", 0),
    ]
    letters = f"substring(translate({mixed}, '0123456789+/', 'kQzBvXwTnLpR'), 1, 18 + id % 14)"
    body = f"regexp_replace(repeat(concat(base64(unhex({a})), '\n', base64(unhex({b})), '\n'), cast(4 + id % 30 as int)), '=', 'Q')"
    made_up = some(["hunter", "correct", "Winter", "letmein", "dragon", "s3cr3t"], 3, 1)
    names = some(["DB_PASSWORD=", "Password: ", "PASSWD=", "\"password\": \"", "pwd="], 5, 2)
    plain = some(["required", "forgotten", "must have eight", "incorrect", "protected", "optional"], 7, 1)
    lower = some(["internationalization", "authentication-service", "configuration_manager", "representative-of-the-house", "responsibilities"], 3, 2)
    kinds += [
        (letters, f"concat({prose}, {keys}, {sign})", 1), (f"concat('-----BEGIN PRIVATE KEY-----\n', {body}, '-----END PRIVATE KEY-----')", prose, 1),
        (f"concat('-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,', upper(substring({b}, 1, 32)), '\n\n', {body}, '-----END RSA PRIVATE KEY-----')", f"concat({prose}, {keys}, {sign})", 1),
        (f"concat({made_up}, substring({a}, 1, 1 + id % 4), pmod(id * 31, 97), element_at(array('!', '#', '', 'secret!'), cast(1 + id % 4 as int)))", f"concat('x ', {names})", 1),
        (plain, f"concat({prose}, {names})", 0), (lower, f"concat({prose}, {keys}, {sign})", 0),
        (f"concat('/', repeat(concat('archive-', id % 90, '/docs/'), cast(3 + id % 12 as int)), substring({a}, 1, 8))", prose, 0),
    ]
    each = max(1, n // len(kinds))
    made = [spark.range(i * each, (i + 1) * each, 1, 1).select(F.expr(c).alias("candidate"), F.expr(p).alias("before"), F.lit(" and so ").alias("after"), F.lit(float(y)).alias("label")) for i, (c, p, y) in enumerate(kinds)]
    return reduce(DataFrame.unionByName, made)


def _tree(node, column) -> Column:
    if node.getClass().getSimpleName() == "LeafNode":
        stats = [float(x) for x in node.impurityStats().stats()]
        return F.lit(stats[1] / sum(stats))
    split = node.split()
    return F.when(column(split.featureIndex()) <= F.lit(float(split.threshold())), _tree(node.leftChild(), column)).otherwise(_tree(node.rightChild(), column))


class SecretForest:
    """A random forest as a Column expression; ``findings`` are labelled rows (candidate, before, after, label)."""

    def __init__(self, findings: DataFrame, *, trees: int = 20, depth: int = 6, seed: int = 11):
        named = features(F.col("candidate"), F.col("before"), F.col("after"))
        data = VectorAssembler(inputCols=FEATURES, outputCol="x").transform(findings.select("label", *[named[k].cast("double").alias(k) for k in FEATURES]))
        data = data.select("label", "x").coalesce(2).persist()  # the labelled findings are few, and each level of the trees reads them
        model = RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=trees, maxDepth=depth, seed=seed).fit(data)
        data.unpersist()
        self.roots = [t._call_java("rootNode") for t in model.trees]

    def score(self, made: Column) -> Column:
        """made: a struct of the features, made once."""
        votes = [_tree(r, lambda i: made[FEATURES[i]]) for r in self.roots]
        return reduce(lambda a, b: a + b, votes) / float(len(votes))


def _scanned(docs: DataFrame, forest: SecretForest, text_col: str, threshold: float) -> DataFrame:
    """``_found`` and ``_parts`` (the candidates, and what stands around them) and ``findings``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.withColumn("_found", F.when(text.rlike(ANY), F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0))).otherwise(F.array().cast("array<string>")))
    rows = rows.withColumn("_parts", F.when(F.size("_found") > 0, F.split(text, CANDIDATE)).otherwise(F.array().cast("array<string>")))

    def one(c, i):
        before, after = F.get("_parts", i), F.coalesce(F.get("_parts", i + 1), F.lit(""))
        start = F.aggregate(F.sequence(F.lit(0), i), F.lit(1).cast("long"), lambda s, j: s + F.length(F.get("_parts", j)) + F.when(j < i, F.length(F.get("_found", j))).otherwise(0))
        named = features(c, F.substring(before, -40, 40), F.substring(after, 1, 24))
        return F.struct(start.alias("start"), c.alias("candidate"), F.struct(*[named[k].cast("double").alias(k) for k in FEATURES]).alias("f"))

    rows = rows.withColumn("_made", F.transform("_found", one))
    judged = F.transform("_made", lambda m: F.struct(m["start"].alias("start"), m["candidate"].alias("candidate"), forest.score(m["f"]).alias("score")))
    rows = rows.withColumn("_judged", judged)
    final = F.transform("_judged", lambda m: F.struct(m["start"].alias("start"), m["candidate"].alias("candidate"), m["score"].alias("score"), (m["score"] >= threshold).alias("is_secret")))
    return rows.withColumn("findings", final)


def scan_secrets(docs: DataFrame, forest: SecretForest, *, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """All columns with ``findings``: array of (start, candidate, score, is_secret); start counts characters from 1."""
    own = Hidden(docs)
    return own.show(_scanned(own.df, forest, own[text_col], threshold), findings=F.col("findings"))


def redact_secrets(docs: DataFrame, forest: SecretForest, *, text_col: str = "text", threshold: float = 0.5, length_col: str | None = None) -> DataFrame:
    """The same rows with each secret replaced by ``[SECRET]``; rejected candidates stay. length_col is set to the new length where given."""
    own = Hidden(docs)
    text = F.col(own[text_col])
    rows = _scanned(own.df, forest, own[text_col], threshold)
    kept = F.transform("_parts", lambda p, i: F.concat(p, F.when(i < F.size("findings"), F.when(F.get("findings", i)["is_secret"], F.lit(MASK)).otherwise(F.get("findings", i)["candidate"])).otherwise("")))
    rows = rows.withColumn("new", F.when(F.exists("findings", lambda x: x["is_secret"]), F.array_join(kept, "")).otherwise(text))
    put = {text_col: F.col("new")}
    if length_col:
        put[length_col] = F.when(F.exists("findings", lambda x: x["is_secret"]), F.length("new").cast("long")).otherwise(F.col(own[length_col]))
    return own.show(rows, put=put)


def op8_scan_secrets(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = scan_secrets(docs, SecretForest(labelled_findings(spark)))
    rows = found.select("doc_id", F.posexplode("findings").alias("finding", "x"))
    return rows.select("doc_id", "finding", F.col("x.start").alias("start"), F.length("x.candidate").alias("length"), F.col("x.candidate").alias("candidate"), F.col("x.score").alias("score"), F.col("x.is_secret").alias("is_secret"))
