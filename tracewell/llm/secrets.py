"""Secret scanning: candidates by pattern, false positives removed by a random forest, in DataFrame operations alone.

Candidates are long runs of characters that keys are made of. A forest of decision trees, fitted by Spark's own
DataFrame learner, looks at a candidate's length, its transitions between character classes, how much of it common
words cover, whether it stands in a path or address, and the words beside it. It is trained from labelled findings:
any table with candidate, before, after and label will do, and ``labelled_findings`` makes one.

Nulls and edge cases: a null or empty text has no findings. Texts are scanned whole. Equal secrets at several places
are findings of their own. Rows that repeat a key are scanned each. Of an unquoted assignment (NAME=value, ?name=value)
the value is the candidate and the name its context. Offsets count characters from 0. Other columns are left out of the
findings and kept by ``redact``. An empty table works.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names of secrets, by what they hold.
FOR = "token|secret|passwo?r?d|passwd|pwd|api[ _-]?key|apikey|access[ _-]?key|private|credential|auth|bearer|client[ _-]?id"
#: A candidate: 16 or more key characters with a digit, 24 or more of any kind, or right after a secret's name 8 or more
#: with a digit; with nothing of the kind before it. '=' parts a name from its value, so it only ends one, as padding.
KEY, LETTERS = "A-Za-z0-9+/_\\-", "A-Za-z+/_\\-"
NAMED = f"(?<=[=:\"'` ])(?<=(?i:{FOR})[A-Za-z0-9_\\-]{{0,16}}[\"'`]?(?: ?[=:] ?| )[\"'`]?)"
CANDIDATE = f"(?<![{KEY}])(?:(?=[{LETTERS}]*[0-9])[{KEY}]{{16,}}+|[{LETTERS}]{{24,}}+|(?=[{LETTERS}]{{0,15}}[0-9]){NAMED}[{KEY}]{{8,}}+)(?:={{1,2}}(?![{KEY}=]))?"
#: Characters of the surroundings that count as neighbouring words, before and after.
BEFORE, AFTER = 48, 24
#: Confirmed secrets up to which redaction broadcasts them; beyond, it joins.
BROADCAST_FINDINGS = 100_000
MASK = "[SECRET]"

#: Words and word parts for dictionary coverage, and neighbours that speak for or against a secret.
DICTIONARY = (
    "able access account action admin age ance and app array base block build bus cache call case cation change char check class client "
    "code column com config content control count create current data date default des die document east ein else ence end ent entre er "
    "error event example factory false field file filter for form function get handler heit her index info ing input instance int "
    "interface is item keit key lich line list load location main manager map ment message method mode model module name ness net new "
    "node null number object on option order ous page param path point process property public query que read record request resource "
    "response result return row schema schein search select server service session set source state string system table tag target "
    "task test text the time tion true type und ung update user value version view web window with work write"
).split()
AGAINST = "example|dummy|sample|placeholder|checksum|commit|sha-?1|sha-?256|md5|digest|revision|etag|uuid|hash|integrity|build|blob|tree"

FEATURES = (
    "length",
    "transitions",
    "digits",
    "uppers",
    "symbols",
    "distinct",
    "vowel_pairs",
    "longest_letters",
    "hexadecimal",
    "coverage",
    "slashes",
    "path_before",
    "path_after",
    "assigned",
    "quoted",
    "neighbours_for",
    "neighbours_against",
    "known_prefix",
)


def _count(column: Column, pattern: str) -> Column:
    return F.size(F.regexp_extract_all(column, F.lit(pattern), F.lit(0))).cast("double")


def features(candidate: Column, before: Column, after: Column) -> dict[str, Column]:
    length = F.length(candidate).cast("double")
    low, around = F.lower(candidate), F.lower(F.concat(before, F.lit(" "), after))
    words = "|".join(sorted((w for w in DICTIONARY if len(w) > 2), key=len, reverse=True))
    without = lambda pattern, of: length - F.length(F.regexp_replace(of, pattern, ""))
    runs = F.regexp_extract_all(candidate, F.lit("[A-Za-z]+"), F.lit(0))
    flag = lambda c: c.cast("double")
    return {
        "length": length,
        "transitions": (_count(candidate, "[0-9]+|[a-z]+|[A-Z]+|[^0-9A-Za-z]+") - 1) / length,
        "digits": without("[0-9]", candidate) / length,
        "uppers": without("[A-Z]", candidate) / length,
        "symbols": without("[^0-9A-Za-z]", candidate) / length,
        "distinct": F.size(F.array_distinct(F.split(candidate, ""))).cast("double") / F.least(length, F.lit(40.0)),
        "vowel_pairs": _count(low, "[aeiouy][bcdfghjklmnpqrstvwxz]") / length,
        "longest_letters": F.coalesce(F.array_max(F.transform(runs, F.length)), F.lit(0)).cast("double") / length,
        "hexadecimal": flag(low.rlike("^[0-9a-f-]+$")),
        "coverage": without(words, low) / length,
        "slashes": _count(candidate, "/"),
        "path_before": flag(F.lower(before).rlike(r"(?:https?:|www\.|[a-z]:\\|[./\\@])[^\s?&=]*$")),
        "path_after": flag(after.rlike(r"^(?:\.[A-Za-z]{2,5}\b|[/\\@?#])")),
        "assigned": flag(before.rlike(r"[=:]\s*[\"'`]?$")),
        "quoted": flag(before.rlike("[\"'`]$") & after.rlike("^[\"'`]")),
        "neighbours_for": _count(around, FOR),
        "neighbours_against": _count(around, AGAINST),
        "known_prefix": flag(candidate.rlike("^(?:AKIA|ASIA|gh[pousr]_|sk[-_]|pk[-_]|xox[abp]-|AIza|eyJ|glpat-|npm_)")),
    }


def candidates(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, start, candidate, before and after of each candidate.

    The pattern's matches and the pieces between them come from one text; lengths of both add up to the offsets."""
    rows = df.select(df[key].alias(key), df[text].cast("string").alias("_text")).where(F.col("_text").rlike(CANDIDATE))
    split = rows.select(key, F.regexp_extract_all("_text", F.lit(CANDIDATE), F.lit(0)).alias("_found"), F.split("_text", CANDIDATE, -1).alias("_between"))
    start = F.expr("""
        aggregate(sequence(0, size(_found) - 1), named_struct('at', 0, 'all', cast(array() as array<int>)), (s, i) -> named_struct(
          'at', s.at + length(_between[i]) + length(_found[i]), 'all', array_append(s.all, s.at + length(_between[i]))), s -> s.all)""")
    # a name that is long enough is a candidate itself, so what stands before takes in the candidates there
    piece = lambda of, i: F.right(F.when(i >= 0, F.get(of, i)).otherwise(""), F.lit(BEFORE))
    each = split.select(key, "_found", "_between", start.alias("_starts")).select(
        key,
        F.explode(
            F.transform(
                "_found",
                lambda c, i: F.struct(
                    F.get("_starts", i).cast("long").alias("start"),
                    c.alias("candidate"),
                    F.right(F.concat(piece("_between", i - 2), piece("_found", i - 2), piece("_between", i - 1), piece("_found", i - 1), piece("_between", i)), F.lit(BEFORE)).alias("before"),
                    F.left(F.get("_between", i + 1), F.lit(AFTER)).alias("after"),
                ),
            )
        ).alias("c"),
    )
    return each.select(key, "c.start", "c.candidate", "c.before", "c.after")


def with_features(findings: DataFrame) -> DataFrame:
    made = features(F.col("candidate"), F.col("before"), F.col("after"))
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(findings.select("*", *(made[f].alias(f) for f in FEATURES))).drop(*FEATURES)


def labelled_findings(spark: SparkSession, rows: int = 4000) -> DataFrame:
    """candidate, before, after and label of ``rows`` findings: keys in assignments and headers, and what is taken for
    them - digests of commits and files, ids, paths, addresses, long words, identifiers and fillers. The same always."""
    r = lambda salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(1 << 30))
    pick = lambda salt, *of: F.element_at(F.array(*[F.lit(x) for x in of]), (r(salt) % len(of) + 1).cast("int"))
    made = {"noise": F.concat(F.sha2(F.concat(F.lit("a"), F.col("id")), 512), F.sha2(F.concat(F.lit("b"), F.col("id")), 512))}
    noise = F.col("noise")
    hexes = lambda low, span, salt: F.substring(noise, F.lit(1), (r(salt) % span + low).cast("int"))
    made["wild"] = F.regexp_replace(F.base64(F.unhex(noise)), r"[\r\n]", "")
    wild = F.col("wild")
    base = lambda low, span, salt: F.substring(wild, F.lit(3), (r(salt) % span + low).cast("int"))
    plain = lambda low, span, salt: F.substring(F.translate(wild, "+/=", "Qx7"), F.lit(5), (r(salt) % span + low).cast("int"))
    word = lambda salt: pick(salt, *DICTIONARY)
    made["prose"] = F.concat_ws(" ", pick("p1", "there", "und", "que", "as", "los"), word("p2"), word("p3"))
    made["name"] = pick("n", "token", "api_key", "secret", "password", "access_key", "auth_token", "private_key", "TOKEN", "SECRET_KEY", "client_secret")
    prose, names = F.col("prose"), F.col("name")
    made["sign"] = pick("s", " = \"", "=\"", ": \"", " = '", "=", ": ", ":\"")
    close = F.when(F.right(F.col("sign"), F.lit(1)).isin("\"", "'"), F.right(F.col("sign"), F.lit(1))).otherwise(" ")
    kind = r("k") % 24
    secret = F.when(r("f") % 5 <= 1, hexes(32, 33, "h")).when(r("f") % 5 == 2, base(20, 45, "b")).when(r("f") % 5 == 3, plain(20, 30, "c")).otherwise(F.upper(hexes(32, 33, "h")))
    tagged = F.concat(pick("t", "AKIA", "ghp_", "sk_live_", "xoxb-", "AIza", "glpat-"), plain(16, 20, "g"))
    words = F.concat(*[word(f"w{i}") for i in range(7)])
    camel = F.concat(*[F.initcap(word(f"c{i}")) for i in range(6)])
    uuid = F.regexp_replace(F.substring(noise, 1, 32), "^(.{8})(.{4})(.{4})(.{4})", "$1-$2-$3-$4-")
    digits = F.substring(F.regexp_replace(noise, "[a-f]", ""), F.lit(1), (r("d") % 12 + 16).cast("int"))
    filler = F.when(r("x") % 2 == 0, F.repeat(pick("y", "x", "0", "a1", "-", "="), 24)).otherwise(F.concat(F.lit("your-"), names, F.lit("-goes-here-123")))
    path = F.concat_ws("/", word("q1"), word("q2"), F.concat(word("q3"), (r("q4") % 1000).cast("string")), word("q5"))
    told = pick("u", "commit ", "sha256: ", "md5sum ", "checksum=", "digest: sha256:", "revision ", "etag: \"", "integrity sha256-", "uuid ", "tree ", "build id ")
    short = F.concat(F.when(r("o") % 3 == 0, F.substring(noise, F.lit(1), (r("o1") % 8 + 7).cast("int"))).otherwise(F.substring(F.translate(wild, "+/=", "Qx7"), F.lit(5), (r("o1") % 8 + 7).cast("int"))), (r("o2") % 10).cast("string"))
    dated = F.concat(F.lit("20"), (r("m5") % 80 + 10).cast("string"), pick("m6", "-", "", "/"), F.lit("0"), (r("m7") % 9 + 1).cast("string"), pick("m6", "-", "", "/"), (r("m8") % 20 + 10).cast("string"))
    plainly = F.concat(F.initcap(word("m1")), pick("m2", "_", "-", ""), word("m3"), (r("m4") % 2000).cast("string"))
    named = F.when(r("m") % 3 == 0, dated).when(r("m") % 3 == 1, plainly).otherwise(F.lower(plainly))
    address = F.concat(pick("v", "https://host/", "https://www.", "http://"), word("v1"), F.lit("/"), word("v2"), pick("v3", "?", "?page=2&", "?q=a&lang=en&"))
    lead = F.when(r("l") % 3 == 0, address).when(r("l") % 3 == 1, F.concat(pick("l1", "PORT=80", "DEBUG=true", prose), F.lit("\n"), pick("l2", "", "export "))).otherwise(pick("l3", "", "?", "&"))
    ended = pick("z", "&page=2", "&", "\n", "\nHOST=a", " ", "")
    one = lambda c, b, a, y: F.struct(c.alias("c"), b.alias("b"), a.alias("a"), y.alias("y"))
    rows_ = (
        F.when(kind <= 6, one(secret, F.concat(prose, F.lit(" "), names, F.col("sign")), F.concat(close, prose), F.lit(1.0)))
        .when(kind == 7, one(tagged, F.concat(prose, F.lit(" ")), F.concat(F.lit(" "), prose), F.lit(1.0)))
        .when(kind == 8, one(tagged, F.concat(prose, F.lit(" "), names, F.col("sign")), F.concat(close, prose), F.lit(1.0)))
        .when(kind == 9, one(plain(24, 40, "g"), F.concat(prose, F.lit(" Authorization: Bearer ")), F.lit(" "), F.lit(1.0)))
        .when(kind <= 12, one(hexes(32, 33, "h"), F.concat(prose, F.lit(" "), told), F.concat(F.lit(" "), prose), F.lit(0.0)))
        .when(kind == 13, one(uuid, F.concat(prose, F.lit(" "), pick("i", "id=", "uuid: ", "request ", "")), F.lit(" "), F.lit(0.0)))
        .when(kind == 14, one(words, F.concat(prose, F.lit(" ")), F.concat(F.lit(" "), prose), F.lit(0.0)))
        .when(kind == 15, one(camel, F.concat(prose, F.lit(" "), pick("i", "new ", "class ", "token = ", "x = \"")), F.lit("("), F.lit(0.0)))
        .when(kind == 16, one(digits, F.concat(prose, F.lit(" "), pick("i", "order ", "id: ", "no. ", "")), F.concat(F.lit(" "), prose), F.lit(0.0)))
        .when(kind == 17, one(path, F.concat(prose, F.lit(" "), pick("i", "https://www.", "/usr/", "./", "see ")), pick("j", ".html", ".py", "/", " "), F.lit(0.0)))
        .when(kind == 18, one(filler, F.concat(names, F.col("sign")), close, F.lit(0.0)))
        .when(kind == 19, one(short, F.concat(prose, F.lit(" "), names, F.col("sign")), F.concat(close, prose), F.lit(1.0)))
        .when(kind == 20, one(named, F.concat(prose, F.lit(" "), names, F.col("sign")), F.concat(pick("j1", "(", ".", "[", " "), prose), F.lit(0.0)))
        .when(kind == 21, one(F.when(r("o3") % 3 == 0, short).when(r("o3") % 3 == 1, tagged).otherwise(secret), F.concat(lead, names, F.lit("=")), ended, F.lit(1.0)))
        .when(kind == 22, one(F.when(r("o3") % 3 == 0, uuid).when(r("o3") % 3 == 1, digits).otherwise(hexes(32, 33, "h")), F.concat(lead, pick("u1", "id=", "commit=", "checksum=", "sha256=", "uuid=", "v=", "build=")), ended, F.lit(0.0)))
        .otherwise(one(F.substring(noise, 1, 40), F.concat(prose, F.lit(" "), pick("i", "https://host/", "blob/", "@", "/")), pick("j", ".tar", "/", ".js"), F.lit(0.0)))
    )
    ids = spark.range(0, rows, 1, 1).select(F.col("id").cast("string").alias("id"))
    for column, of in made.items():  # columns, as the branches would repeat them
        ids = ids.withColumn(column, of)
    return ids.select(rows_.alias("f")).select(F.col("f.c").alias("candidate"), F.col("f.b").alias("before"), F.col("f.a").alias("after"), F.col("f.y").alias("label"))


def train(findings: DataFrame, trees: int = 40, depth: int = 8) -> RandomForestClassificationModel:
    """Fits the forest on candidate, before, after and label; the learner samples with a fixed seed."""
    learner = RandomForestClassifier(numTrees=trees, maxDepth=depth, featureSubsetStrategy="sqrt", seed=7, featuresCol="features", labelCol="label")
    return learner.fit(with_features(findings))


def scan(df: DataFrame, key: str, text: str, model: RandomForestClassificationModel | None = None, threshold: float = 0.5) -> DataFrame:
    """key, start, length, candidate and score of the secrets: candidates that the forest gives ``threshold`` or more."""
    model = model or train(labelled_findings(df.sparkSession))
    scored = model.transform(with_features(candidates(df, key, text)))
    score = vector_to_array("probability")[1]
    return scored.select(key, "start", F.length("candidate").cast("long").alias("length"), "candidate", score.alias("score")).where(F.col("score") >= threshold)


def redact(df: DataFrame, key: str, text: str, model: RandomForestClassificationModel | None = None) -> DataFrame:
    """``df`` with each secret in its text replaced by MASK.

    Findings are gathered by a hash of the text they stand in, not by key: rows may share a key or have none, and equal
    texts have the same findings, each once."""
    from tracewell.llm.storage import written

    taken = {c.lower() for c in df.columns}
    own, spans = (next(n for n in (f"{name}{i}" for i in range(len(taken) + 1)) if n not in taken) for name in ("_key", "_spans"))
    same = F.sha2(df[text].cast("string").cast("binary"), 256)
    found = scan(df.select(same.alias(own), df[text].alias("_scanned")), own, "_scanned", model)
    found = written(found.groupBy(own).agg(F.reverse(F.array_sort(F.collect_set(F.struct("start", "length")))).alias(spans)), "secrets")
    if found.count() <= BROADCAST_FINDINGS:
        found = F.broadcast(found)
    cleaned = F.expr(f"aggregate(coalesce({spans}, array()), `{text}`, (t, s) -> overlay(t placing '{MASK}' from cast(s.start as int) + 1 for cast(s.length as int)))")
    return df.join(found, same == F.col(own), "left").select(*[cleaned.alias(c) if c == text else df[c] for c in df.columns])
