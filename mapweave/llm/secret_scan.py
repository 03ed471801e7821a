"""Secret scanning with a random forest against false findings, with DataFrame functions only.

Candidates are long runs of letters, digits and signs that hold a digit, values assigned to words such as `password`, bearer tokens, and
private key blocks. Each has features: length, shares of character kinds and of each change from kind to kind, how likely its
neighbouring characters are by those of the dictionary, distinct characters, coverage by the dictionary (the `WORDS` words most frequent in all
documents), signs of a path or address, known prefixes and neighbouring words. A random forest trained from labelled findings decides which
candidates are secrets. The forest is turned into an SQL expression, so that texts are scored where they are: no row is
exploded, shuffled or handed to Python. Each text is searched once: the pattern marks its candidates, and the marked text is split at the marks.

Labelled findings: pass a table with the columns before, candidate, after, label (0 or 1). Without one, `labelled_findings` makes some by
rule (a fixed number, of which a share has wrong labels); `held_out` gives precision and recall on such findings that the forest hasn't
seen, which says how well it learns, not how well the rules match the world. Rows with a null candidate or label are ignored. If only one
label is there, every candidate gets it.

Results: null texts count as empty and have no candidates; texts and candidates of any length are taken whole. Offsets count characters. Ties in
the vote (one half) count as secrets. Equal texts get equal findings; repeated rows are independent. Extra columns pass through, and
the new columns replace columns of the same name.
"""

import math
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mapweave.llm.common import free_name, stored

#: Words that announce a secret, and words that announce a digest or a number; fixed values.
SECRET_WORDS = ["password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "api-key", "access_key", "auth", "credential", "private_key"]
HARMLESS_WORDS = ["sha1", "sha256", "md5", "commit", "checksum", "digest", "uuid", "order", "invoice", "isbn", "phone", "version", "revision", "page", "card"]
PREFIXES = ["AKIA", "ASIA", "ghp_", "gho_", "ghs_", "github_pat_", "glpat-", "xoxb-", "xoxp-", "sk_live_", "sk-", "AIza", "eyJ", "-----BEGIN"]

_ASSIGNED = "(?i:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credentials?|auth|authorization)[\"']?[ ]{0,2}[:=][ ]{0,2}(?:(?i:bearer|basic)[ ])?[\"']?"
#: The plain tests that come first keep the costly look-behinds off most places.
CANDIDATE = (
    "-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----(?:\\s*+[A-Za-z][A-Za-z0-9-]*+:[^\r\n]*+)*+[A-Za-z0-9+/=\\s]*+-----END [A-Z ]{0,30}PRIVATE KEY-----"
    f"|(?<=[:= \"'])(?:(?<=[:=][ ]{{0,2}}(?:(?i:bearer|basic)[ ])?[\"']?)(?<={_ASSIGNED})(?!(?i:bearer|basic)[ ])[^\\s\"'<>,;]{{6,}}+|(?<=(?i:bearer)[ ])[A-Za-z0-9_+/.=-]{{15,}}+)"
    "|(?<![A-Za-z0-9_+/.-])(?=[A-Za-z0-9_+/.-]{15})(?:(?:AKIA|ASIA|AIza|eyJ|gh[pos]_|github_pat_|glpat-|xox[bp]-|sk_live_|sk-)[A-Za-z0-9_+/.-]{15,}[A-Za-z0-9_+/]={0,2}"
    "|(?=[A-Za-z_+/.-]*+[0-9])[A-Za-z0-9_+/.-]{15,}[A-Za-z0-9_+/]={0,2})"
)
FEATURES = ["length", "digits", "upper", "lower", "signs", "digit_letter", "letter_digit", "lower_upper", "upper_lower", "likelihood", "distinct", "coverage", "numeric", "hex", "path", "address", "prefix", "announced", "harmless", "assigned"]
#: Words of the dictionary, a few tens of kB that go to the tasks with the plan.
WORDS = 2000
#: Stands around candidates; texts that hold it are searched twice instead.
_MARK = "\x01"
_KINDS = 28  # letters, a digit, anything else
COLUMNS = ["n_candidates", "findings", "redacted"]
MASK = "[SECRET]"


def dictionary(docs: DataFrame, text: str, words: int = WORDS) -> list[str]:
    """The most frequent words of 4 to 12 small letters in all documents; ties in order."""
    each = docs.select(F.explode(F.split(F.lower(F.col(text).cast("string")), "[^\\p{L}]+")).alias("w")).where("length(w) between 4 and 12")
    rows = each.groupBy("w").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "w").limit(words).collect()
    return sorted(r["w"] for r in rows)


def transitions(words: list[str]) -> list[float]:
    """log p(kind of a character | kind before), over the words with their ends, smoothed by one."""
    seen = [[1.0] * _KINDS for _ in range(_KINDS)]
    kind = lambda c: ord(c) - 97 if "a" <= c <= "z" else 26 if "0" <= c <= "9" else 27
    for w in words:
        for x, y in zip(" " + w, w + " "):
            seen[kind(x)][kind(y)] += 1
    return [math.log(v / sum(row)) for row in seen for v in row]


def _likelihood(candidate: Column, table: Column) -> Column:
    """The mean of the transitions' logarithms, in one walk over the characters."""
    code = lambda c: F.ascii(c)
    kind = lambda c: F.when(code(c).between(97, 122), code(c) - 97).when(code(c).between(48, 57), 26).otherwise(27)
    start = F.struct(F.lit(_KINDS - 1).alias("last"), F.lit(0.0).alias("sum"), F.lit(0).alias("n"))
    walk = lambda s, c: F.struct(kind(c).alias("last"), (s["sum"] + F.get(table, s["last"] * _KINDS + kind(c))).alias("sum"), (s["n"] + 1).alias("n"))
    return F.aggregate(F.split(F.lower(candidate), ""), start, walk, lambda s: s["sum"] / F.greatest(s["n"], F.lit(1)))


def features(before: Column, candidate: Column, after: Column, words: list[str]) -> Column:
    """An array of doubles in the order of FEATURES. `before` and `after` are the neighbouring texts."""
    n = F.greatest(F.length(candidate), F.lit(1)).cast("double")
    count = lambda pattern: F.regexp_count(candidate, F.lit(pattern)).cast("double")
    near = F.lower(before)
    said = lambda names: near.rlike("(?:" + "|".join(map(re.escape, names)) + ")[^a-z0-9]{0,8}$").cast("double")
    parts = F.regexp_extract_all(candidate, F.lit("[A-Z]?[a-z]{3,}|[A-Z]{4,}"), F.lit(0))
    covered = F.aggregate(F.filter(parts, lambda w: F.lower(w).isin(words)), F.lit(0.0), lambda a, w: a + F.length(w)) if words else F.lit(0.0)
    table = F.split(F.lit(" ".join(f"{v:.4f}" for v in transitions(words))), " ").cast("array<double>")  # folded to a constant
    return F.array(
        F.least(n, F.lit(200.0)),
        count("[0-9]") / n,
        count("[A-Z]") / n,
        count("[a-z]") / n,
        count("[^A-Za-z0-9]") / n,
        count("[0-9](?=[A-Za-z])") / n,
        count("[A-Za-z](?=[0-9])") / n,
        count("[a-z](?=[A-Z])") / n,
        count("[A-Z](?=[a-z])") / n,
        _likelihood(candidate, table),
        F.size(F.array_distinct(F.split(candidate, ""))) / n,
        covered / n,
        candidate.rlike("^[0-9.+-]+$").cast("double"),
        candidate.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$").cast("double"),
        count("/") + before.rlike("/$").cast("double"),
        (candidate.rlike("\\.[A-Za-z]{2,6}$") | before.rlike("@$") | after.rlike("^@") | near.rlike("https?:[^ ]*$")).cast("double"),
        candidate.rlike("^(?:" + "|".join(map(re.escape, PREFIXES)) + ")").cast("double"),
        said([f"{w}" for w in SECRET_WORDS]),
        said(HARMLESS_WORDS),
        before.rlike("[:=] {0,2}(?:(?i:bearer|basic) )?[\"']?$").cast("double"),
    )


def labelled_findings(spark: SparkSession, rows: int = 4000, noise: float = 0.02) -> DataFrame:
    """Findings with labels, made by rule: kinds of secrets and of harmless strings in turn, with digits and letters from hashes. A share `noise` of
    the labels is wrong, as labels by hand are; true_label has none of that."""
    r = spark.range(0, rows, 1, 1)
    hexes = F.concat(F.sha2(F.col("id").cast("string").cast("binary"), 256), F.sha2(F.concat(F.lit("b"), F.col("id").cast("string")).cast("binary"), 256))
    b64 = F.regexp_replace(F.base64(F.unhex(hexes)), "[^A-Za-z0-9]", "x")
    digits = F.translate(hexes, "abcdef", "012345")
    word = lambda k: F.element_at(F.array(*map(F.lit, ("server", "index", "report", "module", "section", "backup", "license", "archive"))), (F.floor(F.col("id") / k) % 8 + 1).cast("int"))
    secret_word = F.element_at(F.array(*map(F.lit, SECRET_WORDS)), (F.floor(F.col("id") / 3) % len(SECRET_WORDS) + 1).cast("int"))
    harmless = F.element_at(F.array(*map(F.lit, HARMLESS_WORDS)), (F.floor(F.col("id") / 3) % len(HARMLESS_WORDS) + 1).cast("int"))
    cut = lambda c, low, step: F.substring(c, F.lit(1), (F.col("id") % step + low).cast("int"))
    plain, sep = F.concat(word(5), F.lit(" ")), F.element_at(F.array(*map(F.lit, ("=", " = \"", ": ", ":'"))), (F.col("id") % 4 + 1).cast("int"))
    assigned = F.concat(secret_word, sep)
    kinds = [  # before, candidate, label
        (plain, F.concat(F.lit("AKIA"), F.upper(F.substring(b64, 1, 16))), 1),
        (plain, F.concat(F.lit("ghp_"), F.substring(b64, 1, 36)), 1),
        (plain, F.concat(F.element_at(F.array(*map(F.lit, ("xoxb-", "sk_live_", "sk-", "glpat-", "AIza"))), (F.col("id") % 5 + 1).cast("int")), cut(b64, 20, 20)), 1),
        (assigned, cut(hexes, 12, 40), 1),
        (assigned, cut(b64, 8, 36), 1),
        (assigned, F.concat(word(7), cut(digits, 4, 4)), 1),
        (F.concat(plain, assigned), F.upper(cut(hexes, 16, 30)), 1),
        (plain, F.concat(F.lit("eyJ"), cut(b64, 40, 40), F.lit("."), F.substring(hexes, 1, 30)), 1),
        (F.concat(plain, F.lit("Authorization: Bearer ")), F.regexp_replace(cut(b64, 24, 30), "[0-9]", "q"), 1),
        (plain, F.concat(F.lit("-----BEGIN PRIVATE KEY-----\n"), b64, F.lit("\n-----END PRIVATE KEY-----")), 1),
        (assigned, F.concat(word(7), word(11)), 0),
        (plain, cut(digits, 16, 6), 0),
        (F.concat(harmless, F.lit(" ")), cut(digits, 16, 10), 0),
        (F.concat(harmless, sep), F.substring(hexes, 1, 40), 0),
        (F.concat(harmless, F.lit(" ")), F.substring(hexes, 1, 32), 0),
        (F.concat(word(5), F.lit("/")), F.concat(word(3), F.lit("/"), word(11), cut(digits, 1, 5), F.lit("/"), word(2), F.lit(".html")), 0),
        (F.concat(plain, F.lit("https://")), F.concat(word(3), F.lit("."), word(2), F.lit("/"), word(13), cut(digits, 1, 6)), 0),
        (plain, F.concat(word(3), F.lit("_"), word(2), F.lit("_"), word(9), cut(digits, 1, 3)), 0),
        (plain, F.concat(cut(digits, 1, 3), F.lit("."), F.substring(digits, 5, 3), F.lit("."), F.substring(digits, 9, 3), F.lit("."), F.substring(digits, 13, 5)), 0),
        (plain, F.concat(word(3), F.lit("."), word(2), cut(digits, 1, 3), F.lit(".example.com")), 0),
        (plain, F.concat(F.substring(hexes, 1, 8), F.lit("-"), F.substring(hexes, 9, 4), F.lit("-"), F.substring(hexes, 13, 4), F.lit("-"), F.substring(hexes, 17, 12)), 0),
        (plain, F.concat(word(3), F.lit("-"), word(2), F.lit("-"), cut(digits, 4, 3)), 0),
        (plain, F.concat(F.lit("20"), F.substring(digits, 1, 2), F.lit("-0"), F.substring(digits, 3, 1), F.lit("-1"), F.substring(digits, 4, 1), F.lit("T"), F.substring(digits, 5, 6)), 0),
    ]
    k = (F.col("id") % len(kinds)).cast("int")
    pick = lambda j: F.coalesce(*[F.when(k == i, x[j] if j < 2 else F.lit(x[j])) for i, x in enumerate(kinds)])  # noqa: E731  only one is made
    wrong = F.pmod(F.xxhash64(F.lit(6), "id"), F.lit(10_000)) < int(noise * 10_000)
    return r.select(pick(0).alias("before"), pick(1).alias("candidate"), F.lit("").alias("after"), F.when(wrong, 1 - pick(2)).otherwise(pick(2)).alias("label"), pick(2).alias("true_label"))


def train(labelled: DataFrame, words: list[str], trees: int = 24, depth: int = 6, seed: int = 11) -> Callable[[Column], Column]:
    """The forest as a function of an array of features: the share of trees that vote for a secret; 0 without labels."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector

    rows = stored(labelled.where("candidate IS NOT NULL AND label IN (0, 1)").select("before", "candidate", "after", "label"))  # made once
    x = stored(rows.select(features(F.coalesce("before", F.lit("")), F.col("candidate"), F.coalesce("after", F.lit("")), words).alias("x"), F.col("label").cast("double").alias("label")))
    found = {r["label"] for r in x.select("label").distinct().collect()}
    if len(found) < 2:
        return lambda x: F.lit(max(found, default=0.0))
    model = RandomForestClassifier(featuresCol="v", numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="onethird").fit(x.orderBy("x", "label").coalesce(1).select(array_to_vector("x").alias("v"), "label"))
    return _votes(model.toDebugString, len(model.trees))


def _votes(text: str, trees: int) -> Callable[[Column], Column]:
    """The trees of a forest's description, as SQL conditions."""
    lines = [x.strip() for x in text.splitlines()[1:] if x.strip()]

    def node(it):
        line = next(it)
        if m := re.match(r"Predict: ([\d.]+)", line):
            return float(m[1])
        feature, bound = re.match(r"If \(feature (\d+) <= ([-\d.E]+)\)", line).groups()
        left = node(it)
        next(it)  # Else
        return int(feature), float(bound), left, node(it)

    it, roots = iter(lines), []
    for line in it:
        if not line.startswith("Tree"):
            raise ValueError(line)
        roots.append(node(it))
    if len(roots) != trees:
        raise ValueError("a tree is missing")

    def said(x: Column, n) -> Column:
        return F.lit(n) if isinstance(n, float) else F.when(F.get(x, F.lit(n[0])) <= n[1], said(x, n[2])).otherwise(said(x, n[3]))

    return lambda x: sum((said(x, r) for r in roots[1:]), said(x, roots[0])) / len(roots)


def held_out(spark: SparkSession, words: list[str], labelled: DataFrame | None = None, cut: float = 0.5) -> DataFrame:
    """precision and recall of the forest on every fourth finding (by a hash of the candidate), learned from the others."""
    rows = stored(labelled_findings(spark) if labelled is None else labelled)
    unseen = F.pmod(F.xxhash64(F.lit(2), "before", "candidate"), F.lit(4)) == 0
    votes = train(rows.where(~unseen), words)
    said = rows.where(unseen).select(votes(features(F.coalesce("before", F.lit("")), F.col("candidate"), F.coalesce("after", F.lit("")), words)).alias("v"), F.col("true_label" if "true_label" in rows.columns else "label").alias("label"))
    hit = F.count_if((F.col("v") >= cut) & (F.col("label") == 1))
    return said.agg(F.count("*").alias("findings"), (hit / F.count_if(F.col("v") >= cut)).alias("precision"), (hit / F.count_if(F.col("label") == 1)).alias("recall"))


def scan(docs: DataFrame, labelled: DataFrame | None = None, text: str = "text", cut: float = 0.5, words: list[str] | None = None) -> DataFrame:
    """All columns of `docs` and n_candidates, findings (start, end, score of each secret) and redacted (the text with secrets masked)."""
    words = dictionary(docs, text) if words is None else words
    votes = train(labelled_findings(docs.sparkSession) if labelled is None else labelled, words)
    kept = [c for c in docs.columns if c.lower() not in COLUMNS]
    t, parts, cands, segs, f, scores = (free_name(docs, x) for x in ("scan_text", "scan_parts", "scan_candidates", "scan_segments", "scan_features", "scan_scores"))
    out = docs.select(*[F.col(f"`{c}`") for c in kept], F.coalesce(F.col(text).cast("string"), F.lit("")).alias(t))
    # segments and candidates in turn
    found = F.regexp_extract_all(t, F.lit(CANDIDATE), F.lit(0))
    twice = F.flatten(F.zip_with(F.split(t, CANDIDATE, -1), found, lambda x, c: F.when(c.isNull(), F.array(x)).otherwise(F.array(x, c))))
    once = F.split(F.regexp_replace(t, CANDIDATE, f"{_MARK}$0{_MARK}"), _MARK, -1)
    out = out.withColumn(parts, F.when(F.contains(t, F.lit(_MARK)), twice).otherwise(once))
    any_ = F.size(parts) > 1
    none = F.array().cast("array<string>")
    out = out.withColumn(cands, F.when(any_, F.filter(parts, lambda x, i: i % 2 == 1)).otherwise(none))
    out = out.withColumn(segs, F.when(any_, F.filter(parts, lambda x, i: i % 2 == 0)))
    feature = F.transform(F.col(cands), lambda c, i: features(F.substring(F.get(F.col(segs), i), -48, 48), c, F.substring(F.get(F.col(segs), i + 1), 1, 16), words))
    out = out.withColumn(f, F.when(any_, feature))
    out = out.withColumn(scores, F.when(any_, F.transform(F.col(f), votes)))
    # the end of candidate i: all segments and candidates up to it
    spans = F.aggregate(
        F.sequence(F.lit(0), F.size(cands) - 1),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,score:double>>").alias("out")),
        lambda s, i: _step(s, i, F.col(segs), F.col(cands), F.col(scores), cut),
        lambda s: s["out"],
    )
    masked = F.array_join(F.transform(F.col(segs), lambda x, i: F.concat(x, F.when(i >= F.size(cands), F.lit("")).when(F.get(F.col(scores), i) >= cut, F.lit(MASK)).otherwise(F.get(F.col(cands), i)))), "")
    empty = F.array().cast("array<struct<start:int,end:int,score:double>>")
    return out.select(*[F.col(f"`{c}`") for c in kept], F.size(cands).alias("n_candidates"), F.when(any_, spans).otherwise(empty).alias("findings"), F.when(any_, masked).otherwise(F.col(t)).alias("redacted"))


def _step(s: Column, i: Column, segs: Column, cands: Column, scores: Column, cut: float) -> Column:
    start = s["at"] + F.length(F.get(segs, i))
    end = start + F.length(F.get(cands, i))
    one = F.array(F.struct(start.alias("start"), end.alias("end"), F.get(scores, i).alias("score")))
    return F.struct(end.alias("at"), F.when(F.get(scores, i) >= cut, F.concat(s["out"], one)).otherwise(s["out"]).alias("out"))
