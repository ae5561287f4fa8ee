"""Secret scans: candidates by pattern, false positives removed by a random forest. DataFrame and SQL functions only.

A candidate is a run of 16 or more letters, digits and _ + / - with a digit or a known prefix, and = as padding at its end, or whatever is assigned to a
name with a keyword, of any length and any signs, up to a space or quote. The forest looks at its length, changes between classes
of characters, cover by dictionary words, the path (source) and the words beside it. It is trained from labelled findings, by default
those that labelled_findings() makes by rule, and is fitted once for an application.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from epochweave.llm.shared import once

#: Words that real secrets don't hold, in the candidate or its path.
DICTIONARY = "example sample dummy test fake mock placeholder your here insert change token secret password user name data file image page article version build release config default local host http index item value table model train batch report month summer winter title".split()
PATHS = "test|example|sample|fixture|mock|spec|docs"
KEYWORDS = "token|secret|passw|api[_-]?key|access[_-]?key|auth|credential|private"
PREFIXES = "AKIA|ASIA|ghp_|gho_|sk_live_|xox[bp]-|glpat-"
RUN = rf"(?<![A-Za-z0-9_+/\-])(?=[A-Za-z_+/\-]*+[0-9]|{PREFIXES})[A-Za-z0-9_+/\-]{{16,}}+(?:={{1,2}}(?![\"']?[A-Za-z0-9_+/=\-]))?"
ASSIGNED = rf"(?<=[=:]\s{{0,3}}[\"']?)(?<=(?i:{KEYWORDS})[A-Za-z0-9_\-]{{0,24}}[\"']?\s{{0,3}}[=:]{{1,2}}\s{{0,3}}[\"']?)(?![=:])"
#: Up to a space or quote, or the next parameter of a URL. Nothing in it goes back, so that no text is too long or too odd to be searched.
VALUE = r"(?:[^\s\"'`]++(?=[\"'`])|(?:[^\s\"'`&]++|&(?!\w{1,40}=))++)"
CANDIDATE = f"{ASSIGNED}(?=[^\\s\"'`]){VALUE}|{RUN}"
#: What a candidate doesn't end with, unless a quote follows: signs that end a clause, and more than two signs of equality.
ENDS = ",;.)]}>:="
HASHES = "commit|sha1|sha256|md5|checksum|digest|etag|revision|uuid|guid|build|order|card|invoice"


#: How many pieces of a text on either side a candidate looks at, and how many pieces a block of lengths has.
NEAR, NEARBY = 8, 256
_fitted: dict[str, PipelineModel] = {}


def _share(pattern: str) -> Column:
    return F.regexp_count("candidate", F.lit(pattern)) / F.length("candidate")


def _classes() -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace("candidate", "[a-z]", "l"), "[A-Z]", "u"), "[0-9]", "d"), "[^lud]", "s")


def features() -> dict[str, Column]:
    """What the forest looks at, from columns candidate, before, after, path."""
    low = F.lower("candidate")
    return {
        "length": F.length("candidate").cast("double"),
        "lower": _share("[a-z]"), "upper": _share("[A-Z]"), "digit": _share("[0-9]"), "sign": _share("[^A-Za-z0-9]"),
        "changes": F.regexp_count(_classes(), F.lit(r"(.)(?!\1)(?=.)")) / F.length("candidate"),
        "distinct": F.size(F.array_distinct(F.split("candidate", ""))) / F.least(F.length("candidate"), F.lit(64)),
        "vowels": F.regexp_count(low, F.lit("[aeiou]")) / F.length("candidate"),
        "hex": F.expr("candidate").rlike("^[0-9a-fA-F]+$").cast("double"),
        "uuid": low.rlike("^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$").cast("double"),
        "prefix": F.col("candidate").rlike(f"^({PREFIXES})").cast("double"),
        "dictionary": 1 - F.length(F.regexp_replace(low, "|".join(DICTIONARY), "")) / F.length("candidate"),
        "path": F.lower("path").rlike(PATHS).cast("double"),
        "keyword": F.lower("before").rlike(rf"({KEYWORDS})[a-z0-9_\-]*[\"']?\s*[=:]+\s*[\"']?$").cast("double"),
        "hashed": F.lower("before").rlike(rf"({HASHES})[a-z_]*[\"']?[\s=:#]+[\"']?$").cast("double"),
        "assigned": F.col("before").rlike(r"[=:]\s*[\"']?$").cast("double"),
        "quoted": (F.col("before").rlike("[\"']$") & F.col("after").rlike("^[\"']")).cast("double"),
        "address": F.col("before").rlike(r"(://|[/?&.@])\S*$").cast("double"),
    }


def _columns() -> dict[str, Column]:
    """The features under names that no other column has."""
    return {f"_of_{k}": F.coalesce(c, F.lit(0.0)) for k, c in features().items()}


def labelled_findings(spark: SparkSession, seed: int = 0, rows: int = 4000) -> DataFrame:
    """Columns candidate, before, after, path, label: made by rule from hashes, half of them secrets (1), half not (0)."""
    n = F.col("id")
    hexed = lambda k: F.sha1(F.concat_ws(":", F.lit(f"{seed}{k}"), n))
    mixed = lambda k: F.regexp_replace(F.base64(F.unhex(F.sha2(F.concat_ws(":", F.lit(f"{seed}{k}"), n), 512))), "[+/=]", "q")
    pick = lambda k, of: F.element_at(F.array(*map(F.lit, of)), (F.pmod(F.xxhash64(n, F.lit(f"{seed}{k}")), F.lit(len(of))) + 1).cast("int"))
    words = pick("w", ["the report of", "and so it was", "in that year", "von der", "para el", "see also"])
    name = pick("n", ["token", "TOKEN", "api_key", "API_KEY", "client_secret", "password", "auth_token", "aws_secret_access_key"])
    is_to = pick("i", [' = "', '="', ': "', "=", ": "])
    plain = pick("p", ["src0", "src7", "site/blog", "app/main.py", "web"])
    hash_name = pick("h", ["commit ", "sha1: ", "checksum=", "etag: \"", "revision ", "build ", "order ", "card "])
    n_word = pick("x", DICTIONARY)
    spread = F.concat(F.substr(mixed("r"), F.lit(1), F.lit(3)), pick("s", ["!", "@", "#", "$", "."]), F.substr(mixed("r"), F.lit(5), n % 7 + 3), pick("t", ["!", "%", "*", "7", "x"]))
    letters = F.substr(F.regexp_replace(mixed("v"), "[0-9]", ""), F.lit(1), n % 12 + 18)
    common = pick("c", ["required", "John", "the", "string", "None", "null", "str", "request.headers", "get_token(", "os.environ", "Wilson", "session", "invalid", "expired", "Optional[str]", "under", "and", "thereof", "resolution", "on"])
    kinds = [
        (1, spread, F.concat(words, F.lit(" "), name, is_to), plain), (1, letters, F.concat(name, is_to), plain),
        (0, common, F.concat(words, F.lit(" "), name, is_to), plain), (0, F.concat(common, pick("d", ["-", "_", "."]), pick("b", DICTIONARY)), F.concat(name, is_to), plain),
        (1, hexed("a"), F.concat(words, F.lit(" "), name, is_to), plain), (1, hexed("b"), F.concat(name, F.lit(' = "')), plain), (1, F.substr(mixed("c"), F.lit(1), F.lit(40)), F.concat(words, F.lit("\n"), name, is_to), plain),
        (1, F.concat(F.lit("AKIA"), F.upper(F.substr(mixed("d"), F.lit(1), F.lit(16)))), F.concat(words, F.lit(" ")), plain), (1, F.concat(F.lit("ghp_"), F.substr(mixed("e"), F.lit(1), F.lit(36))), F.concat(words, is_to), plain), (1, F.substr(mixed("f"), F.lit(1), F.lit(24)), F.concat(name, is_to), plain),
        (0, hexed("g"), F.concat(words, F.lit(" "), hash_name), plain), (0, hexed("h"), F.concat(words, F.lit(" ")), plain),
        (0, F.regexp_replace(F.substr(hexed("i"), F.lit(1), F.lit(32)), "(.{8})(.{4})(.{4})(.{4})(.{12})", "$1-$2-$3-$4-$5"), F.concat(words, pick("u", [" id=", " uuid: ", " "])), plain),
        (0, F.substr(F.regexp_replace(F.conv(F.substr(hexed("j"), F.lit(1), F.lit(15)), 16, 10), "^", "4"), F.lit(1), F.lit(16)), F.concat(words, F.lit(" ")), plain),
        (0, F.concat(n_word, F.lit("_"), pick("y", DICTIONARY), F.lit("_"), pick("z", DICTIONARY), F.lit("_"), n % 90 + 10), F.concat(pick("k", ["token = \"", "", "password=", "name: "])), plain),
        (0, F.concat(F.lit("xxxxxxxxxxxxxxxx"), n % 10), F.concat(name, is_to), plain), (0, hexed("l"), F.concat(name, is_to), pick("q", ["tests/data", "docs/example.md", "mock/api", "fixtures/a"])),
        (0, F.concat(F.lit("2024-"), n_word, F.lit("-"), pick("m", DICTIONARY), F.lit("-"), pick("o", DICTIONARY)), F.concat(words, F.lit(" https://www.site.org/")), plain),
    ]
    good, bad = [k for k in kinds if k[0]], [k for k in kinds if not k[0]]
    struct = lambda k: F.struct(k[1].alias("candidate"), k[2].alias("before"), F.when(k[2].rlike('"$'), '" ').otherwise(" ").alias("after"), k[3].alias("path"), F.lit(k[0]).alias("label"))
    one = lambda of: F.element_at(F.array(*map(struct, of)), ((n / 2).cast("long") % len(of) + 1).cast("int"))
    return spark.range(0, rows, 1, 1).select(F.when(n % 2 == 0, one(good)).otherwise(one(bad)).alias("f")).select("f.*")


def forest(findings: DataFrame, trees: int = 15, depth: int = 6, seed: int = 9) -> PipelineModel:
    """A model of the features' columns. findings: columns candidate, before, after, path, label; a bounded number of rows."""
    assembler = VectorAssembler(inputCols=list(_columns()), outputCol="_features")
    rows = findings.select(*[c.alias(k) for k, c in _columns().items()], F.col("label").cast("double").alias("label"))
    fitted = RandomForestClassifier(featuresCol="_features", numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="6").fit(assembler.transform(rows).select("_features", "label"))
    return PipelineModel([assembler, fitted.setPredictionCol("").setRawPredictionCol("").setProbabilityCol("_probability")])


def default_forest(spark: SparkSession) -> PipelineModel:
    """That of labelled_findings(), fitted once for an application."""
    known = spark.sparkContext.applicationId
    if known not in _fitted:
        _fitted.clear()
        _fitted[known] = forest(labelled_findings(spark))
    return _fitted[known]


def scored(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """rows (columns candidate, before, after, path) with score, from 0 to 1: the mean over trees of the share of secrets where a candidate ends up."""
    every = rows.select("*", *[c.alias(k) for k, c in _columns().items()])
    return model.transform(every).select(*rows.columns, F.get(vector_to_array("_probability"), F.lit(1)).alias("score"))


def candidates(docs: DataFrame) -> DataFrame:
    """Columns doc_id, begin (in characters), candidate, before, after, path: every match of CANDIDATE in the whole text.

    before and after are up to 48 and 24 characters around it, as far as NEAR pieces of the text reach. One search of a text marks
    its candidates, and the marks cut it into pieces; a candidate looks at the pieces beside it alone, and at sums of lengths by
    blocks, so that many candidates in one text don't cost its length each.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    text = F.when(F.contains(text, F.lit("\x01")) | F.contains(text, F.lit("\x02")), F.translate(text, "\x01\x02", "  ")).otherwise(text)  # few texts have these
    # the first piece comes before all candidates, any other is a candidate, its end mark and what follows
    pieces = F.split(F.regexp_replace(text, CANDIDATE, "\x01$0\x02"), "\x01", -1)
    total = lambda of, first, n: F.aggregate(F.slice(of, first, n), F.lit(0).cast("long"), lambda s, x: s + x)
    some = lambda p, first, n, cut: F.translate(F.array_join(F.transform(F.slice(p, first, n), cut), ""), "\x02", "")

    def found(p: Column, n: Column, sums: Column, i: Column) -> Column:
        block, first = F.floor(i / NEARBY).cast("int"), F.greatest(i - NEAR, F.lit(0))
        begin = total(sums, F.lit(1), block) + total(n, block * NEARBY + 1, i % NEARBY)
        parts = F.split(F.get(p, i), "\x02", 2)
        core = F.length(F.rtrim(parts[0], F.lit(ENDS)))
        whole = core + F.least(F.length(F.regexp_extract(F.substring(parts[0], core + 1, F.lit(3)), "^=*", 0)), F.lit(2))
        size = F.when(parts[1].rlike("^[\"'`]"), F.length(parts[0])).otherwise(whole)
        before = F.right(some(p, first + 1, i - first, lambda x: F.right(x, F.lit(49))), F.lit(48))
        after = F.left(F.concat(F.left(F.concat(F.substring(parts[0], size + 1, F.lit(24)), parts[1]), F.lit(24)), some(p, i + 2, F.lit(NEAR), lambda x: F.left(x, F.lit(25)))), F.lit(24))
        return F.struct(begin.alias("begin"), F.substring(parts[0], F.lit(1), size).alias("candidate"), before.alias("before"), after.alias("after"))

    lengths = lambda p: F.transform(p, lambda x: F.length(F.translate(x, "\x02", "")).cast("long"))
    sums_of = lambda n: F.transform(F.sequence(F.lit(0), F.floor((F.size(n) - 1) / NEARBY).cast("int")), lambda b: total(n, b * NEARBY + 1, F.lit(NEARBY)))
    each = lambda p, n, sums: F.transform(F.sequence(F.lit(1), F.size(p) - 1), lambda i: found(p, n, sums, i))
    every = once(pieces, lambda p: F.when(F.size(p) > 1, once(lengths(p), lambda n: once(sums_of(n), lambda sums: each(p, n, sums)))))
    of = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("path"), F.explode(every).alias("f"))
    return of.select("doc_id", "f.*", "path").where("candidate <> ''")  # nothing but signs was assigned


def secret_scan(docs: DataFrame, findings: DataFrame | None = None, least: float = 0.5) -> DataFrame:
    """Columns doc_id, begin, n_chars, sha256, score: the candidates that the forest calls secret, without showing them.

    docs: columns doc_id, text, source (the path; null as empty). findings: labelled ones to train on, of bounded number, as from
    labelled_findings(). Null and empty texts have no candidates. Repeated rows are reported each, with null ids too.
    """
    model = default_forest(docs.sparkSession) if findings is None else forest(findings)
    return scored(model, candidates(docs)).where(F.col("score") >= least).select("doc_id", "begin", F.length("candidate").alias("n_chars"), F.sha2("candidate", 256).alias("sha256"), "score")
