"""URL filters: rules by host and path first, then a logistic regression on hashed character n-grams.

A URL's host and path are cut into n-grams of characters, hashed to a fixed number of weights (one half for hosts, one for paths), each
part averaged over its n-grams. The weights are learnt from a small table of labelled URLs, by default one made by rule.
DataFrame functions only: a map over rows, without a shuffle, whose work is in proportion to a URL's length.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel, Normalizer, VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from epochweave.llm.shared import once

#: The number of weights, and the n-grams' lengths.
SLOTS, GRAMS = 4096, (3, 4)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Host, path, verdict.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
#: Words of hosts and paths that a filter for training texts keeps out, and words of those it lets in.
UNWANTED = "adult ads adserver affiliate bet bets betting bingo bonus casino cheap cialis clicks crypto dating doubleclick escort farm forex free gambling hot jackpot keygen lottery loan loans milf nude offers payday pharma pills poker porn promo replica roulette sex sexy slots spam tracker track viagra warez webcam win xxx".split()
WANTED = "academy archive article books city college community council culture daily docs encyclopedia forum garden gazette guide health history institute journal kitchen law library maps math museum music nature news observer parish physics poems press recipes research review school science society sports stories technology times travel university weather wiki".split()
#: Parts of made-up syllables.
ONSETS, VOWELS, CODAS = "b c d f g h k l m n p r s t v w th st sh wh br tr ch pr qu".split(), "a e i o u ea ou io ei y".split(), " n r s t l nd nt ng st d ble m rd n r".split(" ")


def host_of(url: Column) -> Column:
    """What is after the first :// up to /, ?, # or the end, A-Z lower-cased; empty for a null or without ://."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*+)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*+([^?#]*+)", 1), F.lit(""))


def fitting_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The rule (struct rule, verdict) that fits the host, or a host above it, and the path: the longest, of several the first in order; else null."""
    ordered = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1], r[2]))
    fits = lambda h, p: ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
    return F.coalesce(*[F.when(fits(h, p), F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for h, p, v in ordered], F.lit(None).cast("struct<rule:string,verdict:string>"))


def _slots(text: Column, part: int, slots: int) -> Column:
    """Places among the weights of all n-grams of a text, with its two ends marked."""
    half = slots // 2

    def of(chars: Column) -> Column:
        gram = lambda n: F.transform(F.sequence(F.lit(0), F.greatest(F.size(chars) - n, F.lit(0))), lambda i: F.array_join(F.slice(chars, i + 1, n), ""))
        return F.transform(F.concat(*[gram(n) for n in GRAMS]), lambda g: (F.pmod(F.xxhash64(g), F.lit(half)) + part * half).cast("int"))

    return once(F.split(F.concat(F.lit("^"), text, F.lit("$")), ""), of)


def strength(weights: list[float], host: Column, path: Column) -> Column:
    """The weights of the n-grams of host and path, the mean over either part."""
    known = F.split(F.lit(" ".join(map(repr, weights))), " ").cast("array<double>")  # folded into one literal
    part = lambda places: F.aggregate(places, F.lit(0.0), lambda s, i: s + F.get(known, i)) / F.size(places)
    return once(_slots(host, 0, len(weights)), part) + once(_slots(path, 1, len(weights)), part)


def labelled_urls(spark: SparkSession, rows: int = 6000) -> DataFrame:
    """Columns url, label (1: to be blocked): made by rule from fixed words, syllables and hashes; every other one is to be blocked."""
    n = F.col("id")
    draw = lambda k, upto: F.pmod(F.xxhash64(n, F.lit(k)), F.lit(upto)).cast("int")
    pick = lambda k, of: F.get(F.lit(of), draw(k, len(of)))
    syllable = lambda k: F.concat(pick(f"{k}1", ONSETS), pick(f"{k}2", VOWELS), pick(f"{k}3", CODAS))
    plain = F.concat(syllable("a"), syllable("b"), F.when(draw("c", 2) == 0, syllable("d")).otherwise(""))
    join = pick("e", ["-", "-", "", "."])
    good = F.when(draw("f", 3) == 0, F.concat(pick("g", WANTED), join, plain)).when(draw("f", 3) == 1, pick("h", WANTED)).otherwise(plain)
    other = F.when(draw("i", 2) == 0, pick("j", UNWANTED)).otherwise(plain)
    bad = F.when(draw("k", 2) == 0, F.concat(pick("l", UNWANTED), join, other)).otherwise(F.concat(other, join, pick("m", UNWANTED)))
    blocked = n % 2 == 1
    host = F.concat(pick("n", ["", "", "www.", "m.", "blog.", "en."]), F.when(blocked, bad).otherwise(good), pick("o", ["", "", ".example", ".site"]), pick("p", [".com", ".net", ".org", ".de", ".fr", ".es", ".info"]))
    word = F.when(blocked & (draw("q", 4) == 0), pick("r", UNWANTED)).otherwise(F.when(draw("s", 2) == 0, pick("t", WANTED)).otherwise(pick("u", ["en", "de", "fr", "es", "page", "a"])))
    path = F.concat(F.lit("/"), word, pick("v", ["", "/", "/"]), draw("w", 10_000).cast("string"), pick("x", ["", "/", ".html", ".php"]))
    return spark.range(0, rows, 1, 1).select(F.concat(pick("y", ["http://", "https://"]), host, path).alias("url"), blocked.cast("double").alias("label"))


def train(labelled: DataFrame, slots: int = SLOTS, ridge: float = 1e-6) -> tuple[list[float], float]:
    """Weights and the intercept, from columns url, label (1: block, 0: allow; others and nulls are left out). A bounded table: all of it is used.

    Without both labels there is nothing to learn: all weights are 0, and the intercept says allow.
    """
    known = labelled.where("label in (0, 1) and url is not null").select("url", F.col("label").cast("double").alias("label"))
    if known.select("label").distinct().count() < 2:
        return [0.0] * slots, -1.0
    places = known.select("label", _slots(host_of(F.col("url")), 0, slots).cast("array<string>").alias("host"), _slots(path_of(F.col("url")), 1, slots).cast("array<string>").alias("path"))
    steps = []
    for part in ("host", "path"):
        steps += [CountVectorizerModel.from_vocabulary([str(i) for i in range(slots)], part, f"{part}_n"), Normalizer(p=1.0, inputCol=f"{part}_n", outputCol=f"{part}_x")]
    rows = PipelineModel(steps).transform(places).select("label", "host_x", "path_x")
    model = LogisticRegression(featuresCol="features", regParam=ridge, maxIter=50, standardization=False).fit(VectorAssembler(inputCols=["host_x", "path_x"], outputCol="features").transform(rows))
    both = model.coefficients.toArray()
    return [float(w) for w in both[:slots] + both[slots:]], float(model.intercept)


def judged_urls(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, labelled: DataFrame | None = None) -> DataFrame:
    """Columns page_id, host, path, rule, verdict, score: one row for each row of pages.

    pages: columns page_id, url. A rule (host, path, verdict) fits its host and all hosts below it where the path starts with the
    rule's; the longest wins, and its verdict holds. Else the verdict is block from a score of 0.5 on, or allow. A null url, or one
    without ://, has an empty host and path, which no rule fits and which the method judges like any other. Repeated rows are judged
    each, page_id may be null. labelled: a small table of columns url, label, as from labelled_urls().
    """
    weights, intercept = train(labelled_urls(pages.sparkSession) if labelled is None else labelled)
    url = F.col("url").cast("string")
    rows = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    rows = rows.select("*", fitting_rule(F.col("host"), F.col("path"), rules).alias("fit"), (1 / (1 + F.exp(-(strength(weights, F.col("host"), F.col("path")) + intercept)))).alias("score"))
    return rows.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce(F.col("fit.verdict"), F.when(F.col("score") >= 0.5, "block").otherwise("allow")).alias("verdict"), "score")
