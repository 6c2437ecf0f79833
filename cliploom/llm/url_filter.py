"""URL filters: host/path rules, and gradient-boosted trees on lexical features (native).

Rules decide the URLs that they fit; the longest rule wins. Every other URL gets
the verdict of boosted trees over lexical features: lengths, path depth, digit
ratio, character entropy, parameter counts and statistics of the host's suffix.
The trees are trained on labelled URLs. Where no labels are given, the rules give
them: URLs that a block rule fits are positive, all others negative, so the trees
block what looks like the blocked and let the rest pass. No URL is judged by trees
that have seen it: two models are trained, each on one half of the URLs by a hash, and
each scores the other half; a row's suffix statistics come from the other half's labels.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Hash buckets of host suffixes: their statistics are a table of this many rows whatever the corpus.
SUFFIX_BUCKETS = 1024
#: Each model is fitted on about this many labelled rows at most, half of them of either class, taken by a hash of the row.
TRAIN_ROWS = 20_000
FEATURES = ("url_length", "host_length", "path_length", "depth", "digit_ratio", "entropy", "n_params", "host_labels", "n_hyphens", "suffix_share", "suffix_block_rate")
#: Action and rule, host then path.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))


def host_of(url: Column) -> Column:
    """Between the first ``://`` and the next ``/``, ``?`` or ``#``, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """From the end of the host to ``?`` or ``#``; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def match_rules(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """struct<rule,action> of the longest rule that fits, else null.

    A rule is ``host/path``: it fits that host and its subdomains where the path
    starts with the rule's. The list is a handful of rules held by the caller; of two
    equal rules the first wins.
    """
    out: Column | None = None
    for action, rule in sorted(rules, key=lambda r: -len(r[1])):
        rule_host, slash, rest = rule.partition("/")
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(slash + rest)
        value = F.struct(F.lit(rule).alias("rule"), F.lit(action).alias("action"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return F.lit(None).cast("struct<rule:string,action:string>") if out is None else out


def lexical_features(df: DataFrame, url_col: str = "url") -> DataFrame:
    """Adds host, path, suffix bucket and the lexical features; a null URL is an empty one."""
    url = F.coalesce(F.col(url_col), F.lit(""))
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    digits = F.length(url) - F.length(F.translate(url, "0123456789", ""))
    df = df.withColumns({"host": host_of(F.col(url_col)), "path": path_of(F.col(url_col)), "_c": F.filter(F.split(url, ""), lambda c: c != "")})
    # Characters in order: where each begins, and how many there are of it.
    df = df.withColumn("_c", F.sort_array("_c"))
    df = df.withColumn("_s", F.filter(F.transform("_c", lambda c, i: F.when((i == 0) | (c != F.get(F.col("_c"), i - 1)), i)), lambda i: i.isNotNull()))
    share = F.transform("_s", lambda i, k: (F.coalesce(F.get(F.col("_s"), k + 1), F.size("_c")) - i) / F.size("_c"))
    return df.withColumns({
        "url_length": F.length(url).cast("double"),
        "host_length": F.length("host").cast("double"),
        "path_length": F.length("path").cast("double"),
        "depth": F.size(F.filter(F.split("path", "/"), lambda s: s != "")).cast("double"),
        "digit_ratio": digits / F.greatest(F.length(url), F.lit(1)),
        "entropy": F.aggregate(share, F.lit(0.0), lambda a, p: a - p * F.log2(p)),
        "n_params": F.size(F.filter(F.split(query, "&"), lambda s: s != "")).cast("double"),
        "host_labels": F.size(F.split("host", r"\.")).cast("double"),
        "n_hyphens": (F.length(url) - F.length(F.translate(url, "-_", ""))).cast("double"),
        "suffix": F.pmod(F.hash(F.substring_index("host", ".", -1)), F.lit(SUFFIX_BUCKETS)),
    }).drop("_c", "_s")


def classify(pages: DataFrame, labelled: Column, rules: Sequence[tuple[str, str]] = RULES, id_col: str = "page_id", url_col: str = "url", train_rows: int = TRAIN_ROWS, seed: int = 7) -> DataFrame:
    """page_id, host, path, rule, verdict, score for every row.

    ``labelled`` gives 1.0 (block), 0.0 (allow) or null (no label) from the columns
    of ``pages`` and ``rule``/``action``. Null, empty and malformed URLs have empty
    host and path and are judged by their features like any other; repeated rows
    get equal results, and other columns of the input play no part but in
    ``labelled``. If a half of the URLs has labels of fewer than two classes there is
    nothing to learn from it, and URLs of the other half without a rule are allowed,
    with a null score.
    """
    df = lexical_features(pages.select(F.struct(*[pages[f"`{c}`"] for c in pages.columns]).alias("_row"), F.col(id_col).alias("page_id"), F.col(url_col).alias("url")))
    df = df.withColumn("_m", match_rules(F.col("host"), F.col("path"), rules)).select("*", "_m.rule", "_m.action")
    own = [c for c in pages.columns if c not in ("page_id", "url", "rule", "action")]
    asked = df.select("*", *[F.col("_row").getField(c).alias(c) for c in own if c not in df.columns])
    df = asked.withColumn("label", labelled.cast("double")).select(*[c for c in df.columns if c not in ("_row", "_m")], "label")
    df = materialize(df.withColumn("half", F.pmod(F.xxhash64("url"), F.lit(2)).cast("int")), "urls")
    of_half = lambda h, value: F.coalesce(F.sum(F.when(F.col("half") == h, value)), F.lit(0.0))
    sums = [x for h in (0, 1) for x in (of_half(h, F.col("label").isNotNull().cast("double")).alias(f"labels{h}"), of_half(h, F.col("label")).alias(f"blocked{h}"))]
    suffixes = materialize(df.groupBy("suffix").agg(F.count(F.lit(1)).alias("n"), *sums), "suffixes")
    total = suffixes.agg(*[F.sum(c).alias(c) for c in suffixes.columns[1:]]).first()
    labels = (total["labels0"] or 0) + (total["labels1"] or 0)
    prior = (total["blocked0"] + total["blocked1"]) / labels if labels else 0.0
    df = df.join(F.broadcast(suffixes), "suffix")  # SUFFIX_BUCKETS rows at most
    other = lambda c: F.when(F.col("half") == 0, F.col(f"{c}1")).otherwise(F.col(f"{c}0"))
    df = df.withColumns({"suffix_share": F.col("n") / F.lit(float(total["n"] or 1)), "suffix_block_rate": (other("blocked") + 10 * prior) / (other("labels") + 10)})
    df = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(df)
    counts = {(r["half"], r["label"]): r["n"] for r in df.where("label IS NOT NULL").groupBy("half", "label").agg(F.count(F.lit(1)).alias("n")).collect()}
    scored = []
    for half in (0, 1):
        of = {y: counts.get((1 - half, y), 0) for y in (0.0, 1.0)}
        mine = df.where(F.col("half") == half)
        if not all(of.values()):
            scored.append(mine.select("page_id", "host", "path", "rule", "action", F.lit(None).cast("double").alias("score")))
            continue
        part = {y: min(1.0, train_rows / 2 / n) for y, n in of.items()}
        of_class = lambda x0, x1: F.when(F.col("label") == 1, x1).otherwise(x0)
        chosen = F.pmod(F.xxhash64("url", "page_id"), F.lit(1 << 30)) < of_class(*[int(part[y] * (1 << 30)) + 1 for y in (0.0, 1.0)])
        train = df.where((F.col("half") != half) & F.col("label").isNotNull() & chosen).select("label", "features", of_class(1 / part[0.0], 1 / part[1.0]).alias("weight"))
        model = GBTClassifier(maxIter=12, maxDepth=4, stepSize=0.3, seed=seed, weightCol="weight").fit(materialize(train, "train"))
        scored.append(model.transform(mine).select("page_id", "host", "path", "rule", "action", vector_to_array("probability")[1].alias("score")))
    out = scored[0].unionByName(scored[1])
    verdict = F.coalesce(F.col("action"), F.when(F.col("score") >= 0.5, "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.round("score", 6).alias("score"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL, judged by the five rules and else by the trees that learn from them."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return classify(pages, F.when(F.col("action") == "block", 1.0).otherwise(0.0))
