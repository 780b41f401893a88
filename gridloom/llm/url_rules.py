"""URL filtering: curated host and path rules first, mined token rules for the rest.

Mined rules are class association rules. A bad url is a transaction of its tokens; Spark's FP-growth
finds the token combinations of at least LEAST bad urls, and those of whose urls, among all labelled ones, enough
are bad are the rules. The support is a number, so that what is a rule does not depend on how much else is
labelled. Each rule is filed in an inverted index under its rarest token, so that a url is held only against
rules that may fit it. A rule that a part of it is no less sure without goes.

Cases: a null url, or one without `://`, has an empty host and path, fits no curated rule and no
token; it is allowed. A url that several mined rules fit takes the most confident. Without labelled
rows there are no mined rules. Urls of any length are read whole. Repeated rows are judged as often as they stand there. Other columns
of the input are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import SMALL, written

#: host, start of the path, verdict.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
#: Least number of bad urls that a token combination stands in, and least share of the urls with it that are bad.
LEAST, CONFIDENCE = 20, 0.7


def host_of(url: Column) -> Column:
    return _ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def curated(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else null."""
    longest_first = sorted(rules, key=lambda r: -len(r[0] + r[1]))
    fits = [((host == h) | host.endswith(f".{h}")) & path.startswith(p) for h, p, _ in longest_first]
    rule = reduce(lambda acc, x: F.when(x[0], F.lit(x[1][0] + x[1][1])).otherwise(acc), reversed(list(zip(fits, longest_first))), F.lit(None).cast("string"))
    verdict = reduce(lambda acc, x: F.when(x[0], F.lit(x[1][2])).otherwise(acc), reversed(list(zip(fits, longest_first))), F.lit(None).cast("string"))
    return rule, verdict


def tokens(url: Column) -> Column:
    """Distinct sorted tokens: host labels, path parts and query keys; digits are as one zero."""
    host, path = host_of(url), path_of(url)
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^?#]*\?([^#]*)", 1)
    plain = lambda c: F.regexp_replace(_ascii_lower(c), "[0-9]+", "0")

    def kind(mark: str, parts: Column) -> Column:
        return F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.concat(F.lit(mark), plain(x)))

    keys = F.transform(F.split(query, "&"), lambda x: F.substring_index(x, "=", 1))
    return F.array_sort(F.array_distinct(F.concat(kind("h:", F.split(host, r"\.")), kind("p:", F.split(path, "/")), kind("q:", keys))))


def mine(labelled: DataFrame, confidence: float = CONFIDENCE, least: int = LEAST) -> DataFrame | None:
    """(rule_id, antecedent, confidence, support, key) from (url, blocked); support: bad urls; key: the rarest token.

    All labelled rows take part. None if fewer than least of them are bad.
    """
    rows = labelled.where("blocked is not null").groupBy(tokens(F.col("url")).alias("items")).agg(F.count(F.lit(1)).alias("n"), F.count_if("blocked").alias("bad"))
    rows = written(rows.where(F.size("items") > 0), "url-sets")
    n, bad = rows.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("bad"), F.lit(0))).first()
    if bad < least:
        return None
    each = rows.where("bad > 0").select("items", F.explode(F.sequence(F.lit(1), "bad")).alias("_i")).select("items")
    # A little below least / bad, so that no combination of just least is lost to rounding.
    model = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / bad).fit(each)
    sets = model.freqItemsets.where(F.col("freq") >= least).select(F.array_sort("items").alias("antecedent"), F.col("freq").alias("support"))
    sets = sets.withColumn("rule_id", F.array_join("antecedent", " "))
    rare = rows.select(F.explode("items").alias("token"), "n").groupBy("token").agg(F.sum("n").alias("freq"))
    key = sets.select("rule_id", F.explode("antecedent").alias("token")).join(rare, "token").groupBy("rule_id").agg(F.min(F.struct("freq", "token"))["token"].alias("key"))
    sets = written(sets.join(key, "rule_id"), "url-combinations")
    all_ = rows.withColumn("key", F.explode("items")).join(sets.select("rule_id", "antecedent", "key"), "key").where(F.size(F.array_except("antecedent", "items")) == 0)
    sure = sets.join(all_.groupBy("rule_id").agg(F.sum("n").alias("all")), "rule_id").withColumn("confidence", F.col("support") / F.col("all"))
    sure = written(sure.where((F.col("confidence") >= confidence) & (F.col("confidence") > bad / n)), "url-rules")
    # A part of a rule that is as sure fits all that the rule does.
    part = sure.select(F.col("key").alias("token"), F.col("antecedent").alias("_a"), F.col("confidence").alias("_c"))
    wider = sure.select("rule_id", "antecedent", "confidence", F.explode("antecedent").alias("token")).join(part, "token")
    wider = wider.where((F.size("_a") < F.size("antecedent")) & (F.size(F.array_except("_a", "antecedent")) == 0) & (F.col("_c") >= F.col("confidence")))
    return sure.join(wider.select("rule_id").distinct(), "rule_id", "left_anti").select("rule_id", "antecedent", "confidence", "support", "key")


def match(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url_tokens, mined_rule, mined_confidence): the best rule of each token set in urls.url_tokens."""
    sets = urls.select("url_tokens").distinct().withColumn("key", F.explode("url_tokens"))
    hits = sets.join(rules, "key").where(F.size(F.array_except("antecedent", "url_tokens")) == 0)
    best = F.max(F.struct("confidence", "support", "rule_id"))
    return hits.groupBy("url_tokens").agg(best.alias("_b")).select("url_tokens", F.col("_b.rule_id").alias("mined_rule"), F.col("_b.confidence").alias("mined_confidence"))


def judge(pages: DataFrame, labelled: DataFrame, rules: tuple = RULES, confidence: float = CONFIDENCE, least: int = LEAST) -> DataFrame:
    """(page_id, host, path, rule, verdict, mined_rule, mined_confidence) of every page.

    Pages that a curated rule fits are held against no mined one.
    """
    mined = mine(labelled, confidence, least)
    url = F.col("url")
    out = pages.select("page_id", "url").withColumn("host", host_of(url)).withColumn("path", path_of(url))
    rule, verdict = curated(F.col("host"), F.col("path"), rules)
    out = out.withColumn("rule", rule).withColumn("verdict", verdict)
    none = {"mined_rule": F.lit(None).cast("string"), "mined_confidence": F.lit(None).cast("double")}
    found = None
    if mined is not None:
        some = out.where("rule is null").withColumn("url_tokens", tokens(url))
        found = written(match(some, mined), "url-verdicts")
    n = 0 if found is None else found.count()
    if not n:
        out = out.withColumns(none)
    else:
        some = some.join(F.broadcast(found) if n <= SMALL else found, "url_tokens", "left").drop("url_tokens")
        out = out.where("rule is not null").withColumns(none).unionByName(some)
    verdict = F.coalesce("verdict", F.when(F.col("mined_rule").isNotNull(), F.lit("block")).otherwise(F.lit("allow")))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "mined_rule", "mined_confidence")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages; a page's label is that of the row in labels with its id: toxic or of low quality is bad."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    bad = labels.groupBy("doc_id").agg(F.max((F.coalesce("toxic", F.lit(0)) == 1) | (F.coalesce("quality", F.lit(1)) == 0)).alias("blocked"))
    labelled = pages.select("page_id", "url").join(bad, F.col("page_id") == F.col("doc_id")).select("url", "blocked")
    return judge(pages, labelled)
