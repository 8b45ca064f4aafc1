"""URL filter: rules first, then a ratio of two character language models. DataFrame operations only.

Rules `host/path` fit a host with all its subdomains where the path begins with the rule's; the longest
fitting rule decides. URLs that rules accept or reject teach two variable-order Markov models over
the characters of `host + path`, of all contexts of up to ORDER characters that occur. Probabilities are interpolated from order to order:

    p_k(c | s) = (n(sc) + GAMMA * p_{k-1}(c | s')) / (n(s) + GAMMA)

A character's ratio depends on its window, itself and the ORDER characters before: it is computed once for each distinct window, and
each place of each distinct URL then meets its window's ratio in one join. Counts are joined, too, not broadcast, but where they are
few. The log-likelihood difference divided by the length is calibrated on labelled URLs that the models have
not seen (one fold of five): two normal distributions of equal variance give P(accept); 0.5 and above is allowed.

Null or malformed URLs have empty host and path and are judged like any other. URLs are read whole; repeated rows get equal
verdicts; two rules of equal length that fit would be decided by the later one. Without labelled URLs of both classes
nothing can be learned and all is allowed with score 0.5. An empty table gives no rows. Of clashing columns, the
table's own host, path, rule, verdict, llr and score are replaced; all others are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verivane.llm.common import ascii_lower, materialize, small_side, table

#: Verdict, host, path.
RULES = [
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
]
ORDER = 4  #: longest context in characters
GAMMA = 2.0
ALPHABET = 256  #: size of the uniform distribution that the lowest order falls back to
FOLDS = 5
START, END = "\x02", "\x03"


def parts(url_table: DataFrame, url: str = "url") -> DataFrame:
    """Adds host and path."""
    u = F.coalesce(F.col(url), F.lit(""))
    rest = F.when(F.instr(u, "://") > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")).otherwise("")
    return url_table.withColumns({
        "host": ascii_lower(F.regexp_extract(rest, "^([^/?#]*)", 1)),
        "path": F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1),
    })


def by_rule(rules: list[tuple[str, str, str]]):
    """The longest fitting rule, and its verdict; both null without one."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, f"{host}{path}").otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def windows(strings: DataFrame) -> DataFrame:
    """A row for each character and the closing mark of s: w, itself after the ORDER characters before."""
    t = F.concat(F.lit(START * ORDER), F.col("s"), F.lit(END))
    at = F.sequence(F.lit(1), F.length("s") + 1)
    return strings.withColumn("__t", t).withColumn("__at", F.explode(at)).withColumn("w", F.substring(F.col("__t"), F.col("__at"), F.lit(ORDER + 1))).drop("__t", "__at")


def suffix(k: int):
    """The last character of a window with k characters before it."""
    return F.substring(F.col("w"), F.lit(ORDER + 1 - k), F.lit(k + 1))


def train(labelled: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Counts of grams (g: context and character), and of contexts, in accepted (a) and rejected (r) URLs; labelled has s, accepted
    (boolean), n (how often s occurs)."""
    of = lambda accepted: F.sum(F.when(F.col("accepted") == accepted, F.col("n")).otherwise(0)).cast("double")
    seen = windows(labelled).groupBy("w").agg(of(True).alias("a"), of(False).alias("r"))
    total = lambda df: df.groupBy("g").agg(F.sum("a").alias("a"), F.sum("r").alias("r"))
    grams = materialize(total(seen.select("a", "r", F.explode(F.array(*[suffix(k) for k in range(ORDER + 1)])).alias("g"))), "url-grams")
    return grams, materialize(total(grams.select("a", "r", F.expr("substring(g, 1, length(g) - 1)").alias("g"))), "url-contexts")


def ratios(seen: DataFrame, grams: DataFrame, contexts: DataFrame) -> DataFrame:
    """w, ratio (log of accepted to rejected probability) of each distinct window of seen (w)."""
    parts = [F.struct(F.lit(k).alias("k"), suffix(k).alias("g")) for k in range(ORDER + 1)]
    each = seen.select("w").distinct().select("w", F.inline(F.array(*parts))).withColumn("c", F.expr("substring(g, 1, length(g) - 1)"))
    each = each.join(small_side(grams.select("g", F.col("a").alias("ga"), F.col("r").alias("gr"))), "g", "left")
    each = each.join(small_side(contexts.select(F.col("g").alias("c"), F.col("a").alias("ca"), F.col("r").alias("cr"))), "c", "left").na.fill(0.0)
    orders = each.groupBy("w").agg(F.sort_array(F.collect_list(F.struct("k", "ga", "gr", "ca", "cr"))).alias("orders"))
    start = F.struct(F.lit(1.0 / ALPHABET).alias("p"), F.lit(1.0 / ALPHABET).alias("q"))
    up = lambda acc, x: F.struct(((x["ga"] + GAMMA * acc["p"]) / (x["ca"] + GAMMA)).alias("p"), ((x["gr"] + GAMMA * acc["q"]) / (x["cr"] + GAMMA)).alias("q"))
    return orders.select("w", F.aggregate("orders", start, up, lambda acc: F.log(acc["p"] / acc["q"])).alias("ratio"))


def llr(strings: DataFrame, grams: DataFrame, contexts: DataFrame) -> DataFrame:
    """s, and its log-likelihood difference by character; strings: distinct s."""
    places = windows(strings.select("s"))
    known = materialize(ratios(places, grams, contexts), "url-ratios")
    return places.join(small_side(known), "w").groupBy("s").agg(F.avg("ratio").alias("llr"))


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, url: str = "url") -> DataFrame:
    """Adds host, path, rule, verdict, llr and score (calibrated probability of acceptance); keeps all other columns."""
    spark = pages.sparkSession
    rule, verdict = by_rule(rules)
    added = ("host", "path", "rule", "verdict", "llr", "score")
    judged = parts(pages.drop(*[c for c in added if c in pages.columns]), url).withColumns({"rule": rule, "verdict": verdict})
    strings = judged.groupBy(F.concat("host", "path").alias("s"), "verdict").agg(F.count("*").alias("n"))
    # Dealt out by number, so that few long strings don't end in one task.
    strings = materialize(strings.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "s"), "url-strings")
    labelled = strings.where(F.col("verdict").isNotNull()).withColumn("accepted", F.col("verdict") == "allow")
    fold = F.pmod(F.xxhash64("s"), F.lit(FOLDS)) == 0
    grams, contexts = train(labelled.where(~fold))
    scored = materialize(llr(strings.where(F.col("verdict").isNull() | fold).select("s").distinct(), grams, contexts), "url-scores")
    seen = labelled.where(fold).join(small_side(scored), "s")
    stats = {
        x["accepted"]: x
        for x in seen.groupBy("accepted").agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("llr")) / F.sum("n")).alias("mean"), (F.sum(F.col("n") * F.col("llr") * F.col("llr")) / F.sum("n")).alias("square")).collect()
    }
    probability = F.lit(0.5)
    if len(stats) == 2:
        yes, no = stats[True], stats[False]
        n = yes["n"] + no["n"]
        variance = max(1e-6, sum(x["n"] * (x["square"] - x["mean"] ** 2) for x in (yes, no)) / n)
        slope, middle = (yes["mean"] - no["mean"]) / variance, (yes["mean"] + no["mean"]) / 2
        probability = F.coalesce(1 / (1 + F.exp(-slope * (F.col("llr") - middle))), F.lit(0.5))
    ruled = judged.where(F.col("rule").isNotNull()).withColumns({"llr": F.lit(None).cast("double"), "score": F.when(F.col("verdict") == "allow", 1.0).otherwise(0.0)})
    rest = judged.where(F.col("rule").isNull()).withColumn(_OWN, F.concat("host", "path")).join(small_side(scored.withColumnRenamed("s", _OWN)), _OWN, "left").drop(_OWN)
    rest = rest.withColumn("score", probability).withColumn("verdict", F.when(F.col("score") >= 0.5, "allow").otherwise("block"))
    return ruled.unionByName(rest)


_OWN = "__url_string"  #: joined to a caller's table and dropped again


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "score", "llr")


QUERIES = {"op6_url_filter": op6_url_filter}
ORACLE_SQL: dict[str, str] = {}  # two trained models: tests compare with a brute-force version
