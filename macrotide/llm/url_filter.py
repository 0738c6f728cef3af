"""URL filtering with association rules mined by FP-growth, in DataFrame and ML functions only."""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from macrotide.llm.store import table, written

#: (host, path, verdict). A rule fits its host and all subdomains.
RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))
#: Mined rules need so many blocked pages, however large the table, this confidence and this lift; longer ones are left out.
MIN_PAGES, MIN_CONFIDENCE, MIN_LIFT, MAX_TOKENS = 20, 0.4, 1.5, 3
#: One labelled page of so many is held out. Rules are used from the least confidence at which the held-out pages they match are blocked this often.
HOLD_OUT, MIN_PRECISION = 5, 0.5
#: Rule indexes of up to so many bytes are broadcast; larger ones are joined by a shuffle.
BROADCAST_BYTES = 16 << 20
BLOCK = "label=block"


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without one."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def url_document(path: Column) -> Column:
    """The number of the document that a page shows: its path is /language/number, maybe with ``/`` or an ending; else null."""
    return F.regexp_extract(path, r"^/[^/]+/(\d{1,18})(?:/|\.\w+)?$", 1).try_cast("long")


def url_tokens(host: Column, path: Column, scheme_url: Column) -> Column:
    """Distinct tokens of a URL: host labels, runs of letters inside them, path words, path depth, query or fragment."""
    labels = F.transform(F.filter(F.split(host, r"\."), lambda x: x != ""), lambda x: F.concat(F.lit("host="), x))
    parts = F.transform(F.filter(F.split(host, r"[^a-z]+"), lambda x: F.length(x) >= 3), lambda x: F.concat(F.lit("part="), x))
    words = F.transform(F.filter(F.split(F.lower(path), r"[^\p{L}]+"), lambda x: x != ""), lambda x: F.concat(F.lit("path="), x))
    depth = F.array(F.concat(F.lit("depth="), F.least(F.lit(9), F.size(F.split(path, "/"))).cast("string")))
    query = F.when(F.contains(scheme_url, F.lit("?")), F.array(F.lit("query"))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(labels, parts, words, depth, query))


def fitting_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The rule (struct of rule and verdict) with the longest host, then the longest path, among those that fit; else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule_host, rule_path, verdict in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), len(r[0]))):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        out = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def mine_rules(labelled: DataFrame, min_pages: int = MIN_PAGES, min_confidence: float = MIN_CONFIDENCE, min_lift: float = MIN_LIFT, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """(tokens, confidence, token) from (tokens, blocked): token combinations that foretell a block, and the rarest token of each.

    Support, of ``min_pages`` pages, prunes inside FP-growth; confidence, lift and length prune after it, and so does a
    shorter rule that is contained in a longer one and at least as sure. No labels, no rules.
    """
    baskets = written(labelled.select(F.concat("tokens", F.when(F.col("blocked"), F.array(F.lit(BLOCK))).otherwise(F.array().cast("array<string>"))).alias("items")), "url-baskets")
    n_baskets = baskets.count()
    if n_baskets < min_pages:
        return labelled.sparkSession.createDataFrame([], "tokens array<string>, confidence double, token string")
    found = FPGrowth(itemsCol="items", minSupport=(min_pages - 0.5) / n_baskets, minConfidence=min_confidence).fit(baskets).associationRules
    rules = found.filter((F.col("consequent")[0] == BLOCK) & (F.size("antecedent") <= max_tokens) & (F.col("lift") >= min_lift))
    rules = written(rules.select(F.array_sort("antecedent").alias("tokens"), "confidence"), "url-rules")
    short, long = rules.alias("s"), rules.alias("l")
    beaten = (F.col("s.tokens")[0] == F.col("x")) & (F.size("s.tokens") < F.size("l.tokens")) & (F.size(F.array_except("s.tokens", "l.tokens")) == 0) & (F.col("s.confidence") >= F.col("l.confidence"))
    covered = long.withColumn("x", F.explode("l.tokens")).join(short, beaten).select(F.col("l.tokens").alias("tokens"))
    kept = written(rules.join(covered, "tokens", "left_anti"), "url-rules")
    counts = baskets.select(F.explode("items").alias("token")).groupBy("token").count()
    return kept.withColumn("token", F.explode("tokens")).join(counts, "token").groupBy("tokens", "confidence").agg(F.min_by("token", F.struct("count", "token")).alias("token"))


def match_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(tokens, n_rules, confidence) for the distinct rows (tokens) that hold all tokens of a rule, by an inverted index from each rule's rarest token."""
    index = written(rules.select(F.col("tokens").alias("need"), "confidence", "token"), "url-index")
    held = index.agg(F.sum(F.length(F.array_join("need", " ")) + 64)).first()[0] or 0
    index = F.broadcast(index) if held <= BROADCAST_BYTES else index
    met = urls.select("tokens", F.explode("tokens").alias("token")).join(index, "token").filter(F.size(F.array_except("need", "tokens")) == 0)
    return met.groupBy("tokens").agg(F.count("*").alias("n_rules"), F.max("confidence").alias("confidence"))


def least_confidence(held_out: DataFrame, rules: DataFrame, min_precision: float = MIN_PRECISION) -> dict:
    """The least confidence of rules whose matches among the labelled rows (tokens, blocked) are blocked often enough, with precision and recall there.

    Without such rules ``confidence`` is None, and precision and recall are those of all rules.
    """
    rows = held_out.groupBy("tokens").agg(F.count("*").alias("pages"), F.sum(F.col("blocked").cast("long")).alias("bad"))
    matched = rows.join(match_rules(rows.select("tokens"), rules), "tokens", "left")
    bands = matched.groupBy(F.floor(F.coalesce("confidence", F.lit(-1.0)) * 20).alias("band")).agg(F.sum("pages").alias("pages"), F.sum("bad").alias("bad")).collect()  # 22 bands at most
    total = sum(r.bad for r in bands)
    pages = bad = 0
    best = {"confidence": None, "precision": None, "recall": None, "pages": sum(r.pages for r in bands), "bad": total}
    for r in sorted(bands, key=lambda r: -r.band):
        if r.band < 0:
            break
        pages, bad = pages + r.pages, bad + r.bad
        found = {"precision": bad / pages, "recall": bad / total if total else None}
        if bad >= min_precision * pages:
            best |= found | {"confidence": r.band / 20}
        elif best["confidence"] is None:
            best |= found
    return best


def learned_rules(labelled: DataFrame, min_precision: float = MIN_PRECISION) -> tuple[DataFrame, dict]:
    """(rules, held-out figures) from (url, tokens, blocked): mined without the held-out pages, and used from the confidence that they set."""
    labelled = written(labelled.select("tokens", "blocked", (F.crc32(F.col("url").cast("binary")) % HOLD_OUT == 0).alias("out")), "labelled-urls")
    mined = written(mine_rules(labelled.filter("not out")), "mined-rules")
    found = least_confidence(labelled.filter("out"), mined, min_precision)
    kept = mined.filter(F.col("confidence") >= found["confidence"]) if found["confidence"] is not None else mined.limit(0)
    return kept, found | {"mined": mined.count(), "used": kept.count()}


def judge_urls(pages: DataFrame, labels: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, by_document: bool = False) -> DataFrame:
    """(id, url, host, path, rule, verdict, n_rules, confidence) for every row of ``pages``.

    A stated rule that fits decides; else a URL that any mined rule matches is blocked, and any
    other allowed. A null URL, or one without ``://``, has an empty host and path and is allowed.
    ``labels`` has (id, blocked) for some of the pages, or, ``by_document``, for some of the
    documents that the URLs number; an id with clashing labels is blocked. Rows that repeat are
    judged alike, very long URLs whole; other columns play no part. An empty table gives no rows.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    rows = rows.withColumn("tokens", F.when(F.col("host") == "", F.array().cast("array<string>")).otherwise(url_tokens(F.col("host"), F.col("path"), F.col("url"))))
    known = labels.groupBy(F.col("id").alias("labelled")).agg(F.max("blocked").alias("blocked")).filter("labelled is not null and blocked is not null")
    of = url_document(F.col("path")) if by_document else F.col("id")
    with_host = rows.filter("host <> ''")
    mined, _ = learned_rules(with_host.select("url", "tokens", of.alias("of")).join(known, F.col("of") == F.col("labelled")).select("url", "tokens", "blocked"))
    matched = match_rules(with_host.select("tokens").dropDuplicates(), mined).withColumnRenamed("tokens", "matched")
    judged = with_host.join(matched, F.col("tokens") == F.col("matched"), "left").drop("matched")
    judged = judged.unionByName(rows.filter("host = ''").withColumns({"n_rules": F.lit(None).cast("long"), "confidence": F.lit(None).cast("double")}))
    stated = fitting_rule(F.col("host"), F.col("path"), rules)
    by_method = F.when(F.col("n_rules") > 0, "block").otherwise("allow")
    return judged.withColumn("stated", stated).select("id", "url", "host", "path", F.col("stated.rule").alias("rule"), F.coalesce("stated.verdict", by_method).alias("verdict"), F.coalesce("n_rules", F.lit(0)).alias("n_rules"), "confidence")


def blocked_documents(labels: DataFrame) -> DataFrame:
    """(id, blocked) from (doc_id, quality, toxic): blocked if of low quality or toxic."""
    return labels.select(F.col("doc_id").alias("id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("blocked")).filter("blocked is not null")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every row of ``pages``; nulls, repeats and the like as in ``judge_urls``."""
    judged = judge_urls(table(spark, sf_dir, "pages"), blocked_documents(table(spark, sf_dir, "labels")), by_document=True)
    return judged.select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict", "n_rules", "confidence")
