"""URL filter: host rules first, then a character language-model ratio.

URLs that a rule decides are labelled accepted or rejected. Both classes get a variable-order Markov
model over characters as they are: contexts of four, three, two, one and no characters, each order interpolated
with the next shorter one by Witten-Bell weights. All URLs are scored by the difference of the two models'
log-likelihoods, divided by length, against a threshold that is calibrated on labelled URLs held out from the counts.

The models are tables of counts, which grow with the URLs and stay distributed: the grams of the URLs to be scored join them order by order,
and the URLs join their grams. Only the grams that are frequent, whose number is bounded, are given to every task.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, small_batches

#: (rule, verdict): a host, which stands for its subdomains too, and the start of a path.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: Characters in a gram: the longest context and the one after it.
ORDER = 5
#: Before a URL's first character and behind its last; the probability of any character before anything is counted.
_START, _END, UNIFORM = "\x02", "\x03", 1 / 256
#: One in so many labelled URLs calibrates and isn't counted.
HELD_OUT = 5
#: A gram is frequent if it makes more than one in so many of all, so that fewer than that are.
FREQUENT = 10_000
_BINS, _SPAN = 4096, 8.0
_AT_ONCE = 1 << 16
_CLASSES = ("allow", "block")


def host_and_path(url):
    """Columns for host and path of a URL column; null or without ://, both are empty."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def with_rules(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, url, host, path, and the longest rule that fits with its verdict (else null)."""
    host, path = host_and_path(F.col("url"))
    out = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")).withColumn("host", host).withColumn("path", path)
    rule = verdict = F.lit(None).cast("string")
    for name, said in sorted(rules, key=lambda r: (len(r[0]), r[0])):  # the longest is tried first, so it comes last
        of_host, _, start = name.partition("/")
        fits = ((F.col("host") == of_host) | F.col("host").endswith(f".{of_host}")) & F.col("path").startswith(f"/{start}")
        rule, verdict = F.when(fits, F.lit(name)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return out.withColumn("rule", rule).withColumn("ruled", verdict)


def scored_text(url: str | None) -> str:
    """What the models see: the URL behind its scheme."""
    return (url or "").partition("://")[2] or (url or "")


def grams(url: str | None) -> list[str]:
    """Each character of a URL, and its end, with the characters before it."""
    text = scored_text(url)
    padded = _START * (ORDER - 1) + text + _END
    return [padded[k : k + ORDER] for k in range(len(text) + 1)]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each gram occurs in URLs, in all and in labelled ones of either class that aren't held out, summed over a batch."""
    for b in batches:
        found: dict[str, list[int]] = {}
        for url, n, said in zip(b.column("url").to_pylist(), b.column("n").to_pylist(), b.column("learn").to_pylist()):
            for g, times in Counter(grams(url)).items():
                counts = found.setdefault(g, [0, 0, 0])
                counts[0] += n * times
                if said is not None:
                    counts[1 + _CLASSES.index(said)] += n * times
        columns = list(zip(*found.values())) if found else [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), *(pa.array(c, pa.int64()) for c in columns)], ["gram", "n", *_CLASSES])


def log_ratios(counts: DataFrame) -> DataFrame:
    """(gram, n, ratio) for every gram of counts(gram, n, allow, block): log-likelihood of its last character after the others, accepted less rejected.

    From the shortest order up, a gram's probability is that of what lies behind its first character, interpolated with its own counts by how often, and with
    how many characters, its context is followed. Each order is a few joins of distinct grams.
    """
    known = None
    for order in range(1, ORDER + 1):
        gram = F.substring("gram", ORDER - order + 1, order)
        own = counts.groupBy(gram.alias("gram")).agg(*[F.sum(c).alias(c) for c in ("n", *_CLASSES)])
        context = F.substring("gram", 1, order - 1)
        seen = own.groupBy(context.alias("context")).agg(*[F.sum(c).alias(f"{c}_total") for c in _CLASSES], *[F.count_if(F.col(c) > 0).alias(f"{c}_kinds") for c in _CLASSES])
        rows = own.withColumn("context", context).join(seen, "context").drop("context")
        if known is None:
            rows = rows.select("*", *[F.lit(UNIFORM).alias(f"{c}_shorter") for c in _CLASSES])
        else:
            shorter = known.select(F.col("gram").alias("behind"), *[F.col(f"{c}_p").alias(f"{c}_shorter") for c in _CLASSES])
            rows = rows.withColumn("behind", F.substring("gram", 2, order - 1)).join(shorter, "behind").drop("behind")
        p = [F.when(F.col(f"{c}_total") > 0, (F.col(c) + F.col(f"{c}_kinds") * F.col(f"{c}_shorter")) / (F.col(f"{c}_total") + F.col(f"{c}_kinds"))).otherwise(F.col(f"{c}_shorter")).alias(f"{c}_p") for c in _CLASSES]
        known = rows.select("gram", "n", *p)
    return known.select("gram", "n", (F.log("allow_p") - F.log("block_p")).alias("ratio"))


def scores(urls: DataFrame, ratios: DataFrame) -> DataFrame:
    """(uid, score) for urls(uid, url): the mean of their grams' ratios."""
    total = ratios.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    frequent = {r["gram"]: r["ratio"] for r in ratios.filter(F.col("n") * FREQUENT > total).select("gram", "ratio").collect()}  # fewer than FREQUENT rows
    given = urls.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each URL the sum over its frequent grams, divided by the number of all, with a null gram; and its other grams with their share of all."""
        known = given.value

        def batch(*columns) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.string(), pa.float64()))], ["uid", "gram", "share"])

        for b in batches:
            ids, names, shares = [], [], []
            for uid, url in zip(b.column("uid").to_pylist(), b.column("url").to_pylist()):
                found = grams(url)
                rare = Counter(g for g in found if g not in known)
                ids += [uid] * (1 + len(rare))
                names += [None, *rare]
                shares += [math.fsum(known[g] for g in found if g in known) / len(found), *(times / len(found) for times in rare.values())]
                if len(ids) >= _AT_ONCE:
                    yield batch(ids, names, shares)
                    ids, names, shares = [], [], []
            yield batch(ids, names, shares)

    parts = materialize(urls.select("uid", "url").transform(small_batches).mapInArrow(run, "uid long, gram string, share double"), "url-grams")
    rare = parts.filter("gram is not null").join(ratios.select("gram", "ratio"), "gram").select("uid", (F.col("share") * F.col("ratio")).alias("share"))
    # sums depend on the order of their terms in the last places
    return parts.filter("gram is null").select("uid", "share").union(rare).groupBy("uid").agg(F.round(F.sum("share"), 9).alias("score"))


def threshold(histogram: np.ndarray) -> float:
    """The score from which URLs are accepted: best balanced accuracy over rows (block, allow) of score counts; ties go to the score nearest zero."""
    block, allow = histogram
    if not block.sum() or not allow.sum():
        return 0.0
    # cut k accepts bins k and above
    right = np.append(0, block.cumsum()) / block.sum() + 1 - np.append(0, allow.cumsum()) / allow.sum()
    cuts = np.arange(_BINS + 1) * (2 * _SPAN / _BINS) - _SPAN
    best = np.flatnonzero(right >= right.max() - 1e-12)
    return float(cuts[best[np.abs(cuts[best]).argmin()]])


def filter_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) for every row of pages(page_id, url, ...).

    verdict is the longest fitting rule's, else allow if the score reaches the calibrated threshold and
    block if not; of two rules as long, the one later by code point. A null or empty URL has empty host and path, scores 0 and, as nothing speaks for it,
    is blocked. If either class has no labelled URL, the threshold is 0. Very long URLs are read whole. Repeated rows come back row by row and count as
    often, an empty table gives an empty result; other columns of pages are ignored, whatever their names.
    """
    ruled = with_rules(pages, rules)
    held = F.pmod(F.xxhash64(F.lit("calibrate"), "url"), F.lit(HELD_OUT)) == 0
    urls = ruled.filter("url <> ''").groupBy("url").agg(F.count("*").alias("n"), F.first("ruled").alias("ruled"))
    urls = materialize(urls.select("url", "n", "ruled", held.alias("held"), F.when(~held, F.col("ruled")).alias("learn"), F.monotonically_increasing_id().alias("uid")), "urls")
    counts = urls.transform(small_batches).mapInArrow(_counted, "gram string, n long, allow long, block long").groupBy("gram").agg(*[F.sum(c).alias(c) for c in ("n", *_CLASSES)])
    ratios = materialize(log_ratios(materialize(counts, "gram-counts")), "ratios")
    scored = materialize(urls.join(scores(urls, ratios), "uid"), "scored")
    at = F.least(F.lit(_BINS - 1), F.greatest(F.lit(0), F.floor((F.col("score") + _SPAN) * (_BINS / (2 * _SPAN)))))
    histogram = np.zeros((2, _BINS))
    for r in scored.filter("held and ruled is not null").groupBy("ruled", at.cast("int").alias("bin")).agg(F.sum("n").alias("n")).collect():
        histogram[int(r["ruled"] == "allow"), r["bin"]] = r["n"]
    from_score = threshold(histogram)
    by_model = F.when((F.col("score") >= from_score) & (F.coalesce(F.length("url"), F.lit(0)) > 0), "allow").otherwise("block")
    found = ruled.join(scored.select("url", "score"), "url", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    return found.select("page_id", "host", "path", "rule", F.coalesce("ruled", by_model).alias("verdict"), "score")
