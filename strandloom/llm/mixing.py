"""Mixing sources to target weights, with DataFrame operations alone.

A source's documents, in a pseudorandom order, are one stream of words, cut into blocks of fixed length (the
last may be shorter). A source's target makes a number of slots: whole passes over its blocks, then a
part of a pass, its last block cut short, so that the slots hold the target to the word. How many of a source's
slots each output shard gets is drawn first, from a multinomial distribution over the shards. The shards then take
their counts from the source's slots one after another; a slot's place in its pass goes through a permutation of
the pass to a block's index; and blocks join the pieces of documents by that index.

All pseudorandom numbers are the first 60 bits of an MD5, so that any SQL engine can follow them.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import GAP_AND_WORD, WORD_GAP, materialize, row_keys, word_count

SEED = 7
#: Words in a block; output shards; what a source can exceed its size by; weights of the sources in order, repeating.
BLOCK, SHARDS, MOST, WEIGHTS = 1024, 16, 3, (5, 2, 1)
#: Rounds of the swap-or-not permutation.
ROUNDS = 24
#: Documents that one task lays out one after another, and slots that one row unfolds to.
RUN, UNFOLD = 1024, 256


def draw(*parts):
    """60 pseudorandom bits from text parts, nulls as empty text."""
    text = F.concat_ws("|", *[F.coalesce((p if not isinstance(p, (int, str)) else F.lit(p)).cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def sources(thin: DataFrame) -> DataFrame:
    """One row per source: sid, source, source_size, target, and the passes and words that make it up.

    Targets share the total by weight; what passes MOST times a source's size goes to the others by weight.
    In order of limit over weight, a source is under its limit from the first at which the rest, shared
    among it and those behind it, fits.
    """
    sums = thin.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1
    pick = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.col("sid") % len(WEIGHTS) + 1).cast("int"))
    table = sums.withColumn("sid", rank).withColumn("weight", pick.cast("double")).withColumn("limit", MOST * F.col("source_size")).withColumn("ratio", F.col("limit") / F.col("weight"))
    order = Window.orderBy("ratio", "sid")
    before, on = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.partitionBy()
    share = (F.sum("source_size").over(every) - F.coalesce(F.sum("limit").over(before), F.lit(0))) / F.sum("weight").over(on)
    table = table.withColumn("share", share).withColumn("place", F.row_number().over(order))
    level = F.min(F.when(F.col("share") <= F.col("ratio"), F.struct("place", "share"))).over(every)["share"]
    table = table.withColumn("target", F.least(F.col("limit").cast("double"), F.col("weight") * level))
    words = F.floor(F.col("target") + 0.5).cast("long")
    return table.withColumn("words", words).select(
        "sid",
        "source",
        "source_size",
        "target",
        F.expr("if(source_size > 0, words div source_size, 0)").alias("passes"),
        F.expr("if(source_size > 0, words % source_size, 0)").alias("rest"),
        F.expr(f"(source_size + {BLOCK - 1}) div {BLOCK}").alias("blocks"),
    )


def permuted(x, n, *key):
    """The place of x under a pseudorandom permutation of 0..n-1 (columns): swap-or-not rounds."""

    def step(at, k):
        partner = F.pmod(draw(SEED, "turn", *key, k) - at, n)
        return F.when(draw(SEED, "swap", *key, k, F.greatest(at, partner)) % 2 == 0, partner).otherwise(at)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), x.cast("long"), step)


def _slot_counts(table: DataFrame) -> DataFrame:
    """The sources with what their slots follow from: full blocks, words of the short one (tail), number of slots; sources without slots are gone."""
    # the part of a pass that is left: its blocks, counted as if all were full, with one more for a short one
    upper = F.least(F.col("blocks"), F.expr(f"(rest + {BLOCK - 1}) div {BLOCK}") + 1)
    count = F.col("passes") * F.col("blocks") + F.when(F.col("rest") > 0, upper).otherwise(0)
    return table.withColumn("full", F.expr(f"source_size div {BLOCK}")).withColumn("tail", F.expr(f"source_size % {BLOCK}")).withColumn("slots", count).filter("slots > 0")


def _runs(rows: DataFrame) -> DataFrame:
    """rows of sources, one for each run of UNFOLD slots, dealt out: these few small rows unfold to many, so they mustn't be put together by size."""
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = rows.withColumn("run", F.explode(F.expr(f"sequence(0, (slots - 1) div {UNFOLD})"))).repartition(tasks, "sid", "run")
    return runs.withColumn("slot", F.explode(F.expr(f"sequence(run * {UNFOLD}, least(slots, (run + 1) * {UNFOLD}) - 1)")))


def shard_counts(table: DataFrame) -> DataFrame:
    """(sid, shard, slots, upto): how many of its slots each source gives to each output shard, drawn from a multinomial distribution, and their running sum.

    As many throws as the source has slots, each into one of SHARDS shards; only their counts, SHARDS rows a source, are kept.
    """
    thrown = _runs(_slot_counts(table).select("sid", "slots")).select("sid", (draw(SEED, "shard", F.col("sid"), F.col("slot")) % SHARDS).cast("int").alias("shard"))
    counts = thrown.groupBy("sid", "shard").agg(F.count("*").alias("slots"))
    return counts.withColumn("upto", F.sum("slots").over(Window.partitionBy("sid").orderBy("shard")))


def slots(table: DataFrame, counts: DataFrame) -> DataFrame:
    """Every slot that the shards take: sid, slot, shard, block, `pass`, whether it is of a whole pass, and the words it takes from its block's front.

    counts is what shard_counts has drawn: a shard takes the slots behind those of the shards before it. The short block, if there is one, stands at a drawn place of each pass.
    """
    drawn = counts.groupBy("sid").agg(F.array_sort(F.collect_list(F.struct("upto", "shard"))).alias("drawn"))  # SHARDS entries a source
    out = _runs(_slot_counts(table).join(drawn, "sid"))
    out = out.withColumn("shard", F.element_at(F.filter("drawn", lambda d: d["upto"] > F.col("slot")), 1)["shard"])
    out = out.withColumn("pass", F.expr("slot div blocks")).withColumn("at", F.expr("slot % blocks"))
    out = out.withColumn("tail_at", F.when(F.col("tail") > 0, draw(SEED, "tail", F.col("sid"), F.col("pass")) % F.col("blocks")).otherwise(F.col("blocks")))
    of_full = F.col("at") - F.when(F.col("at") > F.col("tail_at"), 1).otherwise(0)
    out = out.withColumn("block", F.when(F.col("at") == F.col("tail_at"), F.col("full")).otherwise(permuted(of_full, F.greatest("full", F.lit(1)), F.col("sid"), F.col("pass"))))
    before = F.col("at") * BLOCK - F.when(F.col("at") > F.col("tail_at"), BLOCK - F.col("tail")).otherwise(0)
    length = F.when(F.col("at") == F.col("tail_at"), F.col("tail")).otherwise(F.lit(BLOCK))
    whole = F.col("pass") < F.col("passes")
    take = F.when(whole, length).otherwise(F.greatest(F.lit(0), F.least(length, F.col("rest") - before)))
    return out.select("sid", "slot", "shard", "block", "pass", whole.alias("whole"), take.cast("long").alias("take")).filter("take > 0")


def placed(thin: DataFrame, table: DataFrame) -> DataFrame:
    """thin with its source's columns and `start`, a document's first word in its source's stream.

    The stream runs by drawn number. Runs of it, by the number's highest bits, are summed by themselves and
    then laid end to end, so that a hot source is spread over many tasks.
    """
    bits = max(0, math.ceil(math.log2(max(1, thin.count() / RUN))))
    known = thin.join(table.select("sid", "source", "source_size", "target", "passes"), thin["source"].eqNullSafe(table["source"])).drop(table["source"])
    known = known.withColumn("run", F.expr(f"shiftright(order_key, {60 - bits})"))
    ends = known.groupBy("sid", "run").agg(F.sum("size").alias("words"))
    base = ends.withColumn("base", F.sum("words").over(Window.partitionBy("sid").orderBy("run")) - F.col("words")).select("sid", "run", "base")
    own = Window.partitionBy("sid", "run").orderBy("order_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return known.withColumn("upto", F.sum("size").over(own)).join(base, ["sid", "run"]).withColumn("start", F.col("base") + F.col("upto") - F.col("size")).drop("upto", "base", "run")


def measured(docs: DataFrame, *more) -> DataFrame:
    """doc_id, source, size in words and the number that orders a source's stream; more of docs' columns may be asked for."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count().alias("size"), draw(SEED, "order", F.col("doc_id"), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))).alias("order_key"), *more)


def mix(docs: DataFrame, *more) -> DataFrame:
    """One row for every row of docs(doc_id, text, source, ...): doc_id, size, source, source_size, target, taken, passes, by_shard, parts, shard.

    size counts words `[^\\x20\\x09-\\x0D]+` (null: 0); taken is how many words the mix takes of the document, with
    repeats: all of it `passes` times, and once more the word ranges `parts`, (from, upto) structs in order. by_shard has
    the words that each output shard takes of it, as structs (shard, words) in order of the shards; null where nothing is taken.
    shard is the one that takes its first words in the first pass that takes any.
    A null source is a source, the last. Empty texts are taken 0 times. Repeated rows lie one after another in the
    stream. If all texts are empty, so is the mix; an empty table gives an empty result. Same rows, same mix.
    """
    thin = materialize(measured(docs, *more), "measured")
    table = materialize(sources(thin), "sources")
    counts = materialize(shard_counts(table), "shard-counts")
    at = materialize(placed(thin, table), "placed")
    pieces = at.filter("size > 0").select("sid", "start", "size", F.explode(F.expr(f"sequence(start div {BLOCK}, (start + size - 1) div {BLOCK})")).alias("block"))
    first, last = F.greatest(F.lit(0).cast("long"), F.col("start") - F.col("block") * BLOCK), F.least(F.lit(BLOCK).cast("long"), F.col("start") + F.col("size") - F.col("block") * BLOCK)
    pieces = pieces.select("sid", "start", "block", first.alias("first"), last.alias("last"))
    # a slot takes of a piece what lies before its own end; a block has a slot in every pass at most
    # the slots unfold from a few rows, by whose size a broadcast would be chosen
    met = pieces.join(slots(table, counts).hint("merge"), ["sid", "block"]).withColumn("upto", F.least("last", "take")).filter("upto > first")
    shift = F.col("block") * BLOCK - F.col("start")
    met = met.select("sid", "start", "shard", "pass", "whole", (F.col("first") + shift).alias("from"), (F.col("upto") + shift).alias("upto"))
    part = F.when(~F.col("whole"), F.struct("from", "upto"))
    of_shard = met.groupBy("sid", "start", "shard").agg(F.sum(F.col("upto") - F.col("from")).alias("words"), F.collect_list(part).alias("parts"), F.min(F.struct("pass", "from")).alias("head"))
    taken = of_shard.groupBy("sid", "start").agg(
        F.sum("words").alias("taken"),
        F.array_sort(F.collect_list(F.struct("shard", "words"))).alias("by_shard"),
        F.array_sort(F.flatten(F.collect_list("parts"))).alias("parts"),
        F.min(F.struct(F.col("head.pass").alias("pass"), F.col("head.from").alias("from"), "shard"))["shard"].alias("shard"),
    )
    taken = materialize(taken.withColumnRenamed("start", "at"), "taken")
    # arrays unfold to far more than their files' bytes, by which a broadcast would be chosen
    out = at.withColumn("at", F.when(F.col("size") > 0, F.col("start"))).join(taken.hint("merge"), ["sid", "at"], "left")
    return out.withColumn("taken", F.coalesce("taken", F.lit(0).cast("long"))).drop("sid", "at", "start", "order_key")


def mixed_documents(docs: DataFrame, shard: str | None = None) -> DataFrame:
    """The mix as rows of docs: each document as often as it is taken whole, and what else is taken of it as one more row.

    A whole document keeps its text. A part is cut from the text as it stands, white space and all, from its first word to the end of its
    last; parts that don't touch are joined by a line feed. n_chars, if there is such a column, follows the text; other columns are repeated.
    Documents of which nothing is taken are gone, null and empty texts among them. Rows equal in all columns are taken row by row. An empty table
    gives an empty result. With the name of a column more, `shard`, that column has the output shard that takes the document's first words, by which the rows can be written.
    """
    # rows travel as one struct, so that no name of docs can clash, and meet what is taken of them by their keys
    rows = row_keys(docs)
    mixed = mix(rows.select("part", "place", *[F.col("row").getField(c).alias(c) for c in ("doc_id", "text", "source")]), "part", "place").filter("taken > 0")
    taken = rows.join(mixed.select("part", "place", "size", "passes", "parts", "shard").hint("merge"), ["part", "place"])
    whole = F.col("passes") * (F.col("size") > 0).cast("long")
    partly = F.aggregate("parts", F.lit(0).cast("long"), lambda n, p: n + p["upto"] - p["from"])
    taken = taken.withColumn("partly", F.coalesce(partly, F.lit(0)))
    # words with the gaps before them, so that neighbours put together are the text as it stands
    taken = taken.withColumn("words", F.when((F.col("partly") > 0) & (F.col("partly") < F.col("size")), F.regexp_extract_all(F.col("row.text"), F.lit(GAP_AND_WORD), 0)))

    def cut(p, k):
        text = F.array_join(F.slice("words", (p["from"] + 1).cast("int"), (p["upto"] - p["from"]).cast("int")), "")
        touches = F.coalesce(F.get("parts", k - 1)["upto"] == p["from"], F.lit(False))
        return F.when(touches, text).otherwise(F.concat(F.when(k > 0, "\n").otherwise(""), F.regexp_replace(text, rf"\A{WORD_GAP}", "")))

    piece = F.when(F.col("partly") == F.col("size"), F.col("row.text")).when(F.col("partly") > 0, F.array_join(F.transform("parts", cut), ""))
    copies = F.concat(F.when(whole > 0, F.array_repeat(F.col("row.text"), whole.cast("int"))).otherwise(F.array().cast("array<string>")), F.filter(F.array(piece), lambda t: t.isNotNull()))
    out = taken.withColumn("copies", copies).select("row", "shard", F.explode("copies").alias("copy"))
    columns = [F.col("copy").alias(c) if c == "text" else F.length("copy").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col("row").getField(c).alias(c) for c in docs.columns]
    return out.select(*columns, *([F.col("shard").alias(shard)] if shard else []))
