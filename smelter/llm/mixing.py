"""Mixing sources to target weights with hash thresholds.

Every document has a 64-bit hash. A source that needs ``full`` whole passes and a rest takes the documents whose hash
lies below a cut once more. The cut is found from histograms: tokens by source and the first 16 bits of the hash, then
the next 16 bits inside the boundary bucket only, and so on. Nothing is sorted but bucket totals, and the hash alone
decides, so reruns agree. A larger target never takes fewer copies of any document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import durable

WORD = r"[^\x20\x09-\x0D]+"
MOST_COPIES = 3
WEIGHTS = (1, 2, 3)
LEVEL_BITS = 16
#: A table of sources up to this many rows is broadcast; a longer one is joined by shuffle.
BROADCAST_SOURCES = 20_000
_POSITION = (1 << 33) - 1


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def key_of(doc_id: Column, text: Column) -> Column:
    """Rows equal in id and text share a key and are taken alike."""
    return F.xxhash64(doc_id, text)


def _part(level: int) -> Column:
    """Bits of the key for one level; ordered by level they give the order of the signed key."""
    shifted = F.shiftright("key", 64 - LEVEL_BITS * (level + 1))
    return shifted if level == 0 else shifted.bitwiseAND(F.lit((1 << LEVEL_BITS) - 1))


def _join(rows: DataFrame, sources: DataFrame, n_sources: int, on: list[str], how: str = "inner") -> DataFrame:
    """Join a table of at most ``n_sources`` rows on columns that may be NULL."""
    renamed = sources.withColumnsRenamed({c: f"_{c}" for c in on})
    condition = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in on]
    side = F.broadcast(renamed) if n_sources <= BROADCAST_SOURCES else renamed
    return rows.join(side, condition, how).drop(*[f"_{c}" for c in on])


def _ranked(totals: DataFrame) -> DataFrame:
    """Number sources 0.. by code point, NULL last, without a single-task sort of all of them."""
    order = [F.col("source").isNull(), F.col("source").asc_nulls_last()]
    ranged = durable(totals.repartitionByRange(*order).sortWithinPartitions(*order)
                     .select("*", F.spark_partition_id().alias("part"),
                             F.monotonically_increasing_id().bitwiseAND(F.lit(_POSITION)).alias("position")))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # one row per partition
    starts = (ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
              .withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))))
    return ranged.join(starts, "part").withColumn("rank", F.col("start") + F.col("position"))


def source_targets(sized: DataFrame, weights=WEIGHTS, most: int = MOST_COPIES) -> tuple[DataFrame, int]:
    """(source, source_size, target) of each source, and the number of sources.

    Targets share the total size by weight; one above ``most`` times its source's size stops there and the excess is
    shared again by weight. With L the words that a weight of 1 gets, every target is min(cap, L * weight), and L
    only grows from round to round.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = durable(_ranked(totals).select(
        "source", "source_size", (F.col("source_size") * F.lit(float(most))).alias("cap"),
        F.element_at(cycle, (F.col("rank") % len(weights)).cast("int") + 1).alias("weight")))
    total, n = ranked.agg(F.coalesce(F.sum("source_size"), F.lit(0)).cast("double"), F.count(F.lit(1))).first()
    level, stopped_before = 0.0, -1
    while True:
        stops = F.col("cap") <= F.lit(level) * F.col("weight")
        stopped, held, open_weight = ranked.agg(
            F.count(F.when(stops, 1)), F.coalesce(F.sum(F.when(stops, F.col("cap"))), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~stops, F.col("weight"))), F.lit(0.0))).first()
        if stopped == stopped_before or not open_weight:
            break
        stopped_before, level = stopped, (total - held) / open_weight
    target = F.least(F.col("cap"), F.lit(level) * F.col("weight"))
    return ranked.select("source", "source_size", target.alias("target")), n


def source_cuts(sized: DataFrame, weights=WEIGHTS, most: int = MOST_COPIES) -> tuple[DataFrame, int]:
    """Per source: size, target, whole passes (``full``), and the cut: keys below it are taken once more, keys equal
    to it if that comes nearer to the target (``at_cut``). ``sized`` has source, size and key."""
    targets, n = source_targets(sized, weights, most)
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    level_state = durable(targets.withColumn("full", F.least(passes, F.lit(most)).cast("long"))
                          .withColumn("rest", F.col("target") - F.col("full") * F.col("source_size"))
                          .withColumn("prefix", F.lit(0).cast("long")).withColumn("below", F.lit(0).cast("long")))
    rows = sized
    for level in range(64 // LEVEL_BITS):
        last = level == 64 // LEVEL_BITS - 1
        inside = _join(rows, level_state.select("source", "prefix", "below", "rest"), n, ["source"])
        if level:
            inside = inside.where(F.shiftright("key", 64 - LEVEL_BITS * level) == F.col("prefix"))
        buckets = (inside.groupBy("source", "prefix", "below", "rest", _part(level).alias("part"))
                   .agg(F.sum("size").alias("size")))
        run = F.sum("size").over(W.partitionBy("source").orderBy("part"))  # at most 2^16 buckets a source
        crossed = (buckets.withColumn("after", F.col("below") + run).where(F.col("after") > F.col("rest"))
                   .groupBy("source").agg(F.min_by(F.struct("prefix", "part", "after", "size"), "part").alias("b")))
        edge = crossed.select("source", (F.col("b.prefix") * (1 << LEVEL_BITS) + F.col("b.part") if level else
                                         F.col("b.part")).alias("new_prefix"),
                              (F.col("b.after") - F.col("b.size")).alias("new_below"), F.col("b.size").alias("group_size"))
        joined = _join(level_state.drop("below", "prefix"), edge, n, ["source"], "left")
        level_state = durable(joined.withColumnsRenamed({"new_prefix": "prefix", "new_below": "below"})
                              .drop(*([] if last else ["group_size"])))
    nearer = F.col("below") + F.col("group_size") - F.col("rest") <= F.col("rest") - F.col("below")
    return level_state.select("source", "source_size", "target", "full", F.col("prefix").alias("cut"),
                              F.coalesce(nearer, F.lit(False)).alias("at_cut")), n


def _copies() -> Column:
    more = (F.col("key") < F.col("cut")) | ((F.col("key") == F.col("cut")) & F.col("at_cut"))
    return F.col("full") + F.coalesce(more, F.lit(False)).cast("long")


def _sized(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", words(F.col("text")).alias("size"),
                       key_of(F.col("doc_id"), F.col("text")).alias("key"))


def mix(docs: DataFrame, weights=WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """(doc_id, size, source_size, target, taken): how many words the mix takes of each document.

    A document is taken whole, 0 to ``most`` times. NULL texts have size 0, a NULL source is a source, rows that
    repeat an id and text are taken alike. A source's taken words miss its target by at most half of the document
    (or group of repeated rows) at its cut. An empty table gives an empty table.
    """
    sized = durable(_sized(docs))
    cuts, n = source_cuts(sized, weights, most)
    return _join(sized, cuts, n, ["source"]).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * _copies()).alias("taken"))


def mixed_documents(docs: DataFrame, weights=WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """The documents of the mix: each row as often as the mix takes it, all columns unchanged.

    A document without words weighs nothing; it stays once.
    """
    cuts, n = source_cuts(durable(_sized(docs)), weights, most)
    own = docs.select(F.struct(*docs.columns).alias("doc"), F.col("source").alias("source"),
                      key_of(F.col("doc_id"), F.col("text")).alias("key"),
                      F.coalesce(F.rlike("text", F.lit(r"[^\x20\x09-\x0D]")), F.lit(False)).alias("has_words"))
    times = F.when(F.col("has_words"), _copies()).otherwise(1).cast("int")
    taken = _join(own, cuts, n, ["source"]).select("doc", F.explode(F.array_repeat(F.lit(0), times)))
    return taken.select("doc.*")
