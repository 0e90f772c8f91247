"""Mixing sources to target weights by capped water-filling (DataFrame functions only).

Every source may contribute at most ``max_epochs`` times its size. The share of all words that
exceeds a cap is dealt again to the other sources in proportion to their weights until none is
above its cap. That fixed point has a closed form: with sources in ascending order of cap / weight,
the first k are clamped and the rest share what is left at one level.

A source's epochs are whole repetitions, which every document gets, and a fraction. For the
fraction, documents of one source are dealt by size from large to small with the error carried
along, so the words taken stay within about half a small document of the target; which of the
documents of equal size are taken follows a seeded hash. Null texts have size 0; null sources are a source of
their own, last in order; an empty table gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lintmill.llm.common import WORD_PATTERN, cut, fresh

#: Sub-groups of the documents of one source and size, so that a hot group is spread over tasks.
SALTS = 256
#: Distinct sizes folded into one array at a time.
CHUNK = 1024


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, max_epochs: float = 2.0) -> DataFrame:
    """Per source of ``sized(source, size)``: source_size, weight, target.

    The windows run over one row per source, not over documents.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = W.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = totals.withColumn("weight", F.element_at(cycle, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
    everything = W.partitionBy(F.lit(0))
    level = W.partitionBy(F.lit(0)).orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = level.rowsBetween(W.unboundedPreceding, -1), level.rowsBetween(0, W.unboundedFollowing)
    filled = (
        ranked.withColumn("total", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("rest", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("here", F.col("rest") / F.sum("weight").over(after))
        .withColumn("fits", F.col("cap") / F.col("weight") > F.col("here"))
        # the level of the first source that is not clamped holds for all later ones
        .withColumn("level", F.min(F.when(F.col("fits"), F.struct(F.col("cap") / F.col("weight"), F.col("here")))).over(everything)["here"])
    )
    target = F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("weight") * F.col("level")))
    return filled.select("source", "source_size", "weight", target.alias("target"))


def _quotas(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """How many documents of each (source, size, salt) get one more repetition: ``extra``.

    One row per source and distinct size is folded from large to small. The number of distinct
    sizes is bounded by the longest document, not by the number of documents.
    """
    groups = sized.where("size > 0").groupBy("source", "size", "salt").agg(F.count("*").alias("n"))
    sizes = groups.groupBy("source", "size").agg(F.sum("n").alias("n"))
    ranked = sizes.withColumn("chunk", F.floor((F.row_number().over(W.partitionBy("source").orderBy(F.desc("size"))) - 1) / CHUNK))
    chunks = ranked.groupBy("source", "chunk").agg(F.sort_array(F.collect_list(F.struct("size", "n")), asc=False).alias("sizes"))
    per_source = chunks.groupBy("source").agg(F.transform(F.sort_array(F.collect_list(F.struct("chunk", "sizes"))), lambda c: c["sizes"]).alias("sizes"))
    fraction = F.col("target") / F.col("source_size") - F.floor(F.col("target") / F.col("source_size"))
    per_source = per_source.join(targets.withColumnRenamed("source", "t_source"), F.col("source").eqNullSafe(F.col("t_source"))).select("source", "sizes", fraction.alias("fraction"))
    none = F.array().cast("array<bigint>")

    def step(acc: Column, x: Column) -> Column:
        owed = acc["owed"] + F.col("fraction") * x["size"] * x["n"]
        pick = F.greatest(F.lit(0).cast("bigint"), F.least(x["n"], F.round(owed / x["size"]).cast("bigint")))
        return F.struct((owed - (pick * x["size"]).cast("double")).alias("owed"), F.array_append(acc["picks"], pick).alias("picks"))

    def chunk_step(acc: Column, chunk: Column) -> Column:
        # arrays grow within a chunk and by whole chunks, so appending stays cheap however many sizes there are
        done = F.aggregate(chunk, F.struct(acc["owed"].alias("owed"), none.alias("picks")), step)
        return F.struct(done["owed"].alias("owed"), F.array_append(acc["picks"], done["picks"]).alias("picks"))

    zero = F.struct(F.lit(0.0).alias("owed"), F.array().cast("array<array<bigint>>").alias("picks"))
    picks = per_source.withColumn("picks", F.flatten(F.aggregate("sizes", zero, chunk_step)["picks"])).withColumn("sizes", F.flatten("sizes"))
    picked = picks.select("source", F.explode(F.arrays_zip("sizes", "picks")).alias("z")).select("source", F.col("z.sizes.size").alias("size"), F.col("z.sizes.n").alias("of"), F.col("z.picks").alias("pick"))
    within = W.partitionBy("source", "size").orderBy("salt")
    upto = F.sum("n").over(within)
    dealt = groups.withColumn("upto", upto).join(picked.withColumnRenamed("source", "s2").withColumnRenamed("size", "z2"), F.col("source").eqNullSafe(F.col("s2")) & (F.col("size") == F.col("z2")))
    share = lambda c: F.floor(F.col("pick") * c / F.col("of"))
    return dealt.select("source", "size", "salt", (share(F.col("upto")) - share(F.col("upto") - F.col("n"))).alias("extra"))


def mix(docs: DataFrame, *, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, max_epochs: float = 2.0, seed: int = 42) -> DataFrame:
    """Per document of ``docs(doc_id, text, source)``: doc_id, source, size, source_size, target, repeats, taken.

    ``repeats`` is the number of times the mix takes the document, ``taken`` that many times its
    size. Rows that are alike in id, source and size are interchangeable, so reruns agree.
    """
    salt = F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id", "text_hash"), F.lit(SALTS)).cast("int")
    sized = cut(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64(F.col("text")).alias("text_hash")).withColumn("salt", salt))
    targets = cut(source_targets(sized, weights, share, max_epochs))
    quotas = cut(_quotas(sized, targets))
    order = W.partitionBy("source", "size", "salt").orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id", "text_hash")
    ranked = sized.withColumn("rank", F.row_number().over(order))
    q = quotas.select(F.col("source").alias("q_source"), F.col("size").alias("q_size"), F.col("salt").alias("q_salt"), "extra")
    t = targets.select(F.col("source").alias("t_source"), "source_size", "target")
    joined = (
        ranked.join(q, F.col("source").eqNullSafe(F.col("q_source")) & (F.col("size") == F.col("q_size")) & (F.col("salt") == F.col("q_salt")), "left")
        .join(t, F.col("source").eqNullSafe(F.col("t_source")))
    )
    whole = F.coalesce(F.floor(F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size"))), F.lit(0))
    repeats = (whole + F.when(F.col("rank") <= F.coalesce("extra", F.lit(0)), 1).otherwise(0)).cast("int")
    return joined.select("doc_id", "source", "size", "source_size", "target", repeats.alias("repeats"), (repeats * F.col("size")).cast("long").alias("taken"))


def mix_rows(docs: DataFrame, **options) -> DataFrame:
    """The mixed documents themselves: each row of ``docs`` as often as the mix takes it.

    Documents without words weigh nothing and stay once. Rows that share id, source and size are
    told apart by a running number on both sides, so none is multiplied twice. The number of a repetition is in ``copy``, with
    underscores after it where ``docs`` has such a column; other columns pass through, whatever their names.
    """
    keys = ["doc_id", "source", "size"]
    chosen = mix(docs, **options).select(*keys, "repeats").withColumn("twin", F.row_number().over(W.partitionBy(*keys).orderBy("repeats")))
    chosen = chosen.select(*[F.col(c).alias(f"k_{c}") for c in [*keys, "twin"]], "repeats")
    # the row itself travels as one struct, so no name in it can clash
    left = docs.select(F.struct("*").alias("row")).withColumn("mix_size", word_count(F.col("row.text")))
    left = left.withColumn("mix_twin", F.row_number().over(W.partitionBy("row.doc_id", "row.source", "mix_size").orderBy(F.xxhash64("row.text"))))
    on = F.col("row.doc_id").eqNullSafe(F.col("k_doc_id")) & F.col("row.source").eqNullSafe(F.col("k_source")) & (F.col("mix_size") == F.col("k_size")) & (F.col("mix_twin") == F.col("k_twin"))
    times = F.when(F.col("mix_size") == 0, F.lit(1)).otherwise(F.col("repeats"))
    joined = left.join(chosen, on).where(times > 0)
    return joined.select("row", F.explode(F.sequence(F.lit(1), times)).alias("copy")).select("row.*", F.col("copy").alias(fresh(docs, "copy")))
