"""Mixing sources to target weights, with DataFrame expressions only.

Targets fill the whole corpus size by weight, capped at ``most_copies`` times a
source.  Every (source, shard) cell is a stream of whole documents, the longest
sizes first and seeded within a size; it is cut into blocks of ``block_words``
words, and a document belongs to the block in which it starts, so that no text is
ever cut.  Sainte-Lague apportionment (each next block goes to the highest
quotient votes / (2 k + 1)) gives each source a whole number of blocks, and each
shard of a source its part of them.  Block i of a stretch of w words, of which r are to be
taken, is taken as often as the rounded line (r i + u) / w rises there, u being
a seeded offset.  A cell is taken in ``LEVELS`` stretches, longest documents
first; each one's r is what the quota still lacks, so that what a long document
takes too much or too little is made up by the shorter ones after it.

With ``fine`` stretches, the last two blocks' words of a cell are taken in that
many further ones (two blocks, one, half a block, ...), in which every document is
a block of its own and the rise is rounded to the nearest, and before them no
document is taken beyond what the quota lacks: a cell then misses its quota by
parts of a document, not of a block.

The window over a source is split into shards of bounded words, so that a hot
source is spread; only sizes, never texts, are needed to decide.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

#: A cell's stream is taken in parts: half of its words, half of the rest, and so on.
LEVELS = 5
WORD = r"[^\x20\x09-\x0D]+"


def seeded(seed: int, *parts: Column) -> Column:
    """First 32 bits of an MD5 over seed and parts, as long."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *parts)), 1, 8), 16, 10).cast("long")


def apportion(cells: DataFrame, votes: Column, seats: Column, most: Column, order: list[str], within: list[str]) -> DataFrame:
    """Sainte-Lague: ``quota`` seats for each row, the rows of one ``within`` sharing ``seats``.

    Ties between quotients go to the first row in ``order``; no row gets more
    than ``most``.  Only quotients near the threshold are ranked (at most about
    two for each row): all above are certain, all below have no chance.
    """
    group = Window.partitionBy(*within)
    c = cells.withColumns({"__v": votes.cast("double"), "__seats": seats.cast("double"), "__most": most.cast("long")})
    c = c.withColumns({"__sum": F.sum("__v").over(group), "__n": F.count("*").over(group)})
    share = F.when(F.col("__sum") > 0, F.col("__v") / F.col("__sum")).otherwise(F.lit(0.0))
    low = F.floor(share * F.greatest(F.col("__seats") - F.col("__n") / 2 - 1, F.lit(0.0)) + 0.5)
    high = F.ceil(share * (F.col("__seats") + F.col("__n") / 2 + 1) + 0.5)
    c = c.withColumn("__low", F.least(low, F.col("__most")))
    c = c.withColumn("__high", F.greatest(F.least(high, F.col("__most")), F.col("__low")))
    c = c.withColumn("__left", F.col("__seats") - F.sum("__low").over(group))
    claims = c.filter("__high > __low").withColumn("__k", F.explode(F.sequence(F.col("__low"), F.col("__high") - 1)))
    rank = F.row_number().over(Window.partitionBy(*within).orderBy((F.col("__v") / (2 * F.col("__k") + 1)).desc(), *order, "__k"))
    won = claims.filter("__v > 0").withColumn("__rank", rank).filter("__rank <= __left").groupBy(*order).agg(F.count("*").alias("__won"))
    same = [F.col(f"c.{k}").eqNullSafe(F.col(f"w.{k}")) for k in order]
    joined = c.alias("c").join(won.alias("w"), same, "left")
    quota = (F.col("c.__low") + F.coalesce("w.__won", F.lit(0))).alias("quota")
    return joined.select(*[F.col(f"c.{k}") for k in cells.columns], quota)


def source_targets(sources: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most_copies: int = 3) -> DataFrame:
    """``sources`` (source, source_size) with ``weight`` and ``target``.

    Sources by code point, null last, weigh ``weights`` in turn.  The targets
    sum to all words; those above ``most_copies`` times their source stop there
    and the excess goes to the others by weight.  In order of size per weight
    the capped sources come first, so one running sum finds the level.
    """
    everything = Window.partitionBy()
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1).cast("int"))
    s = sources.withColumn("weight", weight).withColumn("cap", (most_copies * F.col("source_size")).cast("double"))
    level = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    upto = level.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumns(
        {
            "__total": F.sum("source_size").over(everything).cast("double"),
            "__caps": F.coalesce(F.sum("cap").over(upto), F.lit(0.0)),
            "__rest": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(upto), F.lit(0)),
        }
    )
    s = s.withColumn("__level", (F.col("__total") - F.col("__caps")) / F.col("__rest"))
    free = F.max(F.when(F.col("cap") / F.col("weight") > F.col("__level"), F.col("__level"))).over(everything)
    s = s.withColumn("__free", free)
    target = F.when(F.col("__free").isNull() | (F.col("cap") <= F.col("weight") * F.col("__free")), F.col("cap")).otherwise(F.col("weight") * F.col("__free"))
    return s.withColumn("target", target).select("source", "source_size", "weight", "target", F.col("__total").cast("long").alias("total"))


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = (1, 2, 3),
    most_copies: int = 3,
    block_words: int = 256,
    shard_words: int = 1 << 24,
    least_shard_words: int = 1 << 17,
    seed: int = 17,
    fine: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """``docs`` with what the mix takes of each: size, source_size, target, quota (its cell's), copies, taken.

    A size is the number of words; a null or empty text has none and gives
    none.  ``taken`` is size times copies: documents are taken whole.  A shard
    holds a 256th of all words, within ``least_shard_words`` and
    ``shard_words``, and is chosen by id and text.  A null source is a source of
    its own (last); repeated rows are separate documents; an empty table stays
    empty.  Columns with the added names are replaced; names starting ``__``
    are reserved.
    """
    taken = ("size", "source_size", "target", "quota", "copies", "taken", "shard", "shards", "start", "block", "cell_size", "offset")
    size = F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long")
    key = F.concat_ws("|", F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")))
    facts = saved(docs.select(F.col(source_col).alias("source"), key.alias("id"), size.alias("size")), "mix-sizes")
    total = facts.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    words_of_shard = max(least_shard_words, min(shard_words, total // 256))

    targets = source_targets(facts.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most_copies)
    targets = saved(targets.withColumn("shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / words_of_shard))), "mix-targets")
    shard_of = lambda i, n: F.pmod(seeded(seed, F.lit("shard"), i), n)
    cells = facts.alias("f").join(targets.alias("t"), F.col("f.source").eqNullSafe(F.col("t.source")))
    cells = cells.select("t.*", shard_of(F.col("id"), F.col("shards")).alias("shard"), "size")
    cells = cells.groupBy("source", "source_size", "target", "total", "shards", "shard").agg(F.sum("size").alias("cell_size"))
    cells = saved(cells.withColumn("n_blocks", F.ceil(F.col("cell_size") / block_words)), "mix-shards")
    by_source = cells.groupBy("source", "source_size", "target", "total", "shards").agg(F.sum("n_blocks").alias("n_blocks"))
    quotas = apportion(by_source.withColumn("__all", F.lit(0)), F.col("target"), F.round(F.col("total") / block_words), most_copies * F.col("n_blocks"), ["source"], ["__all"])
    quotas = saved(quotas.select("source", F.col("quota").alias("source_quota")), "mix-quotas")
    cells = cells.alias("c").join(quotas.alias("q"), F.col("c.source").eqNullSafe(F.col("q.source"))).select("c.*", "q.source_quota")
    cells = apportion(cells, F.coalesce(F.try_divide(F.col("target") * F.col("cell_size"), F.col("source_size")), F.lit(0.0)), F.col("source_quota"), most_copies * F.col("n_blocks"), ["source", "shard"], ["source"])
    offset = F.pmod(seeded(seed, F.lit("block"), F.coalesce("source", F.lit("null")), F.col("shard").cast("string")), F.greatest(F.col("cell_size"), F.lit(1)))
    cells = saved(cells.select("source", "shard", "shards", "source_size", "target", "cell_size", "quota", offset.alias("offset")), "mix-cells")

    per_source = cells.groupBy("source").agg(F.max("shards").alias("shards"))
    here = F.col(f"d.{source_col}")
    d = docs.drop(*[c for c in taken if c not in (id_col, text_col, source_col)]).withColumns({"size": size, "__id": key})
    d = d.alias("d").join(per_source.alias("p"), here.eqNullSafe(F.col("p.source"))).select("d.*", shard_of(F.col("d.__id"), F.col("p.shards")).alias("shard"))
    cell = cells.select("source", "shard", "source_size", "target", "cell_size", "quota", "offset").alias("c")
    d = d.alias("d").join(cell, here.eqNullSafe(F.col("c.source")) & (F.col("d.shard") == F.col("c.shard")))
    d = d.select("d.*", *[F.col(f"c.{k}").alias(f"__{k}") for k in ("source_size", "target", "cell_size", "quota", "offset")])
    stream = Window.partitionBy(source_col, "shard").orderBy(F.length(F.bin("size")).desc(), seeded(seed, F.lit("order"), F.col("__id")), "__id")
    upto = stream.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.withColumn("__block", F.floor((F.sum("size").over(upto) - F.col("size")) / block_words))
    d = d.withColumn("__new", (F.lag("__block", 1, -1).over(stream) < F.col("__block")).cast("long"))
    place = F.col("__block") * block_words
    coarse = sum((place * (1 << k) >= F.col("__cell_size") * ((1 << k) - 1)).cast("int") for k in range(1, LEVELS))
    ahead = F.col("__cell_size") - F.sum("size").over(upto) + F.col("size")
    late = sum(((ahead * (1 << k) <= 2 * block_words).cast("int") for k in range(fine)), F.lit(0))
    d = d.withColumns({"__i": F.sum("__new").over(upto) - 1, "__level": F.when(late > 0, late + LEVELS - 1).otherwise(coarse), "copies": F.lit(0).cast("long")})
    for level in range(LEVELS + fine):
        before, own = F.col("__level") < level, level >= LEVELS
        done, passed = (F.coalesce(F.sum(F.when(before, x)).over(upto), F.lit(0)) for x in (F.col("size") * F.col("copies"), F.col("size")))
        left = F.col("__cell_size") - passed
        unit = F.coalesce(F.sum(F.when((F.col("__level") == level) & (F.col("size") > 0), 1)).over(upto), F.lit(0)) - 1 if own else F.col("__i")
        d = d.withColumns({"__left": left, "__rest": F.least(F.greatest(F.col("__quota") * block_words - done, F.lit(0)), most_copies * left), "__unit": unit})
        shift = F.floor(F.col("__left") / 2) if own else F.pmod("__offset", F.nullif("__left", F.lit(0)))
        line = lambda i: F.floor((F.col("__rest") * i + shift) / F.nullif("__left", F.lit(0)))  # noqa: E731, B023
        here_copies = F.coalesce(line(F.col("__unit") + 1) - line(F.col("__unit")), F.lit(0)).cast("long")
        if fine and not own:
            here_copies = F.least(here_copies, F.coalesce(F.floor(F.col("__rest") / F.nullif("size", F.lit(0))), F.lit(0)))
        d = d.withColumn("copies", F.when(F.col("__level") == level, here_copies).otherwise(F.col("copies")))
    d = d.withColumn("taken", F.col("size") * F.col("copies"))
    named = {k: F.col(f"__{k}") for k in ("source_size", "target", "quota")}
    return d.withColumns(named).drop("__id", "__block", "__new", "__i", "__unit", "__level", "__left", "__rest", "shard", *[f"__{k}" for k in ("source_size", "target", "cell_size", "quota", "offset")])


def taken_texts(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The mixed corpus: one row for each copy of a document, with ``columns``; a document without words is no row."""
    d = mixed.filter("taken > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return d.select(*columns)
