"""Operator 13: mixing sources to target weights by Sainte-Lague apportionment.

1. Targets: the sources share ``percent`` of all words by weight (5, 2, 1, in
   code point order of the source, null last, repeating); a target stops at
   twice its source's words and the excess is shared again by weight.
2. The mix has as many blocks of ``block`` words as fill the targets.  They go
   to the sources by highest quotients target / (2j - 1), and a source's blocks
   in the same way to its shards, parts of about ``shard_words`` words into
   which its documents are dealt by a seeded hash.  So every shard has an
   integer quota.  Most seats follow from a divisor that is surely too large;
   only the quotients between it and one surely too small are ranked.
3. A shard's documents in seeded order are one run of words, cut into blocks.
   A quota of ``q`` blocks out of ``nb`` takes each block ``q div nb`` times and
   ``q mod nb`` of them once more, by systematic selection from a seeded start.
   A document's words are those of the blocks it lies in.

Everything is DataFrame expressions; ranks over unbounded groups go by range
partitions and offsets, so no source, and no copies of one row, meet in one task.

Defined results: null text has size 0, null source is a source of its own and
null ids are ids of their own; rows equal in source, id and size are placed one
after the other; documents of size 0 take 0 words; a table without words has
targets 0; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .flow import Stage

WEIGHTS, PERCENT, MOST = (5, 2, 1), 150, 2
BLOCK, SHARD_WORDS, SEED = 8, 1 << 16, 13
COPIES = 10_000  # equal rows that one array holds at most


def draw(*parts: str | Column) -> Column:
    """Seeded hash below 2**60 of some values (null is a value of its own)."""
    text = F.concat_ws("|", F.lit(str(SEED)), *[F.coalesce(F.col(p).cast("string") if isinstance(p, str) else p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def ordered_rank(st: Stage, df: DataFrame, order: list[Column], out: str, tag: str) -> DataFrame:
    """``out``: 0-based rank of every row in a total order, by range partitions and their offsets; no task has all rows."""
    parts = st.keep(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()), tag)
    sizes = parts.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))  # a row per partition
    first = sizes.select("_p", (F.sum("_n").over(W.orderBy("_p")) - F.col("_n")).alias("_o"))
    at = F.row_number().over(W.partitionBy("_p").orderBy(*order)) - 1
    return parts.withColumn("_r", at).join(F.broadcast(first), "_p").withColumn(out, (F.col("_o") + F.col("_r")).cast("long")).drop("_p", "_r", "_o")


def sainte_lague(st: Stage, parties: DataFrame, group: str, tie: str, tag: str) -> DataFrame:
    """``parties`` (group, tie, votes double, seats long of the group, ...) with column ``quota`` in place of votes and seats.

    Seats go one by one to the highest quotient votes / (2j - 1), the smaller
    ``tie`` first.  With n parties, V votes and S seats, rounding votes / d gives
    S seats at most for d = V / (S - n / 2) and S at least for d = V / (S + n / 2).
    """
    totals = parties.groupBy(group).agg(F.sum("votes").alias("_v"), F.count(F.lit(1)).alias("_k"))
    share = lambda s: F.when(F.col("_v") > 0, F.floor(F.col("votes") * s / F.col("_v") + 0.5)).otherwise(0).cast("long")
    slack = F.col("_k") / 2.0 + 1
    p = parties.join(totals, group).withColumns({"_low": share(F.greatest(F.col("seats") - slack, F.lit(0.0))), "_high": share(F.col("seats") + slack) + 1})
    p = st.keep(p.drop("_v", "_k"), f"{tag}-parties")
    offers = p.where("votes > 0").select(group, tie, "votes", F.explode(F.sequence(F.col("_low") + 1, F.col("_high"))).alias("j"))
    order = [F.asc(group), F.desc("q"), F.asc(tie), F.asc("j")]
    ranked = ordered_rank(st, offers.withColumn("q", F.col("votes") / (2 * F.col("j") - 1)), order, "place", f"{tag}-offers")
    left = p.groupBy(group).agg((F.first("seats") - F.sum("_low")).alias("_left")).join(ranked.groupBy(group).agg(F.min("place").alias("_from")), group)
    won = ranked.join(left, group).where(F.col("place") - F.col("_from") < F.col("_left")).groupBy(group, tie).agg(F.count(F.lit(1)).alias("_won"))
    return p.join(won, [group, tie], "left").withColumn("quota", F.col("_low") + F.coalesce("_won", F.lit(0))).drop("_low", "_high", "_won", "votes", "seats")


def source_targets(st: Stage, sources: DataFrame, weights: tuple[int, ...], percent: int, most: int) -> DataFrame:
    """``sources`` (source, source_size) with ``nr`` (0-based place in code point order, null last) and ``target``."""
    nr = ordered_rank(st, sources, [F.col("source").asc_nulls_last()], "nr", "sources")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("nr") % len(weights) + 1).cast("int"))
    nr = st.keep(nr.withColumn("weight", weight), "weights")
    cap = F.col("source_size") * float(most)
    total = float(nr.agg(F.coalesce(F.sum("source_size"), F.lit(0)).alias("t")).first()["t"]) * percent / 100
    level, capped = -1.0, -1
    while True:  # the level rises until it caps no further source; two numbers a round
        below = cap <= F.col("weight") * level
        r = nr.agg(F.coalesce(F.sum(F.when(below, cap)), F.lit(0.0)).alias("c"), F.sum(F.when(~below, F.col("weight"))).alias("w"), F.count_if(below).alias("n")).first()
        if r["n"] == capped or not r["w"]:
            break
        capped, level = r["n"], (total - r["c"]) / r["w"]
    return nr.withColumn("target", F.least(cap, F.col("weight") * level)).drop("weight")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, percent: int = PERCENT, most: int = MOST, block: int = BLOCK,
        shard_words: int = SHARD_WORDS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, size, source, source_size, target, taken) for every row."""
    st = Stage(docs.sparkSession, "mix")
    text = F.ltrim(F.coalesce(F.col(text_col), F.lit("")), F.lit(" \t\n\v\f\r"))
    size = F.length(F.regexp_replace(text, r"[^\x20\x09-\x0D]++[\x20\x09-\x0D]*+", "x")).cast("long")  # a letter a word
    units = st.keep(docs.select(F.col(source_col).alias("source"), F.col(id_col).alias("doc_id"), size.alias("size"))
                    .groupBy("source", "doc_id", "size").agg(F.count(F.lit(1)).alias("copies")), "units")
    targets = source_targets(st, units.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size")), weights, percent, most)
    seats = targets.agg(F.round(F.coalesce(F.sum("target"), F.lit(0.0)) / block).cast("long").alias("n")).first()["n"]  # one number
    parties = targets.withColumns({"mix": F.lit(0), "votes": F.col("target"), "seats": F.lit(seats)})
    quotas = sainte_lague(st, parties, "mix", "nr", "by-source").drop("mix")
    quotas = st.keep(quotas.withColumn("shards", F.greatest(F.ceil(F.col("source_size") / shard_words), F.lit(1)).cast("long")), "quotas")

    named = units.withColumn("_s", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")))  # null is a source
    own = quotas.withColumn("_s", F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))).drop("source")
    placed = st.keep(named.join(own, "_s").drop("_s").withColumn("draw", draw("doc_id", "size"))
                     .withColumn("shard", F.pmod("draw", "shards")).withColumn("words", F.col("size") * F.col("copies")), "placed")
    cells = placed.where("words > 0").groupBy("nr", "shard", F.col("quota").alias("seats")).agg(F.sum("words").alias("cell_words"))
    cells = sainte_lague(st, cells.withColumn("votes", F.col("cell_words").cast("double")), "nr", "shard", "by-shard")
    blocks = F.ceil(F.col("cell_words") / block).cast("long")
    quota = F.least(F.col("quota"), most * blocks)
    cells = cells.select("nr", "shard", blocks.alias("nb"), F.expr(f"least(quota, {most} * ceil(cell_words / {block})) div ceil(cell_words / {block})").alias("times"),
                         F.pmod(quota, blocks).alias("more"), F.pmod(draw("nr", "shard"), blocks).alias("shift"))

    run = W.partitionBy("nr", "shard").orderBy("draw", F.col("doc_id").asc_nulls_last(), "size")
    laid = placed.where("words > 0").withColumn("start", F.sum("words").over(run.rowsBetween(W.unboundedPreceding, 0)) - F.col("words")).join(cells, ["nr", "shard"])
    laid = laid.unionByName(placed.where("words = 0"), allowMissingColumns=True)
    groups = laid.withColumn("_g", F.explode(F.sequence(F.lit(0), F.expr(f"(copies - 1) div {COPIES}"))))
    rows = groups.withColumn("_c", F.explode(F.sequence(F.col("_g") * COPIES, F.least(F.col("copies"), (F.col("_g") + 1) * COPIES) - 1)))
    rows = rows.withColumn("at", F.col("start") + F.col("_c") * F.col("size"))

    def chosen(x: str) -> str:  # blocks chosen once more among the first x; products may pass 64 bits
        return f"(cast(({x}) + shift as decimal(19,0)) * cast(more as decimal(19,0))) div cast(nb as decimal(19,0))"

    def extra(x: str) -> str:  # their words among the first x words
        b = f"({x}) div {block}"
        return f"({block} * ({chosen(b)} - {chosen('0L')}) + (({x}) % {block}) * ({chosen(f'{b} + 1')} - {chosen(b)}))"

    taken = F.when(F.col("size") > 0, F.col("size") * F.col("times") + F.expr(f"{extra('at + size')} - {extra('at')}")).otherwise(0)
    out = st.hold(rows.select("doc_id", "size", "source", "source_size", "target", taken.cast("long").alias("taken")))
    st.drop(*list(st.paths))
    return out


ORACLE_SQL = r"""
WITH rows_ AS (SELECT source, doc_id, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
units AS (SELECT source, doc_id, size, count(*) AS copies, ('0x' || substr(md5(concat_ws('|', '13', coalesce(doc_id::VARCHAR, 'null'), size)), 1, 15))::BIGINT AS draw
          FROM rows_ GROUP BY source, doc_id, size),
src AS (SELECT *, [5.0, 2.0, 1.0][nr % 3 + 1]::DOUBLE AS w, 2.0::DOUBLE * source_size AS cap
        FROM (SELECT source, sum(size * copies)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS nr FROM units GROUP BY source)),
total AS (SELECT sum(source_size)::DOUBLE * 150 / 100 AS t FROM src),
steps AS (SELECT 0 AS k, (SELECT t FROM total) / (SELECT sum(w) FROM src) AS level UNION ALL
          SELECT k, (t - c) / nullif(rest, 0) FROM (
            SELECT row_number() OVER o AS k, sum(cap) OVER o AS c, (SELECT sum(w) FROM src) - sum(w) OVER o AS rest FROM src WINDOW o AS (ORDER BY cap / w, nr ROWS UNBOUNDED PRECEDING)), total),
level AS (SELECT level FROM steps WHERE k = (SELECT count(*) FROM src WHERE cap <= w * level) ORDER BY k LIMIT 1),
targets AS (SELECT src.*, least(cap, w * (SELECT level FROM level)) AS target FROM src),
seats AS (SELECT round(sum(target) / 8)::BIGINT AS n FROM targets),
offers AS (SELECT nr, target / (2 * j - 1) AS q, j FROM (SELECT nr, target, unnest(range(1, (target / 7)::BIGINT + 9)) AS j FROM targets)),
quotas AS (SELECT nr, count(*) AS quota FROM (SELECT * FROM offers WHERE q > 0 ORDER BY q DESC, nr, j LIMIT (SELECT n FROM seats)) GROUP BY nr),
placed AS (SELECT u.*, t.nr, t.source_size, t.target, coalesce(quota, 0) AS seats, draw % greatest(ceil(source_size / 65536.0), 1)::BIGINT AS shard
           FROM units u JOIN targets t ON u.source IS NOT DISTINCT FROM t.source LEFT JOIN quotas q ON q.nr = t.nr),
cells AS (SELECT nr, shard, seats, sum(size * copies)::BIGINT AS words FROM placed WHERE size > 0 GROUP BY nr, shard, seats),
cell_offers AS (SELECT nr, shard, seats, words::DOUBLE / (2 * j - 1) AS q, j
                FROM (SELECT *, unnest(range(1, (words::DOUBLE * seats / sum(words) OVER (PARTITION BY nr))::BIGINT + 9)) AS j FROM cells)),
won AS (SELECT nr, shard, count(*) AS quota FROM (SELECT *, row_number() OVER (PARTITION BY nr ORDER BY q DESC, shard, j) AS place FROM cell_offers)
        WHERE place <= seats GROUP BY nr, shard),
cut AS (SELECT c.nr, c.shard, nb, least(coalesce(quota, 0), 2 * nb) // nb AS times, least(coalesce(quota, 0), 2 * nb) % nb AS more,
               ('0x' || substr(md5(concat_ws('|', '13', c.nr, c.shard)), 1, 15))::BIGINT % nb AS shift
        FROM (SELECT *, ceil(words / 8.0)::BIGINT AS nb FROM cells) c LEFT JOIN won w ON w.nr = c.nr AND w.shard = c.shard),
laid AS (SELECT *, unnest(range(0, copies)) AS c FROM (
  SELECT *, sum(size * copies) OVER (PARTITION BY nr, shard ORDER BY draw, doc_id NULLS LAST, size ROWS UNBOUNDED PRECEDING) - size * copies AS start FROM placed WHERE size > 0)),
spans AS (SELECT l.*, times, more, shift, nb, (start + c * size)::BIGINT AS a, (start + c * size + size)::BIGINT AS b
          FROM laid l JOIN cut ON cut.nr = l.nr AND cut.shard = l.shard),
ends AS (SELECT *, ((a // 8 + shift)::HUGEINT * more) // nb AS a0, ((a // 8 + 1 + shift)::HUGEINT * more) // nb AS a1,
                   ((b // 8 + shift)::HUGEINT * more) // nb AS b0, ((b // 8 + 1 + shift)::HUGEINT * more) // nb AS b1 FROM spans)
SELECT doc_id, size, source, source_size, target, (size * times + 8 * (b0 - a0) + (b % 8) * (b1 - b0) - (a % 8) * (a1 - a0))::BIGINT AS taken FROM ends
UNION ALL SELECT doc_id, size, source, source_size, target, 0 FROM (SELECT *, unnest(range(0, copies)) FROM placed WHERE size = 0)
"""
