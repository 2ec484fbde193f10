"""Mixing sources to target weights by hash-threshold histograms.

Targets: a budget is shared among the sources by weight; a source is taken at most ``CAP``
times over, and what it cannot use is shared again. A source is then taken in whole epochs
plus a part: the documents whose hash lies below a threshold. The threshold comes from sums
of words by (source, first hash bits); only the bucket in which the budget ends is summed
again by the next bits, and so on. What the boundary document leaves of the budget goes to later and
smaller documents in the same way, ``PASSES`` times. Nothing is sorted but histogram
buckets, and a rerun takes the same documents.

All sums combine on the map side, so a source with a third of the rows sends one row per
task and bucket; joins by source keep a small row per source and carry no broadcast hint.
Words are counted once and staged in the shared folder as (id, source, size, digest).

The hash is that of id, source and text, and of a copy's number where rows are equal in all
three, so rows without ids or with one id for all are dealt out like others.

Defined results: NULL source is a source of its own, the last; NULL or empty text has size
0 and takes 0; of equal rows as many are taken as fit, which of them is open; a source of size
0 has target 0; an empty table gives no rows. The operator returns its own columns only, so other
columns cannot clash.
"""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from liftspark.llm.texts import free_name, n_words, table
from liftspark.sources.tables import stage

WEIGHTS = (5, 2, 1)
SHARE = 1.5  # of all words
CAP = 2  # times a source's words
PASSES = 4
LEVELS = (11, 11, 10)  # bits of the hash that each histogram adds


def digest(key: Column, source: Column, text: Column) -> Column:
    """MD5 that rows share only if id, source and text are equal; NULL is not the empty text."""
    parts = [F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("")) for c in (key, source)]
    sizes = [F.length(p).cast("string") for p in parts]
    # The text goes in by its own MD5, so it is not copied.
    return F.md5(F.concat_ws("|", *sizes, *parts, F.coalesce(F.md5(text.cast("binary")), F.lit(""))))


def hash32(of: Column, number: Column) -> Column:
    """First 32 bits of the MD5 of a digest and a copy's number."""
    return F.conv(F.substring(F.md5(F.concat_ws("#", of, number.cast("string"))), 1, 8), 16, 10).cast("long")


def with_hash(rows: DataFrame, repeated: DataFrame, of: str, name: str) -> DataFrame:
    """Rows with the hash their threshold is compared with; equal rows get different ones.

    Copies are numbered from 0, so the set of their hashes is the same in every run whichever row
    comes first. ``repeated`` has the digests of several rows. Those rows are written once and
    numbered inside their partition and then by partition, so a text that fills a third of the
    table is no group of one task. Other rows are not shuffled.
    """
    part, row, before = (free_name(rows, n) for n in ("_part", "_row", "_before"))
    once = rows.join(repeated, of, "left_anti").withColumn(name, hash32(F.col(of), F.lit(0)))
    again = rows.join(repeated, of, "left_semi").withColumn(part, F.spark_partition_id())
    again = stage(again.select(*rows.columns, part), "copies")
    order = Window.partitionBy(of, part).orderBy(F.lit(0))
    again = again.withColumn(row, F.row_number().over(order) - 1)
    earlier = Window.partitionBy(of).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    counts = again.groupBy(of, part).count()
    counts = counts.select(of, part, F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias(before))
    again = again.join(counts, [of, part])
    again = again.withColumn(name, hash32(F.col(of), F.col(before) + F.col(row)))
    return once.select(*rows.columns, name).unionByName(again.select(*rows.columns, name))


def repeated_digests(rows: DataFrame, of: str) -> DataFrame:
    """Digests of more than one row, written once: where there are few, they are broadcast."""
    return stage(rows.groupBy(of).count().filter("count > 1").select(of), "repeated")


def source_key(source: Column) -> Column:
    """A join key without NULL."""
    return F.when(source.isNull(), "").otherwise(F.concat(F.lit("="), source.cast("string")))


def numbered(rows: DataFrame, *order: Column) -> DataFrame:
    """Rows with their ``rank`` from 0 in the given order.

    Ranges are sorted apart and numbered by the row counts of the ranges before them, so no
    task holds all rows.
    """
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    row = F.monotonically_increasing_id()
    ranged = stage(
        ranged.withColumn("_part", F.shiftright(row, 33)).withColumn("_row", row.bitwiseAND((1 << 33) - 1)),
        "ranges",
    )
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy("_part").count().withColumn("_before", F.coalesce(F.sum("count").over(before), F.lit(0)))
    joined = ranged.join(offsets.select("_part", "_before"), "_part")
    return joined.withColumn("rank", F.col("_before") + F.col("_row")).drop("_part", "_row", "_before")


def targets(sizes: DataFrame) -> DataFrame:
    """Source sizes and targets: the budget by weight, capped, the excess shared again.

    A round fixes the sources above their cap; the share of the others only grows, so the
    rounds end. Each round is one aggregate over the source table and returns two numbers.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("rank") % len(WEIGHTS) + 1).cast("int"))
    sources = stage(
        # In code point order, NULL last.
        numbered(sources, F.col("source").isNull(), F.col("source")).withColumn("weight", weight.cast("long")),
        "weights",
    )
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    cap = F.lit(float(CAP)) * F.col("source_size")
    capped, last = F.lit(False), None
    while True:
        free, taken = sources.agg(
            F.sum(F.when(~capped, F.col("weight"))), F.sum(F.when(capped, F.col("source_size")))
        ).first()
        rest = round(2 * SHARE) * total - 2 * CAP * (taken or 0)  # in half words, exact
        share = F.col("weight") * F.lit(float(rest)) / F.lit(2.0 * (free or 1))
        if (rest, free) == last or not free:
            break
        last = (rest, free)
        capped = share > cap
    return sources.withColumn("target", F.when(capped, cap).otherwise(share)).drop("weight", "rank")


def threshold(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """Per key, the least hash at which the running size exceeds the budget, and the size below it.

    Each level sums by the next bits of the hash, inside the bucket where the budget ended
    before, so that a key has at most ``2 ** bits`` rows to add up.
    """
    state = budgets.select(
        "key", "budget", F.lit(None).cast("long").alias("edge"), F.lit(0).cast("long").alias("below")
    )
    running = Window.partitionBy("key").orderBy("bucket")
    over = F.col("reach") > F.col("budget")
    shift = sum(LEVELS)
    for level, bits in enumerate(LEVELS):
        inside = rows.join(state, "key")
        if level:
            inside = inside.filter(F.shiftright("hash", shift) == F.col("edge"))
        shift -= bits
        sums = inside.groupBy("key", F.shiftright("hash", shift).alias("bucket")).agg(
            F.sum("size").alias("n"), F.first("budget").alias("budget"), F.first("below").alias("below")
        )
        reached = sums.withColumn("reach", F.col("below") + F.sum("n").over(running))
        found = reached.groupBy("key").agg(
            F.min(F.when(over, F.col("bucket"))).alias("next"), F.max(F.when(~over, F.col("reach"))).alias("reached")
        )
        # Keys without an edge have no rows inside and stay as they are.
        state = stage(
            state.join(found, "key", "left").select(
                "key", "budget", F.col("next").alias("edge"), F.coalesce("reached", "below").alias("below")
            ),
            "threshold",
        )
    limit = F.coalesce("edge", F.lit(1 << sum(LEVELS)))
    return state.select("key", limit.alias("limit"), F.col("below").alias("spent"))


def plan(sizes: DataFrame) -> DataFrame:
    """Per source key: size, target, whole epochs, and the hash ranges taken once more.

    ``sizes`` has source, key, size and hash of every document. A range ``n`` takes hashes
    from ``from<n>`` to below ``to<n>`` of documents of at most ``most<n>`` words.
    """
    epochs = F.floor(F.col("target") / F.col("source_size"))
    state = targets(sizes).select(
        source_key(F.col("source")).alias("key"),
        "source_size",
        "target",
        F.coalesce(F.when(F.col("source_size") > 0, epochs), F.lit(0)).alias("epochs"),
    )
    state = state.withColumn("budget", F.col("target") - F.col("epochs") * F.col("source_size"))
    state = stage(state.withColumn("limit", F.lit(0).cast("long")), "plan")
    sized = sizes.select("key", "size", "hash")
    for n in range(PASSES):
        # Only what fits into the rest of the budget and lies above the last threshold.
        rest = state.select("key", "budget", F.col("limit").alias("from"))
        open_rows = sized.join(rest, "key").filter("hash >= from AND size <= budget AND size > 0")
        found = threshold(open_rows.select("key", "size", "hash"), state.select("key", "budget"))
        after = state.join(found.withColumnRenamed("limit", "next"), "key", "left")
        state = stage(
            after.select(
                *[c for c in state.columns if c not in ("budget", "limit")],
                F.col("limit").alias(f"from{n}"),
                F.coalesce("next", "limit").alias(f"to{n}"),
                F.col("budget").alias(f"most{n}"),
                (F.col("budget") - F.coalesce("spent", F.lit(0))).alias("budget"),
                F.coalesce("next", "limit").alias("limit"),
            ),
            "plan",
        )
    return state


def copies(size: Column, hashed: Column, of) -> Column:
    """How often a document is taken; ``of`` gives the columns of its source's plan."""
    extra = F.lit(False)
    for n in range(PASSES):
        extra |= (hashed >= of(f"from{n}")) & (hashed < of(f"to{n}")) & (size <= of(f"most{n}"))
    return F.when(size > 0, of("epochs") + extra.cast("long")).otherwise(F.lit(0)).cast("long")


def sizes_of(docs: DataFrame, key: Column, source: Column, size: Column, text: Column) -> tuple[DataFrame, DataFrame]:
    """(doc_id, source, key, size, digest, hash) of every document, written once, and the repeated digests."""
    source = source.cast("string")
    columns = {"doc_id": key, "source": source, "key": source_key(source), "size": size, "digest": digest(key, source, text)}
    sizes = stage(docs.select(*[c.alias(n) for n, c in columns.items()]), "sizes")
    repeated = repeated_digests(sizes, "digest")
    if repeated.isEmpty():
        return sizes.withColumn("hash", hash32(F.col("digest"), F.lit(0))), repeated
    return stage(with_hash(sizes, repeated, "digest", "hash"), "sizes"), repeated


def mix(docs: DataFrame, key: Column, source: Column, size: Column, text: Column) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies): how often each document is taken."""
    sizes, _ = sizes_of(docs, key, source, size, text)
    planned = sizes.join(plan(sizes), "key")
    taken = copies(F.col("size"), F.col("hash"), F.col)
    return planned.select("doc_id", "source", "size", "source_size", "target", taken.alias("copies"))


def take(docs: DataFrame) -> DataFrame:
    """The documents of the mix with their columns, and ``copies`` (1 or 2; a new name if taken)."""
    key, source, text = F.col("doc_id"), F.col("source"), F.col("text")
    size = n_words(text)
    of, own, mark, hashed, name = (free_name(docs, n) for n in ("_plan", "_own", "_digest", "_hash", "copies"))
    sizes, repeated = sizes_of(docs, key, source, size, text)
    planned = plan(sizes).select(F.struct("*").alias(of))
    # Counted once a row, and only then compared with the plan.
    sized = docs.withColumn(own, size).withColumn(mark, digest(key, source, text))
    if repeated.isEmpty():
        sized = sized.withColumn(hashed, hash32(F.col(mark), F.lit(0)))
    else:
        sized = with_hash(sized, repeated.withColumnRenamed("digest", mark), mark, hashed)
    joined = sized.join(planned, source_key(source) == F.col(f"{of}.key"))
    taken = copies(F.col(own), F.col(hashed), lambda c: F.col(f"{of}.{c}"))
    return joined.withColumn(name, taken).filter(F.col(name) > 0).drop(of, own, mark, hashed)


def op2_mix_to_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words the mix takes from every document."""
    docs = table(spark, sf_dir, "documents")
    text = F.col("text")
    mixed = mix(docs, F.col("doc_id"), F.col("source"), n_words(text), text)
    return mixed.select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken")
    )


def _passes_sql() -> str:
    out = []
    for n in range(PASSES):
        out.append(
            f"""r{n} AS (SELECT * FROM s{n} WHERE size > 0 AND size <= budget),
c{n} AS (SELECT *, sum(size) OVER (PARTITION BY k ORDER BY h RANGE UNBOUNDED PRECEDING) AS reach FROM r{n}),
x{n} AS (SELECT k, coalesce(max(reach) FILTER (reach <= budget), 0) AS spent FROM c{n} GROUP BY k),
s{n + 1} AS (SELECT c.k, rid, size, h, budget - spent AS budget FROM c{n} c JOIN x{n} x ON x.k = c.k
  WHERE reach > budget)"""
        )
    return ",\n".join(out)


ORACLE_SQL = f"""
WITH RECURSIVE docs AS (
  SELECT *, row_number() OVER () AS rid,
    ('0x' || substr(md5(g || '#' || (row_number() OVER (PARTITION BY g) - 1)), 1, 8))::BIGINT AS h
  FROM (SELECT doc_id, source, CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS k,
      len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
      md5(length(i) || '|' || length(s) || '|' || i || '|' || s || '|' || t) AS g
    FROM (SELECT *, coalesce('=' || doc_id, '') AS i, coalesce('=' || source, '') AS s,
        coalesce(md5(text), '') AS t FROM documents))
),
src AS (
  SELECT k, sum(size)::BIGINT AS source_size,
    [5, 2, 1][1 + (row_number() OVER (ORDER BY min(source) NULLS LAST) - 1) % 3] AS w FROM docs GROUP BY k
),
lined AS (
  SELECT *, row_number() OVER o AS i, sum(w) OVER () - sum(w) OVER o + w AS free,
    3 * sum(source_size) OVER () - 4 * (sum(source_size) OVER o - source_size) AS rest
  FROM src WINDOW o AS (ORDER BY source_size::DOUBLE / w, k ROWS UNBOUNDED PRECEDING)
),
edge AS (
  SELECT i, rest::DOUBLE AS rest, 2.0::DOUBLE * free AS free FROM lined
  WHERE w * rest::DOUBLE / (2.0::DOUBLE * free) <= 2.0::DOUBLE * source_size ORDER BY i LIMIT 1
),
t AS (
  SELECT k, source_size,
    CASE WHEN lined.i < edge.i THEN 2.0::DOUBLE * source_size ELSE w * edge.rest / edge.free END AS target
  FROM lined, edge
),
p AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs FROM t
),
s0 AS (
  SELECT docs.k, rid, size, h, target - epochs * source_size AS budget FROM docs JOIN p USING (k)
),
{_passes_sql()},
extra AS (
  {" UNION ALL ".join(f"SELECT rid FROM c{n} WHERE reach <= budget" for n in range(PASSES))}
)
SELECT docs.doc_id, docs.size, source_size, target,
  CAST(docs.size * (epochs + CASE WHEN extra.rid IS NULL THEN 0 ELSE 1 END) AS BIGINT) AS taken
FROM docs JOIN p USING (k) LEFT JOIN extra ON extra.rid = docs.rid
"""
