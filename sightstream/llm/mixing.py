"""Operator 3: sources mixed to target weights by Poisson replication. DataFrame functions only.

A source of size s (characters) that should be the share w of a mixture of size t is repeated t * w / s times on
average. Every document of it gets a count from the Poisson distribution with that mean: a hash of the document and a
seed gives a uniform number, and the count is the number of values of the distribution function that are not above it.
A mean over STEP is split into equal parts of at most STEP that are drawn apart and added up, which again is exactly
Poisson and keeps the table of the distribution function short. Documents are exploded by their counts, and the copies
are dealt out by a hash of document and copy, sorted by it in each partition: a global shuffle without a sampling pass.

Sizes are summed in partial aggregates, so that a source with a third of all documents is a sum like any other. The
table of sources goes to all tasks if a count shows that it is small, so that no text is shuffled by source. Otherwise
it is joined by source and a salt from the document, each source being there once for each salt.

Nulls and ties: a null or empty source is one source, named ''. A null text has size 0. A source of size 0 is repeated 0
times. Rows with one doc_id draw the same count; rows without one draw by their text. A source without a weight has weight 0. Columns of the input named
copy or shuffle_key are replaced, all others are kept. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightstream.llm.common import free_name

SEED = 42
STEP = 16.0

#: Values of the distribution function; for a mean up to STEP, what is beyond is under 2 ** -53.
VALUES = 100

#: Sources up to which their table (a kilobyte each) goes to all tasks; beyond, documents are joined by source and salt.
SMALL = 10_000
SALTS = 64


def name_of() -> Column:
    """What a document draws by: its doc_id; without one, its text."""
    return F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null-"), F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")))))


def uniform(*parts: Column | str) -> Column:
    """From 0 to 1, by the first 52 bits of an MD5 of the parts."""
    text = F.md5(F.concat_ws(":", *(F.coalesce(p.cast("string"), F.lit("null")) if isinstance(p, Column) else F.lit(p) for p in parts)))
    return F.conv(F.substring(text, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def poisson_table(mean: Column) -> Column:
    """P(X <= 0), P(X <= 1), ... for a mean up to STEP."""
    start = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("c"))
    grow = lambda a, k: F.struct((a.p * mean / k).alias("p"), F.concat(a.c, F.array(F.element_at(a.c, -1) + a.p * mean / k)).alias("c"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(VALUES)), start, grow, lambda a: a.c)


def source_rates(docs: DataFrame, weights: dict[str, float] | None = None, target: float | None = None) -> tuple[DataFrame, int]:
    """(source, size, rate: how often the source's documents are repeated on average; the number of sources).

    weights: of each source, in any scale; None: the square root of its size. target: size of the mixture; None: of docs."""
    sizes = docs.groupBy(F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source")).agg(F.sum(F.coalesce(F.length("text"), F.lit(0))).cast("long").alias("size"))
    if weights is None:
        weight = F.floor(F.sqrt("size") * 1000)
    else:
        given = F.create_map(*(F.lit(x) for kv in weights.items() for x in kv)) if weights else F.create_map().cast("map<string,double>")
        weight = F.floor(F.coalesce(F.try_element_at(given, F.col("source")).cast("double"), F.lit(0.0)) * 1_000_000)
    sizes = sizes.withColumn("weight", weight.cast("long"))
    all_sizes, all_weights, n = sizes.agg(F.sum("size"), F.sum("weight"), F.count("*")).first()
    goal = float(target if target is not None else all_sizes or 0)
    rate = F.when((F.col("size") > 0) & (F.col("weight") > 0), F.lit(goal) * F.col("weight") / F.lit(float(all_weights or 1)) / F.col("size")).otherwise(0.0)
    return sizes.select("source", "size", rate.alias("rate")), n


def mix(docs: DataFrame, weights: dict[str, float] | None = None, target: float | None = None, seed: int = SEED) -> DataFrame:
    """The columns of docs, copy (from 1) and shuffle_key, in shuffled order."""
    docs = docs.drop("copy", "shuffle_key")
    own = {c: free_name(docs, c) for c in ("_mix_source", "_mix_parts", "_mix_table", "_mix_salt", "_mix_count", "_mix_name")}
    parts = F.greatest(F.ceil(F.col("rate") / STEP), F.lit(1)).cast("int")
    rates, n = source_rates(docs, weights, target)
    rates = rates.select(F.col("source").alias(own["_mix_source"]), parts.alias(own["_mix_parts"]), poisson_table(F.col("rate") / parts).alias(own["_mix_table"]))
    named = docs.withColumn(own["_mix_name"], name_of())
    source = F.coalesce(F.col("source").cast("string"), F.lit(""))
    if n <= SMALL:
        drawn = named.join(F.broadcast(rates), source == F.col(own["_mix_source"]))
    else:
        rates = rates.withColumn(own["_mix_salt"], F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        drawn = named.join(rates, (source == F.col(own["_mix_source"])) & (F.pmod(F.xxhash64(own["_mix_name"]), F.lit(SALTS)) == F.col(own["_mix_salt"])))
    # each number is a lambda variable below: written inside the filter, its hash would be computed for every value of the table
    numbers = F.transform(F.sequence(F.lit(1), F.col(own["_mix_parts"])), lambda j: uniform(str(seed), F.col(own["_mix_name"]), j))
    count = F.aggregate(numbers, F.lit(0), lambda n, u: n + F.size(F.filter(own["_mix_table"], lambda t: t <= u)))
    kept = [F.col(f"`{c}`") for c in docs.columns]
    copies = drawn.select(*kept, own["_mix_name"], count.alias(own["_mix_count"])).where(F.col(own["_mix_count"]) > 0)
    copies = copies.select(*kept, own["_mix_name"], F.explode(F.sequence(F.lit(1), F.col(own["_mix_count"]))).alias("copy"))
    key = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(own["_mix_name"]), F.lit("copy"), F.col("copy").cast("string"))), 1, 15), 16, 10).cast("long")
    return copies.select(*kept, "copy", key.alias("shuffle_key")).repartition("shuffle_key").sortWithinPartitions("shuffle_key", "doc_id", "copy")


def op3(docs: DataFrame) -> DataFrame:
    return mix(docs).select("doc_id", "source", F.col("copy").cast("long"), "shuffle_key", "text")


def mix_sql(docs: str = "documents", columns: str = "doc_id, source, CAST(copy AS BIGINT) AS copy, shuffle_key, text") -> str:
    return f"""
WITH RECURSIVE named AS (
  SELECT *, coalesce(CAST(doc_id AS VARCHAR), 'null-' || md5(coalesce(text, ''))) AS name FROM {docs}
), sizes AS (
  SELECT coalesce(source, '') AS source, CAST(sum(coalesce(length(text), 0)) AS BIGINT) AS size FROM {docs} GROUP BY 1
), weighted AS (
  SELECT source, size, CAST(floor(sqrt(CAST(size AS DOUBLE)) * 1000) AS BIGINT) AS weight FROM sizes
), totals AS (
  SELECT CAST(sum(size) AS DOUBLE) AS goal, CAST(sum(weight) AS DOUBLE) AS w FROM weighted
), rates AS (
  SELECT source, CASE WHEN size > 0 AND weight > 0 THEN goal * weight / w / size ELSE 0.0 END AS rate FROM weighted, totals
), split_rates AS (
  SELECT source, greatest(CAST(ceil(rate / 16.0) AS BIGINT), 1) AS parts, rate / greatest(CAST(ceil(rate / 16.0) AS BIGINT), 1) AS mean FROM rates
), dist(source, mean, k, p, c) AS (
  SELECT source, mean, 0, exp(-mean), exp(-mean) FROM split_rates
  UNION ALL
  SELECT source, mean, k + 1, p * mean / (k + 1), c + p * mean / (k + 1) FROM dist WHERE k < 100
), draws AS (
  SELECT d.name, s.source, j, CAST(CAST('0x' || substr(md5('42:' || d.name || ':' || CAST(j AS VARCHAR)), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 AS u
  FROM (SELECT DISTINCT name, coalesce(source, '') AS source FROM named) d JOIN split_rates s ON d.source = s.source, unnest(range(1, s.parts + 1)) AS t(j)
), counts AS (
  SELECT w.name, w.source, count(*) AS n FROM draws w JOIN dist t ON w.source = t.source AND t.c <= w.u GROUP BY w.name, w.source
), copies AS (
  SELECT d.*, copy FROM named d JOIN counts c ON d.name = c.name AND coalesce(d.source, '') = c.source, unnest(range(1, c.n + 1)) AS t(copy)
)
SELECT {columns} FROM (SELECT *, CAST('0x' || substr(md5('42:' || name || ':copy:' || CAST(copy AS VARCHAR)), 1, 15) AS BIGINT) AS shuffle_key FROM copies)
"""


OP3_SQL = mix_sql()
