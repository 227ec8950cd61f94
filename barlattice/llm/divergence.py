"""Source divergence audit: how far the sources of a language are apart in their terms, and by which terms each stands out.

1. Terms are counted per piece of some MB of text with an exact dictionary, and summed by (lang, source, term): occurrences
   and documents, partial sums before the shuffle.
2. The sums are hashed to shards by lang and term, so a term of a language has all its sources in one shard; shards are as
   many as keep their rows under `SHARD_ROWS`. In each, DuckDB drops the terms of too few documents (`KEPT`). Spark sums what
   is left to the size of each group and language, and the number of terms of each language.
3. Each shard then gets those totals as rows of its own, and DuckDB gives its share of every pair's sum and its leading
   terms of every group (`PAIRS`, `LEADING`). A pair's sum goes over all terms of the language, but only those
   that occur in one of the two are visited; the others have one value per pair and are counted. Spark adds up the pairs and ranks.

Shares are integers of a thousand million, products that could exceed 64 bits are 128 bits wide, sums of pairs are exact.

Defined results: null text, lang and source are the empty string. Each row is a document, repeated rows too. A group without terms
has all shares at 1 + floor(10**9 / V); a language without kept terms has pairs of value 0 and no terms; a language of one source
has no pairs. An empty table gives an empty result. Very long texts are counted whole, and extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barlattice.llm import textcore as tc
from barlattice.llm.common import by_value, materialise, small_batches
from barlattice.llm.grouped import runs

by_value(__name__)

MIN_DOCS = 3
LEADERS = 200
#: Bytes of text that are counted together, rows of a shard, and parts in which a group's leading terms are merged first.
COUNTED = 8 << 20
SHARD_ROWS = 250_000
MERGED = 64

#: The bytes of [^\x00-\x40\x5B-\x60\x7B-\x7F], after lower-casing.
TERM = np.zeros(256, dtype=bool)
TERM[97:123] = TERM[128:] = True

COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def term_counts(part: pa.RecordBatch) -> pa.RecordBatch:
    """Occurrences and documents of every term in every group of the piece."""
    data, offsets = tc.bytes_of(part.column("text"))
    start, end, of = tc.words(tc.LOWER[data], offsets, TERM)
    if not len(start):
        return pa.RecordBatch.from_pylist([], schema=COUNTS)
    bounds = pa.py_buffer(np.stack([start, end], axis=1).ravel().astype(np.int64))
    spans = pa.Array.from_buffers(pa.large_string(), 2 * len(start) - 1, [None, bounds, pa.py_buffer(tc.LOWER[data])])
    terms = spans.take(pa.array(np.arange(0, 2 * len(start), 2))).dictionary_encode()
    names = [part.column(c).dictionary_encode() for c in ("lang", "source")]
    lang, source = (x.indices.to_numpy().astype(np.int64) for x in names)
    group = lang * len(names[1].dictionary) + source
    many = len(terms.dictionary)
    seen, times = np.unique(of * many + terms.indices.to_numpy(), return_counts=True)
    key, place = np.unique(group[seen // many] * many + seen % many, return_inverse=True)
    n, docs = np.bincount(place, weights=times).astype(np.int64), np.bincount(place)
    g = key // many
    columns = [names[0].dictionary.take(pa.array(g // len(names[1].dictionary))), names[1].dictionary.take(pa.array(g % len(names[1].dictionary))), terms.dictionary.take(pa.array(key % many)).cast(pa.string()), pa.array(n), pa.array(docs)]
    return pa.RecordBatch.from_arrays(columns, schema=COUNTS)


def counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in tc.pieces(batch, "text", COUNTED):
            yield term_counts(part)


#: The terms of enough documents, a row per source; new_term is 1 in one row of each term.
KEPT = """
SELECT shard, lang, source, term, n, CASE WHEN source = min(source) OVER t THEN 1 ELSE 0 END AS new_term
FROM rows WINDOW t AS (PARTITION BY lang, term) QUALIFY sum(docs) OVER t >= {min_docs}
"""

#: p of every row and of its term in the whole language; p0 is the share of a term that a group doesn't have.
SHARES = """
CREATE TEMP TABLE groups AS SELECT lang, source, CAST(n AS HUGEINT) AS size, CAST(lang_n AS HUGEINT) AS lang_size, CAST(terms AS HUGEINT) AS terms, CAST(1 + 1000000000::HUGEINT // (size + terms) AS BIGINT) AS p0 FROM rows WHERE term IS NULL;
CREATE TEMP TABLE shares AS SELECT lang, source, term, r.n, sum(r.n) OVER (PARTITION BY lang, term) AS lang_n, p0,
  CAST(1 + 1000000000::HUGEINT * (r.n + 1) // (size + g.terms) AS BIGINT) AS p, CAST(1 + 1000000000::HUGEINT * (sum(r.n) OVER (PARTITION BY lang, term) + 1) // (lang_size + g.terms) AS BIGINT) AS q
FROM rows r JOIN groups g USING (lang, source) WHERE term IS NOT NULL
"""

LEADING = """
SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value FROM shares WHERE n > 0 AND p > q
QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) <= {leaders}
"""

#: The sum over the terms that a has, as if b had none of them; over those that b has, as if a had none; what both have
#: instead; and all other terms of the language in this shard.
PAIRS = """
WITH held AS (SELECT lang, source, p, count(*) AS terms FROM shares GROUP BY ALL),
here AS (SELECT lang, count(DISTINCT term) AS terms FROM shares GROUP BY lang),
duo AS (SELECT a.lang, a.source AS source, b.source AS item, a.p0 AS p0, b.p0 AS q0, here.terms FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source JOIN here ON here.lang = a.lang),
mine AS (SELECT d.lang, d.source, d.item, sum(h.terms * ((h.p - q0) * (h.p - q0) // q0)) AS value, sum(h.terms) AS terms FROM duo d JOIN held h ON h.lang = d.lang AND h.source = d.source GROUP BY ALL),
theirs AS (SELECT d.lang, d.source, d.item, sum(h.terms * ((p0 - h.p) * (p0 - h.p) // h.p)) AS value, sum(h.terms) AS terms FROM duo d JOIN held h ON h.lang = d.lang AND h.source = d.item GROUP BY ALL),
both_have AS (
  SELECT a.lang, a.source, b.source AS item, count(*) AS terms,
         sum((a.p - b.p) * (a.p - b.p) // b.p - (a.p - b.p0) * (a.p - b.p0) // b.p0 - (a.p0 - b.p) * (a.p0 - b.p) // b.p) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL)
SELECT d.lang, d.source, 'pair' AS part, d.item, CAST(coalesce(mine.value, 0) + coalesce(theirs.value, 0) + coalesce(both_have.value, 0)
  + (d.terms - coalesce(mine.terms, 0) - coalesce(theirs.terms, 0) + coalesce(both_have.terms, 0)) * ((p0 - q0) * (p0 - q0) // q0) AS BIGINT) AS value
FROM duo d LEFT JOIN mine USING (lang, source, item) LEFT JOIN theirs USING (lang, source, item) LEFT JOIN both_have USING (lang, source, item)
"""


def in_shards(run: str, schema: pa.Schema, setup: str = "", more: str = ""):
    """SQL over each shard's rows, one shard at a time, by an in-memory DuckDB of one thread."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        for t, bounds in runs(batches, ["shard"]):
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                with duckdb.connect(":memory:", config={"threads": 1}) as db:
                    db.register("rows", t.slice(a, b - a))
                    if setup:
                        db.execute(setup)
                    for sql in filter(None, (run, more)):
                        out = db.sql(sql).to_arrow_table()
                        if "shard" in schema.names and "shard" not in out.column_names:
                            out = out.append_column("shard", pa.array(np.full(out.num_rows, t.column("shard")[a].as_py())))
                        yield from out.select(schema.names).cast(schema).to_batches()

    return each


def sharded(rows: DataFrame) -> DataFrame:
    return rows.repartition("shard").sortWithinPartitions("shard")


KEPT_ROWS = pa.schema([("shard", pa.int64()), ("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("new_term", pa.int64())])
PARTS = pa.schema([("shard", pa.int64()), ("lang", pa.string()), ("source", pa.string()), ("part", pa.string()), ("item", pa.string()), ("value", pa.int64())])


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = MIN_DOCS, leaders: int = LEADERS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """lang, source, part, item, value, rank. Part pair: every other source of the lang, and the divergence to it over all kept terms. Part term: the terms that the group has more than the lang has, the first `leaders` of them."""
    small_batches(docs.sparkSession)
    word = lambda c, name: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name)
    rows = docs.select(word(lang_col, "lang"), word(source_col, "source"), word(text_col, "text"))
    counted = rows.mapInArrow(counter, "lang string, source string, term string, n long, docs long")
    counts = materialise(counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "terms")
    shards = max(1, -(-counts.count() // shard_rows))
    shard = F.expr(f"pmod(xxhash64(lang, term), {shards}L)").alias("shard")
    kept = materialise(sharded(counts.select(shard, "*")).mapInArrow(in_shards(KEPT.format(min_docs=min_docs), KEPT_ROWS), "shard long, lang string, source string, term string, n long, new_term long"), "kept")

    sizes = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.sum("new_term").alias("terms"))
    groups = rows.select("lang", "source").distinct().join(sizes, ["lang", "source"], "left").na.fill(0, ["n", "terms"])
    langs = groups.groupBy("lang").agg(F.sum("n").alias("lang_n"), F.sum("terms").alias("terms"))
    groups = materialise(groups.drop("terms").join(langs, "lang"), "groups")

    # the totals go to every shard as rows: no bound on the number of groups is needed
    totals = groups.where("terms > 0").select(F.expr(f"explode(sequence(0L, {shards - 1}L))").alias("shard"), "lang", "source", F.lit(None).cast("string").alias("term"), "n", "lang_n", "terms")
    zero = F.lit(0).cast("long")
    work = totals.unionByName(kept.select("shard", "lang", "source", "term", "n", zero.alias("lang_n"), zero.alias("terms")))
    parts = sharded(work).mapInArrow(in_shards(PAIRS, PARTS, SHARES, LEADING.format(leaders=leaders)), "shard long, lang string, source string, part string, item string, value long")
    parts = materialise(parts, "parts")

    best = [F.desc("value"), F.asc("item")]
    sums = parts.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    others = groups.select("lang", F.col("source").alias("item"))
    pairs = groups.select("lang", "source").join(others, "lang").where("source <> item").join(sums, ["lang", "source", "item"], "left").withColumn("value", F.coalesce("value", F.lit(0)))
    pairs = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(*best))).withColumn("part", F.lit("pair"))
    merged = F.row_number().over(Window.partitionBy("lang", "source", F.expr(f"pmod(shard, {MERGED})")).orderBy(*best))
    terms = parts.where("part = 'term'").withColumn("rank", merged).where(F.col("rank") <= leaders)
    terms = terms.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(*best))).where(F.col("rank") <= leaders)
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.select(columns).unionByName(terms.select(columns))
