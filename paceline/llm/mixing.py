"""Mix sources to target weights by systematic sampling, in DataFrame operations alone.

Sources in code-point order (null last) weigh 5, 2, 1 and so on in turn and share all words by weight; a target
stops at ``most`` times its source's size and the excess goes to the others by weight. A source then emits every
document ``target / size`` times on average: documents stand in a fixed order, expected copies are summed from
the start of the source, one offset per source is added, and a document is emitted once for every integer that
its step crosses. As all documents of a source have the same expectation, the prefix sum is ``rate * rank``.

The order is by size class first, so a source's emitted words stay near its target whatever the sizes. A source is
never put into one task: its documents are numbered inside blocks (size class and two hex digits of a hash), and
the blocks, of which there are a few thousand whatever the input, are numbered before them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paceline.llm.common import WORD, stage

WEIGHTS = (5, 2, 1)
MOST = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size) to (source, source_size, target); one row per source in and out.

    The share of one unit of weight is raised until nothing is above its cap: a source is capped when that share,
    with all sources capped before it taken out, still exceeds ``cap / weight``. Sums stay whole numbers.
    """
    # One row per source: a listing, not the documents.
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(order) - 1) % len(weights)) + 1)
    capped = sizes.select("source", "source_size", turn.cast("long").alias("w"), (F.col("source_size") * most).alias("cap"))
    fill = Window.orderBy((F.col("cap") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    everyone = Window.partitionBy()
    steps = capped.select(
        "*",
        (F.sum("source_size").over(everyone) - F.coalesce(F.sum("cap").over(before), F.lit(0))).alias("left"),
        (F.sum("w").over(everyone) - F.coalesce(F.sum("w").over(before), F.lit(0))).alias("weight_left"),
    )
    share = F.col("left").cast("double") / F.col("weight_left")
    first_open = F.max(F.when(share * F.col("w") <= F.col("cap"), share)).over(everyone)
    target = F.least(F.col("cap").cast("double"), F.coalesce(first_open, F.lit(0.0)) * F.col("w"))
    return steps.select("source", "source_size", target.alias("target"))


BLOCK = ["source", "bits", "lead", "part"]


def _listed(docs: DataFrame, *more: Column) -> DataFrame:
    """Columns that fix a document's place: source, size class, hash of the id, hash of the text."""
    listed = docs.select(
        "doc_id",
        "source",
        word_count(F.col("text")).alias("size"),
        F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_md5"),
        F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("h"),
        *more,
    )
    return listed.withColumns(
        {
            "bits": F.length(F.bin("size")),
            "lead": F.expr("shiftright(size, greatest(length(bin(size)) - 3, 0))"),
            "part": F.substring("h", 1, 2),
        }
    )


def _plan(listed: DataFrame, weights: tuple[int, ...], most: int, seed: int) -> DataFrame:
    """For each block of a source: documents before it, and the source's size, target, rate and offset."""
    blocks = stage(listed.groupBy(*BLOCK).agg(F.count("*").alias("n"), F.sum("size").alias("words")), "mix-blocks")
    before = Window.partitionBy("source").orderBy("bits", "lead", "part").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select(*BLOCK, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    sizes = blocks.groupBy("source").agg(F.sum("words").cast("long").alias("source_size"))
    targets = source_targets(sizes, weights, most)
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}/"), F.coalesce("source", F.lit("")))), 1, 8), 16, 10)
    rates = targets.select(
        "*",
        F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("rate"),
        (offset.cast("double") / 4294967296.0).alias("offset"),
    )
    plan = starts.alias("b").join(rates.alias("r"), F.col("b.source").eqNullSafe(F.col("r.source")))
    return stage(plan.select("b.*", "source_size", "target", "rate", "offset"), "mix-plan")


def _placed(listed: DataFrame, plan: DataFrame) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*BLOCK).orderBy("h", "doc_id", "text_md5"))
    same = [F.col(f"d.{c}").eqNullSafe(F.col(f"p.{c}")) for c in BLOCK]
    joined = listed.withColumn("place", place).alias("d").join(plan.alias("p"), same)
    rank = F.col("start") + F.col("place")
    step = F.floor(rank * F.col("rate") + F.col("offset")) - F.floor((rank - 1) * F.col("rate") + F.col("offset"))
    return joined.select("d.*", "source_size", "target", step.cast("long").alias("copies"))


def mix_copies(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = 0) -> DataFrame:
    """How often the mix takes each document: doc_id, source, size, source_size, target, copies (0 to ``most``).

    ``docs`` needs doc_id, source and text. Empty and null texts have size 0 and still take a place in the order.
    Documents alike in id, source and text are numbered in any order, which gives the same rows. A null source is
    a source like the others, the last one. No words at all: target and copies are 0. No rows: no rows.
    """
    listed = stage(_listed(docs), "mix-sizes")
    placed = _placed(listed, _plan(listed, weights, most, seed))
    return placed.select("doc_id", "source", "size", "source_size", "target", "copies")


def mix_documents(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = 0) -> DataFrame:
    """The mix itself: each document's row, with all its columns, once per copy; documents with no copy are gone."""
    listed = _listed(docs, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    placed = _placed(listed, _plan(listed.drop("row"), weights, most, seed)).where(F.col("copies") > 0)
    return placed.select(F.explode(F.array_repeat("row", F.col("copies").cast("int"))).alias("row")).select("row.*")


OP2_SQL = r"""
WITH listed AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
        md5(coalesce(text, '')) AS text_md5, md5(coalesce(doc_id::VARCHAR, '')) AS h
    FROM documents
), classed AS (
    SELECT *, length(bin(size)) AS bits, size >> greatest(length(bin(size)) - 3, 0) AS lead, substr(h, 1, 2) AS part
    FROM listed
), sources AS (
    SELECT source, sum(size)::BIGINT AS source_size FROM listed GROUP BY source
), capped AS (
    SELECT source, source_size, ([5, 2, 1])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3) + 1] AS w,
        source_size * 3 AS cap
    FROM sources
), steps AS (
    SELECT *, (sum(source_size) OVER ())::BIGINT - coalesce(sum(cap) OVER before, 0)::BIGINT AS rest,
        (sum(w) OVER ())::BIGINT - coalesce(sum(w) OVER before, 0)::BIGINT AS weight_left
    FROM capped
    WINDOW before AS (ORDER BY cap::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), open AS (
    SELECT max(rest::DOUBLE / weight_left) FILTER (WHERE rest::DOUBLE / weight_left * w <= cap) AS share FROM steps
), targets AS (
    SELECT source, source_size, least(cap::DOUBLE, coalesce(share, 0.0) * w) AS target,
        ('0x' || substr(md5('0/' || coalesce(source, '')), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE AS off
    FROM steps, open
), ranked AS (
    SELECT c.doc_id, c.size, t.source_size, t.target, t.off,
        CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END AS rate,
        row_number() OVER (PARTITION BY c.source ORDER BY bits, lead, part, h, doc_id, text_md5) AS rank
    FROM classed c JOIN targets t ON c.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target::DOUBLE AS target,
    ((floor(rank * rate + off) - floor((rank - 1) * rate + off))::BIGINT * size)::BIGINT AS taken
FROM ranked
"""
