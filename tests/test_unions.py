"""Unions of tables that are each dealt by the same key."""

from pyspark.sql import functions as F

from lodestone.operators import chunks
from lodestone.plans.lineage import sound_unions


def test_chunks_in_a_join(spark):
    """Chunks of symbols are numbered over a union; every file and number is there once, in whatever plan."""
    spark.conf.set("spark.sql.unionOutputPartitioning", "true")
    lines = spark.range(4000).select(F.concat(F.lit("p"), (F.col("id") % 40).cast("string")).alias("path"), (F.floor(F.col("id") / 40) + 1).cast("int").alias("line_no"))
    sizes = lines.groupBy("path").agg(F.max("line_no").alias("n_lines"))
    ranges = lines.filter("line_no % 7 = 3").select("path", F.col("line_no").alias("start_line"), (F.col("line_no") + 2).alias("end_line"))
    cells = sizes.select("path", F.explode(F.array(*[F.lit(i) for i in range(4)])).alias("chunk_index"))
    got = cells.join(chunks.symbol_chunks(sizes, ranges, 12, 3), ["path", "chunk_index"], "left").collect()
    assert len(got) == 160
    assert {(r.chunk_index, r.start_line, r.end_line) for r in got} == {(0, 1, 2), (1, 3, 5), (2, 6, 9), (3, 10, 12)}
    assert spark.conf.get("spark.sql.unionOutputPartitioning") == "false"
    sound_unions(spark)
