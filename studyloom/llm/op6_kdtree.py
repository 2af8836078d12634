"""Shards from a k-d tree over metadata, with DataFrame operations only.

A node of the tree stands for a range of shards and holds the rows not yet
told apart.  It is cut along its widest dimension (spread relative to the
spread over all rows) so that each side gets its shards' part of the bytes.
Cuts of all nodes of a level are found together: weighted histograms over the
nodes' key ranges, refined where the cut falls, until the bin at the cut
holds next to nothing or one row.  A histogram is a partial aggregation of bounded size,
whatever the number of rows, and no row moves while the tree grows; the
driver sees one row for each node.  Keys order rows by the dimension, then by
the text's checksum, then by a hash of the id and the row's place, so a group
of equal texts or of repeated rows, even a third of all, is cut wherever the
bytes demand it and otherwise stays together.

The law is `bytes`: shards differ by no more than the tolerance and a row.
Null text counts as empty, a null id and null metadata as values of their
own.  Repeated rows are rows like others, in any shard.  An empty
table gives no rows; with fewer rows than shards some shards are empty.
Only named columns are read, so extra columns do not matter.
"""

from __future__ import annotations

import json
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import written

#: Bins of a histogram for each node.
BINS = 2048
#: Tree nodes whose table is broadcast; a larger tree is joined as Spark sees fit.
MOST_BROADCAST = 1 << 16


def _code(column: Column) -> Column:
    """A value as 31 bits: numbers up to that as they are, names by their checksum."""
    return F.shiftright(F.crc32(F.coalesce(column.cast("string"), F.lit("\0"))), 1)


def points(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", metadata: tuple[str, ...] = ("source", "lang")) -> DataFrame:
    """id, size, crc, h and one key for each dimension: the size in bytes and the metadata columns."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    size, crc = (F.octet_length(text) + 1).cast("long"), F.crc32(text)
    values = [F.least(size, F.lit((1 << 31) - 1)), *(_code(F.col(c)) for c in metadata)]
    keys = [(F.shiftleft(v.cast("long"), 32) + crc).alias(f"k{i}") for i, v in enumerate(values)]
    # the id's hash orders rows; its last bits come from the row's place, so that repeated rows can be told apart
    place = F.xxhash64(F.monotonically_increasing_id()).bitwiseAND(F.lit((1 << 22) - 1))
    h = F.xxhash64(F.col(id_col), F.lit("kd")).bitwiseAND(F.lit((1 << 62) - (1 << 22))).bitwiseOR(place)
    return docs.select(F.col(id_col).alias("id"), size.alias("size"), crc.alias("crc"), h.alias("h"), *keys)


def _table(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A table of one row a tree node, broadcast while it has at most MOST_BROADCAST rows (some 3 MB)."""
    out = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")).alias("x")).select("x.*")
    return F.broadcast(out) if len(rows) <= MOST_BROADCAST else out


def _located(pts: DataFrame, levels: list[list[dict]]) -> DataFrame:
    """pts with the first shard of the node that each row has reached."""
    out = pts.withColumn("node", F.lit(0).cast("long"))
    dims = [c for c in pts.columns if c[0] == "k" and c[1:].isdigit()]
    for cuts in levels:
        small = _table(pts.sparkSession, cuts, "node:bigint, dim:int, cut:bigint, cut_h:bigint, right:bigint")
        key = F.element_at(F.array(*dims), F.col("dim") + 1)
        beyond = (key > F.col("cut")) | ((key == F.col("cut")) & (F.col("h") > F.col("cut_h")))
        out = out.join(small, "node", "left").withColumn("node", F.when(beyond, F.col("right")).otherwise(F.col("node"))).drop("dim", "cut", "cut_h", "right")
    return out


def _cuts(rows: DataFrame, goals: dict[int, dict], tolerance: float) -> None:
    """Find cut and cut_h for each node of goals, which has dim, lo, hi, total and goal (bytes left of the cut)."""
    spark = rows.sparkSession
    dims = [c for c in rows.columns if c[0] == "k" and c[1:].isdigit()]
    for g in goals.values():
        g |= {"before": 0, "phase": 0, "key": 0, "open": True}
    while todo := {n: g for n, g in goals.items() if g["open"]}:
        asked = [{"node": n, "dim": g["dim"], "lo": g["lo"], "hi": g["hi"], "wide": max(1, -(-(g["hi"] - g["lo"] + 1) // BINS)), "phase": g["phase"], "key": g["key"], "want": g["goal"] - g["before"]} for n, g in todo.items()]
        small = _table(spark, asked, "node:bigint, dim:int, lo:bigint, hi:bigint, wide:bigint, phase:int, key:bigint, want:bigint")
        key = F.element_at(F.array(*dims), F.col("dim") + 1)
        near = rows.join(small, "node").withColumn("_v", F.when(F.col("phase") == 0, key).otherwise(F.col("h"))).where(((F.col("phase") == 0) | (key == F.col("key"))) & F.col("_v").between(F.col("lo"), F.col("hi")))
        bins = near.groupBy("node", "want", F.expr("(_v - lo) div wide").alias("bin")).agg(F.sum("size").alias("mass"), F.min("_v").alias("least"), F.max("_v").alias("most"), F.count("*").alias("n"))
        ran = bins.withColumn("upto", F.sum("mass").over(Window.partitionBy("node").orderBy("bin"))).where("upto >= want")
        picked = ran.groupBy("node").agg(F.min_by(F.struct("least", "most", "mass", "upto", "n"), "bin").alias("x")).select("node", "x.*")
        for r in picked.collect():
            g = goals[r["node"]]
            start = g["before"] + r["upto"] - r["mass"]
            if r["n"] == 1 or r["mass"] <= tolerance * g["total"] or (r["least"] == r["most"] and g["phase"] == 1):
                ahead = g["before"] + r["upto"] - g["goal"] <= g["goal"] - start
                at = r["most"] if ahead else r["least"] - 1
                g |= {"open": False, "cut": g["key"] if g["phase"] else at, "cut_h": at if g["phase"] else (1 << 62)}
            elif r["least"] == r["most"]:
                g |= {"phase": 1, "key": r["least"], "lo": 0, "hi": (1 << 62) - 1, "before": start}
            else:
                g |= {"lo": r["least"], "hi": r["most"], "before": start}


def tree(pts: DataFrame, n_shards: int, tolerance: float = 0.0005) -> DataFrame:
    """pts (as from points(), written) with a shard from 0 to n_shards - 1."""
    dims = [c for c in pts.columns if c[0] == "k" and c[1:].isdigit()]
    nodes, levels, whole = {0: n_shards}, [], None
    while any(k > 1 for k in nodes.values()):
        rows = _located(pts, levels)
        spread = [F.min(d).alias(f"lo_{d}") for d in dims] + [F.max(d).alias(f"hi_{d}") for d in dims]
        stats = {r["node"]: r for r in rows.groupBy("node").agg(F.sum("size").alias("total"), F.count("*").alias("n"), *spread).collect()}
        whole = whole or stats.get(0)
        goals: dict[int, dict] = {}
        for n, k in nodes.items():
            r = stats.get(n)
            if k > 1 and r is not None and r["n"] > 1:
                width = [(r[f"hi_{d}"] - r[f"lo_{d}"]) / max(1, whole[f"hi_{d}"] - whole[f"lo_{d}"]) for d in dims]
                i = max(range(len(dims)), key=lambda j: (width[j], -j))
                goals[n] = {"dim": i, "lo": r[f"lo_{dims[i]}"], "hi": r[f"hi_{dims[i]}"], "total": r["total"], "goal": max(1, r["total"] * (k // 2) // k)}
        if goals:
            _cuts(rows, goals, tolerance)
        levels.append([{"node": n, "dim": g["dim"], "cut": g["cut"], "cut_h": g["cut_h"], "right": n + nodes[n] // 2} for n, g in goals.items()])
        nodes = {m: s for n, k in nodes.items() for m, s in (((n, k // 2), (n + k // 2, k - k // 2)) if k > 1 else ((n, k),))}
        if not goals:
            break
    return _located(pts, [x for x in levels if x]).withColumnRenamed("node", "shard")


def slots(rows: DataFrame, n_shards: int, n_rows: int, bucket_rows: int = 4096) -> DataFrame:
    """rows with a slot: in each shard 0, 1, 2 ... without a gap.

    A shard's rows are numbered in buckets of about bucket_rows by the hash h,
    and a bucket starts after the counts of those before it, so no task holds a shard.
    """
    n = max(1, ceil(n_rows / n_shards / bucket_rows))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("h"), F.lit(n)))
    counts = rows.groupBy("shard", "bucket").agg(F.count("*").alias("many"))
    begins = counts.select("shard", "bucket", (F.sum("many").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("many")).alias("begin"))
    within = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("h", "id", "size", "crc"))
    return rows.join(begins, ["shard", "bucket"]).withColumn("slot", F.col("begin") + within - 1).drop("bucket", "begin")


def shard(docs: DataFrame, n_shards: int | None = None, target_bytes: int | None = None, id_col: str = "doc_id", text_col: str = "text", metadata: tuple[str, ...] = ("source", "lang")) -> DataFrame:
    """(id, size, crc, shard, slot) for each row of docs.

    Either the number of shards is given, or the bytes that a shard should have.
    """
    pts = written(points(docs, id_col, text_col, metadata), "kd-points")
    total = pts.agg(F.sum("size").alias("size"), F.count("*").alias("n")).first()
    n = n_shards or max(1, ceil((total["size"] or 0) / (target_bytes or 1 << 30)))
    return slots(tree(pts, n), n, total["n"]).select("id", "size", "crc", F.col("shard").cast("int").alias("shard"), "slot")


def op6_kdtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = shard(spark.read.parquet(f"{sf_dir}/documents.parquet"), 16)
    return found.select(
        F.col("id").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
