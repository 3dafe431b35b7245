"""Queries through files: tables that are written by the library's sinks and scanned by its sources."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.operators import importance as I
from tessera.plans import experiments as E
from tessera.plans.registry import query, table
from tessera.sources import readers as R
from tessera.sources import bundles, shards, stacked, writers
from tessera.sources.files import shared_folder


def new_folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}/{uuid.uuid4().hex}"


def vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("vid"), "vec_id", F.col("embedding").alias("features"))


def weighted(column: str):
    """Sum of the entries times their places, which tells whether their order is right."""
    return F.reduce(F.zip_with(column, F.sequence(F.lit(1), F.size(column)), lambda x, i: x.cast("double") * i), F.lit(0.0), lambda a, x: a + x)


@query("""SELECT vec_id::VARCHAR AS vid, CASE WHEN vec_id % 3 = 0 THEN 'valid' ELSE 'train' END AS split, len(embedding)::INT AS n,
round(list_sum(list_transform(embedding, lambda x, i: x::DOUBLE * i)), 5) AS total FROM embeddings""")
def s3_stacked_scan(spark, sf_dir):
    manifest = f"{new_folder(spark, 'stacked')}/manifest.json"
    rows = vectors(spark, sf_dir)
    stacked.write_stacked(rows.where("vec_id % 3 <> 0"), manifest, (64, 1), "train", gridShape="4,4,4")
    stacked.write_stacked(rows.where("vec_id % 3 = 0"), manifest, (64, 1), "valid", gridShape="4,4,4")
    read = [stacked.stacked(spark, manifest, s).withColumn("split", F.lit(s)) for s in ("train", "valid")]
    return read[0].unionByName(read[1]).select("vid", "split", F.size("features").alias("n"), F.round(weighted("features"), 5).alias("total"))


CODES = "SELECT vec_id, unnest(embedding) AS x FROM embeddings"


@query(f"""SELECT vec_id::VARCHAR AS vid, n_regionkey::INT AS entry, count(*) AS cells FROM ({CODES})
JOIN nation ON n_nationkey = least(24, floor((x::DOUBLE + 1) * 12.5)) GROUP BY ALL""")
def s2_codebook_scan(spark, sf_dir):
    manifest = f"{new_folder(spark, 'codes')}/manifest.json"
    code = F.transform("features", lambda x: F.least(F.lit(24), F.floor((x.cast("double") + 1) * 12.5)).cast("long"))
    stacked.write_stacked(vectors(spark, sf_dir).withColumn("codes", code), manifest, (64,), kind="codes", gridShape="4,4,4")
    codes = stacked.stacked(spark, manifest, kind="codes").select("vid", F.posexplode("codes").alias("pos", "code"))
    book = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("code"), F.col("n_regionkey").cast("int").alias("entry"))
    return R.codebook_grids(codes, book).groupBy("vid", "entry").agg(F.count("*").alias("cells"))


@query("""SELECT vec_id::VARCHAR AS vid, '2,2,2,8' AS shape,
round(list_sum(list_transform(embedding, lambda x, i: x::DOUBLE * ((i - 1) % 8 * 8 + (i - 1) // 8 + 1))), 5) AS total FROM embeddings""")
def s4_token_shards(spark, sf_dir):
    """Tensors of [8, 2, 2, 2] in shards, read as [2, 2, 2, 8]."""
    folder = new_folder(spark, "shards")
    shards.write_token_shards(vectors(spark, sf_dir), folder, "train", (8, 2, 2, 2)).write.json(f"{folder}/index")
    read = shards.token_shards(shards.token_index(spark, f"{folder}/index"), folder, channels=8)
    return read.select("vid", F.array_join("shape", ",").alias("shape"), F.round(weighted("features"), 5).alias("total"))


BINS = "(VALUES (0, 0), (0, 1), (1, 1), (1, 2), (2, 2), (2, 3)) AS {0}(o{0}, i{0})"
CELLS = "SELECT vec_id::VARCHAR AS vid, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings"
MAPS = f"""pooled AS (SELECT kind, vid, ot AS t, oh AS h, ow AS w, avg(v) AS v FROM cells JOIN {BINS.format("t")} ON it = i // 16
JOIN {BINS.format("h")} ON ih = i // 4 % 4 JOIN {BINS.format("w")} ON iw = i % 4 GROUP BY ALL)
SELECT kind, vid, t::INT AS t, h::INT AS h, w::INT AS w, round(0.75 * v * count(*) OVER k / sum(v) OVER k + 0.25, 5) AS weight FROM pooled WINDOW k AS (PARTITION BY kind, vid)"""


@query(f"WITH c AS ({CELLS}), cells AS (SELECT 'last' AS kind, vid, i, (x * x)::FLOAT::DOUBLE AS v FROM c UNION ALL SELECT 'all', vid, i, abs(x) FROM c), {MAPS}")
def x8_attention_importance(spark, sf_dir):
    """Two kinds of attention maps in files, chosen by the session's setting; 4 x 4 x 4 cells to 3 x 3 x 3 tokens."""
    root, grids = new_folder(spark, "attention"), R.dealt(vectors(spark, sf_dir), "vid")
    made = None
    for kind, value in (("last", lambda x: x * x), ("all", lambda x: F.abs(x))):
        maps = grids.select("vid", F.array(*map(F.lit, (4, 4, 4))).alias("shape"), F.transform(F.col("features").cast("array<double>"), value).alias("features"))
        writers.npy_files(maps, f"{root}/train/attn_received/{kind}").write.format("noop").mode("overwrite").save()
        before = spark.conf.get(I.ATTENTION_VARIANT, None)
        spark.conf.set(I.ATTENTION_VARIANT, kind)
        try:
            scores = I.attention_scores(spark, root, "train", (4, 4, 4), vectors(spark, sf_dir))
        finally:
            spark.conf.set(I.ATTENTION_VARIANT, before) if before else spark.conf.unset(I.ATTENTION_VARIANT)
        part = E.IMPORTANCE.apply("attention", scores, shape=(4, 4, 4), out=(3, 3, 3), share=0.25).withColumn("kind", F.lit(kind))
        made = part if made is None else made.unionByName(part)
    return made.select("kind", "vid", "t", "h", "w", F.round("weight", 5).alias("weight"))


@query(f"""WITH c AS ({CELLS}), n AS (SELECT n_regionkey AS k, count(*) AS n FROM nation WHERE n_nationkey % 6 > 0 GROUP BY ALL),
cells AS (SELECT 'organ' AS kind, vid, i, coalesce(n, 0) AS v FROM c LEFT JOIN n ON floor(abs(x) * 20) % 8 = k), {MAPS}""")
def x4_organ_importance(spark, sf_dir):
    """Classes of cells by size of value; nations are the findings that name a region's class."""
    at = F.col("i")
    cells = vectors(spark, sf_dir).select("vid", F.posexplode("features").alias("i", "x")).select(
        "vid", F.expr("i div 16").cast("int").alias("t"), (F.expr("i div 4") % 4).cast("int").alias("h"), (at % 4).cast("int").alias("w"),
        (F.floor(F.abs(F.col("x").cast("double")) * 20) % 8).cast("int").alias("class_id"),
    )
    findings = table(spark, sf_dir, "nation").where("n_nationkey % 6 > 0").select(F.col("n_nationkey").alias("finding"), F.col("n_regionkey").cast("int").alias("class_id"))
    made = E.IMPORTANCE.apply("organ_soft", cells, findings=findings, shape=(4, 4, 4), out=(3, 3, 3), share=0.25)
    return made.select(F.lit("organ").alias("kind"), "vid", "t", "h", "w", F.round("weight", 5).alias("weight"))


LISTING = "'corpus/' || CASE WHEN doc_id % 2 = 0 THEN 'compressed/' ELSE 'whole/' END || lang || '/x_b' || [8, 27, 216][1 + doc_id % 3] || '_d1/' || source || '/' || doc_id || '.npy'"


@query(f"""WITH l AS (SELECT {LISTING} AS path, n_chars AS bytes FROM documents),
m AS (SELECT 'compressed' AS bundle, path, bytes, 'data/embeddings/' || substr(path, 19) AS target FROM l WHERE path LIKE 'corpus/compressed/%/x_b27_d1/%'
UNION ALL SELECT 'whole', path, bytes, 'data/whole/' || substr(path, 14) FROM l WHERE path LIKE 'corpus/whole/%' UNION ALL SELECT 'german', path, bytes, 'data/' || substr(path, 17) FROM l WHERE path LIKE 'corpus/whole/de/%')
SELECT bundle, path, bytes::BIGINT AS bytes, target FROM m""")
def x9_bundle_members(spark, sf_dir):
    """Documents as files of a store; a set of bundles, narrowed to one budget where its patterns can be."""
    name = F.concat(
        F.lit("corpus/"), F.when(F.col("doc_id") % 2 == 0, "compressed/").otherwise("whole/"), "lang", F.lit("/x_b"),
        F.element_at(F.array(*map(F.lit, (8, 27, 216))), (F.col("doc_id") % 3 + 1).cast("int")), F.lit("_d1/"), "source", F.lit("/"), "doc_id", F.lit(".npy"),
    )
    listing = table(spark, sf_dir, "documents").select(name.alias("path"), F.col("n_chars").cast("long").alias("bytes"))
    known = {
        "compressed": bundles.Bundle(("corpus/compressed/{encoder}/*_b{budget}_*/**",), "data/embeddings", 1.0),
        "whole": bundles.Bundle(("corpus/whole/{encoder}/**", "corpus/whole/*/x_*/**"), "data/whole/", 2.0),
        "german": bundles.Bundle(("corpus/whole/de/**/*.npy",), "data", 0.5),
        "other": bundles.Bundle(("other/**",), "data", 0.5),
    }
    names = bundles.resolved(known, {"all_whole": ["whole", "german"], "asked": ["compressed", "all_whole"]}, ["asked"])
    told = bundles.bundle_table(spark, known, names, budget=27)
    return bundles.bundle_members(listing, told)
