"""A family's run over the driver's tables: label files, grids, training, scores by seed and epoch."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.operators import grid as G
from tessera.plans import experiments as E
from tessera.plans import family_run
from tessera.plans.registry import query, table
from tessera.sources.files import shared_folder

RATE, EPOCHS, SEEDS = 0.5, 2, (1, 2)


def _epoch(k: int) -> str:
    """Weights, biases and outputs after plain step k, from those of step k - 1."""
    before = f"o{k - 1}" if k > 1 else "(SELECT fam, vid, t, 0.0::DOUBLE AS out FROM z)"
    slope = "CASE WHEN fam = 'size' THEN 2 * (out - y) ELSE pw * y * (1 / (1 + exp(-out)) - 1) + (1 - y) / (1 + exp(-out)) END"
    old_w, old_b = (f"(SELECT w FROM w{k - 1} q WHERE q.fam = p.fam AND q.t = p.t AND q.c = p.c)", f"(SELECT b FROM b{k - 1} q WHERE q.fam = p.fam AND q.t = p.t)") if k > 1 else ("0", "0")
    return f""",
d{k} AS (SELECT fam, vid, t, {slope} AS d FROM z JOIN {before} USING (fam, vid, t) WHERE train AND y IS NOT NULL),
m{k} AS (SELECT fam, count(*) AS m FROM d{k} GROUP BY fam),
w{k} AS (SELECT fam, t, c, {old_w} - {RATE} * g AS w FROM (SELECT fam, t, c, sum(d * v) / any_value(m) AS g FROM d{k} JOIN x USING (vid) JOIN m{k} USING (fam) GROUP BY fam, t, c) p),
b{k} AS (SELECT fam, t, {old_b} - {RATE} * g AS b FROM (SELECT fam, t, sum(d) / any_value(m) AS g FROM d{k} JOIN m{k} USING (fam) GROUP BY fam, t) p),
o{k} AS (SELECT fam, vid, t, sum(w * v) + any_value(b) AS out FROM z JOIN x USING (vid) JOIN w{k} USING (fam, t, c) JOIN b{k} USING (fam, t) GROUP BY fam, vid, t)"""


def _scores(k: int) -> str:
    return f"""SELECT {k} AS epoch, 'size' AS family, t::VARCHAR AS target, 'r2' AS metric, r AS score FROM r2 WHERE k = {k}
UNION ALL SELECT {k}, 'size', 'mean', 'r2', avg(r) FROM r2 WHERE k = {k}
UNION ALL SELECT {k}, 'disease', CASE t WHEN 0 THEN 'quality' ELSE 'toxic' END, 'auroc', a FROM au WHERE k = {k} AND t >= 0
UNION ALL SELECT {k}, 'disease', 'macro', 'auroc', avg(a) FROM au WHERE k = {k} AND t >= 0
UNION ALL SELECT {k}, 'disease', 'micro', 'auroc', a FROM au WHERE k = {k} AND t = -1"""


RUN_SQL = f"""WITH cells AS (SELECT vec_id AS vid, i % 8 AS c, avg(v) AS v FROM (
SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings) GROUP BY ALL),
x AS (SELECT vid, c, (v - avg(v) OVER (PARTITION BY vid)) / sqrt(var_pop(v) OVER (PARTITION BY vid) + 1e-5) AS v FROM cells),
raw AS (SELECT doc_id AS vid, 'size' AS fam, 0 AS t, n_chars / 1000.0::DOUBLE AS y FROM documents
UNION ALL SELECT doc_id, 'size', 1, CASE WHEN doc_id % 3 > 0 THEN len(string_split(text, ' ')) / 100.0::DOUBLE END FROM documents
UNION ALL SELECT doc_id, 'disease', 0, quality::DOUBLE FROM documents LEFT JOIN labels USING (doc_id)
UNION ALL SELECT doc_id, 'disease', 1, toxic::DOUBLE FROM documents LEFT JOIN labels USING (doc_id)),
mine AS (SELECT raw.*, vid % 5 > 0 AS train FROM raw WHERE vid IN (SELECT vid FROM x)),
s AS (SELECT fam, t, CASE WHEN fam = 'size' THEN avg(y) ELSE 0 END AS mu, CASE WHEN fam = 'size' THEN stddev_pop(y) + 1e-6 ELSE 1 END AS sd,
least(100, (1 - greatest(1e-3, least(1 - 1e-3, avg(y)))) / greatest(1e-3, least(1 - 1e-3, avg(y)))) AS pw FROM mine WHERE train GROUP BY fam, t),
z AS (SELECT fam, vid, t, train, (y - mu) / sd AS y, y AS y_true, mu, sd, pw FROM mine JOIN s USING (fam, t)){"".join(_epoch(k) for k in range(1, EPOCHS + 1))},
judged AS (SELECT k, fam, vid, t, y_true, out * sd + mu AS said FROM z JOIN ({" UNION ALL ".join(f"SELECT {k} AS k, * FROM o{k}" for k in range(1, EPOCHS + 1))}) USING (fam, vid, t)
WHERE NOT train AND y_true IS NOT NULL),
r2 AS (SELECT k, t, greatest(-1, least(1, 1 - sum((y_true - said) ** 2) / (var_pop(y_true) * count(*) + 1e-9))) AS r FROM judged WHERE fam = 'size' GROUP BY k, t),
ranked AS (SELECT k, t, y_true, rank() OVER (PARTITION BY k, t ORDER BY said) + (count(*) OVER (PARTITION BY k, t, said) - 1) / 2.0::DOUBLE AS r FROM (
SELECT k, t, y_true, said FROM judged WHERE fam = 'disease' UNION ALL SELECT k, -1, y_true, said FROM judged WHERE fam = 'disease')),
au AS (SELECT k, t, (sum(r * y_true) - sum(y_true) * (sum(y_true) + 1) / 2) / (sum(y_true) * (count(*) - sum(y_true))) AS a FROM ranked GROUP BY k, t)
SELECT seed::INT AS seed, epoch::INT AS epoch, family, target, metric, round(score, 4) AS score FROM ({" UNION ALL ".join(_scores(k) for k in range(1, EPOCHS + 1))})
CROSS JOIN (SELECT unnest({list(SEEDS)}) AS seed)"""


@query(RUN_SQL)
def x7_family_run(spark, sf_dir):
    """Linear heads over block averages, from weights of zero by plain steps, so that SQL can follow them."""
    folder = f"{shared_folder(spark)}/runs/{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"), "doc_id", "left")
    words = F.when(F.col("doc_id") % 3 > 0, F.size(F.split("text", " ")) / 100)
    columns = {"size": [(F.col("n_chars") / 1000).alias("chars"), words.alias("words")], "disease": [F.col("quality"), F.col("toxic")]}
    files = {}
    for family, targets in columns.items():
        for split, part in (("train", F.col("doc_id") % 5 > 0), ("valid", F.col("doc_id") % 5 == 0)):
            files.setdefault(family, {})[split] = path = f"{folder}/labels/{family}_{split}"
            docs.where(part).select(F.col("doc_id").alias("VolumeName"), *targets).write.csv(path, header=True)
    probe = {"seeds": list(SEEDS), "epochs": EPOCHS, "readout": "mean", "hidden": 0, "rate": RATE, "plain": True, "clip": 0.0, "scale": 0.0}
    told = {"exp_id": "exp_run", "encoder": "grid", "shape": [2, 2, 2], "channels": 8, "compression": {"method": "avgpack"}, "families": list(columns), "labels": files, "probe": probe}
    experiment = E.Experiment.model_validate(told)
    grid = G.from_arrays(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", (2, 2, 2), 8)
    family_run.run(spark, experiment, E.FAMILIES, grid.where("vid % 5 > 0"), grid.where("vid % 5 = 0"), folder)
    logs = [family_run.score_log(spark, folder, "grid", f) for f in columns]
    return logs[0].unionByName(logs[1])
