"""Queries over tables: joins, sets, sampling, and the cleaning of texts and labels."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import scalars as S
from tessera.operators import tables as T
from tessera.operators.metrics import first_by
from tessera.plans.registry import query, table


def volumes(spark, sf_dir):
    """Conversations as files of volumes."""
    name = F.concat(F.lit("data/img_train_"), F.col("conv_id"), F.lit("_a_"), F.col("turn"), F.when(F.col("turn") % 2 == 0, ".nii.gz").otherwise(".npz"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text", name.alias("file"))


FILES = "f AS (SELECT conv_id, turn, role, text, 'data/img_train_' || conv_id || '_a_' || turn || CASE WHEN turn % 2 = 0 THEN '.nii.gz' ELSE '.npz' END AS file FROM conversations)"


@query(f"""WITH {FILES} SELECT file, 'train_' || conv_id || '_a_' || turn AS volume, 'train' AS split, conv_id::VARCHAR AS number, turn::VARCHAR AS idx,
'train/train_' || conv_id || '/train_' || conv_id || '_a/train_' || conv_id || '_a_' || turn || '.nii.gz' AS path FROM f""")
def p1_p2_s16_volume_ids(spark, sf_dir):
    v = volumes(spark, sf_dir).withColumn("volume", S.volume_id(F.col("file")))
    part = S.volume_parts(F.col("volume"))
    return v.select("file", "volume", part["split"].alias("split"), part["number"].alias("number"), part["index"].alias("idx"), S.nested_path(F.col("volume")).alias("path"))


@query("SELECT doc_id, d FROM (SELECT doc_id, 'img/' || doc_id || '.nii_embedded.npz' AS d FROM documents) WHERE regexp_replace(d, '^.*/|\\.nii_embedded\\.npz$', '', 'g') = doc_id::VARCHAR")
def p3_image_ids(spark, sf_dir):
    name = F.concat(F.lit("img/"), F.col("doc_id"), F.lit(".nii_embedded.npz"))
    d = table(spark, sf_dir, "documents").select("doc_id", name.alias("d"))
    return d.where(S.image_volume_id(F.col("d")) == F.col("doc_id").cast("string"))


@query("SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) AND doc_id NOT IN (SELECT item_id FROM benchmark)")
def p4_usable_ids(spark, sf_dir):
    bad = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"))
    return T.usable_ids(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), bad, "doc_id")


@query("SELECT role, count(*) AS n_in, count_if(trim(text) = '')::BIGINT AS n_empty, count_if(text IS NULL)::BIGINT AS n_missing, count_if(role LIKE 'as%' AND trim(text) <> '')::BIGINT AS n_out FROM conversations GROUP BY role")
def p5_p6_filter_counts(spark, sf_dir):
    blank = F.trim("text") == ""
    return table(spark, sf_dir, "conversations").groupBy("role").agg(
        F.count("*").alias("n_in"), F.count_if(blank).alias("n_empty"), F.count_if(F.col("text").isNull()).alias("n_missing"),
        F.count_if(F.col("role").startswith("as") & ~blank).alias("n_out"),
    )


@query("SELECT doc_id, source, lang FROM (SELECT *, max((lang = 'de')::INT) OVER (PARTITION BY source) AS has FROM documents) WHERE has = 0 OR lang = 'de'")
def p7_source_fallback(spark, sf_dir):
    """German rows of a source; all of its rows if it has none. Counted, then joined."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    has = d.groupBy("source").agg(F.max(F.col("lang") == "de").alias("has"))
    return d.join(has, "source").where(~F.col("has") | (F.col("lang") == "de")).select("doc_id", "source", "lang")


@query("""WITH s AS (SELECT l_orderkey, l_linenumber, l_quantity AS q, l_extendedprice AS p, l_discount AS d FROM lineitem), t AS (SELECT avg(p) AS m, stddev_pop(p) + 1e-6 AS s FROM s)
SELECT l_orderkey, l_linenumber, round(ln(1 + 0.1 * q), 6) AS logged, round((p - m) / t.s, 6) AS z, round(1 / (1 + exp(-d)), 6) AS sig, round(greatest(0.02, least(0.08, d)), 6) AS clipped,
round(greatest(-1000, least(1000, p - 30000)) / 1000, 6) AS hu, round(0.7 * d + 0.3, 6) AS mixed, round(q * (1 + (d - 1) * 0.25), 6) AS gated FROM s, t""")
def p8_p16_scalar_maths(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    stats = rows.agg(F.avg("l_extendedprice").alias("m"), (F.stddev_pop("l_extendedprice") + 1e-6).alias("s"))
    q, p, d = F.col("l_quantity"), F.col("l_extendedprice"), F.col("l_discount")
    r = lambda x, n: F.round(x, 6).alias(n)
    return rows.crossJoin(F.broadcast(stats)).select(
        "l_orderkey", "l_linenumber", r(S.log_scaled(q, 0.1), "logged"), r((p - F.col("m")) / F.col("s"), "z"), r(S.sigmoid(d), "sig"), r(S.clip(d, 0.02, 0.08), "clipped"),
        r(S.hounsfield_scaled(p - 30000), "hu"), r(S.uniform_mix(d, 0.3), "mixed"), r(S.residual_gate(q, d, 0.25), "gated"),
    )


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 4 <> 0 THEN 'r' || (l_linenumber % 4) ELSE 'b' || (l_partkey % 512) END AS tok FROM lineitem")
def p17_token_label(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    return rows.select("l_orderkey", "l_linenumber", S.token_label(F.col("l_linenumber") % 4, F.col("l_partkey") % 512).alias("tok"))


@query("SELECT p_partkey, p_retailprice AS spacing FROM part")
def p18_spacing(spark, sf_dir):
    text = F.concat(F.lit("["), F.col("p_retailprice").cast("decimal(18,6)").cast("string"), F.lit(", 1.5]"))
    return table(spark, sf_dir, "part").select("p_partkey", F.round(S.first_number(text), 6).alias("spacing"))


@query("""WITH p AS (SELECT p_partkey, p_size % 4 + 1 AS r, CASE WHEN p_size % 3 = 0 THEN p_size END AS budget, CASE WHEN p_size > 25 THEN 'pack' WHEN p_size > 10 THEN 'crop' ELSE 'mean' END AS method FROM part),
t AS (SELECT * FROM (VALUES (1, 64), (2, 8), (3, 8), (4, 1)) AS t(r, n))
SELECT p_partkey, coalesce(budget, n)::BIGINT AS tokens, CASE method WHEN 'pack' THEN 18 * r * r * r WHEN 'crop' THEN least(64, 18 * r * r * r) ELSE 18 END::BIGINT AS dim FROM p JOIN t USING (r)""")
def p19_token_size(spark, sf_dir):
    """Tokens by the budget or else by the factor; channels by the method."""
    size = F.col("p_size")
    method = F.when(size > 25, "pack").when(size > 10, "crop").otherwise("mean")
    tokens, dim = S.token_size(F.when(size % 3 == 0, size), (size % 4 + 1).cast("int"), method, (4, 4, 4), 18, 64, [1, 2, 3, 4])
    return table(spark, sf_dir, "part").select("p_partkey", tokens.alias("tokens"), dim.alias("dim"))


@query("SELECT doc_id, source FROM documents WHERE source <> 'src0'")
def p20_without_global(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("source <> 'src0'").select("doc_id", "source")


# --- joins -----------------------------------------------------------------------------


@query("SELECT d.doc_id, quality, toxic, l.doc_id IS NOT NULL AS present FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def j1_label_join(spark, sf_dir):
    return T.label_join(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT doc_id, lang, quality FROM labels JOIN documents USING (doc_id)")
def j2_strict_join(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return T.strict_join(table(spark, sf_dir, "labels").select("doc_id", "quality"), d, ["doc_id"])


@query("SELECT count(l.doc_id) AS matched, count_if(l.doc_id IS NULL)::BIGINT AS missing FROM documents d LEFT JOIN labels l USING (doc_id)")
def j3_lenient_counts(spark, sf_dir):
    return T.lenient_join(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), ["doc_id"])[1]


@query("""WITH g AS (SELECT l_orderkey AS id, l_linenumber, l_linestatus AS answer FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC) = 1)
SELECT o_orderkey AS id, answer, o_orderstatus = answer AS hit FROM orders JOIN g ON o_orderkey = id""")
def j4_gold_join(spark, sf_dir):
    """Of gold answers with one id the last one counts; each needs a prediction."""
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")]
    answers = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), "l_linenumber", F.col("l_linestatus").alias("answer"), *place)
    # Line numbers repeat in these tables: of equal ones the first in the files counts, whatever order tasks and shuffles bring them in.
    gold = first_by(answers, ["id"], [F.desc("l_linenumber"), F.asc("file"), F.asc("row")]).drop("file", "row")
    said = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_orderstatus")
    return T.strict_join(gold, said, ["id"]).select("id", "answer", (F.col("o_orderstatus") == F.col("answer")).alias("hit"))


@query("SELECT c.conv_id, c.turn, w.place FROM conversations c JOIN (SELECT doc_id AS conv_id, row_number() OVER (ORDER BY doc_id DESC) - 1 AS place FROM labels) w USING (conv_id)")
def j5_ordered_semi(spark, sf_dir):
    ids = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("conv_id"), (-F.col("doc_id")).alias("k"))
    wanted = T.numbered_rows(ids, "k").select("conv_id", F.col("row").alias("place"))
    return T.ordered_semi(table(spark, sf_dir, "conversations").select("conv_id", "turn"), wanted, "conv_id", "place")


@query("SELECT doc_id, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def j6_resume(spark, sf_dir):
    return T.resume(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), table(spark, sf_dir, "labels").select("doc_id"), ["doc_id"])


@query("""WITH a AS (SELECT l_suppkey AS k, avg(l_discount) AS x FROM lineitem WHERE l_linestatus = 'O' GROUP BY ALL), b AS (SELECT l_suppkey AS k, avg(l_discount) AS x FROM lineitem WHERE l_linestatus = 'F' GROUP BY ALL)
SELECT k, round(b.x - a.x, 6) AS delta_x FROM a JOIN b USING (k)""")
def j7_deltas(spark, sf_dir):
    mean = lambda s: table(spark, sf_dir, "lineitem").where(F.col("l_linestatus") == s).groupBy(F.col("l_suppkey").alias("k")).agg(F.avg("l_discount").alias("x"))
    return T.deltas(mean("O"), mean("F"), "k", ["x"]).withColumn("delta_x", F.round("delta_x", 6))


@query("SELECT doc_id, finding, grp FROM (SELECT doc_id, unnest(['quality', 'toxic']) AS finding, unnest([quality, toxic]) AS y FROM labels) JOIN (VALUES ('quality', 'lung'), ('quality', 'heart'), ('toxic', 'lung')) b(finding, grp) USING (finding) WHERE y = 1")
def j8_bridge(spark, sf_dir):
    bridge = {"quality": ["lung", "heart"], "toxic": ["lung"]}
    b = spark.createDataFrame([(k, g) for k, gs in bridge.items() for g in gs], "finding string, grp string")
    long = table(spark, sf_dir, "labels").unpivot("doc_id", ["quality", "toxic"], "finding", "y")
    return long.where("y = 1").join(F.broadcast(b), "finding").select("doc_id", "finding", "grp")


@query("SELECT p_partkey, s_suppkey FROM (SELECT DISTINCT l_partkey AS p_partkey, l_suppkey AS s_suppkey FROM lineitem) QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY s_suppkey) = 1")
def j9_first_available(spark, sf_dir):
    have = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p_partkey"), F.col("l_suppkey").alias("s_suppkey")).distinct()
    return T.first_available(have, ["p_partkey"], "s_suppkey")


@query("""WITH p AS (SELECT DISTINCT lang || '/' || source AS path, lang, source FROM documents)
SELECT path, CASE WHEN source = 'src1' THEN 'kept' WHEN source = 'src2' THEN 'skipped' WHEN lang = 'en' THEN 'kept' ELSE 'fallback' END AS status,
CASE WHEN source = 'src1' THEN 'a' WHEN source = 'src2' THEN NULL WHEN lang = 'en' THEN 'b' ELSE 'other' END AS grp FROM p""")
def j10_leaf_lookup(spark, sf_dir):
    paths = table(spark, sf_dir, "documents").select(F.concat_ws("/", "lang", "source").alias("path")).distinct()
    keep = spark.createDataFrame([("src1", "a"), ("en", "b")], "name string, grp string")
    skip = spark.createDataFrame([("src2",)], "name string")
    return T.leaf_lookup(paths, "path", F.broadcast(keep), F.broadcast(skip), "other")


@query("SELECT l_orderkey, l_linenumber, (l_partkey & 262143) AS code, ((l_partkey & 262143) % 97)::INT AS entry, CASE l_partkey & 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS findings FROM lineitem")
def j11_j12_s2_codebook(spark, sf_dir):
    """Codes against a codebook of 2^18 rows, and classes against a table of findings."""
    book = spark.range(1 << 18).select(F.col("id").alias("code"), (F.col("id") % 97).cast("int").alias("entry"))
    n = spark.createDataFrame([(0, 2), (1, 1)], "class_id long, n int")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").bitwiseAND(F.lit(262143)).alias("code"))
    joined = rows.join(book, "code").withColumn("class_id", F.col("code").bitwiseAND(F.lit(3)))
    return joined.join(F.broadcast(n), "class_id", "left").select("l_orderkey", "l_linenumber", "code", "entry", F.coalesce("n", F.lit(0)).alias("findings"))


@query("SELECT n_nationkey, CASE WHEN n_name IN ('FRANCE', 'NATION_1', 'BRAZIL') THEN 'named' ELSE 'attr_' || n_nationkey END AS attribute FROM nation")
def j13_name_or_index(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    names = spark.createDataFrame([("FRANCE", "named"), ("NATION_1", "named"), ("BRAZIL", "named")], "n_name string, by_name string")
    index = spark.range(100).select(F.col("id").alias("n_nationkey"), F.concat(F.lit("attr_"), "id").alias("by_index"))
    return n.join(F.broadcast(names), "n_name", "left").join(index, "n_nationkey", "left").select("n_nationkey", F.coalesce("by_name", "by_index").alias("attribute"))


@query("SELECT doc_id, lang IN ('de', 'fr') OR source IN ('src1', 'src3') AS matched FROM documents")
def j14_either_member(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("name"), F.col("source").alias("grp"))
    names = spark.createDataFrame([("de",), ("fr",)], "name string")
    groups = spark.createDataFrame([("src1",), ("src3",)], "grp string")
    return T.either_member(rows, F.broadcast(names), F.broadcast(groups)).select("doc_id", "matched")


@query("""WITH n AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings), c AS (SELECT label AS k, list_transform(range(64), lambda i: (i % (label + 2))::DOUBLE) AS y FROM (SELECT DISTINCT label FROM embeddings))
SELECT vec_id, k, round(list_dot_product(x, y) / sqrt(list_dot_product(x, x)) / sqrt(list_dot_product(y, y)) / 0.07, 4) AS logit FROM n, c""")
def j16_similarity(spark, sf_dir):
    """Each volume against a fixed table of ten text vectors."""
    kinds = table(spark, sf_dir, "embeddings").select("label").distinct()
    texts = kinds.select(F.col("label").alias("k"), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: (i % (F.col("label") + 2)).cast("double")).alias("y"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", S.unit(F.col("embedding")).alias("x"))
    # Every row meets every text: a query against all rows, whose size is counted.
    pairs = rows.join(T.small(texts.withColumn("y", S.unit(F.col("y")))), F.lit(True))
    return pairs.select("vec_id", "k", F.round(S.dot(F.col("x"), F.col("y")) / 0.07, 4).alias("logit"))


@query("SELECT e.event_type, round(avg(c.chance), 6) AS chance, count(*) AS n FROM events e JOIN (SELECT DISTINCT event_type, CASE WHEN event_type < 'd' THEN 0.5 ELSE 1 / 3 END AS chance FROM events) c USING (event_type) GROUP BY ALL")
def j18_chance(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_type")
    chance = e.distinct().withColumn("chance", F.when(F.col("event_type") < "d", F.lit(0.5)).otherwise(F.lit(1 / 3)))
    return T.strict_join(e, chance, ["event_type"]).groupBy("event_type").agg(F.round(F.avg("chance"), 6).alias("chance"), F.count("*").alias("n"))


@query("SELECT doc_id FROM documents ANTI JOIN labels USING (doc_id)")
def j19_preflight(spark, sf_dir):
    return T.missing(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id"), ["doc_id"])


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND doc_id NOT IN (SELECT item_id FROM benchmark) ORDER BY md5(doc_id || ':7'), doc_id LIMIT 100")
def j20_sample_of_the_rest(spark, sf_dir):
    """A seeded sample of 100 of the documents that neither list has."""
    lists = table(spark, sf_dir, "labels").select("doc_id").union(table(spark, sf_dir, "benchmark").select("item_id"))
    rest = table(spark, sf_dir, "documents").select("doc_id").join(lists, "doc_id", "left_anti")
    return rest.orderBy(T.seeded(7, F.col("doc_id")), "doc_id").limit(100)


@query("SELECT doc_id, g.grp, f.finding, (CASE f.finding WHEN 'quality' THEN quality ELSE toxic END * (g.grp <> 'heart' OR f.finding = 'quality')::INT)::INT AS y FROM labels, (VALUES ('lung'), ('heart')) g(grp), (VALUES ('quality'), ('toxic')) f(finding)")
def j21_validity(spark, sf_dir):
    long = table(spark, sf_dir, "labels").unpivot("doc_id", ["quality", "toxic"], "finding", "y")
    grid = spark.createDataFrame([(g, f, int(g != "heart" or f == "quality")) for g in ("lung", "heart") for f in ("quality", "toxic")], "grp string, finding string, valid int")
    return long.join(F.broadcast(grid), "finding").select("doc_id", "grp", "finding", F.coalesce(F.col("y") * F.col("valid"), F.lit(0)).alias("y"))


# --- sets, order and samples -----------------------------------------------------------


@query("""SELECT k, min(src)::INT AS src, arg_min(seq, src * 1000000000 + seq) AS seq FROM (SELECT doc_id AS k, 0 AS src, doc_id AS seq FROM labels UNION ALL SELECT item_id, 1, item_id FROM benchmark) GROUP BY k""")
def u1_ordered_union(spark, sf_dir):
    a = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("k"), F.col("doc_id").alias("seq"))
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("k"), F.col("item_id").alias("seq"))
    return T.ordered_union(a, b, "k", "seq")


@query("SELECT doc_id FROM labels INTERSECT SELECT item_id FROM benchmark")
def u2_intersect(spark, sf_dir):
    return table(spark, sf_dir, "labels").select("doc_id").intersect(table(spark, sf_dir, "benchmark").select("item_id"))


@query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def u3_except(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").subtract(table(spark, sf_dir, "labels").select("doc_id"))


@query("SELECT (SELECT count(*) FROM (SELECT doc_id FROM labels INTERSECT SELECT item_id FROM benchmark)) = 0 AS disjoint, count(*) AS covered FROM (SELECT doc_id FROM labels UNION SELECT item_id FROM benchmark)")
def u4_disjoint_and_cover(spark, sf_dir):
    a, b = table(spark, sf_dir, "labels").select("doc_id"), table(spark, sf_dir, "benchmark").select("item_id")
    both = a.distinct().withColumn("s", F.lit(1)).union(b.distinct().withColumn("s", F.lit(2))).groupBy("doc_id").agg(F.sum("s").alias("s"))
    return both.agg((F.count_if(F.col("s") == 3) == 0).alias("disjoint"), F.count("*").alias("covered"))


@query("SELECT o_custkey AS id FROM orders UNION SELECT c_custkey FROM customer")
def u5_u9_union(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id")).union(table(spark, sf_dir, "customer").select("c_custkey")).distinct()


@query("SELECT n_nationkey AS leaf, n_name AS name FROM nation WHERE n_regionkey IN (0, 2)")
def u6_alias_closure(spark, sf_dir):
    """A name that stands for two regions, each of which stands for its nations."""
    n = table(spark, sf_dir, "nation")
    edges = n.select(F.concat(F.lit("region "), F.col("n_regionkey")).alias("alias"), F.col("n_nationkey").cast("string").alias("member"))
    top = spark.createDataFrame([("all", "region 0"), ("all", "region 2")], "alias string, member string")
    # A circle runs into the engine's limit of recursion, which is an error.
    leaves = spark.sql(
        """WITH RECURSIVE reach(name) AS (SELECT 'all' UNION ALL SELECT e.member FROM reach r JOIN {edges} e ON e.alias = r.name)
        SELECT DISTINCT name FROM reach WHERE name NOT IN (SELECT alias FROM {edges})""",
        edges=edges.unionByName(top),
    )
    return leaves.select(F.col("name").try_cast("long").alias("n_nationkey")).join(n, "n_nationkey").select(F.col("n_nationkey").alias("leaf"), F.col("n_name").alias("name"))


@query("SELECT user_id, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def u7_last_wins(spark, sf_dir):
    return T.last_wins(table(spark, sf_dir, "events").select("user_id", "event_id", "value"), "user_id", "event_id")


@query("SELECT d.doc_id, coalesce(l.toxic, d.n_chars) AS n_chars FROM documents d LEFT JOIN labels l USING (doc_id)")
def u8_patched(spark, sf_dir):
    base = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    patch = table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").cast("long").alias("n_chars"))
    return T.patched(base, patch, "doc_id", ["n_chars"])


@query("SELECT doc_id, r AS row FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS r FROM labels) WHERE r % 3 = 1")
def t8_t10_shard(spark, sf_dir):
    return T.shard(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", 3, 1)


@query("""WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS row, count(*) OVER () // 24 AS steps FROM labels),
e AS (SELECT *, unnest([0, 1]) AS epoch FROM r), s AS (SELECT *, epoch * steps + row // 24 + 1 AS step FROM e WHERE row < steps * 24)
SELECT doc_id, row, epoch::INT AS epoch, step, (row % 24 // 8)::INT AS rank, (row % 8)::INT AS slot FROM s WHERE step BETWEEN steps - 1 AND steps + 2""")
def t10_batches(spark, sf_dir):
    """Three ranks of eight rows, from the last two steps of the first epoch to the second of the next."""
    rows = table(spark, sf_dir, "labels").select("doc_id")
    n = rows.count()
    steps = T.steps_of_epoch(n, 3, 8)
    return T.batches(T.numbered_rows(rows, "doc_id"), n, 3, 8, max(1, steps - 1), steps + 2)


OPEN = "list_transform(sums, lambda s, j: CASE WHEN taken[j] < 4 THEN s ELSE 1000000000000000 END)"


@query(f"""WITH RECURSIVE k AS (SELECT doc_id, n_chars AS len, doc_id % 4 <> 0 AS one, ('0x' || substr(md5(doc_id || ':5'), 1, 12))::BIGINT AS h FROM documents),
a AS (SELECT *, row_number() OVER (PARTITION BY one ORDER BY h, doc_id) - 1 AS seq FROM k),
n AS (SELECT one, (count(*) + 15) // 16 - 1 AS last FROM k GROUP BY one),
m AS (SELECT one, unnest(range(last)) AS part FROM n),
s AS (SELECT one, part, row_number() OVER (ORDER BY ('0x' || substr(md5(one::INT || ':' || part || ':5'), 1, 12))::BIGINT, part * 2 + one::INT) - 1 AS run FROM m),
u AS (SELECT a.doc_id, a.len, a.seq, run FROM a JOIN s ON a.one = s.one AND seq // 16 = part),
o AS (SELECT doc_id, run, len, row_number() OVER (PARTITION BY run ORDER BY len DESC, seq) AS i FROM u),
g AS (SELECT run, 0::BIGINT AS i, [0, 0, 0, 0]::BIGINT[] AS sums, [0, 0, 0, 0]::BIGINT[] AS taken, NULL::BIGINT AS doc_id, NULL::BIGINT AS best FROM s
UNION ALL SELECT run, i, list_transform(sums, lambda x, j: x + CASE WHEN j = best THEN len ELSE 0 END), list_transform(taken, lambda x, j: x + CASE WHEN j = best THEN 1 ELSE 0 END), doc_id, best
FROM (SELECT g.run, o.i, o.doc_id, len, sums, taken, list_position({OPEN}, list_min({OPEN})) AS best FROM g JOIN o ON g.run = o.run AND o.i = g.i + 1)),
z AS (SELECT doc_id, run, best - 1 AS rank, taken[best] - 1 AS slot FROM g WHERE i > 0),
e AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, (SELECT sum(last)::BIGINT FROM n) AS run FROM a JOIN n USING (one) WHERE seq // 16 = last)
SELECT doc_id, run, rank::INT AS rank, slot::INT AS slot, run * 16 + rank * 4 + slot AS place FROM z
UNION ALL SELECT doc_id, run, (i % 4)::INT, (i // 4)::INT, run * 16 + i FROM e""")
def t11_length_groups(spark, sf_dir):
    """Four ranks of four rows; a quarter of the documents is the second modality."""
    length = F.when(F.col("doc_id") % 4 == 0, -F.col("n_chars")).otherwise(F.col("n_chars"))
    return T.length_grouped_ranks(table(spark, sf_dir, "documents").select("doc_id", length.alias("length")), "doc_id", "length", 4, 4, 5).drop("length")


@query("SELECT doc_id, row_number() OVER (ORDER BY md5(doc_id || ':2026'), doc_id) <= 50 AS held FROM documents")
def t9_holdout(spark, sf_dir):
    return T.hash_holdout(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 50, 2026)


@query("SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders ORDER BY o_orderpriority, o_totalprice DESC, o_orderkey LIMIT 50")
def t12_t13_sorted_limit(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return rows.orderBy("o_orderpriority", F.desc("o_totalprice"), "o_orderkey").limit(50)


@query("""SELECT source, doc_id, rank::INT AS rank FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY coalesce(toxic, 0) = 0, sha1(source || ':' || doc_id)) AS rank FROM documents LEFT JOIN labels USING (doc_id)) WHERE rank <= 10""")
def w4_w5_stratified(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id", "left")
    key = F.concat_ws(":", "source", F.col("doc_id").cast("string"))
    return T.stratified_first(d, "source", F.coalesce("toxic", F.lit(0)) == 0, key, 10).select("source", "doc_id", "rank")


@query("""WITH c AS (SELECT min(doc_id) AS doc_id, count(*) AS duplicate_count FROM documents GROUP BY lang, source, lower(trim(text)))
SELECT doc_id, duplicate_count, row_number() OVER (ORDER BY doc_id) - 1 AS row FROM c""")
def a24_collapse(spark, sf_dir):
    """Rows of one language, source and text as one, numbered by the first of them."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.md5(F.lower(F.trim("text"))).alias("key"))
    one = T.collapse(rows, [F.col("lang"), F.col("source"), F.col("key")], "doc_id").select("doc_id", "duplicate_count")
    return T.numbered_rows(one, "doc_id")


@query("""SELECT source, count(*) AS rows_requested, count(l.doc_id) AS rows_matched, count_if(l.doc_id IS NULL)::BIGINT AS rows_missing, count(DISTINCT d.doc_id) AS pairs_requested, count(DISTINCT l.doc_id) AS pairs_matched FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY source""")
def a23_coverage(spark, sf_dir):
    return T.coverage(table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels"), ["doc_id"], "source")


# --- texts -----------------------------------------------------------------------------


@query("""WITH d AS (SELECT doc_id, regexp_replace(regexp_replace(text, '\\s+', ' ', 'g'), '^ +| +$', '', 'g') AS t FROM documents)
SELECT doc_id, trim(lower(t), ' .;:,') AS finding, rtrim(t, ' .') AS plain, substr(sha1(lower(rtrim(t, ' .'))), 1, 16) AS hash, 'Region: left lung. Finding: ' || rtrim(t, ' .') || '.' AS target FROM d""")
def f1_f4_finding_texts(spark, sf_dir):
    t = F.col("text")
    target = S.target_text(F.lit("left_lung"), t)
    return table(spark, sf_dir, "documents").select("doc_id", S.finding_text(t).alias("finding"), S.plain_text(t).alias("plain"), S.text_hash(t).alias("hash"), target.alias("target"))


_PAIRS = """CASE event_id % 4 WHEN 0 THEN '  ' || event_type || ' ' WHEN 1 THEN ' ' END AS raw,
CASE event_id % 4 WHEN 1 THEN 'mass ' || event_id END AS finding,
CASE event_id % 4 WHEN 2 THEN 'Region: x. Finding: seen ' || event_id || '. Finding: again' WHEN 3 THEN ' No  finding. ' ELSE '' END AS t"""


@query(f"""WITH e AS (SELECT event_id, {_PAIRS} FROM events),
f AS (SELECT event_id, CASE WHEN trim(raw) <> '' THEN trim(raw) WHEN trim(finding) <> '' THEN trim(finding) WHEN instr(trim(t), 'Finding:') > 0 THEN substr(trim(t), instr(trim(t), 'Finding:') + 8) ELSE trim(t) END AS finding FROM e)
SELECT event_id, finding, trim(lower(regexp_replace(trim(finding), '\\s+', ' ', 'g')), ' .;:,') IN ('no finding', 'no findings') AS normal, finding LIKE 'click%' AS yes FROM f""")
def f5_f6_f9_findings(spark, sf_dir):
    """A finding from the first filled of two columns, or the text after its first mark."""
    e = table(spark, sf_dir, "events").selectExpr("event_id", *_PAIRS.split(",\n"))
    f = e.select("event_id", S.pair_finding(F.col("raw"), F.col("finding"), F.lit(None).cast("string"), F.col("t")).alias("finding"))
    yes = F.concat(F.lit(" \t"), F.replace(F.col("finding"), F.lit("click"), F.lit("Yes, click")))
    return f.select("event_id", "finding", S.is_normal(F.col("finding")).alias("normal"), S.says_yes(yes).alias("yes"))


@query("""SELECT conv_id, turn, len(regexp_extract_all(upper(text), '\\b([ABC])\\b', 1))::INT AS letters FROM conversations""")
def f7_option_letters(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(S.option_letters(F.regexp_replace("text", r"[^\x00-\x7F]", "_"))).alias("letters"))


@query("""SELECT doc_id, concat_ws(' ', lang, CASE WHEN toxic IS NOT NULL THEN 'label ' || toxic END, source) AS report FROM documents LEFT JOIN labels USING (doc_id)""")
def f8_sections(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    label = F.when(F.col("toxic").isNull(), " NaN ").otherwise(F.concat(F.lit(" label "), F.col("toxic").cast("string")))
    return d.select("doc_id", S.joined_sections(F.col("lang"), label, F.lit(""), F.col("source")).alias("report"))


@query("""SELECT doc_id, array_to_string(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')[1:300], ' ') AS head FROM documents""")
def f10_first_words(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", S.first_words(F.col("text")).alias("head"))


@query("SELECT item_id, trim(text) AS reply FROM benchmark")
def f11_reply_cleanup(spark, sf_dir):
    raw = F.concat(F.lit("<s> USER: ask [INST] x [/INST] "), F.col("text"), F.lit(" </s><unk>"))
    return table(spark, sf_dir, "benchmark").select("item_id", F.trim(S.cleaned_reply(raw, ["[/INST]"], ["</s>", "<unk>"])).alias("reply"))


_JUDGED = """CASE p_size % 5 WHEN 0 THEN '(a) False report: ' || n || '. x' || chr(10) || '(2) Missing: ' || m || '. y'
WHEN 1 THEN 'No errors. (a) x: 4. y' WHEN 2 THEN '(1) False: ' || n || '. x' || chr(10) || '(2) Third: ' || m || '. y'
WHEN 3 THEN '(b) Later: ' || n || '. x' || chr(10) || '(b) Again: ' || m || '. y' || chr(10) || '(a) First: 1. z' ELSE '(c) none' || chr(10) || '(a) x: ' || n || '; ' || m || '. w' END"""


@query(f"""WITH q AS (SELECT p_partkey, p_size, p_size % 7 AS n, p_size % 3 AS m, p_size % 4 AS k FROM part), s AS (SELECT *, {_JUDGED} AS s FROM q),
l AS (SELECT *, list_sort(regexp_extract_all(s, '\\([a-f]\\) [^\\n]*')) AS a, list_sort(regexp_extract_all(s, '\\([1-6]\\) [^\\n]*')) AS b FROM s),
u AS (SELECT *, CASE WHEN s LIKE 'No%' THEN [] WHEN len(a) > 0 THEN a ELSE b END AS u FROM l),
c AS (SELECT *, list_filter(list_transform(list_filter(u, lambda x: x[1:4] IN ('(a) ', '(1) ')), lambda x: regexp_extract(x, ': (\\d+)\\.', 1)), lambda x: x <> '') AS ca,
list_filter(list_transform(list_filter(u, lambda x: x[1:4] IN ('(b) ', '(2) ')), lambda x: regexp_extract(x, ': (\\d+)\\.', 1)), lambda x: x <> '') AS cb FROM u),
n AS (SELECT p_partkey, k, coalesce(ca[-1]::INT, 0) AS n_a, coalesce(cb[-1]::INT, 0) AS n_b FROM c)
SELECT p_partkey, n_a, n_b, CASE WHEN k = 0 THEN 0 ELSE k / (k + n_a + n_b) END AS green, 'one|two' AS said FROM n""")
def f12_f14_judgements(spark, sf_dir):
    """Categories by letter, by number, mixed, repeated, and a section that begins with No."""
    q = table(spark, sf_dir, "part").selectExpr("p_partkey", "p_size", "p_size % 7 AS n", "p_size % 3 AS m", "p_size % 4 AS k")
    body = F.expr(_JUDGED)
    text = F.concat(F.lit("[Clinically Significant Errors]:\n"), body, F.lit("\n\n[Matched Findings]: "), F.col("k"), F.lit(". one; two;"))
    # Columns of their own, as each is named more than once below and would be computed as often.
    told = q.select("p_partkey", text.alias("text"))
    told = told.select("p_partkey", S.judged_section(F.col("text"), "Clinically Significant Errors").alias("section"), S.judged_section(F.col("text"), "Matched Findings").alias("found"))
    told = told.select("p_partkey", "found", S.judged_lines(F.col("section")).alias("lines"))
    told = told.select("p_partkey", "found", S.counted(F.col("lines"), "a").alias("n_a"), S.counted(F.col("lines"), "b").alias("n_b"), S.judged_matches(F.col("found")).alias("matched"))
    said = F.array_join(S.judged_sentences(F.col("found"), matched=True), "|")
    return told.select("p_partkey", "n_a", "n_b", S.green_score(F.col("matched"), [F.col("n_a"), F.col("n_b")]).alias("green"), said.alias("said"))


@query("SELECT event_id, (json_extract_string(props, '$.k'))::DOUBLE AS k, CASE WHEN event_id % 2 = 0 THEN 'green' ELSE 'fast' END AS kind FROM events")
def f15_f17_json(spark, sf_dir):
    blob = F.when(F.col("event_id") % 2 == 0, F.lit('{"green": 1}')).otherwise(F.lit('{"text": {}}'))
    return table(spark, sf_dir, "events").select("event_id", S.first_json(F.col("props"), "$.metrics.k", "$.k").alias("k"), S.source_kind(blob).alias("kind"))


_BLOB = """CASE event_id % 3 WHEN 0 THEN '{"text": {"bleu_1": ' || event_id || ', "deep": {"x": "y"}}, "n": [1, 2], "e": {}}'
WHEN 1 THEN '{"text": {"bleu_1": null}, "clinical": {"f1": 0.5, "confusion": {"TP": 3}}}' ELSE '{"clinical": {"f1": ' || event_id || '}}' END"""


@query("""SELECT event_id, unnest(CASE event_id % 3 WHEN 0 THEN [{'path': 'text.bleu_1', 'value': event_id::VARCHAR}, {'path': 'text.deep.x', 'value': 'y'}, {'path': 'n', 'value': '[1,2]'}, {'path': 'e', 'value': '{}'}]
WHEN 1 THEN [{'path': 'text.bleu_1', 'value': NULL}, {'path': 'clinical.f1', 'value': '0.5'}, {'path': 'clinical.confusion.TP', 'value': '3'}] ELSE [{'path': 'clinical.f1', 'value': event_id::VARCHAR}] END, recursive := true) FROM events""")
def f16_flat_json(spark, sf_dir):
    """Leaves of nested JSON objects with their dotted paths; an empty object is a leaf."""
    e = table(spark, sf_dir, "events").select("event_id", F.expr(_BLOB).alias("blob"))
    leaf = F.explode(S.leaf_paths(F.col("blob"))).alias("leaf")
    return e.select("event_id", leaf).select("event_id", "leaf.path", "leaf.value")


@query("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_id END::DOUBLE AS bleu_1, CASE event_id % 3 WHEN 1 THEN 0.5 WHEN 2 THEN event_id END::DOUBLE AS clinical_f1, CASE WHEN event_id % 3 = 1 THEN 3 END::DOUBLE AS clinical_tp FROM events""")
def f18_summary_values(spark, sf_dir):
    names = {"text.bleu_1": "bleu_1", "clinical.f1": "clinical_f1", "clinical.confusion.TP": "clinical_tp"}
    return table(spark, sf_dir, "events").select("event_id", *S.summary_values(F.expr(_BLOB), names))


@query("SELECT p_partkey, 'merge' AS method, (p_size * 4)::INT AS budget, p_size / 10 AS lam FROM part")
def f19_exp_ids(spark, sf_dir):
    exp = F.concat(F.lit("exp_1_merge_wide_b"), F.col("p_size") * 4, F.lit("_lam"), (F.col("p_size") / 10).cast("string"))
    x = table(spark, sf_dir, "part").select("p_partkey", exp.alias("e"))
    got = lambda p: F.regexp_extract("e", p, 1)
    return x.select("p_partkey", got(r"^exp_\d+_([a-z]+)_").alias("method"), got(r"_b(\d+)").cast("int").alias("budget"), got(r"_lam([\d.]+)").cast("double").alias("lam"))


@query("SELECT p_partkey, (p_partkey & 262143) AS code, array_to_string(list_transform(range(18), lambda i: (2 * ((p_partkey >> (17 - i)) & 1) - 1)::INT), ',') AS bits, (p_partkey & 262143) AS back FROM part")
def f20_f21_codec(spark, sf_dir):
    code = F.col("p_partkey").bitwiseAND(F.lit(262143))
    x = table(spark, sf_dir, "part").select("p_partkey", code.alias("code")).withColumn("bits", S.unpack_code(F.col("code")))
    return x.select("p_partkey", "code", F.array_join(F.col("bits").cast("array<string>"), ",").alias("bits"), S.pack_code(F.col("bits")).alias("back"))


@query("SELECT p_partkey, 2 + 0.5 * p_size::DOUBLE AS a, 1 + 0.5 * p_size::DOUBLE AS b FROM part")
def f25_learned_table(spark, sf_dir):
    delta = F.array(F.col("p_size").cast("double"), F.col("p_size").cast("double"))
    entry = S.learned_row(F.array(F.lit(1.0), F.lit(2.0)), delta, 0.5, reverse=True)
    return table(spark, sf_dir, "part").select("p_partkey", F.get(entry, 0).alias("a"), F.get(entry, 1).alias("b"))


@query("SELECT lang, ceil(count(*) / 16)::BIGINT AS steps, 2 * 28 * 4 * 128 * 2 * sum(n_chars)::BIGINT AS cache, CASE WHEN count(*) >= 3 THEN 'FIN' ELSE 'PROV' END || printf('{%.2f+-1.00}', avg(n_chars)) AS cell FROM documents GROUP BY lang")
def f23_f29_run_sizes(spark, sf_dir):
    d = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("t"), F.avg("n_chars").alias("m"))
    return d.select("lang", S.steps_per_epoch(F.col("n")).alias("steps"), S.cache_bytes(28, 4, 128, F.col("t")).alias("cache"), S.cell_text(F.col("m"), F.lit(1.0), F.col("n"), 2).alias("cell"))


@query("SELECT item_id, 'Answer. USER: <image>' || chr(10) || text || ' ASSISTANT:' AS prompt FROM benchmark")
def f30_prompts(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", S.prompt("Answer.", F.col("text")).alias("prompt"))
