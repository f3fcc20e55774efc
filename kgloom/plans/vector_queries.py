"""Queries over vectors, embeddings and texts."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgloom.functions.vectors import doubles, mean_pool, residues, sigmoid
from kgloom.operators import affinity, affinity_net, embed, encode, kge, similarity
from kgloom.sources.readers import combine_pages, fasta_columns
from kgloom.storage import table

KGE_DIM = 8


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")


def cosine_knn(spark, d):
    """The three nearest others of every vector."""
    out = similarity.cosine_knn(_vectors(spark, d), 3)
    return out.select("i", "j", F.round("cos", 6).alias("cos"), "rank")


def cosine_pairs_quantile(spark, d):
    """Pairs of all vectors above the exact 0.99 quantile of all their cosines."""
    return similarity.cosine_above_quantile(_vectors(spark, d), 0.99).select("i", "j", F.round("cos", 8).alias("cos"))


def pair_mse(spark, d):
    """Measures of each vector and its successor."""
    v = _vectors(spark, d)
    pairs = v.select(F.col("id").alias("i"), (F.col("id") + 1).alias("j"))
    return similarity.pair_measures(pairs, v).select("i", "j", F.round("cos_sim", 8).alias("cos_sim"), F.round("mse", 8).alias("mse"))


def gram_matrix(spark, d):
    return similarity.gram(_vectors(spark, d)).select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.round("s", 5).alias("s"))


def _sides(spark, d):
    """Every vector as a head and as a tail, and one as the relation: halves of the first sixteen numbers are re and im."""
    v = _vectors(spark, d).select("id", doubles("embedding").alias("e"))
    nodes = v.select("id", F.slice("e", 1, KGE_DIM).alias("re"), F.slice("e", KGE_DIM + 1, KGE_DIM).alias("im"))
    return nodes, nodes, nodes.where("id = 100").drop("id")


def _query_scores(spark, d):
    """Scores of the query set, heads whose id is divisible by 50, against all tails."""
    heads, tails, rel = _sides(spark, d)
    return kge.score_grid(heads.where("id % 50 = 0"), tails, rel)


def trilinear_score(spark, d):
    return _query_scores(spark, d).select("head", "tail", F.round("score", 8).alias("score"))


def partition_function(spark, d):
    """The sum over all pairs of all vectors."""
    return kge.partition_function(*_sides(spark, d)).select(F.round("z", 4).alias("z"))


def log_prob(spark, d):
    """Log-probabilities among all pairs, of the query set's pairs."""
    sides = _sides(spark, d)
    n = sides[0].count()
    out = kge.log_prob(_query_scores(spark, d), kge.partition_function(*sides), n, n)
    return out.select("head", "tail", F.round("log_prob", 6).alias("log_prob"))


TOP_TAILS = 10


def trilinear_score_all(spark, d):
    """Of all tails the best ones of every head."""
    return kge.top_tails(*_sides(spark, d), TOP_TAILS).select("head", "tail", F.round("score", 8).alias("score"), "rank")


def log_prob_all(spark, d):
    """Log-probabilities among all pairs, of the best tails of every head."""
    sides = _sides(spark, d)
    n = sides[0].count()
    out = kge.log_prob(kge.top_tails(*sides, TOP_TAILS), kge.partition_function(*sides), n, n)
    return out.select("head", "tail", F.round("log_prob", 6).alias("log_prob"), "rank")


def hashed_embedding(spark, d):
    out = embed.hashed_embedding(table(spark, d, "benchmark"), "item_id", "text")
    cells = out.select(F.col("id").alias("item_id"), F.posexplode(doubles("embedding")).alias("k", "x"))
    return cells.where("x <> 0").select("item_id", F.col("k").cast("long").alias("k"), F.round("x", 5).alias("x"))


def encoded_texts(spark, d):
    """Every whole text in chunks of 512 tokens that share 64, encoded in batches of like length and pooled."""
    out, _ = encode.encode(table(spark, d, "documents"), "doc_id", "text", encode.wave_encoder(4), 4)
    return out.select(F.col("id").alias("doc_id"), F.posexplode("embedding").alias("k", "x")).select("doc_id", F.col("k").cast("long").alias("k"), F.round("x", 8).alias("x"))


def padding_share(spark, d):
    """One row: what padding takes of the batches of all texts, by length and in the order that they come."""
    whole = lambda by: encode.encode(table(spark, d, "documents"), "doc_id", "text", encode.wave_encoder(4), 4, by_length=by)[1]
    return whole(True).select("chunks", "used", F.round("padding", 4).alias("padding")).crossJoin(whole(False).select(F.round("padding", 4).alias("padding_unsorted")))


def _affinity_rows(spark, d):
    v = _vectors(spark, d)
    pairs = v.select(F.col("id").alias("drug"), ((F.col("id") * 7 + 3) % 500).alias("protein"), F.col("label").cast("double").alias("affinity"))
    return affinity.features(pairs, v, v)


def affinity_features(spark, d):
    """The numbers that the regression sees of each pair."""
    cells = _affinity_rows(spark, d).select("drug", "protein", F.posexplode(vector_to_array("features")).alias("k", "x"))
    return cells.select("drug", "protein", F.col("k").cast("long").alias("k"), F.round("x", 8).alias("x"))


def affinity_regress(spark, d):
    """Regression of a label on pairs of vectors: measures on held-out pairs."""
    rows = _affinity_rows(spark, d)
    model = affinity.fit(rows.where("drug % 10 < 9"))
    return affinity.evaluate(model, rows.where("drug % 10 = 9"))


def affinity_uncertainty(spark, d):
    """drug, protein, mean, lcb, ucb: predictions of held-out pairs by networks of eight replicas."""
    rows = _affinity_rows(spark, d).withColumn("features", vector_to_array("features"))
    net = affinity_net.fit(rows.where("drug % 10 < 9"), ("drug", "protein"), rounds=3)
    return affinity_net.predict(net, rows.where("drug % 10 = 9"), ("drug", "protein"))


def mean_pooling(spark, d):
    """Masked mean of the four sixteen-number pieces of each vector, the first always and others where the id says so."""
    v = _vectors(spark, d).select("id", doubles("embedding").alias("e"))
    tokens = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.slice("e", k * 16 + 1, 16))
    mask = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: ((k == 0) | (F.col("id") % (k + 1) == 0)).cast("int"))
    out = v.select("id", mean_pool(tokens, mask, 16).alias("p"))
    return out.select("id", F.posexplode("p").alias("k", "x")).select("id", F.col("k").cast("long").alias("k"), F.round("x", 8).alias("x"))


def sigmoid_scores(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.round(sigmoid(F.col("c_acctbal") / 1000), 8).alias("p"))


def fasta_like_parse(spark, d):
    """Documents written as FASTA records and parsed back."""
    records = table(spark, d, "documents").select(
        F.concat(F.lit("sp|"), F.col("doc_id").cast("string"), F.lit(" some text OS="), "source", F.lit(" OX=1"), F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit(" GN="), "lang")).otherwise(""), F.lit("\n"), F.col("text"), F.lit("\n")).alias("value")
    )
    return records.select(*fasta_columns(F.col("value"))).select("id", "organism", "gene_name", F.md5("sequence").alias("sequence"))


def matrix_to_coo(spark, d):
    """Non-zero cells of rows of numbers as text."""
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("row"), F.concat_ws(" ", (F.col("o_orderkey") % 3).cast("string"), (F.col("o_custkey") % 4).cast("string"), (F.col("o_orderkey") % 2).cast("string")).alias("line"))
    cells = rows.select("row", F.posexplode(F.split("line", r"\s+")).alias("col", "value"))
    return cells.select("row", F.col("col").cast("long").alias("col"), F.col("value").cast("double").alias("value")).where("value <> 0")


def log_regex_collect(spark, d):
    """Relation names that the turns of each conversation mention, by pattern."""
    rows = table(spark, d, "events").select("user_id", "event_type", F.regexp_extract("props", r'"k":\s*(\d)', 1).alias("k"))
    out = rows.where("k <> ''").groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set(F.concat_ws("-", "event_type", "k"))), ",").alias("relations"))
    return out


def residue_normalise(spark, d):
    return table(spark, d, "part").select("p_partkey", residues(F.col("p_name")).alias("residues"))


def paged_lookup(spark, d):
    """Answers in pages, each with its own header, put together."""
    rows = table(spark, d, "nation").select(F.col("n_regionkey").alias("page"), F.concat_ws("\t", F.col("n_nationkey").cast("string"), "n_name").alias("line"))
    pages = rows.groupBy("page").agg(F.concat(F.lit("From\tTo\n"), F.array_join(F.sort_array(F.collect_list("line")), "\n")).alias("body"))
    return combine_pages(pages)


_DOT = "list_sum(list_transform(range(1, 65), lambda k: a.e[k] * b.e[k]))"
_E = "SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings"
_COS = f"{_DOT} / (sqrt(list_sum(list_transform(a.e, lambda x: x * x))) * sqrt(list_sum(list_transform(b.e, lambda x: x * x))))"
_PHI = f"""
    WITH v AS MATERIALIZED ({_E}), r AS (SELECT e FROM v WHERE id = 100),
    s AS MATERIALIZED (SELECT a.id AS head, b.id AS tail, list_sum(list_transform(range(1, {KGE_DIM + 1}), lambda k:
        a.e[k] * r.e[k] * b.e[k] + a.e[k + {KGE_DIM}] * r.e[k] * b.e[k + {KGE_DIM}] + a.e[k] * r.e[k + {KGE_DIM}] * b.e[k + {KGE_DIM}] - a.e[k + {KGE_DIM}] * r.e[k + {KGE_DIM}] * b.e[k])) ** 2 AS score
        FROM v a, v b, r), z AS MATERIALIZED (SELECT sum(score) AS z, count(*) AS n FROM s)
"""

QUERIES = {
    f.__name__: f
    for f in (
        cosine_knn, cosine_pairs_quantile, pair_mse, gram_matrix, trilinear_score, partition_function, log_prob, hashed_embedding, encoded_texts, padding_share, affinity_uncertainty, affinity_regress, affinity_features, mean_pooling, sigmoid_scores,
        fasta_like_parse, matrix_to_coo, log_regex_collect, residue_normalise, paged_lookup, trilinear_score_all, log_prob_all,
    )
}
#: Names under which the same queries were registered before.
QUERIES |= {f"{k}_all": QUERIES[k] for k in ("cosine_pairs_quantile", "partition_function")}

ORACLE_SQL = {
    "encoded_texts": """
        WITH t AS (SELECT doc_id, CASE WHEN trim(coalesce(text, '')) = '' THEN 'X' ELSE trim(text) END AS t FROM documents),
        c AS (SELECT doc_id, unnest([substr(t, b + 1, 512) FOR b IN range(0, greatest(1, length(t) - 64), 448)]) AS s, unnest(range(0, greatest(1, length(t) - 64), 448)) AS b FROM t),
        u AS (SELECT doc_id, b, unnest(string_split(s, '')) AS s FROM c),
        m AS (SELECT doc_id, b, k, avg(sin(unicode(s) * ((k + 1) / 7.0::DOUBLE))) AS x, count(*) - max(CASE WHEN b > 0 THEN 64 ELSE 0 END) AS w FROM u, (SELECT unnest(range(4)) AS k) GROUP BY doc_id, b, k)
        SELECT doc_id, k, round(sum(x * w) / sum(w), 8) AS x FROM m GROUP BY doc_id, k""",
    "cosine_knn": f"WITH v AS ({_E}), c AS (SELECT a.id AS i, b.id AS j, {_COS} AS cos FROM v a JOIN v b ON a.id <> b.id) SELECT i, j, round(cos, 6) AS cos, row_number() OVER (PARTITION BY i ORDER BY round(cos, 12) DESC, j) AS rank FROM c QUALIFY rank <= 3",
    "cosine_pairs_quantile": f"WITH v AS ({_E}), c AS (SELECT a.id AS i, b.id AS j, {_COS} AS cos FROM v a JOIN v b ON a.id < b.id) SELECT i, j, round(cos, 8) AS cos FROM c WHERE cos > (SELECT quantile_cont(cos, 0.99) FROM c)",
    "pair_mse": f"WITH v AS ({_E}) SELECT a.id AS i, b.id AS j, round({_COS}, 8) AS cos_sim, round(list_sum(list_transform(range(1, 65), lambda k: (a.e[k] - b.e[k]) ** 2)) / 64, 8) AS mse FROM v a JOIN v b ON b.id = a.id + 1",
    "gram_matrix": f"WITH v AS ({_E}), x AS (SELECT id, unnest(e) AS x, unnest(range(64)) AS k FROM v) SELECT a.k AS i, b.k AS j, round(sum(a.x * b.x), 5) AS s FROM x a JOIN x b USING (id) GROUP BY a.k, b.k",
    "trilinear_score": f"{_PHI} SELECT head, tail, round(score, 8) AS score FROM s WHERE head % 50 = 0",
    "partition_function": f"{_PHI} SELECT round(z, 4) AS z FROM z",
    # the sum over all pairs from the Gram matrix of all vectors, so that only the query set's pairs are made
    "log_prob": f"""
        WITH v AS MATERIALIZED ({_E}), r AS (SELECT e FROM v WHERE id = 100), n AS (SELECT count(*) AS n FROM v), k AS (SELECT unnest(range({KGE_DIM})) AS k),
        x AS (SELECT id, unnest(range({2 * KGE_DIM})) AS k, unnest(e[1:{2 * KGE_DIM}]) AS x FROM v), g AS MATERIALIZED (SELECT a.k AS i, b.k AS j, sum(a.x * b.x) AS s FROM x a JOIN x b USING (id) GROUP BY ALL),
        m AS (SELECT k AS i, k AS k, e[k + 1] AS m FROM r, k UNION ALL SELECT k + {KGE_DIM}, k + {KGE_DIM}, e[k + 1] FROM r, k
            UNION ALL SELECT k, k + {KGE_DIM}, e[k + {KGE_DIM + 1}] FROM r, k UNION ALL SELECT k + {KGE_DIM}, k, -e[k + {KGE_DIM + 1}] FROM r, k),
        z AS (SELECT sum(a.s * p.m * b.s * q.m) AS z FROM g a JOIN m p ON p.i = a.i JOIN m q ON q.i = a.j JOIN g b ON b.i = p.k AND b.j = q.k),
        s AS (SELECT a.id AS head, b.id AS tail, list_sum(list_transform(range(1, {KGE_DIM + 1}), lambda k:
            a.e[k] * r.e[k] * b.e[k] + a.e[k + {KGE_DIM}] * r.e[k] * b.e[k + {KGE_DIM}] + a.e[k] * r.e[k + {KGE_DIM}] * b.e[k + {KGE_DIM}] - a.e[k + {KGE_DIM}] * r.e[k + {KGE_DIM}] * b.e[k])) ** 2 AS score
            FROM v a, v b, r WHERE a.id % 50 = 0)
        SELECT head, tail, round(ln(score + 1.0::DOUBLE / (n * n)) - ln(1 + z), 6) AS log_prob FROM s, z, n""",
    "trilinear_score_all": f"{_PHI} SELECT head, tail, round(score, 8) AS score, row_number() OVER (PARTITION BY head ORDER BY round(score, 12) DESC, tail) AS rank FROM s QUALIFY rank <= {TOP_TAILS}",
    "log_prob_all": f"{_PHI} SELECT head, tail, round(ln(score + 1.0::DOUBLE / n) - ln(1 + z), 6) AS log_prob, row_number() OVER (PARTITION BY head ORDER BY round(score, 12) DESC, tail) AS rank FROM s, z QUALIFY rank <= {TOP_TAILS}",
    "hashed_embedding": """
        WITH t AS (SELECT item_id, CASE WHEN trim(coalesce(text, '')) = '' THEN 'X' ELSE trim(text) END AS t FROM benchmark),
        g AS (SELECT item_id, unnest([substr(t, i, 3) FOR i IN range(1, greatest(1, length(t) - 2) + 1)]) AS g FROM t),
        h AS (SELECT item_id, CAST('0x' || substr(md5(g), 1, 8) AS BIGINT) % 64 AS k, 1 - 2 * (CAST('0x' || substr(md5(g), 9, 1) AS BIGINT) % 2) AS x FROM g),
        s AS (SELECT item_id, k, sum(x)::DOUBLE AS x FROM h GROUP BY ALL), n AS (SELECT item_id, sqrt(sum(x * x)) AS size FROM s GROUP BY item_id)
        SELECT item_id, k, round(x / size, 5) AS x FROM s JOIN n USING (item_id) WHERE x <> 0""",
    "affinity_features": f"""
        WITH v AS ({_E}), p AS (SELECT id AS drug, (id * 7 + 3) % 500 AS protein FROM v), f AS (SELECT drug, protein, list_concat(a.e, b.e) AS f FROM p JOIN v a ON a.id = drug JOIN v b ON b.id = protein)
        SELECT drug, protein, k, round(f[k + 1], 8) AS x FROM f, (SELECT unnest(range(128)) AS k)""",
    "mean_pooling": f"""
        WITH v AS ({_E}), t AS (SELECT id, e, [m FOR m IN [0, 1, 2, 3] IF m = 0 OR id % (m + 1) = 0] AS ms FROM v)
        SELECT id, k, round(list_sum(list_transform(ms, lambda m: e[m * 16 + k + 1])) / len(ms), 8) AS x FROM t, (SELECT unnest(range(16)) AS k)""",
    "sigmoid_scores": "SELECT c_custkey, round(1 / (1 + exp(-c_acctbal / 1000)), 8) AS p FROM customer",
    "fasta_like_parse": "SELECT 'sp|' || doc_id AS id, source AS organism, CASE WHEN doc_id % 3 > 0 THEN lang END AS gene_name, md5(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]', '', 'g')) AS sequence FROM documents",
    "matrix_to_coo": "SELECT row, col, value FROM (SELECT o_orderkey AS row, unnest([0, 1, 2])::BIGINT AS col, unnest([o_orderkey % 3, o_custkey % 4, o_orderkey % 2])::DOUBLE AS value FROM orders) WHERE value <> 0",
    "log_regex_collect": "SELECT user_id, string_agg(DISTINCT r, ',' ORDER BY r) AS relations FROM (SELECT user_id, event_type || '-' || regexp_extract(props, '\"k\":\\s*(\\d)', 1) AS r FROM events WHERE regexp_matches(props, '\"k\":\\s*\\d')) GROUP BY user_id",
    "residue_normalise": "SELECT p_partkey, array_to_string(string_split(CASE WHEN trim(p_name) = '' THEN 'X' ELSE regexp_replace(upper(trim(p_name)), '[UZOB]', 'X', 'g') END, ''), ' ') AS residues FROM part",
    "paged_lookup": "SELECT CAST(n_nationkey AS VARCHAR) AS \"from\", n_name AS \"to\" FROM nation",
}
ORACLE_SQL |= {f"{k}_all": ORACLE_SQL[k] for k in ("cosine_pairs_quantile", "partition_function")}
