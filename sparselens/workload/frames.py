"""Engine tables derived from the benchmark tables, in Spark and as SQL text."""

from pyspark.sql import functions as F

from sparselens.operators.activations import active_entries, activation_records, context_windows
from sparselens.operators.autoencoder import Autoencoder
from sparselens.functions.vectors import normalised

VOCAB_SIZE = 97          # one token id is missing from the vocabulary on purpose
UNIVERSE = 80            # units of the declared range; some never fire
LI_TOKENS = 500


def read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark, d):
    e = read(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("sample_id"),
                    ((F.col("vec_id") * 7 + F.col("label")) % VOCAB_SIZE).cast("int").alias("token_id"),
                    F.expr("vec_id div 100").cast("int").alias("chunk_id"),
                    F.col("embedding").alias("vec"))


def active(spark, d):
    return active_entries(samples(spark, d))


def activations(spark, d):
    return activation_records(active(spark, d), context_windows(samples(spark, d)))


def line_activations(spark, d):
    li = read(spark, d, "lineitem")
    return li.select(F.col("l_suppkey").cast("int").alias("feature_id"),
                     (F.col("l_partkey") % LI_TOKENS).cast("int").alias("token_id"),
                     (F.col("l_quantity") / 50).alias("activation_value"),
                     (F.col("l_orderkey") % 16).cast("int").alias("chunk_id"))


def vocab(spark):
    i = F.col("id")
    text = (F.when(i % 11 == 0, i.cast("string"))
            .when(i % 13 == 0, F.concat(F.lit("AB"), i.cast("string")))
            .when(i % 17 == 0, F.concat(F.lit("Ti"), i.cast("string")))
            .when(i % 2 == 0, F.concat(F.lit(" w"), i.cast("string")))
            .otherwise(F.concat(F.lit("w"), i.cast("string"))))
    return spark.range(VOCAB_SIZE - 1).select(i.cast("int").alias("token_id"), text.alias("token_text"))


def weights(spark, d):
    e = read(spark, d, "embeddings")
    unit = normalised(F.col("embedding"))
    return e.select(F.col("vec_id").cast("int").alias("feature_id"), unit.alias("w_enc"),
                    unit.alias("w_dec"), (F.lit(-0.05) * (F.col("vec_id") % 2)).alias("b_enc"))


def zero_bias(spark, d):
    return read(spark, d, "embeddings").agg(
        F.array_repeat(F.lit(0.0), F.max(F.size("embedding"))).alias("b_dec"))


def mean_bias(spark, d):
    dims = read(spark, d, "embeddings").select(F.posexplode("embedding").alias("i", "x"))
    means = dims.groupBy("i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return means.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))),
                                 lambda e: e["m"]).alias("b_dec"))


def model(spark, d, tied=False, bias="zero"):
    return Autoencoder(weights(spark, d), (zero_bias if bias == "zero" else mean_bias)(spark, d), tied)


def losses(spark, d):
    kind = F.col("event_type")
    split = F.when(kind == "signup", "val").when(kind == "error", "test").otherwise("train")
    return read(spark, d, "events").select(split.alias("split"), F.col("event_id").alias("step"),
                                           (F.col("value") / 1000).alias("loss"))


def replies(spark, d):
    c = read(spark, d, "conversations").where(F.col("role") == "assistant")
    name = F.when(F.col("conv_id") % 3 == 0, "POLYSEMANTIC").otherwise(
        F.concat(F.lit("topic "), (F.col("conv_id") % 7).cast("string")))
    reply = F.when(F.col("conv_id") % 5 == 4, F.col("text")).otherwise(
        F.concat("text", F.lit("\nLabel: "), name))
    return c.select("conv_id", "turn", reply.alias("reply"),
                    F.when(F.col("conv_id") % 2 == 0, "top-k").otherwise("bottom-k").alias("group"))


def chunk_files(spark, d):
    doc = F.col("doc_id")
    name = F.when(doc % 2 == 0, F.concat(F.lit("chunk_"), F.expr("doc_id div 7").cast("string"), F.lit(".pt"))) \
        .otherwise(F.concat(F.lit("Chunk_"), F.expr("doc_id div 7").cast("string"), F.lit("b.pt")))
    return read(spark, d, "documents").select(name.alias("file")).distinct()


# ---- the same tables as SQL -----------------------------------------------------------

CTE = {
    "samples": """
        SELECT vec_id AS sample_id, CAST((vec_id * 7 + label) % 97 AS INTEGER) AS token_id,
               CAST(vec_id // 100 AS INTEGER) AS chunk_id, embedding AS vec FROM embeddings""",
    "active": """
        SELECT sample_id, token_id, chunk_id, CAST(f AS INTEGER) AS feature_id,
               CAST(v AS DOUBLE) AS activation_value
        FROM (SELECT sample_id, token_id, chunk_id, unnest(range(len(vec))) AS f, unnest(vec) AS v
              FROM samples)
        WHERE CAST(v AS DOUBLE) > CAST(0.07 AS DOUBLE)""",
    "trimmed": """
        SELECT sample_id, token_id, chunk_id, feature_id, activation_value
        FROM (SELECT *, row_number() OVER (PARTITION BY sample_id
                     ORDER BY activation_value DESC, feature_id) AS rk FROM active)
        WHERE rk <= 25""",
    "placed": """
        SELECT sample_id, token_id, chunk_id,
               row_number() OVER (PARTITION BY chunk_id ORDER BY sample_id) - 1 AS p,
               count(*) OVER (PARTITION BY chunk_id) AS n FROM samples""",
    "ctx": """
        SELECT a.sample_id, list(b.token_id ORDER BY o.o) AS context_token_ids
        FROM placed a CROSS JOIN (SELECT unnest(range(-10, 11)) AS o) o
        JOIN placed b ON b.chunk_id = a.chunk_id AND b.p = greatest(0, least(a.n - 1, a.p + o.o))
        GROUP BY a.sample_id""",
    "act": """
        SELECT t.sample_id, t.feature_id, t.activation_value, t.token_id, c.context_token_ids, t.chunk_id
        FROM active t JOIN ctx c ON c.sample_id = t.sample_id""",
    "li": """
        SELECT CAST(l_suppkey AS INTEGER) AS feature_id, CAST(l_partkey % 500 AS INTEGER) AS token_id,
               l_quantity / 50 AS activation_value, CAST(l_orderkey % 16 AS INTEGER) AS chunk_id
        FROM lineitem""",
    "vocab": """
        SELECT CAST(i AS INTEGER) AS token_id,
               CASE WHEN i % 11 = 0 THEN CAST(i AS VARCHAR) WHEN i % 13 = 0 THEN 'AB' || i
                    WHEN i % 17 = 0 THEN 'Ti' || i WHEN i % 2 = 0 THEN ' w' || i ELSE 'w' || i END AS token_text
        FROM range(96) r(i)""",
    "w": """
        SELECT CAST(vec_id AS INTEGER) AS feature_id, CAST(vec_id AS DOUBLE) * 0
                 + (-0.05 * (vec_id % 2))::DOUBLE AS b_enc,
               list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS w
        FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)""",
    "mean_vec": """
        SELECT list(m ORDER BY i) AS b FROM (SELECT i, avg(CAST(x AS DOUBLE)) AS m FROM (
            SELECT unnest(range(len(embedding))) AS i, unnest(embedding) AS x FROM embeddings) GROUP BY i)""",
    "enc": """
        SELECT s.sample_id, s.token_id, s.chunk_id, w.feature_id,
               list_dot_product(CAST(s.vec AS DOUBLE[]), w.w) + w.b_enc AS activation_value
        FROM samples s, w
        WHERE list_dot_product(CAST(s.vec AS DOUBLE[]), w.w) + w.b_enc > 0""",
    "losses": """
        SELECT CASE event_type WHEN 'signup' THEN 'val' WHEN 'error' THEN 'test' ELSE 'train' END AS split,
               event_id AS step, value / 1000 AS loss FROM events""",
    "replies": r"""
        SELECT conv_id, turn, CASE WHEN conv_id % 5 = 4 THEN text ELSE text || chr(10) || 'Label: ' ||
               (CASE WHEN conv_id % 3 = 0 THEN 'POLYSEMANTIC' ELSE 'topic ' || (conv_id % 7) END) END AS reply,
               CASE WHEN conv_id % 2 = 0 THEN 'top-k' ELSE 'bottom-k' END AS "group"
        FROM conversations WHERE role = 'assistant'""",
    "tok": r"""
        SELECT doc_id, CAST(unnest(range(len(ws))) AS INTEGER) AS pos, unnest(ws) AS word FROM (
            SELECT doc_id, regexp_extract_all(text, ' ?[^ \t\n\r]+') AS ws FROM documents)""",
    "dict": """
        SELECT word AS token_text,
               row_number() OVER (ORDER BY md5(word || '|'), word) - 1 AS token_id
        FROM (SELECT DISTINCT word FROM tok)""",
    "files": """
        SELECT DISTINCT CASE WHEN doc_id % 2 = 0 THEN 'chunk_' || (doc_id // 7) || '.pt'
               ELSE 'Chunk_' || (doc_id // 7) || 'b.pt' END AS file FROM documents""",
}

NEEDS = {
    "active": ["samples"], "trimmed": ["active"], "placed": ["samples"], "ctx": ["placed"],
    "act": ["active", "ctx"], "enc": ["samples", "w"], "dict": ["tok"],
}


def sql(names, body):
    """Query text with the named tables (and what they need) in front."""
    order = []

    def add(name):
        for other in NEEDS.get(name, []):
            add(other)
        if name not in order:
            order.append(name)

    for name in names.split():
        add(name)
    parts = ", ".join(f"{n} AS MATERIALIZED ({CTE[n].strip()})" for n in order)
    return f"WITH {parts} {body.strip()}" if parts else body.strip()
