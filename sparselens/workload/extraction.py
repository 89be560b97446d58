"""Queries on sources, tokens, vectors, the autoencoder, resampling, splits and streams."""

import uuid

from pyspark.sql import functions as F

from sparselens.functions import text as X
from sparselens.functions import vectors as V
from sparselens.operators import activations as ac
from sparselens.operators import autoencoder as ae
from sparselens.operators import resample as rs
from sparselens.operators import splits as sp
from sparselens.operators import tokens as tk
from sparselens.plans.ordered import dense_index
from sparselens.session import shared_dir, staged
from sparselens.sources import catalog as cat
from sparselens.sources import commits as cm
from sparselens.streaming import incremental as inc
from sparselens.workload import frames as fr
from sparselens.workload.registry import joined, register, rounded

EVERY = 4                # step window of the resampling queries
LAMBDA = 0.01


def R(expr, digits=6):
    """Rounding for comparison, as in ``rounded``.

    Six digits for measured numbers. Means of short decimals can end exactly on a half at the
    seventh digit, where the order of a sum decides; those are compared with ten digits.
    """
    return f"(round({expr}, {digits}) + 0.0)"


def fresh(spark, what):
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


# ---- sources and sinks ----------------------------------------------------------------

@register("S1_create_features_table", "", f"""
    SELECT l_suppkey, count(*) AS n, {R('sum(l_quantity)')} AS total FROM lineitem GROUP BY l_suppkey""")
def create_table(spark, d):
    name = f"features_{uuid.uuid4().hex}"
    table = cat.create_features_table(spark, name, f"{d}/lineitem.parquet", fresh(spark, "table"))
    return rounded(table.groupBy("l_suppkey").agg(
        F.count("*").alias("n"), F.sum("l_quantity").alias("total")), "total")


@register("S2_lazy_view", "", "SELECT lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY lang")
def lazy_view(spark, d):
    view = cat.lazy_features_view(spark, f"docs_{uuid.uuid4().hex}", f"{d}/documents.parquet")
    return view.groupBy("lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@register("S3_table_exists", "", "SELECT count(*) AS n, true AS found, false AS other FROM events")
def exists(spark, d):
    name = f"events_{uuid.uuid4().hex}"
    cat.lazy_features_view(spark, name, f"{d}/events.parquet")
    return spark.table(name).agg(F.count("*").alias("n")).select(
        "n", F.lit(cat.table_exists(spark, name)).alias("found"),
        F.lit(cat.table_exists(spark, name + "_no")).alias("other"))


@register("S4_drop_table", "", "SELECT count(*) AS n, false AS found FROM events")
def drop(spark, d):
    name = f"events_{uuid.uuid4().hex}"
    cat.create_features_table(spark, name, f"{d}/events.parquet", fresh(spark, "table"))
    cat.drop_table(spark, name)
    return fr.read(spark, d, "events").agg(F.count("*").alias("n")).select(
        "n", F.lit(cat.table_exists(spark, name)).alias("found"))


@register("S5_drop_column", "", "SELECT event_id, user_id, event_type, value FROM events")
def drop_column(spark, d):
    name = f"events_{uuid.uuid4().hex}"
    fr.read(spark, d, "events").select("event_id", "user_id", "event_type", "value", "props") \
        .write.option("path", fresh(spark, "table")).saveAsTable(name)
    return cat.drop_column(spark, name, "props", fresh(spark, "table"))


@register("S6_query", "", "SELECT event_type, count(*) AS n FROM events WHERE value > 5 GROUP BY event_type")
def sql_query(spark, d):
    return cat.query(spark, "SELECT event_type, count(*) AS n FROM {ev} WHERE value > :low GROUP BY event_type",
                     {"low": 5.0}, ev=fr.read(spark, d, "events"))


@register("S7_register_frame", "li", f"""
    SELECT feature_id, count(*) AS n, {R('max(activation_value)')} AS top FROM li GROUP BY feature_id""")
def register_frame(spark, d):
    name = f"input_{uuid.uuid4().hex}"
    cat.register(fr.line_activations(spark, d), name)
    out = spark.sql(f"SELECT feature_id, count(*) AS n, max(activation_value) AS top FROM {name} GROUP BY feature_id")
    cat.unregister(spark, name)
    return rounded(out, "top")


def word_rows(spark, d):
    return tk.token_rows(fr.read(spark, d, "documents"), None)


@register("S8_build_vocabulary", "dict", "SELECT token_id, token_text FROM dict")
def vocabulary(spark, d):
    return tk.build_vocabulary(word_rows(spark, d))


@register("S9_activations_sink", "active", f"""
    SELECT sample_id, feature_id, {R('activation_value')} AS activation_value, token_id, chunk_id FROM active""")
def sink(spark, d):
    path = fresh(spark, "activations")
    cm.finish_chunks(cat.typed_activations(fr.activations(spark, d)), fr.samples(spark, d), path)
    back = cm.read_finished(spark, path)
    return rounded(back.select("sample_id", "feature_id", F.col("activation_value").cast("double")
                               .alias("activation_value"), "token_id", "chunk_id"), "activation_value")


@register("S9_feature_clustered_sink", "active", "SELECT feature_id, count(*) AS n FROM active GROUP BY feature_id")
def clustered_sink(spark, d):
    path = fresh(spark, "by-feature")
    cat.write_by_feature(fr.activations(spark, d), path)
    return cat.read_activations(spark, path).groupBy("feature_id").agg(F.count("*").alias("n"))


@register("S10_alive_set", "active", "SELECT DISTINCT feature_id FROM active")
def alive_file(spark, d):
    path = fresh(spark, "alive")
    cat.write_alive_set(fr.active(spark, d), path)
    return cat.read_alive_set(spark, path)


@register("S11_document_chunks", "", """
    SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS doc_rank,
           CAST((row_number() OVER (ORDER BY doc_id) - 1) // 200 AS INTEGER) AS chunk_id FROM documents""")
def chunks(spark, d):
    return tk.document_chunks(fr.read(spark, d, "documents").select("doc_id"))


@register("S12_expand_chunks", "samples", f"""
    SELECT chunk_id, CAST(row_number() OVER (PARTITION BY chunk_id ORDER BY sample_id) - 1 AS INTEGER) AS pos,
           token_id, {R('CAST(vec[1] AS DOUBLE)')} AS first, CAST(len(vec) AS INTEGER) AS dim FROM samples""")
def expand(spark, d):
    stored = fr.samples(spark, d).groupBy("chunk_id").agg(
        F.array_sort(F.collect_list(F.struct("sample_id", "token_id", "vec"))).alias("s"))
    stored = stored.select("chunk_id", F.transform("s", lambda x: x["token_id"]).alias("token_ids"),
                           F.transform("s", lambda x: x["vec"]).alias("activations"))
    return rounded(cat.expand_chunks(stored).select(
        "chunk_id", "pos", "token_id", F.col("vec")[0].cast("double").alias("first"),
        F.size("vec").alias("dim")), "first")


@register("S13_resume", "samples", """
    SELECT sample_id, chunk_id FROM samples WHERE chunk_id = (SELECT max(chunk_id) FROM samples)""")
def resume(spark, d):
    """All chunks but the last are extracted and committed; what is left comes from the log."""
    rows, path = fr.samples(spark, d), fresh(spark, "chunks")
    earlier = rows.where(F.col("chunk_id") < rows.agg(F.max("chunk_id")).scalar())
    cm.finish_chunks(ac.active_entries(earlier), earlier, path)
    return cm.pending_rows(rows, path).select("sample_id", "chunk_id")


@register("S14_first_documents", "", "SELECT doc_id, text FROM documents ORDER BY doc_id LIMIT 500")
def first_documents(spark, d):
    path = fresh(spark, "corpus")
    tk.first_documents(fr.read(spark, d, "documents"), 500).select("doc_id", "text").write.parquet(path)
    return spark.read.parquet(path)


@register("S15_sample", "", "SELECT doc_id, lang, n_chars FROM documents ORDER BY doc_id LIMIT 10")
def print_sample(spark, d):
    return tk.first_documents(fr.read(spark, d, "documents"), 10).select("doc_id", "lang", "n_chars")


# ---- text to tokens -------------------------------------------------------------------

@register("P1_encode_truncated", "", r"""
    SELECT doc_id, len(ws) AS n_tokens, md5(array_to_string(ws, '')) AS digest FROM (
        SELECT doc_id, regexp_extract_all(text, ' ?[^ \t\n\r]+')[1:1024] AS ws FROM documents)""")
def encode_text(spark, d):
    return tk.tokenise(fr.read(spark, d, "documents").select("doc_id", "text")).select(
        "doc_id", F.size("words").cast("long").alias("n_tokens"),
        F.md5(F.array_join("words", "")).alias("digest"))


@register("P2_token_rows", "tok", """
    SELECT doc_id, count(*) AS n, CAST(sum(pos) AS BIGINT) AS pos_sum, CAST(sum(length(word)) AS BIGINT) AS chars
    FROM tok GROUP BY doc_id""")
def flatten(spark, d):
    return word_rows(spark, d).groupBy("doc_id").agg(
        F.count("*").alias("n"), F.sum("pos").alias("pos_sum"), F.sum(F.length("word")).alias("chars"))


@register("P2_drop_padding", "", r"""
    WITH t AS (SELECT conv_id, turn, regexp_extract_all(text, ' ?[^ \t\n\r]+') AS ws FROM conversations)
    SELECT conv_id, turn, CAST(i AS INTEGER) AS pos, CAST(length(w) AS INTEGER) AS token_id
    FROM (SELECT conv_id, turn, unnest(range(len(ws))) AS i, unnest(ws) AS w FROM t)""")
def masked(spark, d):
    longest = F.max(F.size("words"))
    rows = tk.tokenise(fr.read(spark, d, "conversations").select("conv_id", "turn", "text"), None)
    width = rows.agg(longest).scalar()
    padded = rows.withColumn("_width", width).select(
        "conv_id", "turn",
        F.concat(F.transform("words", lambda w: F.length(w)),
                 F.array_repeat(F.lit(0), F.col("_width") - F.size("words"))).alias("token_ids"),
        F.concat(F.array_repeat(F.lit(True), F.size("words")),
                 F.array_repeat(F.lit(False), F.col("_width") - F.size("words"))).alias("attention_mask"))
    return tk.drop_padding(padded)


def id_rows(spark, d):
    words = word_rows(spark, d)
    return tk.assign_token_ids(words, tk.build_vocabulary(words)).select("doc_id", "pos", "token_id")


@register("P3_token_ids", "tok dict", """
    SELECT t.doc_id, count(*) AS n, CAST(sum(d.token_id) AS BIGINT) AS id_sum,
           CAST(sum(d.token_id * (t.pos + 1)) AS BIGINT) AS placed_sum
    FROM tok t JOIN dict d ON d.token_text = t.word GROUP BY t.doc_id""")
def token_ids(spark, d):
    return id_rows(spark, d).groupBy("doc_id").agg(
        F.count("*").alias("n"), F.sum("token_id").alias("id_sum"),
        F.sum(F.col("token_id") * (F.col("pos") + 1)).alias("placed_sum"))


@register("P4_vector_per_token", "tok dict", f"""
    SELECT t.doc_id, count(*) AS n, {R('sum(CAST(e.embedding[1] AS DOUBLE))')} AS first_sum
    FROM tok t JOIN dict d ON d.token_text = t.word
    JOIN embeddings e ON e.vec_id = d.token_id % (SELECT count(*) FROM embeddings)
    GROUP BY t.doc_id""")
def token_vectors(spark, d):
    table = fr.read(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("vec"))
    tokens = id_rows(spark, d).withColumn("vec_id", F.col("token_id") % table.agg(F.count("*")).scalar())
    rows = ae.vectors_for_tokens(tokens, table, "vec_id")
    return rounded(rows.groupBy("doc_id").agg(
        F.count("*").alias("n"), F.sum(F.col("vec")[0].cast("double")).alias("first_sum")), "first_sum")


@register("P5_progress", "", r"""
    WITH b AS (SELECT (row_number() OVER (ORDER BY doc_id) - 1) // 2 AS batch,
                      least(len(regexp_extract_all(text, ' ?[^ \t\n\r]+')), 1024) AS t FROM documents),
         g AS (SELECT batch, count(*) AS examples, CAST(sum(t) AS BIGINT) AS tokens FROM b GROUP BY batch)
    SELECT batch, examples, tokens, CAST(sum(examples) OVER w AS BIGINT) AS running_examples,
           CAST(sum(tokens) OVER w AS BIGINT) AS running_tokens FROM g WINDOW w AS (ORDER BY batch)""")
def progress(spark, d):
    return tk.progress(fr.read(spark, d, "documents"))


# ---- autoencoder ----------------------------------------------------------------------

@register("P6_encode", "enc", f"""
    SELECT sample_id, count(*) AS n, {R('sum(activation_value)')} AS total,
           {R('max(activation_value)')} AS top, CAST(sum(feature_id) AS BIGINT) AS id_sum FROM enc GROUP BY sample_id""")
def encode(spark, d):
    out = ae.encode(fr.samples(spark, d), fr.model(spark, d))
    return rounded(out.groupBy("sample_id").agg(
        F.count("*").alias("n"), F.sum("activation_value").alias("total"),
        F.max("activation_value").alias("top"), F.sum("feature_id").alias("id_sum")), "total", "top")


@register("P6_encode_blocked", "enc", f"""
    SELECT sample_id, count(*) AS n, {R('sum(activation_value)')} AS total FROM enc GROUP BY sample_id""")
def encode_in_slabs(spark, d):
    model = ae.Autoencoder(fr.weights(spark, d), fr.zero_bias(spark, d), slab_cells=64 * 100)  # several slabs of 100 units
    out = ae.encode(fr.samples(spark, d), model)
    return rounded(out.groupBy("sample_id").agg(
        F.count("*").alias("n"), F.sum("activation_value").alias("total")), "total")


TOP_ENC = """(SELECT sample_id, token_id, chunk_id, feature_id, activation_value FROM (
    SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY activation_value DESC, feature_id) AS rk
    FROM enc WHERE activation_value > CAST(0.07 AS DOUBLE)) WHERE rk <= 25)"""


def decode_sql(bias):
    return f"""
    , t AS {TOP_ENC},
    terms AS (SELECT t.sample_id, i, sum(t.activation_value * x) AS s FROM t JOIN (
                  SELECT feature_id, unnest(range(len(w))) AS i, unnest(w) AS x FROM w) u
              ON u.feature_id = t.feature_id GROUP BY t.sample_id, i)
    SELECT s.sample_id, CAST(g.i AS INTEGER) AS dim, {R('coalesce(terms.s, 0) + ' + bias)} AS x_hat
    FROM samples s CROSS JOIN (SELECT unnest(range(64)) AS i) g
    LEFT JOIN terms ON terms.sample_id = s.sample_id AND terms.i = g.i"""


def decoded(spark, d, tied, bias):
    rows, encoder = fr.samples(spark, d), fr.model(spark, d)
    model = fr.model(spark, d, tied, bias) if tied else encoder
    act = ae.encode(rows, encoder, 0.07, 25)
    out = ae.decode(act, rows, model)
    return rounded(out.select("sample_id", F.posexplode("reconstruction").alias("dim", "x_hat")), "x_hat")


@register("P7_decode", "enc w samples", decode_sql("0"))
def decode(spark, d):
    return decoded(spark, d, False, "zero")


@register("P7_decode_tied", "enc w samples mean_vec", decode_sql("(SELECT b FROM mean_vec)[g.i + 1]"))
def decode_tied(spark, d):
    return decoded(spark, d, True, "mean")


# sample x unit values and reconstructions with the mean vector as decoder bias
FORWARD = """
    , c AS (SELECT sample_id, chunk_id, list_transform(list_zip(CAST(vec AS DOUBLE[]), (SELECT b FROM mean_vec)),
                   lambda z: z[1] - z[2]) AS x, CAST(vec AS DOUBLE[]) AS vec FROM samples),
    f AS (SELECT c.sample_id, w.feature_id, list_dot_product(c.x, w.w) + w.b_enc AS v FROM c, w
          WHERE list_dot_product(c.x, w.w) + w.b_enc > 0),
    u AS (SELECT feature_id, unnest(range(len(w))) AS i, unnest(w) AS x FROM w),
    r AS (SELECT f.sample_id, u.i, sum(f.v * u.x) AS s FROM f JOIN u ON u.feature_id = f.feature_id GROUP BY f.sample_id, u.i),
    err AS (SELECT c.sample_id, sum(pow(coalesce(r.s, 0) + (SELECT b FROM mean_vec)[g.i + 1] - c.vec[g.i + 1], 2)) AS squared_error,
                   sum(coalesce(r.s, 0) + (SELECT b FROM mean_vec)[g.i + 1]) AS x_sum
            FROM c CROSS JOIN (SELECT unnest(range(64)) AS i) g
            LEFT JOIN r ON r.sample_id = c.sample_id AND r.i = g.i GROUP BY c.sample_id),
    l AS (SELECT c.sample_id, coalesce(sum(f.v), 0) AS l1, count(f.v) AS n FROM c LEFT JOIN f ON f.sample_id = c.sample_id GROUP BY c.sample_id),
    parts AS (SELECT sample_id, CASE WHEN h < total // 10 * 8 THEN 'train' WHEN h < total // 10 * 9 THEN 'val' ELSE 'test' END AS split FROM (
                  SELECT sample_id, row_number() OVER (ORDER BY sample_id) - 1 AS h, count(*) OVER () AS total FROM samples)),
    b AS (SELECT sample_id, split, (row_number() OVER (PARTITION BY split ORDER BY sample_id) - 1) // 32 AS batch FROM parts),
    e AS (SELECT b.split, b.batch, b.sample_id, err.squared_error, l.l1 FROM b JOIN err ON err.sample_id = b.sample_id
          JOIN l ON l.sample_id = b.sample_id)"""
FW = "samples w mean_vec"


def forwarded(spark, d):
    return ae.forward(fr.samples(spark, d), fr.model(spark, d, bias="mean"))


def split_samples(spark, d):
    """Samples cut 80/10/10 in order, with their batch number inside the split."""
    rows = fr.read(spark, d, "embeddings").select(F.col("vec_id").alias("sample_id"))
    total = rows.agg(F.count("*")).scalar()
    placed = dense_index(rows, "sample_id", name="h").withColumn("tenth", F.floor(total / 10))
    part = F.when(F.col("h") < F.col("tenth") * 8, "train").when(F.col("h") < F.col("tenth") * 9, "val").otherwise("test")
    return sp.batch_index(placed.select("sample_id", part.alias("split")))


def errors(spark, d):
    """Error columns per sample with split and batch."""
    found = ae.model_errors(fr.samples(spark, d), fr.model(spark, d, bias="mean")).select(
        "sample_id", "squared_error", "l1", "dim")
    return found.join(split_samples(spark, d), "sample_id")


@register("P8_forward", FW, FORWARD + f"""
    SELECT err.sample_id, l.n, {R('l.l1')} AS l1, {R('err.x_sum')} AS x_sum, {R('err.squared_error')} AS squared_error
    FROM err JOIN l ON l.sample_id = err.sample_id""")
def forward(spark, d):
    out = forwarded(spark, d).withColumn("x_sum", F.aggregate("reconstruction", F.lit(0.0), lambda s, x: s + x)) \
        .withColumn("n", F.size("features").cast("long"))
    absolute = F.aggregate("features", F.lit(0.0), lambda s, e: s + e["activation_value"])
    return rounded(out.select("sample_id", "n", absolute.alias("l1"), "x_sum",
                              V.squared_distance(F.col("vec"), F.col("reconstruction")).alias("squared_error")),
                   "l1", "x_sum", "squared_error")


@register("P9_active_entries", "active", f"""
    SELECT sample_id, feature_id, {R('activation_value')} AS activation_value FROM active""")
def active(spark, d):
    return rounded(fr.active(spark, d).select("sample_id", "feature_id", "activation_value"), "activation_value")


@register("P10_strongest_per_sample", "trimmed", f"""
    SELECT sample_id, feature_id, {R('activation_value')} AS activation_value FROM trimmed""")
def strongest(spark, d):
    return rounded(ac.strongest_per_sample(fr.active(spark, d)).select(
        "sample_id", "feature_id", "activation_value"), "activation_value")


@register("P10_weakest_per_sample", "active", f"""
    SELECT sample_id, feature_id, {R('activation_value')} AS activation_value FROM (
        SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY activation_value, feature_id) AS rk FROM active)
    WHERE rk <= 5""")
def weakest(spark, d):
    return rounded(ac.strongest_per_sample(fr.active(spark, d), 5, "ascending").select(
        "sample_id", "feature_id", "activation_value"), "activation_value")


@register("P11_context_windows", "ctx", "SELECT sample_id, array_to_string(context_token_ids, ',') AS context FROM ctx")
def contexts(spark, d):
    out = ac.context_windows(fr.samples(spark, d))
    return joined(out.select("sample_id", F.col("context_token_ids").alias("context")), "context")


def _shifted(o):
    """Token at offset o, the edge token beyond the ends of the document."""
    if o == 0:
        return "token_id"
    side, edge = ("lag", "first") if o < 0 else ("lead", "last")
    return f"coalesce({side}(token_id, {abs(o)}) OVER w, {edge}_id)"


@register("P11_context_by_document", "tok dict", f"""
    , p AS (SELECT t.doc_id, t.pos, d.token_id, first_value(d.token_id) OVER f AS first_id, last_value(d.token_id) OVER f AS last_id
            FROM tok t JOIN dict d ON d.token_text = t.word
            WINDOW f AS (PARTITION BY t.doc_id ORDER BY t.pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
    c AS (SELECT doc_id, {' + '.join(f'{o + 11} * {_shifted(o)}' for o in range(-10, 11))} AS weighted
          FROM p WINDOW w AS (PARTITION BY doc_id ORDER BY pos))
    SELECT doc_id, count(*) * 21 AS n, CAST(sum(weighted) AS BIGINT) AS weighted FROM c GROUP BY doc_id""")
def document_contexts(spark, d):
    out = ac.context_windows(id_rows(spark, d), by=["doc_id"], order="pos", pos="pos")
    weighted = F.aggregate(F.transform("context_token_ids", lambda t, i: t * (i + 1)),
                           F.lit(0).cast("long"), lambda s, x: s + x)
    return out.groupBy("doc_id").agg((F.count("*") * 21).alias("n"), F.sum(weighted).alias("weighted"))


@register("P12_records", "trimmed ctx", f"""
    SELECT t.sample_id, t.feature_id, {R('t.activation_value')} AS activation_value, t.token_id,
           array_to_string(c.context_token_ids, ',') AS context, t.chunk_id
    FROM trimmed t JOIN ctx c ON c.sample_id = t.sample_id""")
def records(spark, d):
    out = ac.extract_activations(fr.samples(spark, d))
    return rounded(joined(out.withColumnRenamed("context_token_ids", "context"), "context"), "activation_value")


@register("P13_extract_chunks", "enc ctx", f"""
    SELECT t.sample_id, t.feature_id, {R('t.activation_value')} AS activation_value, t.token_id,
           array_to_string(c.context_token_ids, ',') AS context, t.chunk_id
    FROM {TOP_ENC} t JOIN ctx c ON c.sample_id = t.sample_id""")
def extract(spark, d):
    out = ac.extract_activations(fr.samples(spark, d), fr.model(spark, d))
    return rounded(joined(out.withColumnRenamed("context_token_ids", "context"), "context"), "activation_value")


@register("P13_corpus_to_activations", "enc", rf"""
    , tokc AS (SELECT doc_id, unnest(range(len(ws))) AS pos, unnest(ws) AS word FROM (
        SELECT doc_id, regexp_extract_all(text, ' ?[^ \t\n\r]+')[1:1024] AS ws FROM documents)),
    dictc AS (SELECT word, row_number() OVER (ORDER BY md5(word || '|'), word) - 1 AS token_id FROM (SELECT DISTINCT word FROM tokc)),
    ranked AS (SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 200 AS chunk_id FROM documents),
    ids AS (SELECT t.doc_id, t.pos, d.token_id, r.chunk_id FROM tokc t JOIN dictc d ON d.word = t.word JOIN ranked r ON r.doc_id = t.doc_id),
    cx AS (SELECT token_id, coalesce(lag(token_id, 10) OVER w, first_value(token_id) OVER f) AS c0,
                  coalesce(lead(token_id, 10) OVER w, last_value(token_id) OVER f) AS c20
           FROM ids WINDOW w AS (PARTITION BY chunk_id ORDER BY doc_id, pos),
                f AS (PARTITION BY chunk_id ORDER BY doc_id, pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
    top AS {TOP_ENC}
    SELECT top.feature_id, count(*) AS n, {R('sum(top.activation_value)')} AS total, count(DISTINCT cx.token_id) AS tokens,
           CAST(sum(c0) AS BIGINT) AS first_context, CAST(sum(c20) AS BIGINT) AS last_context
    FROM cx JOIN top ON top.sample_id = cx.token_id % (SELECT count(*) FROM embeddings) GROUP BY top.feature_id""")
def corpus_to_activations(spark, d):
    """The whole way: text, tokens, ids, chunks, vectors, units, contexts. A token's vector comes from
    the table, so the units of each of its vectors are computed once and looked up like the vector, by
    rows that have their contexts already: arrays of units are not moved. A unit's different tokens are
    counted among the different tokens, so its records are added up without them and do not move either."""
    vectors = fr.read(spark, d, "embeddings")
    tokens = staged(tk.corpus_samples(fr.read(spark, d, "documents")), "tokens")
    coded = staged(ae.encode_nested(vectors.select("vec_id", F.col("embedding").alias("vec")), fr.model(spark, d), 0.07, 25), "coded")

    def active(rows):
        met = rows.withColumn("vec_id", F.col("token_id") % vectors.agg(F.count("*")).scalar())
        return ae.vectors_for_tokens(met, coded, "vec_id", vec="features")

    out = ac.nested_records(active(ac.context_windows(tokens)))
    context = F.col("context_token_ids")
    sums = out.groupBy("feature_id").agg(F.count("*").alias("n"), F.sum("activation_value").alias("total"),
                                         F.sum(context[0]).alias("first_context"), F.sum(context[20]).alias("last_context"))
    pairs = active(tokens.select("token_id").distinct()).select("token_id", F.explode("features.feature_id").alias("feature_id"))
    counts = pairs.groupBy("feature_id", "token_id").agg(F.lit(1)).groupBy("feature_id").agg(F.count("token_id").alias("tokens"))
    return rounded(sums.join(counts, "feature_id").select("feature_id", "n", "total", "tokens", "first_context", "last_context"), "total")


NATURAL = """lower(regexp_extract(file, '^[A-Za-z_]+')), CAST(regexp_extract(file, '[0-9]+') AS BIGINT),
             lower(regexp_extract(file, '[a-z]*[.]pt$')), file"""


@register("P14_number_files", "files", f"SELECT file, row_number() OVER (ORDER BY {NATURAL}) - 1 AS chunk_index FROM files")
def number_files(spark, d):
    return sp.natural_order(fr.chunk_files(spark, d)).withColumn("chunk_index", F.col("chunk_index").cast("long"))


@register("P15_alive_before_trim", "enc", """
    SELECT count(DISTINCT feature_id) AS alive_count,
           round(100.0::DOUBLE * count(DISTINCT feature_id) / (SELECT count(*) FROM embeddings), 6) AS alive_percent
    FROM enc WHERE activation_value > CAST(0.07 AS DOUBLE)""")
def alive_share(spark, d):
    model = fr.model(spark, d)
    return rounded(ac.alive_share(ae.alive_units(fr.samples(spark, d), model), model.size[0]), "alive_percent")


@register("P15_alive_features", "active", "SELECT DISTINCT feature_id FROM active")
def alive(spark, d):
    return ac.alive_features(fr.active(spark, d))


# ---- weights and losses ---------------------------------------------------------------

@register("M1_row_norms", "", f"""
    SELECT CAST(vec_id AS INTEGER) AS feature_id, {R('sqrt(list_dot_product(e, e))')} AS norm
    FROM (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * (1 + vec_id % 3)) AS e FROM embeddings)""")
def norms(spark, d):
    w = fr.read(spark, d, "embeddings").select(
        F.col("vec_id").cast("int").alias("feature_id"),
        V.scaled(F.col("embedding"), 1 + F.col("vec_id") % 3).alias("w_dec"))
    return rounded(ae.row_norms(w), "norm")


@register("M2_normalise_rows", "w", f"""
    SELECT feature_id, CAST(i AS INTEGER) AS dim, {R('x')} AS x FROM (
        SELECT feature_id, unnest(range(len(w))) AS i, unnest(w) AS x FROM w)""")
def unit_rows(spark, d):
    raw = fr.read(spark, d, "embeddings").select(
        F.col("vec_id").cast("int").alias("feature_id"), V.scaled(F.col("embedding"), F.lit(3.0)).alias("w_dec"))
    return rounded(ae.normalise_rows(raw).select(
        "feature_id", F.posexplode("w_dec").alias("dim", "x")), "x")


@register("A19_norm_range", "w", f"""
    SELECT {R('min(sqrt(list_dot_product(w, w)))')} AS min_norm, {R('max(sqrt(list_dot_product(w, w)))')} AS max_norm FROM w""")
def norm_range(spark, d):
    return rounded(ae.norm_range(fr.weights(spark, d)), "min_norm", "max_norm")


@register("M5_reconstruction_loss", FW, FORWARD + f"""
    SELECT split, batch, {R('sum(squared_error) / (count(*) * 64)')} AS reconstruction_loss FROM e GROUP BY split, batch""")
def reconstruction(spark, d):
    return rounded(ae.reconstruction_loss(errors(spark, d), ("split", "batch")), "reconstruction_loss")


@register("M6_sparsity_loss", FW, FORWARD + f"""
    SELECT split, batch, {R('0.01::DOUBLE * sum(l1) / (count(*) * (SELECT count(*) FROM embeddings))')} AS sparsity_loss
    FROM e GROUP BY split, batch""")
def sparsity(spark, d):
    units = fr.model(spark, d).size[0]
    return rounded(ae.sparsity_loss(errors(spark, d), LAMBDA, units, ("split", "batch")), "sparsity_loss")


BATCH_LOSS = """sum(squared_error) / (count(*) * 64) + 0.01::DOUBLE * sum(l1) / (count(*) * (SELECT count(*) FROM embeddings))"""


@register("M7_batch_losses", FW, FORWARD + f"SELECT split, batch, {R(BATCH_LOSS)} AS loss FROM e GROUP BY split, batch")
def losses(spark, d):
    units = fr.model(spark, d).size[0]
    return rounded(ae.batch_losses(errors(spark, d), LAMBDA, units, ("split", "batch")).select(
        "split", "batch", "loss"), "loss")


@register("M8_evaluate", FW, FORWARD + f"""
    SELECT split, batch, {R(BATCH_LOSS)} AS loss, count(*) OVER (PARTITION BY split) AS num_batches FROM e GROUP BY split, batch""")
def evaluate(spark, d):
    units = fr.model(spark, d).size[0]
    return rounded(ae.evaluation(errors(spark, d), LAMBDA, units), "loss")


@register("X3_swapped_loss", FW, FORWARD + f"""
    SELECT split, batch, {R('sqrt(sum(squared_error))')} AS loss FROM e GROUP BY split, batch""")
def swapped_loss(spark, d):
    return rounded(ae.batch_losses(errors(spark, d), LAMBDA, 1, ("split", "batch"),
                                   loss=F.sqrt(F.sum("squared_error"))), "loss")


BATCHED = """, st AS (SELECT sample_id, feature_id, activation_value, sample_id // 32 AS batch, sample_id // 32 + 1 AS step FROM active)"""


def batched_active(spark, d):
    rows = sp.batch_index(fr.samples(spark, d).select("sample_id"), by=())
    return fr.active(spark, d).join(rows, "sample_id").withColumn("step", F.col("batch") + 1)


@register("M9_fire_counts", "active", BATCHED + "SELECT feature_id, count(DISTINCT batch) AS fire_count FROM st GROUP BY feature_id")
def fire_counts(spark, d):
    return ae.fire_counts(batched_active(spark, d))


DEAD = BATCHED + f""", wins AS (SELECT unnest(range((SELECT max(sample_id // 32 + 1) FROM samples) // {EVERY})) AS step_window),
    dead AS (SELECT CAST(w.step_window AS BIGINT) AS step_window, CAST(u.i AS INTEGER) AS feature_id
             FROM wins w CROSS JOIN range({fr.UNIVERSE}) u(i)
             WHERE NOT EXISTS (SELECT 1 FROM st WHERE (st.step - 1) // {EVERY} = w.step_window AND st.feature_id = u.i))"""


def dead_units(spark, d):
    act = batched_active(spark, d)
    steps = sp.batch_index(fr.samples(spark, d).select("sample_id"), by=()).select((F.col("batch") + 1).alias("step"))
    return rs.dead_per_window(act, steps, fr.UNIVERSE, EVERY)


@register("M10_dead_per_window", "active", DEAD + "SELECT step_window, feature_id FROM dead")
def dead_per_window(spark, d):
    return dead_units(spark, d)


# squared distance of a sample to the mean vector stands in for its reconstruction error
DIST = """, dist AS (SELECT sample_id, sample_id // 32 AS batch, list_sum(list_transform(
              list_zip(CAST(vec AS DOUBLE[]), (SELECT b FROM mean_vec)), lambda z: pow(z[1] - z[2], 2))) AS squared_error FROM samples)"""


def distances(spark, d):
    rows = sp.batch_index(fr.samples(spark, d), by=())
    return rows.withColumn("_m", fr.mean_bias(spark, d).select("b_dec").scalar()).select(
        "sample_id", "batch", V.squared_distance(F.col("vec"), F.col("_m")).alias("squared_error"))


@register("W4_error_intervals", "samples mean_vec", DIST + f"""
    SELECT batch, sample_id, {R('(sum(squared_error) OVER w - squared_error) / sum(squared_error) OVER (PARTITION BY batch)')} AS cum_lo,
           {R('sum(squared_error) OVER w / sum(squared_error) OVER (PARTITION BY batch)')} AS cum_hi
    FROM dist WINDOW w AS (PARTITION BY batch ORDER BY sample_id ROWS UNBOUNDED PRECEDING)""")
def intervals(spark, d):
    return rounded(rs.error_intervals(distances(spark, d)), "cum_lo", "cum_hi")


DRAWS = DEAD + DIST + f""", cum AS (SELECT batch, sample_id, sum(squared_error) OVER (PARTITION BY batch ORDER BY sample_id ROWS UNBOUNDED PRECEDING) AS hi,
                 sum(squared_error) OVER (PARTITION BY batch) AS total FROM dist),
    u AS (SELECT step_window, feature_id, (step_window + 1) * {EVERY} - 1 AS batch,
                 ('0x' || substr(md5(feature_id || '|' || step_window || '|42'), 1, 12))::BIGINT / pow(2, 48) AS draw FROM dead),
    draws AS (SELECT u.step_window, u.feature_id, u.batch, u.draw, min(cum.sample_id) AS sample_id
              FROM u JOIN cum ON cum.batch = u.batch AND cum.hi > u.draw * cum.total GROUP BY ALL)"""


def draws(spark, d):
    return rs.draw_samples(dead_units(spark, d), distances(spark, d), EVERY)


@register("M11_error_weighted_draw", "active mean_vec", DRAWS + f"""
    SELECT step_window, feature_id, batch, {R('draw')} AS draw, sample_id FROM draws""")
def draw(spark, d):
    return rounded(draws(spark, d), "draw")


@register("J9_interval_join", "active mean_vec", DRAWS + """
    SELECT sample_id, count(*) AS times FROM draws GROUP BY sample_id""")
def interval_join(spark, d):
    return draws(spark, d).groupBy("sample_id").agg(F.count("*").alias("times"))


@register("M12_reinitialise", "active mean_vec w", DRAWS + f"""
    , one AS (SELECT feature_id, sample_id FROM draws WHERE step_window = (SELECT max(step_window) FROM draws)),
    scale AS (SELECT avg(sqrt(list_dot_product(w, w))) AS s FROM w WHERE feature_id NOT IN (SELECT feature_id FROM one)),
    cen AS (SELECT o.feature_id, list_transform(list_zip(CAST(s.vec AS DOUBLE[]), (SELECT b FROM mean_vec)), lambda z: z[1] - z[2]) AS x,
                   -('0x' || substr(md5(o.feature_id || '|42|bias'), 1, 12))::BIGINT / pow(2, 48) * 0.01::DOUBLE AS bias
            FROM one o JOIN samples s ON s.sample_id = o.sample_id)
    SELECT w.feature_id, {R("coalesce(cen.x[1] / sqrt(list_dot_product(cen.x, cen.x)), w.w[1])")} AS dec_first,
           {R("coalesce(cen.x[1] / sqrt(list_dot_product(cen.x, cen.x)) * scale.s * 0.05::DOUBLE, w.w[1])")} AS enc_first,
           {R("coalesce(cen.bias, w.b_enc)")} AS b_enc, cen.x IS NOT NULL AS resampled
    FROM w CROSS JOIN scale LEFT JOIN cen ON cen.feature_id = w.feature_id""")
def reinitialise(spark, d):
    drawn = draws(spark, d)
    last = drawn.where(F.col("step_window") == drawn.agg(F.max("step_window")).scalar())
    out = rs.reinitialise(fr.weights(spark, d), last, fr.samples(spark, d), fr.mean_bias(spark, d))
    return rounded(out.select("feature_id", F.col("w_dec")[0].alias("dec_first"),
                              F.col("w_enc")[0].alias("enc_first"), "b_enc", "resampled"),
                   "dec_first", "enc_first", "b_enc")


# ---- splits ---------------------------------------------------------------------------

@register("M13_split_files", "files", """
    SELECT file, CASE WHEN r < floor(n * 0.8::DOUBLE) THEN 'train'
                      WHEN r < floor(n * 0.8::DOUBLE) + floor(n * 0.1::DOUBLE) THEN 'val' ELSE 'test' END AS split
    FROM (SELECT file, row_number() OVER (ORDER BY md5(file || '|42'), file) - 1 AS r, count(*) OVER () AS n FROM files)""")
def split_files(spark, d):
    return sp.split_keys(fr.chunk_files(spark, d), "file")


@register("M13_split_rows", "", """
    SELECT split, count(*) AS n, CAST(sum(doc_id) AS BIGINT) AS ids FROM (
        SELECT doc_id, CASE WHEN r < floor(n * 0.8::DOUBLE) THEN 'train'
                            WHEN r < floor(n * 0.8::DOUBLE) + floor(n * 0.1::DOUBLE) THEN 'val' ELSE 'test' END AS split
        FROM (SELECT doc_id, row_number() OVER (ORDER BY md5(doc_id || '|42'), doc_id) - 1 AS r, count(*) OVER () AS n FROM documents))
    GROUP BY split""")
def split_rows(spark, d):
    return sp.split_keys(fr.read(spark, d, "documents").select("doc_id"), "doc_id").groupBy("split").agg(
        F.count("*").alias("n"), F.sum("doc_id").alias("ids"))


@register("M14_shard_files", "files", f"""
    SELECT file, (row_number() OVER (ORDER BY {NATURAL}) - 1) % 4 AS worker FROM files""")
def shards(spark, d):
    return sp.shard_files(fr.chunk_files(spark, d), 4).select("file", F.col("worker").cast("long").alias("worker"))


@register("W5_batch_index", "losses", """
    SELECT split, step, (row_number() OVER (PARTITION BY split ORDER BY step) - 1) // 32 AS batch FROM losses""")
def batches(spark, d):
    return sp.batch_index(fr.losses(spark, d), "step").select("split", "step", "batch")


@register("W6_document_rank", "", """
    SELECT chunk_id, count(*) AS n, min(doc_id) AS first, max(doc_id) AS last FROM (
        SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 200 AS chunk_id FROM documents) GROUP BY chunk_id""")
def document_rank(spark, d):
    return tk.document_chunks(fr.read(spark, d, "documents").select("doc_id")) \
        .groupBy(F.col("chunk_id").cast("long").alias("chunk_id")) \
        .agg(F.count("*").alias("n"), F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))


# ---- streams --------------------------------------------------------------------------

def chunk_folder(spark, d):
    path = fresh(spark, "chunks")
    cat.write_chunks(fr.samples(spark, d), path)
    return path


def sample_stream(spark, d):
    return inc.vector_stream(spark, chunk_folder(spark, d))


@register("R1_stream_extract", "trimmed", f"""
    SELECT sample_id, feature_id, {R('activation_value')} AS activation_value FROM trimmed""")
def stream_extract(spark, d):
    out, mark = fresh(spark, "stream"), fresh(spark, "marks")
    inc.append_to(inc.active_stream(sample_stream(spark, d)), out, mark).awaitTermination()
    return rounded(spark.read.parquet(out).select("sample_id", "feature_id", "activation_value"), "activation_value")


@register("R1_stream_encode", "enc", f"""
    SELECT t.sample_id, t.feature_id, {R('t.activation_value')} AS activation_value FROM {TOP_ENC} t""")
def stream_encode(spark, d):
    out, mark = fresh(spark, "stream"), fresh(spark, "marks")
    inc.append_to(inc.active_stream(sample_stream(spark, d), fr.model(spark, d)), out, mark).awaitTermination()
    return rounded(spark.read.parquet(out).select("sample_id", "feature_id", "activation_value"), "activation_value")


@register("R2_stream_alive", "active", "SELECT feature_id, count(*) AS num_activations FROM active GROUP BY feature_id")
def stream_alive(spark, d):
    out, mark = fresh(spark, "alive"), fresh(spark, "marks")
    counts = inc.alive_counts(inc.active_stream(sample_stream(spark, d), top_k_features=None))
    inc.rewrite_result(counts, out, mark).awaitTermination()
    return spark.read.parquet(out)


@register("R3_stream_fire_counts", "active", BATCHED + f"""
    SELECT (step - 1) // {EVERY} AS step_window, feature_id, count(DISTINCT step) AS fire_count FROM st
    WHERE (step - 1) // {EVERY} < (SELECT max(step) FROM st) // {EVERY} GROUP BY ALL""")
def stream_fires(spark, d):
    out, mark = fresh(spark, "fires"), fresh(spark, "marks")
    rows = inc.active_stream(sample_stream(spark, d), top_k_features=None) \
        .withColumn("step", F.expr("sample_id div 32") + 1)
    inc.save_fire_parts(rows, out, mark, EVERY).awaitTermination()
    return inc.fire_counts(spark.read.parquet(out), EVERY)
