"""Token and context text of activation rows, token classes, prompts and labels."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparselens import schema
from sparselens.functions import text as X
from sparselens.operators.features import top_activations, top_activations_per_feature
from sparselens.plans.joins import lookup_join
from sparselens.session import settle

FLAGS = ("pos", "ner", "is_stop", "is_punct", "dep", "subword_position",
         "is_numeric", "is_upper", "is_title", "is_whitespace")


def with_token_text(rows, vocab, vocab_size=None):
    """Add ``token_text``; rows with an unknown token id are dropped.

    With a declared ``vocab_size`` only ids below it are used, which bounds the broadcast.
    """
    texts = vocab.select("token_id", "token_text")
    if vocab_size is not None:
        texts = texts.where(F.col("token_id").between(0, vocab_size - 1))
    return lookup_join(rows, texts, "token_id", max_rows=vocab_size)


def with_context_text(rows, vocab, vocab_size=None):
    """Add ``context_text``, the context ids as texts in order.

    Unknown ids are left out (later ones move up); a context without any known id gives NULL.
    A vocabulary of declared size is turned into one array and looked up by position, so the
    rows are not moved. A vocabulary of unknown size is joined with the distinct contexts. Of
    repeated ids the lowest text counts.
    """
    if vocab_size is not None and vocab_size <= 1 << 20:
        texts = vocabulary_array(vocab, vocab_size)
        # Used once, so the optimizer puts the subquery value into the lookup instead of
        # carrying the whole array along with every row.
        known = F.filter(F.transform("context_token_ids", lambda i: F.get("_texts", i)),
                         lambda t: t.isNotNull())
        named = rows.withColumn("_texts", texts).withColumn("_known", known).drop("_texts")
        return named.withColumn("context_text", F.when(F.size("_known") > 0, F.col("_known"))).drop("_known")
    # Each distinct context is resolved once, however many rows share it.
    contexts = rows.select("context_token_ids").distinct()
    parts = contexts.select("context_token_ids", F.posexplode("context_token_ids").alias("_pos", "token_id"))
    texts = vocab.groupBy("token_id").agg(F.min("token_text").alias("token_text"))
    named = lookup_join(parts, texts, "token_id").groupBy("context_token_ids").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("_pos", "token_text"))),
        lambda e: e["token_text"]).alias("context_text"))
    return rows.join(named, "context_token_ids", "left").select(*rows.columns, "context_text")


def vocabulary_array(vocab, vocab_size):
    """Scalar subquery: texts by id, at most ``vocab_size`` entries, null for missing ids."""
    inside = vocab.where(F.col("token_id").between(0, vocab_size - 1)) \
        .groupBy(F.col("token_id").cast("long").alias("token_id")).agg(F.min("token_text").alias("token_text"))
    ids = vocab.sparkSession.range(vocab_size).withColumnRenamed("id", "token_id")
    return ids.join(inside, "token_id", "left").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("token_id", "token_text"))),
        lambda e: e["token_text"])).scalar()


def with_context_string(rows, window=schema.CONTEXT_WINDOW):
    """Add the readable context with the activating token in bold markers."""
    return rows.withColumn("context_string", X.context_string(
        F.col("context_text"), F.col("token_text"), window))


def with_joined_context(rows, window=schema.CONTEXT_WINDOW):
    """Add the surface text with the token spliced into its context."""
    return rows.withColumn("token_joined_context", X.joined_context(
        F.col("context_text"), F.col("token_text"), window))


def top_contexts(act, feature_id, vocab, k, window=schema.CONTEXT_WINDOW, vocab_size=None):
    """The k strongest records of a feature with their readable contexts."""
    rows = with_token_text(top_activations(act, feature_id, k), vocab, vocab_size)
    return with_context_string(with_context_text(rows, vocab, vocab_size), window)


def top_contexts_per_feature(act, vocab, k, window=schema.CONTEXT_WINDOW, vocab_size=None):
    """The same for every feature in one plan; texts are attached after the trim."""
    rows = with_token_text(top_activations_per_feature(act, k), vocab, vocab_size)
    return with_context_string(with_context_text(rows, vocab, vocab_size), window)


# ---- token classes ------------------------------------------------------------------

def classify_tokens(rows, window=schema.CONTEXT_WINDOW, tagger=None, stop_words=None):
    """Ten properties of the activating token of each row.

    ``is_stop`` and ``is_punct`` are those of the word that covers the token's offset in the joined
    context; a blank there (a token that starts with one) or nothing gives false. The surface properties are native. ``stop_words`` is a frame with one column ``word``.
    ``tagger`` is a function for ``mapInPandas`` that reads ``token_joined_context`` and
    ``char_offset`` and fills pos, ner and dep; without it they keep the fallbacks.
    """
    token = F.col("token_text")
    out = rows if "token_joined_context" in rows.columns else with_joined_context(rows, window)
    out = out.select(
        "*", F.lit("X").alias("pos"), F.lit("O").alias("ner"), F.lit("").alias("dep"),
        X.subword_position(token).alias("subword_position"), X.is_numeric(token).alias("is_numeric"),
        X.is_upper(token).alias("is_upper"), X.is_title(token).alias("is_title"),
        X.is_whitespace(token).alias("is_whitespace"),
        X.char_offset(F.col("context_text"), window).alias("char_offset"))
    out = out.withColumn("_word", F.lower(X.covering_word(F.col("token_joined_context"), F.col("char_offset"))))
    out = out.withColumn("is_punct", F.coalesce(X.is_punct(F.col("_word")), F.lit(False)))
    if stop_words is None:
        out = out.withColumn("is_stop", F.lit(False)).drop("_word")
    else:
        known = stop_words.select(F.lower("word").alias("_word"), F.lit(True).alias("_stop")).distinct()
        out = (lookup_join(out, known, "_word", "left")
               .withColumn("is_stop", F.coalesce("_stop", F.lit(False))).drop("_word", "_stop"))
    return out if tagger is None else out.mapInPandas(tagger, out.schema)


def token_type_breakdown(act, vocab, sample_size=1000, window=schema.CONTEXT_WINDOW,
                         vocab_size=None, tagger=None, stop_words=None):
    """Value counts of the ten token properties over the strongest rows of each feature.

    ``sample_size=None`` takes all rows.
    """
    best = act if sample_size is None else top_activations_per_feature(act, sample_size).drop("rank")
    rows = with_context_text(with_token_text(best, vocab, vocab_size), vocab, vocab_size)
    flags = classify_tokens(rows, window, tagger, stop_words)
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("property"),
                                         F.col(f).cast("string").alias("value")) for f in FLAGS]))
    return (flags.select("feature_id", pairs.alias("_p")).select("feature_id", "_p.property", "_p.value")
            .groupBy("feature_id", "property", "value").agg(F.count("*").alias("count")))


# ---- labels -------------------------------------------------------------------------

PROMPT = ("Each numbered line shows where one unit of a network fires; the firing token is in "
          "**bold**.\n{contexts}\nName the common pattern in a few words, or write POLYSEMANTIC "
          "if there is none. Finish with a line 'Label: <name>'.")


def prompts(ranked, template=PROMPT):
    """One prompt per feature from its ranked context strings."""
    before, after = template.split("{contexts}")
    contexts = F.transform(F.array_sort(F.collect_list(F.struct("rank", "context_string"))),
                           lambda e: e["context_string"])
    return ranked.groupBy("feature_id").agg(
        F.concat(F.lit(before), X.numbered_list(contexts), F.lit(after)).alias("prompt"))


def parse_replies(replies, reply="reply"):
    """Add ``llm_label`` and ``llm_reasoning`` read from a reply text."""
    return replies.withColumn("llm_label", X.reply_label(F.col(reply))) \
                  .withColumn("llm_reasoning", X.reply_reasoning(F.col(reply)))


def with_most_frequent_token(ranked):
    """Offline labels: the most frequent activating token of each feature's few ranked rows."""
    same = Window.partitionBy("feature_id", "token_text")
    best = (Window.partitionBy("feature_id").orderBy(F.desc("_n"), "token_text")
            .rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return (ranked.withColumn("_n", F.count("*").over(same))
            .withColumn("llm_label", X.strip(F.first("token_text").over(best)))
            .withColumn("llm_reasoning", F.lit("most frequent token")).drop("_n"))


def label_features(ranked, labeller=None):
    """Attach a label and its reasoning to every row of each feature.

    ``ranked`` holds a few rows per feature. ``labeller`` is a ``mapInPandas`` function over
    (feature_id, prompt) that returns (feature_id, reply); its input rows are settled because
    they are read twice. Without a labeller the offline labels are used.
    """
    if labeller is None:
        return with_most_frequent_token(ranked)
    ranked = settle(ranked)
    asked = prompts(ranked)
    reply = f"feature_id {asked.schema['feature_id'].dataType.simpleString()}, reply string"
    labels = parse_replies(asked.mapInPandas(labeller, reply)).drop("reply")
    return ranked.join(labels, "feature_id")


def feature_labels(labelled):
    """One row per feature of a labelled frame."""
    return labelled.groupBy("feature_id").agg(F.first("llm_label").alias("llm_label"),
                                              F.first("llm_reasoning").alias("llm_reasoning"))
