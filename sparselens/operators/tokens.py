"""Corpus to token rows: words, ids, chunks, progress counts."""

from pyspark.sql import functions as F

from sparselens import schema
from sparselens.functions import text as X
from sparselens.plans.inputs import spread
from sparselens.plans.joins import frequent_join, lookup_join
from sparselens.plans.ordered import WIDTH, dense_index, rank_by_hash, running_sum


def first_documents(docs, n, key="doc_id"):
    """The first n documents of a corpus."""
    return docs.orderBy(key).limit(n)


def tokenise(docs, max_tokens=schema.MAX_TOKENS, text="text"):
    """Words of each document as an array, cut at ``max_tokens`` (``None``: whole text)."""
    words = X.words(F.col(text))
    return docs.withColumn("words", words if max_tokens is None else F.slice(words, 1, max_tokens))


def token_rows(docs, max_tokens=schema.MAX_TOKENS, key="doc_id", text="text", keep=()):
    """One row per real token: no padding is ever created. ``keep`` names columns to carry along.

    The outer form with a filter behind it keeps the optimizer from putting a second copy of
    the word extraction in front of the explode.
    """
    return tokenise(spread(docs.select(key, *keep, text)), max_tokens, text).select(
        key, *keep, F.posexplode_outer("words").alias("pos", "word")).where(F.col("word").isNotNull())


def drop_padding(padded, ids="token_ids", mask="attention_mask"):
    """One row per unmasked position of padded id arrays."""
    keep = [c for c in padded.columns if c not in (ids, mask)]
    pairs = F.arrays_zip(F.col(ids).alias("token_id"), F.col(mask).alias("_real"))
    return (padded.select(*keep, F.posexplode(pairs).alias("pos", "_p"))
            .where(F.col("_p._real")).select(*keep, "pos", F.col("_p.token_id").alias("token_id")))


def build_vocabulary(tokens, word="word"):
    """A dense id for each distinct word, in md5 order of the words."""
    return rank_by_hash(tokens.select(F.col(word).alias("token_text")).distinct(),
                        "token_text", name="token_id").select("token_id", "token_text")


def assign_token_ids(tokens, vocab, word="word", max_rows=None):
    """Replace words by ids; one frequent word does not overload a task. A vocabulary without a bound
    grows with the corpus, so only its frequent words are sent to all tasks."""
    ids = vocab.select(F.col("token_text").alias(word), "token_id")
    if max_rows is not None:
        return lookup_join(tokens, ids, word, max_rows=max_rows)
    return frequent_join(tokens, ids, word)


def document_chunks(docs, key="doc_id", docs_per_chunk=schema.DOCS_PER_BATCH * schema.BATCHES_PER_CHUNK,
                    dense=False, width=WIDTH):
    """Chunk number of each document by its rank; ``dense`` ids 0..n-1 are used as they are."""
    ranked = docs.withColumn("doc_rank", F.col(key)) if dense else dense_index(docs, key, name="doc_rank", width=width)
    return ranked.withColumn("chunk_id", F.floor(F.col("doc_rank") / docs_per_chunk).cast("int"))


def corpus_samples(docs, vocab=None, max_tokens=schema.MAX_TOKENS, key="doc_id", text="text",
                   docs_per_chunk=schema.DOCS_PER_BATCH * schema.BATCHES_PER_CHUNK):
    """Token rows of a corpus with unique, document-ordered sample ids and chunk numbers.

    ``vocab=None`` builds the dictionary from the corpus itself.
    """
    ranked = document_chunks(docs.select(key, text), key, docs_per_chunk)
    tokens = token_rows(ranked, max_tokens, key, text, ("doc_rank", "chunk_id"))
    ids = assign_token_ids(tokens, build_vocabulary(tokens) if vocab is None else vocab)
    longest = max_tokens or 1 << 31
    return ids.select((F.col("doc_rank") * longest + F.col("pos")).alias("sample_id"), key, "pos",
                      F.col("token_id").cast("int").alias("token_id"), "chunk_id")


def progress(docs, key="doc_id", text="text", max_tokens=schema.MAX_TOKENS,
             batch_size=schema.DOCS_PER_BATCH, width=WIDTH):
    """Running number of documents and of real tokens after each batch."""
    counted = tokenise(docs.select(key, text), max_tokens, text).select(
        key, F.size("words").alias("_tokens"))
    ranked = dense_index(counted, key, name="_rank", width=width)
    batches = ranked.groupBy(F.floor(F.col("_rank") / batch_size).alias("batch")).agg(
        F.count("*").alias("examples"), F.sum("_tokens").alias("tokens"))
    return running_sum(batches, "batch", {"running_examples": "examples", "running_tokens": "tokens"},
                       width=width)
