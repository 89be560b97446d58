"""Column layouts of the engine's tables and the settings of the published runs."""

from pyspark.sql import types as T

VECTORS = T.StructType([
    T.StructField("sample_id", T.LongType()),
    T.StructField("token_id", T.IntegerType()),
    T.StructField("chunk_id", T.IntegerType()),
    T.StructField("vec", T.ArrayType(T.FloatType())),
])

WEIGHTS = T.StructType([
    T.StructField("feature_id", T.IntegerType()),
    T.StructField("w_enc", T.ArrayType(T.DoubleType())),
    T.StructField("w_dec", T.ArrayType(T.DoubleType())),
    T.StructField("b_enc", T.DoubleType()),
])

ACTIVATIONS = T.StructType([
    T.StructField("sample_id", T.LongType()),
    T.StructField("feature_id", T.IntegerType()),
    T.StructField("activation_value", T.FloatType()),
    T.StructField("token_id", T.IntegerType()),
    T.StructField("context_token_ids", T.ArrayType(T.IntegerType())),
    T.StructField("chunk_id", T.IntegerType()),
])

VOCAB = T.StructType([
    T.StructField("token_id", T.IntegerType()),
    T.StructField("token_text", T.StringType()),
])

LOSSES = T.StructType([
    T.StructField("split", T.StringType()),
    T.StructField("step", T.LongType()),
    T.StructField("loss", T.DoubleType()),
])

# Fixed values of the published runs.
ACTIVATION_THRESHOLD = 0.07
FEATURES_PER_SAMPLE = 25
CONTEXT_WINDOW = 10
MAX_TOKENS = 1024
DOCS_PER_BATCH = 2
BATCHES_PER_CHUNK = 100
TRAIN_BATCH = 32
RESAMPLE_EVERY = 25000
MODEL_DIM = 768
GPT2_VOCAB_SIZE = 50257
EXPANSIONS = (4, 8, 16, 32)
LAMBDAS = ("0.01", "0.0001")
