"""Schemas of the files that experiments write."""

from pyspark.sql import types as T

BENCHMARK_RUN = T.StructType(
    [
        T.StructField("model_name", T.StringType()),
        T.StructField("method", T.StringType()),
        T.StructField("hardware", T.StringType()),
        T.StructField("input_length", T.IntegerType()),
        T.StructField("output_length", T.IntegerType()),
        T.StructField("batch_size", T.IntegerType()),
        T.StructField("latency_ms", T.DoubleType()),
        T.StructField("throughput_tok_per_sec", T.DoubleType()),
        T.StructField("peak_memory_mb", T.DoubleType()),
        T.StructField("perplexity", T.DoubleType()),
        T.StructField("timestamp", T.StringType()),
    ]
)
RUN_TIMESTAMP_FORMAT = "yyyy-MM-dd HH:mm:ss"

PERPLEXITY_RESULT = T.StructType(
    [
        T.StructField("model", T.StringType()),
        T.StructField("method", T.StringType()),
        T.StructField("dataset", T.StringType()),
        T.StructField("perplexity", T.DoubleType()),
        T.StructField("eval_time_s", T.DoubleType()),
    ]
)

# task -> metric key -> value; values mix numbers and text, so they are read as text.
EVALUATION_RESULT = T.StructType(
    [
        T.StructField(
            "results",
            T.MapType(T.StringType(), T.MapType(T.StringType(), T.StringType())),
        )
    ]
)

ENGINE_TESTS = T.ArrayType(
    T.StructType(
        [
            T.StructField("test_name", T.StringType()),
            T.StructField("test", T.StringType()),
            T.StructField("n_prompt", T.IntegerType()),
            T.StructField("n_gen", T.IntegerType()),
            T.StructField("avg_ts", T.DoubleType()),
            T.StructField("stddev_ts", T.DoubleType()),
        ]
    )
)
