"""bitledger: Spark jobs for experiments that compress language models.

Benchmark runs, perplexity results, task-accuracy files, engine timings and device
telemetry come in as DataFrames; accuracy, latency, memory, energy and speed-up tables
come out. Every operator is a function ``DataFrame(s) -> DataFrame`` without file access,
so the same code serves files, tables and streams.
"""
