"""Names, constants and formats that results must carry unchanged."""

# --- fixed values: quantization methods --------------------------------------------
METHOD_LABELS = {
    "awq": "AWQ",
    "gptq": "GPTQ",
    "rtn": "RTN",
    "smooth": "SmoothQuant",
    "fp16": "FP16",
    "bnb4": "BnB-4",
    "bnb8": "BnB-8",
}
# Spelling of a method inside a model directory name, and the code it stands for.
METHOD_TOKENS = {
    "awq": "awq",
    "gptq": "gptq",
    "rtn": "rtn",
    "smooth": "smooth",
    "smoothq": "smooth",
    "smoothquant": "smooth",
    "bnb": "bnb",
    "fp16": "fp16",
}
# Every method code that can be read from a directory name, and its display name.
PARSED_METHOD_LABELS = ["AWQ", "FP16", "GPTQ", "RTN", "SmoothQuant", "bnb", "unknown"]
RECORDED_METHODS = ["awq", "bnb4", "bnb8", "fp16", "gptq", "rtn", "smooth"]

# --- fixed values: task accuracy ---------------------------------------------------
# (task, metric keys in order of preference)
TASK_METRICS = [
    ("arc_easy", ["acc_norm,none"]),
    ("arc_challenge", ["acc_norm,none"]),
    ("hellaswag", ["acc_norm,none"]),
    ("winogrande", ["acc,none"]),
    ("mmlu", ["acc,none"]),
    ("truthfulqa_mc2", ["acc,none"]),
    ("gsm8k", ["exact_match,flexible-extract", "exact_match,strict-match"]),
    ("ifeval", ["prompt_level_strict_acc,none", "inst_level_strict_acc,none"]),
]
TASKS = [task for task, _ in TASK_METRICS]
SHORT_TASK_NAMES = {
    "arc_easy": "arc_e",
    "arc_challenge": "arc_c",
    "hellaswag": "hella",
    "winogrande": "wino",
    "mmlu": "mmlu",
    "truthfulqa_mc2": "tqa_mc2",
    "gsm8k": "gsm8k",
    "ifeval": "ifeval",
}
TASK_PRESETS = {
    "quick": "arc_easy,hellaswag",
    "standard": "arc_easy,arc_challenge,hellaswag,winogrande,mmlu",
    "full": "arc_easy,arc_challenge,hellaswag,winogrande,mmlu,truthfulqa_mc2,gsm8k",
}
# Result parts in merge order, and the audit column of each.
PARTS = ["likelihood", "gsm8k", "ifeval"]
PART_AUDIT_COLUMNS = {"likelihood": "_lh_file", "gsm8k": "_gsm8k_file", "ifeval": "_ifeval_file"}
# (label, method, bits) in table order
METHOD_ROWS = [
    ("fp16", "(baseline)", "FP16"),
    ("awqW4A16", "AWQ", "W4A16"),
    ("gptqW4A16", "GPTQ", "W4A16"),
    ("rtnW4A16", "RTN", "W4A16"),
    ("rtnW8A16", "RTN", "W8A16"),
    ("smoothW8A8", "SmoothQuant", "W8A8"),
]
SCHEME_ROWS = ["F16", "Q8_0", "Q5_K_M", "Q4_K_M", "Q4_0"]
ACCURACY_MODEL = "Qwen2.5-0.5B-Instruct"
SCHEME_ENGINE = "llama.cpp"
# Start of the names of result files, ahead of label and part.
METHOD_FILE_PREFIX = "qwen2.5-0.5b-instruct"
SCHEME_FILE_PREFIX = "tabel4"

# --- fixed values: engine workload and telemetry -----------------------------------
PROMPT_TOKENS = 256
GENERATE_TOKENS = 64
BASELINE_TOKENS_PER_SECOND = 11.5
POWER_PATTERN = r"VDD_IN (\d+)mW"
RAM_PATTERN = r"RAM (\d+)/\d+MB"
GPU_PATTERN = r"GR3D_FREQ (\d+)%"
ENGINE_SUMMARY_COLUMNS = [
    "label",
    "prompt_eval_tok_s",
    "prompt_eval_std",
    "generation_tok_s",
    "generation_std",
    "latency_total_ms",
    "throughput_overall_tok_s",
    "peak_ram_mb",
    "ram_delta_mb",
    "avg_power_mw",
    "energy_per_token_mj",
    "avg_gpu_util_pct",
    "speedup_vs_hf_fp16",
]
# Titles of the lines of an engine report, padded to one width.
ENGINE_REPORT_TITLES = [
    "Label",
    "Prompt eval (pp256)",
    "Generation  (tg64)",
    "Latency (256+64 tok)",
    "Throughput overall",
    "Peak RAM",
    "Avg power (VDD_IN)",
    "Avg GPU util",
    "Energy / token",
    "Speedup vs HF-FP16",
]
ENGINE_REPORT_WIDTH = 22
# Columns of the accuracy report after the names: width of a score, the delta and the status.
SCORE_WIDTH, DELTA_WIDTH, STATUS_WIDTH = 9, 11, 14
# Columns of the run report: title and width.
RUN_REPORT_COLUMNS = [("Method", 12), ("Latency(ms)", 14), ("Tput(tok/s)", 14), ("Mem(MB)", 12), ("PPL", 0)]
RUN_REPORT_RULE = 65
KNOWN_SCHEMES = [
    "F32", "F16", "BF16",
    "Q8_0", "Q6_K",
    "Q5_K_M", "Q5_K_S", "Q5_0", "Q5_1",
    "Q4_K_M", "Q4_K_S", "Q4_0", "Q4_1",
    "Q3_K_L", "Q3_K_M", "Q3_K_S",
    "Q2_K",
    "IQ4_XS", "IQ4_NL", "IQ3_M", "IQ3_S", "IQ3_XS", "IQ3_XXS",
    "IQ2_M", "IQ2_S", "IQ2_XS", "IQ2_XXS", "IQ1_M", "IQ1_S",
]

# --- fixed values: published codebook, answer patterns, chat format -----------------
# 4-bit NormalFloat levels.
NF4_LEVELS = [
    -1.0,
    -0.6961928009986877,
    -0.5250730514526367,
    -0.39491748809814453,
    -0.28444138169288635,
    -0.18477343022823334,
    -0.09105003625154495,
    0.0,
    0.07958029955625534,
    0.16093020141124725,
    0.24611230194568634,
    0.33791524171829224,
    0.44070982933044434,
    0.5626170039176941,
    0.7229568362236023,
    1.0,
]
STRICT_ANSWER_PATTERN = r"#### (\-?[0-9\.\,]+)"
FLEXIBLE_ANSWER_PATTERN = r"(-?[$0-9.,]{2,})|(-?[0-9]+)"
CHAT_TURN_START = "<|im_start|>"
CHAT_TURN_END = "<|im_end|>"

# The characters Python counts as white space in str.strip() and str.split().
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0"
    "\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008"
    "\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
# The same characters as a pattern: Unicode white space and the four separators U+001C to U+001F.
WHITESPACE_RUN = r"(?U)[\s\x1C-\x1F]+"

# Which linear layers read the output of a norm, by the ends of their names inside a block.
NORM_READERS = [
    ("input_layernorm", "self_attn.q_proj"),
    ("input_layernorm", "self_attn.k_proj"),
    ("input_layernorm", "self_attn.v_proj"),
    ("post_attention_layernorm", "mlp.gate_proj"),
    ("post_attention_layernorm", "mlp.up_proj"),
    ("self_attn_layer_norm", "self_attn.q_proj"),
    ("self_attn_layer_norm", "self_attn.k_proj"),
    ("self_attn_layer_norm", "self_attn.v_proj"),
    ("ln_1", "attn.c_attn"),
    ("ln_2", "mlp.c_fc"),
]
