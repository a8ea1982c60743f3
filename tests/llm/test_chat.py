import hashlib
import random

import numpy as np
import pyarrow as pa

from bitledger.llm import chat

PIECES = ["<|im_start|>", "<|im_end|>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<", "|", "\\", "[", "s>", "\n", "é", "hi ", ""]


def turns(spark, rows):
    return spark.createDataFrame(
        [(*r, "x") for r in rows], "conv_id bigint, turn bigint, role string, text string, formatted string"
    )


def expected(rows):
    out = {}
    key = lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] is not None, r[3] or "")
    for conv, _, role, text in sorted(rows, key=key):
        out.setdefault(conv, []).append((role or "", text or ""))
    return out


def check(spark, rows):
    chats = chat.format_chat(turns(spark, rows))
    found = {r.conv_id: r for r in chats.collect()}
    digests = {r.conv_id: r for r in chat.read_back(chats).collect()}
    want = expected(rows)
    assert set(found) == set(want)
    for conv, parts in want.items():
        data = found[conv].formatted.encode()
        assert chat.parse_turns(data) == [(r.encode(), t.encode()) for r, t in parts]
        assert data.count(chat.START) == data.count(chat.END) == len(parts) == found[conv].n_turns
        loss = b"".join(chat.unescaped(data[s.start : s.end]) for s in found[conv].loss)
        assert loss.decode() == "".join(t for r, t in parts if r == "assistant")
        row = digests[conv]
        assert row.turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in parts).encode()).hexdigest()
        assert row.loss_sha256 == hashlib.sha256(loss).hexdigest()
        assert (row.loss_chars, row.formatted_chars) == (len(loss.decode()), len(found[conv].formatted))


def test_round_trip_of_control_strings_nulls_and_repeats(spark):
    rng = random.Random(4)
    rows = []
    for k in range(400):
        text = None if k % 50 == 0 else "".join(rng.choice(PIECES) for _ in range(rng.randrange(12)))
        role = rng.choice(["user", "assistant", "system", None, "a\nb\\n", "<|im_end|>"])
        rows.append((rng.choice([*range(60), None]), rng.choice([None, 0, 1, 2, 3]), role, text))
    check(spark, rows + rows[:20])


def test_long_segments_and_a_hot_conversation(spark):
    long = "wörd </s> " * 30_000
    rows = [(1, 0, "user", long), (1, 1, "assistant", long), (2, 0, "assistant", "x")]
    rows += [(3, t, ["user", "assistant"][t % 2], f"turn {t} [INST]") for t in range(5000)]
    check(spark, rows)


def test_empty_table(spark):
    chats = chat.format_chat(turns(spark, [(1, 0, "user", "a")]).limit(0))
    assert chats.count() == 0 and chat.read_back(chats).count() == 0


def test_assembly_of_slices():
    texts = pa.array(["aa", "b", "", "ccc"]).slice(1)
    data, ends, first, last = chat.assemble(pa.array(["u", "v", "w"]), texts)
    whole = data.tobytes()
    assert [whole[a:b] for a, b in zip(first, last)] == [b"b", b"", b"ccc"]
    assert np.array_equal(ends, [len(whole[:e]) for e in ends])
