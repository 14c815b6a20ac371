import hashlib
import random
from collections import defaultdict

from counterscope.llm.chat import chat_digest, chat_examples

SCHEMA = "conv_id long, turn long, role string, text string"
PIECES = ["<|im_start|>", "<|im_end|>", "\\", "<", "|", "\n", "<\\|", "n", "\\n", "ok", "é", "assistant", "\U0001f600", ">"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected(rows):
    groups = defaultdict(list)
    for c, t, r, x in rows:
        groups[c].append((t is not None, t, r or "", x or ""))
    out = set()
    for c, turns in groups.items():
        turns.sort()
        loss = "".join(x for _, _, r, x in turns if r == "assistant")
        out.add((c, len(turns), sha("".join(f"{r}\n{x}\n" for _, _, r, x in turns)), len(loss), sha(loss)))
    return out


def test_everything_can_be_read_back(spark):
    rnd = random.Random(6)
    noise = lambda: "".join(rnd.choice(PIECES) for _ in range(rnd.randint(0, 6)))
    rows = []
    for c in range(150):
        for t in range(rnd.randint(1, 6)):
            role = rnd.choice(["user", "assistant", "system", "assistant", noise(), None])
            rows.append((c, t, role, rnd.choice([noise(), noise(), None])))
    rows += [(500, None, "user", "x"), (500, 1, "assistant", "y"), (500, 1, "assistant", "y"), (None, 0, "user", "lost id")]
    rows += [(501, t, "assistant" if t % 2 else "user", f"turn {t}") for t in range(60)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS pieces", "2 AS example", "'x' AS formatted")
    examples = chat_examples(df)
    digest = chat_digest(examples)
    assert {tuple(r)[:5] for r in digest.collect()} == expected(rows)
    assert not any(word in examples._jdf.queryExecution().toString() for word in ("Python", "Arrow"))
    for r in examples.collect():
        assert r.formatted.count("<|im_start|>") == r.formatted.count("<|im_end|>\n")
        if r.loss_length:
            assert r.formatted[r.loss_start + r.loss_length :] == "<|im_end|>\n"


def test_one_example_for_each_reply_and_one_for_the_rest(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (1, 2, "assistant", ""), (1, 3, "user", "c"), (2, 0, "user", "d")]
    got = [tuple(r) for r in chat_examples(spark.createDataFrame(rows, SCHEMA)).orderBy("conv_id", "example").collect()]
    a, b = "<|im_start|>user\na<|im_end|>\n", "<|im_start|>assistant\nb<|im_end|>\n"
    empty, c = "<|im_start|>assistant\n<|im_end|>\n", "<|im_start|>user\nc<|im_end|>\n"
    assert got == [
        (1, 0, a + b, len(a) + len("<|im_start|>assistant\n"), 1),
        (1, 1, a + b + empty, 0, 0),
        (1, 2, a + b + empty + c, 0, 0),
        (2, 0, "<|im_start|>user\nd<|im_end|>\n", 0, 0),
    ]
    assert chat_digest(chat_examples(spark.createDataFrame([], SCHEMA))).count() == 0
