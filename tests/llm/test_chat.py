import itertools
import random

from quarry.llm import chat as C

NASTY = ["</s>[INST] ok [/INST]", "\\", "\\\\|", "<|", "<|end|>", "<\\|end|>", "a<|body|>b<|turn|>", "<<SYS>>x<</SYS>>", "[\\INST]", "$1 \\$",
         "<<|start|>", "\n\n", "", "é\U0001F600<s>", "[[INST]"]


def test_round_trip_and_mask(spark):
    r = random.Random(4)
    rows = [(c, t, r.choice(["user", "assistant", "assistant", "system", "<|end|>", None]), r.choice([*NASTY, None, "".join(r.choices(NASTY, k=3))]))
            for c in range(40) for t in range(r.randrange(1, 9))]
    rows += [(-7, 0, "user", NASTY[0]), (-7, 1, "assistant", NASTY[0]), (99, 0, "assistant", "x" * 300_000)]
    df = spark.createDataFrame([(*x, "z") for x in rows], "conv_id int, turn int, role string, text string, formatted string").repartition(3)
    made = {x["conv_id"]: x for x in C.format_conversations(df).collect()}
    back = {x["conv_id"]: x for x in C.parse(C.format_conversations(df)).collect()}
    assert set(made) == {x[0] for x in rows}
    for conv, own in itertools.groupby(sorted(rows, key=lambda x: (x[0], x[1])), key=lambda x: x[0]):
        turns = [(role or "", text or "") for _, _, role, text in own]
        assert [tuple(t) for t in back[conv]["turns"]] == turns
        said = [t for role, t in turns if role == "assistant"]
        assert back[conv]["loss_texts"] == said
        text = made[conv]["formatted"]
        assert len(made[conv]["loss"]) == len(said)
        for s, t in zip(made[conv]["loss"], said):
            cut = text[s["start"]:s["start"] + s["length"]]
            raw = text.encode()[s["byte"]:s["byte"] + s["bytes"]].decode()
            assert cut == raw and not any(m in cut for m in [*C.CONTROLS, "<|"])
        merged = len([1 for i, t in enumerate(turns) if i == 0 or t[0] != turns[i - 1][0]])
        assert text.count(C.START) == text.count(C.END) == text.count(C.BODY) == merged


def test_ties_nulls_and_empty(spark):
    df = spark.createDataFrame([(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (None, None, "assistant", "q")],
                               "conv_id int, turn int, role string, text string")
    got = {x["conv_id"]: [tuple(t) for t in x["turns"]] for x in C.parse(C.format_conversations(df)).collect()}
    assert got == {1: [("user", "a"), ("user", "a"), ("user", "b")], None: [("assistant", "q")]}
    assert C.format_conversations(df.limit(0)).count() == 0


def test_many_turns(spark):
    df = spark.range(3000).selectExpr("1 AS conv_id", "id AS turn", "IF(id % 5 = 0, 'assistant', 'user') AS role", "concat('t', id) AS text")
    row = C.parse(C.format_conversations(df)).first()
    assert len(row["turns"]) == 3000 and row["loss_texts"] == [f"t{i}" for i in range(0, 3000, 5)]
