"""Turns that are formatted where they lie read back like whole conversations."""

import hashlib
import random

from pyspark.sql import functions as F

from tessera.llm import chat

PARTS = ["[INST]", "[/INST]", "</s>", "<s>", "[BOT]", "[TURN:x]", "[/TURN]", "\\", "[", "]", "<", "/", "s>", " ", "\n", "a", "é"]


def some_turns(rng, n):
    return [(rng.choice(["user", "assistant", "system", "", "tool ]"]), "".join(rng.choices(PARTS, k=rng.randrange(9)))) for _ in range(n)]


def test_turns_one_after_the_other_read_back():
    rng = random.Random(4)
    for _ in range(2000):
        turns = some_turns(rng, rng.randrange(5))
        assert chat.parse("".join(chat.format_turns([turn])[0] for turn in turns)) == turns


def test_digests_of_turns_and_of_conversations_are_the_same(spark):
    rng = random.Random(9)
    rows = [(conv, turn, *said) for conv in (1, 2, 3, None) for turn, said in enumerate(some_turns(rng, 40))] + [(5, None, None, None), (6, 1, "assistant", "word " * 100_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("level", F.lit("own")).repartition(5)
    names = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256")
    apart, whole = ({tuple(r[n] for n in names) for r in read.collect()} for read in (chat.read_back_turns(chat.format_turn_rows(df)), chat.read_back(chat.format_chat(df))))
    assert apart == whole and len(apart) == 6
    assert chat.read_back_turns(chat.format_turn_rows(df.limit(0))).count() == 0


def test_turns_of_one_place_go_by_their_texts(spark):
    texts = ["a", "a B", "a b", "a]", "a</s>", "a [INST] b", "a\\", "", None, "[/INST]", "\\[", "a"]
    rows = [(conv, 0, role, text) for conv in (1, 2) for role in ("user", "assistant", None) for text in texts]
    names = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256")
    want = "".join(f"{role}\n{text}\n" for role, text in sorted((role or "", text or "") for _, _, role, text in rows[: len(rows) // 2]))
    for parts in (1, 7):
        df = spark.createDataFrame(rows[::-1], "conv_id long, turn long, role string, text string").repartition(parts)
        apart, whole = ({tuple(r[n] for n in names) for r in read.collect()} for read in (chat.read_back_turns(chat.format_turn_rows(df)), chat.read_back(chat.format_chat(df))))
        assert apart == whole and {r[2] for r in apart} == {hashlib.sha256(want.encode()).hexdigest()}
