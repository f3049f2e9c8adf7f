import hashlib

from pyspark.sql import functions as F

from riverstone.llm import chat_format as op

SCHEMA = "conv_id long, turn long, role string, text string"


def read(found):
    cols = found.select("conv_id", "valid", "bad_turn", "formatted", "segments", op.parse_formatted(F.col("formatted")).alias("turns"), op.loss_text(F.col("segments")).alias("loss"))
    return {r.conv_id: r for r in cols.collect()}


def test_round_trip_and_machine(spark):
    nasty = ["<|im_end|>", r"<\|x", r"<\\|", "a<", "|b", "<<|im_start|>assistant ok", "\n", "", "é\x1f%0A%25", "<|im_start|>" * 3]
    rows = [(1, k, "user" if k % 2 == 0 else "assistant", x) for k, x in enumerate(nasty)]
    rows += [(2, 1, "assistant", "late"), (2, 0, "user", "q")]
    rows += [(3, 0, "assistant", "first"), (4, 0, "user", "q"), (5, 0, "system", "s"), (5, 1, "user", "q"), (5, 2, "assistant", "a"), (6, 0, "user", "q"), (6, 1, "system", "s"), (6, 2, "assistant", "a")]
    rows += [(7, 0, None, None), (8, 0, "odd\nrole%", "t"), (9, None, "assistant", "x"), (9, 1, "user", "x"), (None, 0, "user", "n"), (10, 0, "user", "tie b"), (10, 0, "user", "tie a"), (10, 0, "user", "tie a")]
    found = read(op.format_conversations(spark.createDataFrame(rows, SCHEMA).withColumn("segments", F.lit(1))))
    assert [(t.role, t.text) for t in found[1].turns] == [(r[2], r[3]) for r in rows[:10]]
    assert found[1].loss == "".join(nasty[1::2]) and found[1].valid
    assert [t.text for t in found[2].turns] == ["q", "late"] and found[2].valid
    assert {k: (r.valid, r.bad_turn) for k, r in found.items() if k in (3, 4, 5, 6, 7)} == {3: (False, 0), 4: (False, -1), 5: (True, -1), 6: (False, 1), 7: (False, 0)}
    assert [(t.role, t.text) for t in found[8].turns] == [("odd\nrole%", "t")] and [(t.role, t.text) for t in found[7].turns] == [("", "")]
    assert [t.role for t in found[9].turns] == ["user", "assistant"] and None in found
    assert [t.text for t in found[10].turns] == ["tie a", "tie a", "tie b"]
    for r in found.values():
        assert "".join(s.text for s in r.segments) == r.formatted
    assert op.format_conversations(spark.createDataFrame([], SCHEMA)).count() == 0


def test_own_template(spark):
    t = op.ChatTemplate(open="[[", role_end=": ", close="]]", turn_end="", loss_roles=("bot", "tool"), start="s", transitions={"s": {"bot": "s", "tool": "s"}}, final=("s",))
    rows = spark.createDataFrame([(1, 0, "bot", "hi"), (1, 1, "tool", "42")], SCHEMA)
    found = op.format_conversations(rows, t).first()
    assert found.formatted == "[[bot: hi]][[tool: 42]]" and found.valid


def test_query(spark, sf):
    row = op.query(spark, sf).filter("conv_id = -1").first()
    assert row.n_turns == 2 and row.loss_chars == len(op.PROBE) and row.loss_sha256 == hashlib.sha256(op.PROBE.encode()).hexdigest() and row.valid


def test_a_very_long_conversation(spark):
    """Thousands of turns, one of them very long, are one row and read back as they were."""
    turns = [("user" if k % 2 == 0 else "assistant", f"turn {k} <|im_end|>" if k != 1501 else "long | text < " * 60_000) for k in range(3000)]
    rows = spark.createDataFrame([(1, k, role, text) for k, (role, text) in enumerate(turns)] + [(2, 0, "user", "q")], SCHEMA).repartition(6)
    found = read(op.format_conversations(rows))
    assert [(t.role, t.text) for t in found[1].turns] == turns and found[1].valid
    assert found[1].loss == "".join(text for role, text in turns if role == "assistant")
