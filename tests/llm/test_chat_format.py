import hashlib
import random

import pytest
from oracle import both, connect, rows_of
from pyspark.sql import functions as F

from tallyseal.llm import chat_format

MARKS = [chat_format.START, chat_format.END, "<|", "<\\|", "<\\\\|", "\\", "|", ">", "<", "\n", "<|im_end", "|>", "<|lf|>", "é", "\U0001f600", "a", " ", "\r\n", "<|im_end|>\n"]


def conversations(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


@pytest.fixture(scope="module")
def hard_rows():
    rng = random.Random(11)
    rows = [(k, t, rng.choice(["user", "assistant", "system", "", "a\nb", "<|lf|>", "<|im_start|>", "<\\|"]), "".join(rng.choice(MARKS) for _ in range(rng.randrange(8)))) for k in range(80) for t in range(rng.randrange(1, 6))]
    return rows + [(200, 1, "assistant", None), (200, 0, None, "x"), (201, None, "assistant", "first"), (201, 0, "assistant", "b"), (201, 0, "assistant", "a"), (201, 0, "assistant", "a"), (None, 1, "user", "q"), (None, 2, "assistant", "r"), (202, 0, "assistant", "<|im_end|>" * 20_000)]


def expected(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted(((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == conv))
        loss = "".join(t for *_, role, t in own if role == "assistant")
        out[conv] = (len(own), hashlib.sha256("".join(f"{role}\n{t}\n" for *_, role, t in own).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def py_parse(text):
    """The grammar in plain Python, character by character."""
    turns, at = [], 0
    while at < len(text):
        assert text.startswith(chat_format.START, at)
        line = text.index("\n", at)
        end = text.index(chat_format.END, at)
        role, content = text[at + len(chat_format.START) : line], text[line + 1 : end]
        assert line < end and chat_format.START not in role + content and text.startswith(chat_format.CLOSE, end)
        turns.append(tuple(plain(x) for x in (role.replace(chat_format.LINE, "\n"), content)))
        at = end + len(chat_format.CLOSE)
    return turns


def plain(s):
    out, i = "", 0
    while i < len(s):
        j = i + 1
        if s[i] == "<":
            while j < len(s) and s[j] == "\\":
                j += 1
            out += "<" + s[i + 2 : j] if j > i + 1 and j < len(s) and s[j] == "|" else s[i:j]
        else:
            out += s[i]
        i = j
    return out


def test_round_trip(spark, hard_rows):
    made = chat_format.format_conversations(conversations(spark, hard_rows)).collect()
    want = expected(hard_rows)
    assert len(made) == len(want)
    for r in made:
        turns = py_parse(r["formatted"])
        n, told, loss_chars, loss = want[r["conv_id"]]
        assert (r["n_turns"], hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()) == (n, told)
        under = "".join(plain(r["formatted"][s["start"] : s["start"] + s["length"]]) for s in r["layout"] if s["loss"])
        assert len(under) == loss_chars and hashlib.sha256(under.encode()).hexdigest() == loss
        assert all(r["formatted"].startswith(chat_format.START, s["turn_start"]) for s in r["layout"])


def test_only_conflicts_are_escaped(spark):
    rows = [(1, 0, "user", "a <| b <|x|> \\ |>"), (1, 1, "assistant", "<\\|"), (1, 2, "user", "<|im_start|><|x|>")]
    (r,) = chat_format.format_conversations(conversations(spark, rows)).collect()
    assert r["formatted"] == "<|im_start|>user\na <| b <|x|> \\ |><|im_end|>\n<|im_start|>assistant\n<\\\\|<|im_end|>\n<|im_start|>user\n<\\|im_start|><\\|x|><|im_end|>\n"


@pytest.mark.parametrize("text", ["x", "<|im_start|>user", "<|im_start|>user\nx", "<|im_start|>user\nx<|im_end|>", "<|im_start|>user\nx<|im_end|>\ny", "<|im_start|>user<|im_end|>\n", "<|im_start|>user\n<|im_end|>\n<|im_end|>\n", " <|im_start|>user\nx<|im_end|>\n"])
def test_parser_refuses_what_breaks_the_grammar(spark, text):
    assert spark.range(1).select(chat_format.parse(F.lit(text))).first()[0] is None


def test_parser_takes_an_empty_text(spark):
    assert spark.range(1).select(chat_format.parse(F.lit(""))).first()[0] == []


def test_query_equals_sql_and_brute_force(spark, hard_rows, tmp_path):
    ours, theirs = both(spark, chat_format.op13_chat_format, chat_format.SQL, "/root/testdata/sf0.001")
    assert ours == theirs
    path = str(tmp_path)
    conversations(spark, hard_rows).withColumn("piece", F.lit(1)).withColumn("n_turns", F.lit("x")).coalesce(1).write.parquet(f"{path}/conversations.parquet")
    df = chat_format.op13_chat_format(spark, path)
    got = df.collect()
    hard = [(-1, k, role, chat_format.HARD) for k, role in enumerate(("user", "assistant"))]
    assert {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in got} == expected(hard_rows + hard)
    con = connect("/nowhere")
    con.sql(f"create view conversations as select * from '{path}/conversations.parquet/*.parquet'")
    rel = con.sql(chat_format.SQL)
    assert rows_of(df.columns, got) == rows_of(rel.columns, rel.fetchall())


def test_plan_has_one_shuffle_and_no_python(spark):
    plan = chat_format.op13_chat_format(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def test_empty_table(spark, tmp_path):
    conversations(spark, []).write.parquet(f"{tmp_path}/conversations.parquet")
    assert [r["conv_id"] for r in chat_format.op13_chat_format(spark, str(tmp_path)).collect()] == [-1]
