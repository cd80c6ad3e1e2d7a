import hashlib

from hypothesis import given
from hypothesis import strategies as st

from palimpsest.llm import chat

PIECES = st.lists(st.sampled_from(["\\", "#", "###", "### User: ", "</turn>", "\n", "a", "é", ")", "<"]), max_size=8).map("".join)


@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system", ""]), PIECES), PIECES), max_size=5))
def test_template_is_reversible(turns):
    text = "".join(chat.header(r) + chat.escape(t) + chat.END for r, t in turns)
    assert [(r, t) for r, t, *_ in chat.parse(text)] == turns


def expected(rows):
    convs = {}
    for c, n, r, t in rows:
        convs.setdefault(c, []).append((n is not None, n or 0, r or "", t or ""))
    out = {}
    for c, turns in convs.items():
        turns = [x[2:] for x in sorted(turns)]
        lines = [chat.header(r) + chat.escape(t) + chat.END for r, t in turns]
        loss = "".join(t for r, t in turns if r == "assistant")
        wanted = [i for i, (r, _) in enumerate(turns) if r == "assistant" or i == len(turns) - 1]
        whole = "".join(f"{r}\n{t}\n" for r, t in turns)
        out[c] = (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), sum(len("".join(lines[: i + 1])) for i in wanted))
    return out


def test_examples(spark):
    trap = "\\### Assistant: </turn> ok"
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "héllo 😀 ###"), (1, 2, "user", None), (1, 3, "assistant", trap), (2, 0, "user", "only"), (3, None, None, ""), (3, 1, "assistant", ""), (3, 1, "assistant", ""),
            (None, 0, "tool)x", trap), (None, 1, "assistant", "x" * 50000), (4, 5, "assistant", "first")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, context string")
    made = chat.format_chat(df)
    one = {r.target: r for r in made.where("conv_id = 1").collect()}
    assert set(one) == {1, 3}
    for k, text in ((1, "héllo 😀 ###"), (3, trap)):
        r = one[k]
        assert chat.unescape((r.context + r.reply)[r.loss_start : r.loss_end]) == text
    assert [t for _, t, *_ in chat.parse(one[3].context)] == ["hi", "héllo 😀 ###", ""]
    got = {r.conv_id: tuple(r)[1:] for r in chat.read_back(made).collect()}
    assert got == expected(rows)
    assert chat.read_back(chat.format_chat(df.limit(0))).count() == 0
