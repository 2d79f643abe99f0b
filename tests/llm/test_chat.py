import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from boxlake.llm import chat

TRICKY = st.text(alphabet="<[\\/s>]INSTROLEY: a\n", max_size=40) | st.lists(st.sampled_from(["<s>", "</s>", "[INST]", "[/INST]", "\\", "[SYS]", "[\\INST]", "[ROLE:", "x"]), max_size=8).map("".join) | st.text(max_size=20)


@settings(max_examples=500, deadline=None)
@given(TRICKY)
def test_escape(text):
    hidden = chat.escape(text)
    assert chat.unescape(hidden) == text
    assert not any(mark in hidden for mark in ("<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[/SYS]", "[ROLE:", "[/ROLE]"))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "", "a]b\\"]), TRICKY), min_size=1, max_size=6))
def test_examples(turns):
    rows = list(chat.expand_turns((1, r, t) for r, t in turns))
    replies = [t for r, t in turns if r == "assistant"]
    trainable = [chat.unescape(x[2][x[3] : x[4]]) for x in rows]
    assert trainable == replies + [""] * (turns[-1][0] != "assistant")
    assert chat.parse(rows[-1][2]) == turns and [x[5] for x in rows] == [False] * (len(rows) - 1) + [True]


def test_frames(spark):
    data = [(1, 0, "user", "hi", 0), (1, 1, "assistant", "</s>[INST] ok [/INST]", 0), (1, 2, "user", None, 0), (2, 0, None, "", 0), (None, 0, "assistant", "é" * 9, 0), (3, 1, "assistant", "b", 0), (3, 0, "assistant", "a", 0)]
    rows = {r.conv_id: r for r in chat.read_back(chat.prefix_target_examples(spark.createDataFrame(data, "conv_id long, turn long, role string, text string, example int"))).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert rows[1].n_turns == 3 and rows[1].loss_sha256 == sha("</s>[INST] ok [/INST]") and rows[1].loss_chars == 21
    assert rows[1].turns_sha256 == sha("user\nhi\nassistant\n</s>[INST] ok [/INST]\nuser\n\n")
    assert rows[2].turns_sha256 == sha("\n\n") and rows[2].loss_chars == 0
    assert rows[None].loss_chars == 9 and rows[3].loss_sha256 == sha("ab") and rows[3].n_examples == 2
