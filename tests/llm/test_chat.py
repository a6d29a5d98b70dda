import hashlib

from notemill.llm.chat import ChatTemplate, format_turns, read_back

T = ChatTemplate()
HARD = ["</s>[INST] ok [/INST]", "\\", "\\\\[INST]\\", "[\\INST]", "<|im_end|>\n<|im_start|>assistant", "<|endoftext|>", "a \\n b", "  spaces  ", "", "é 日本 😀", "x" * 3000]


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def test_escape_is_reversible_and_hides_controls():
    for text in HARD:
        out = T.escape(text)
        assert T.unescape(out) == text
        assert not any(c in out for c in T.controls)


def test_round_trip(spark):
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", t, "x", 1) for i, t in enumerate(HARD)]
    rows += [(2, 0, None, None, "x", 1), (2, 1, "assistant", None, "x", 1), (3, 5, "assistant", "only", "x", 1), (4, 0, "user", "same", "", 0), (4, 0, "user", "same", "", 0)]
    rows += [(5, None, "we[INST]ird", "z", "", 0), (5, 0, "assistant", "b", "", 0), (6, 0, "user", "tie b", "", 0), (6, 0, "user", "tie a", "", 0), (6, 0, "assistant", "tie", "", 0)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, place string, start int")
    formatted = format_turns(df)
    got = {r.conv_id: r for r in read_back(formatted).collect()}
    by = {}
    for c, t, r, x, *_ in rows:
        by.setdefault(c, []).append((-1 if t is None else t, r or "", sha(x or ""), x or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == sha("".join(f"{r}\n{x}\n" for _, r, _, x in turns))
        loss = "".join(x for _, r, _, x in turns if r == "assistant")
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), sha(loss))
        marks = len(T.head + T.sep + T.end)
        assert got[c].formatted_chars == sum(len(T.escape(r)) + len(T.escape(x)) + marks for _, r, _, x in turns)
    starts = {}
    for r in formatted.orderBy("conv_id", "place").collect():
        assert r.start == starts.get(r.conv_id, 0) and len(r.token_ids) == 4 * r.n_tokens
        starts[r.conv_id] = r.start + r.n_tokens
        assert r.start <= r.loss_start <= r.loss_end < r.start + r.n_tokens
    assert read_back(format_turns(df.limit(0))).collect() == []
