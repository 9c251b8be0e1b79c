from weftgraph.llm.chat_format import chat_format, maximal_conversations

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    """Kept conversations: those whose rows are not the first rows, up to some turn, of a longer one,
    and of equal ones that with the smallest id."""
    convs = {}
    for c, t, r, x in rows:
        if c is not None:
            convs.setdefault(c, set()).add(((False, 0) if t is None else (True, t), r or "unknown", x or ""))
    kept = []
    for c, own in convs.items():
        last = max(t for t, _, _ in own)
        longer = any(d != c and len(o) > len(own) and {x for x in o if x[0] <= last} == own for d, o in convs.items())
        twin = any(d < c and o == own for d, o in convs.items())
        if not longer and not twin:
            kept.append((c, len(own)))
    return sorted(kept)


ROWS = [(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (2, 0, "user", "hi"), (2, 1, "assistant", "yes"), (2, 2, "user", "and?")]
ROWS += [(3, 0, "user", "hi"), (3, 1, "assistant", "no"), (4, 0, "user", "hi"), (5, 0, "user", "hi"), (5, 1, "assistant", "yes"), (5, 2, "user", "and?")]
ROWS += [(6, None, None, None), (6, 0, "user", "x"), (7, None, "unknown", ""), (None, 0, "user", "hi"), (8, 0, "user", "hi"), (8, 0, "user", "hi"), (8, 0, "system", "s")]
ROWS += [(9, i, "user", f"turn {i}") for i in range(700)] + [(10, i, "user", f"turn {i}") for i in range(300)] + [(11, i, "user", f"turn {i}") for i in (*range(299), 300)]


ROWS += [(12, None, "user", "none"), (12, -2, "user", "two"), (12, -1, "user", "one"), (13, None, "user", "none"), (14, -1, "user", "none"), (14, 0, "user", "zero"), (15, None, "user", "none"), (15, 0, "user", "zero")]
ROWS += [(16, None, "user", "same start of a text that is longer than what the order goes by " + str(i)) for i in range(600)]


def test_maximal(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    for block in (2, 256):
        assert sorted(map(tuple, maximal_conversations(df, block).collect())) == brute(ROWS)


def test_rendering(spark):
    got = {}
    for r in chat_format(spark.createDataFrame(ROWS, SCHEMA), block=100).orderBy("conv_id", "part").collect():
        got[r.conv_id] = got.get(r.conv_id, "") + r.rendered
    assert got[3] == "<|user|>\nhi\n<|assistant|>\nno\n"
    assert got[6] == "<|unknown|>\n\n<|user|>\nx\n"
    assert got[12] == "<|user|>\nnone\n<|user|>\ntwo\n<|user|>\none\n"
    assert got[14] == got[15] == "<|user|>\nnone\n<|user|>\nzero\n" and 13 not in got
    assert sorted(got[16].split("<|user|>\n")[1:]) == sorted(f"{r[3]}\n" for r in ROWS if r[0] == 16)
    assert got[9] == "".join(f"<|user|>\nturn {i}\n" for i in range(700))


def test_parts_are_bounded_by_rows(spark):
    """Rows without a turn number, or all of one turn, are cut like others; long texts are whole."""
    rows = [*ROWS, *[(17, 3, "user", f"r{i}") for i in range(500)], (18, 0, "user", "y" * 300_000)]
    for parts in (1, 7):
        got = chat_format(spark.createDataFrame(rows, SCHEMA).repartition(parts), block=100).collect()
        assert max(r.rendered.count("<|") for r in got) == 100 and all(r.rendered for r in got)
        for conv, n in ((16, 600), (17, 500), (9, 700)):
            assert sorted(r.part for r in got if r.conv_id == conv) == list(range(n // 100))
        assert [r.rendered for r in got if r.conv_id == 18] == ["<|user|>\n" + "y" * 300_000 + "\n"]


def test_empty(spark):
    assert chat_format(spark.createDataFrame([], SCHEMA)).count() == 0
    df = spark.createDataFrame([(1, 0, "user", "a", "z", 4, 5, 6)], SCHEMA + ", part string, n long, digest long, numbered long")
    assert chat_format(df).first()["rendered"] == "<|user|>\na\n"
