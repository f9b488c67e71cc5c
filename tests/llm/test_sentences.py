import pytest

from loomwright.llm import boundaries as B
from loomwright.llm.sentences import sentence_ends

CASES = [
    ("", []),
    (" \n\t ", []),
    ("Hello there. How are you?", ["Hello there.", "How are you?"]),
    ("Dr. Smith paid $3.50, e.g. for No. 5. Then he left.", ["Dr. Smith paid $3.50, e.g. for No. 5.", "Then he left."]),
    ("He stayed until 9 p.m. The rest left at 6 p.m. on foot.", ["He stayed until 9 p.m.", "The rest left at 6 p.m. on foot."]),
    ('She wrote, "Wait. Then go." and left. "Yes. It is." Then more.', ['She wrote, "Wait. Then go." and left.', '"Yes. It is."', "Then more."]),
    ("Wait... and see. So what now...? Fine", ["Wait... and see.", "So what now...?", "Fine"]),
    ("One line\ngoes on here. Two.", ["One line\ngoes on here.", "Two."]),
    ("User: hi\nAssistant: hello", ["User: hi", "Assistant: hello"]),
    ("# Title\n\nText. More.\n\n- a. b\n- second", ["# Title", "Text.", "More.", "- a. b", "- second"]),
    ("<think>\n\nA b. C d.\n\n</think>", ["<think>", "A b.", "C d.", "</think>"]),
    ("Look:\n```python\nx. y\n\nz = 1\n```\nDone. Ok.", ["Look:", "```python\nx. y\n\nz = 1\n```", "Done.", "Ok."]),
    ("老师问：“书签在哪里？”数据库很大。他说“慢一点。”是最好的。", ["老师问：“书签在哪里？”", "数据库很大。", "他说“慢一点。”是最好的。"]),
    ("「開けるな！」とあり、もう5年です。次。", ["「開けるな！」とあり、もう5年です。", "次。"]),
    ("Am 2. Mai stieg er, z. B. hier. Gut.", ["Am 2. Mai stieg er, z. B. hier.", "Gut."]),
    ("Sie wohnt in der Kalstr. 28 und prüft. Gut. Er wohnt in der Ostr. Dann", ["Sie wohnt in der Kalstr. 28 und prüft.", "Gut.", "Er wohnt in der Ostr.", "Dann"]),
    ("В 83 г. в городе вышло 4 тыс. копий, т. е. вдвое. Да.", ["В 83 г. в городе вышло 4 тыс. копий, т. е. вдвое.", "Да."]),
    ("कितना अच्छा है! “पहले नापो। फिर।” और चला गया।", ["कितना अच्छा है!", "“पहले नापो। फिर।” और चला गया।"]),
    ("ค่าเพิ่มจาก 18.13 เป็น 52 ก่อน วางตะแกรงไว้", ["ค่าเพิ่มจาก 18.13 เป็น 52 ก่อน", "วางตะแกรงไว้"]),
    ("(See above. It works.) The end", ["(See above. It works.)", "The end"]),
    ("Joined here.Next one. See docs.example.invalid now.", ["Joined here.", "Next one.", "See docs.example.invalid now."]),
]


@pytest.mark.parametrize("text,want", CASES)
def test_units(text, want):
    got, at = [], 0
    for e in B.unit_ends(text):
        got.append(text[at:e].strip())
        at = e
    assert got == want


WHOLE = 1 << 60
PART = "A b. C d.\n\n```\nx. y\n\nz.\n```\n\n- one. Two.\n\nUser: hi. Yes.\n\n~~~\ncode\n\n```\n\n~~~\n\n"


@pytest.mark.parametrize("text", [
    PART * 40 + "```\nopen. Never\n\nclosed",
    "A b “c d.\r\nE f” (g.\r\nH i) j.\r\n" * 30 + "\r\nK. L",
    "A b.\r\n\r\n```\r\nx. y\r\n" * 9 + " \r\n\r\n",
    "A b.\n\u200b \u200b\nC d. E\r\n" * 9,
    "He said “one. Two (three. Four “five. Six” seven. Eight) nine. Ten.” And left. " * 30,
    "# A heading that is long. And goes on\nText (here. There\nand. Then) so. " * 20,
    "ค่าเพิ่มจาก ก่อน วางตะแกรงไว้\n  แล้ว (ไป กลับ) มา " * 20,
])
def test_chunks_of_any_size_agree(text):
    want = B.unit_ends(text, WHOLE)
    for size in (1, 17, 60, 400):
        chunks = B.chunks_of(text, size)
        assert "".join(text[c.start : c.end] for c in chunks) == text and (len(chunks) > 1 or size == 400)
        assert B.unit_ends(text, size) == want


PIECES = ["Word one. ", "Two ", "“", "”", "(", ")", "«", "»", "„", "\"", "'", "‘", "’", "「", "」", "e.g. ", "3.5 ", "\n", "\n\n", "\r\n", "- item ", "# head ", "User: ", "```\n", "~~~", "ไทย ", "字。", "! ", "? ", "... ", "\u200b", "   ", "it's ", ": ", "\u2028", "<a b>\n"]


def test_random_texts_in_chunks_of_any_size():
    import random

    rng = random.Random(11)
    for _ in range(1500):
        text = "".join(rng.choice(PIECES) for _ in range(rng.randint(1, 60)))
        want = B.unit_ends(text, WHOLE)
        assert want == sorted(set(want))
        for size in (1, 5, 23):
            assert B.unit_ends(text, size) == want, (text, size)


@pytest.mark.parametrize("text,want", [
    ("(a. Two (three (four) five) six. Seven) eight. Nine", ["(a. Two (three (four) five) six. Seven) eight.", "Nine"]),
    ("«One. He said «no» twice. Done.» Next.", ["«One. He said «no» twice. Done.»", "Next."]),
    ("“One. He said “no” twice. Done.” Next.", ["“One. He said “no” twice. Done.”", "Next."]),
    ("‘" + "Word here. " * 300 + "End.’ Next.", ["‘" + "Word here. " * 300 + "End.’", "Next."]),
    ("He ((left. Then) came.", ["He ((left. Then) came."]),
    ("„Gut. Ja.“ Er ging. »So. Da.« Sie kam.", ["„Gut. Ja.“", "Er ging.", "»So. Da.«", "Sie kam."]),
])
def test_pairs_of_any_depth_and_length(text, want):
    got, at = [], 0
    for e in B.unit_ends(text):
        got.append(text[at:e].strip())
        at = e
    assert got == want


def test_a_line_break_of_two_characters_is_no_blank_line():
    prose = "The cat sat on the mat and\r\nlooked. " * 2_600
    assert len(B.unit_ends(prose)) == 2_600


def test_operator_on_dirty_rows(spark):
    long = "One. Two.\n\n```\na. b\n\nc\n```\n\n" * 300
    df = spark.createDataFrame([(1, "Hi. There", "x"), (2, None, "x"), (3, "", "x"), (4, " ", None), (1, "Hi. There", "x"), (5, long, "x")], "doc_id long, text string, sent_end string")
    rows = [(r["doc_id"], r["sent_end"]) for r in sentence_ends(df, long_text=200, long_chunk=300).collect()]
    assert sorted(e for d, e in rows if d == 1) == [3, 3, 9, 9]
    assert sorted(e for d, e in rows if d == 5) == B.unit_ends(long, WHOLE)
    assert {d for d, _ in rows} == {1, 5}
    assert sentence_ends(df.limit(0)).count() == 0


def test_one_long_paragraph_in_rows_of_its_chunks(spark):
    long = "She said “it is so. Perhaps (or not. Who knows) it is.” He nodded. Ja „gut. Nein“ und so. " * 200
    rows = spark.createDataFrame([(1, long), (2, long + "\n\n```\nx. y\n"), (3, "(" + long)], "doc_id long, text string")
    got = {}
    for r in sentence_ends(rows, long_text=100, long_chunk=700).collect():
        got.setdefault(r["doc_id"], []).append(r["sent_end"])
    assert {k: sorted(v) for k, v in got.items()} == {r["doc_id"]: B.unit_ends(r["text"], WHOLE) for r in rows.collect()}


@pytest.mark.parametrize("text", ["it is 'tis and " * 3000, "a ( b " * 9000, "- item here. Yes\n" * 4000, "." * 40000, 'say "no ' * 9000, "word word. Next\n" * 9000, "(" * 30000, "«" * 30000])
def test_long_odd_texts_take_linear_time(text):
    import time

    began = time.time()
    ends = B.unit_ends(text)
    assert ends == B.unit_ends(text, WHOLE)
    assert ends[-1] == len(text.rstrip()) and time.time() - began < 5
