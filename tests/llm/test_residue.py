import numpy as np

from siftlake.llm import residue
from siftlake.llm.lines import Scores

ABOUT = "\n".join(["The stipend stops during the summer break.", "Two reference letters are needed.", "Late forms are not entertained.", "Interviews can be held by video.", "Wards of staff are not eligible.", "Calls are answered on working days."])
PAGES = "page_id bigint, url string, final_url string, title string, text string"


def found(spark, texts, titles=None):
    rows = [(i, f"https://s.example/p{i}", None, (titles or {}).get(i), t) for i, t in enumerate(texts)]
    return {r.page_id for r in residue.residue(spark.createDataFrame(rows, PAGES)).collect()}


def test_fields_left_blank_or_at_a_default_that_others_fill(spark):
    about = "The stipend stops during the summer break.\n"
    texts = [f"{about}Last date: {v}\nGender: any" for v in ("5 June 2026", "7 July 2026", "", "TBD", "null", "0000-00-00", "last_date")]
    texts += [about + "Last date:\n7 July 2026", about + "Name of pupil:\nSignature:", about + "Income limit: NaN lakh", about + "Tags:\nGender: any", about + "Tags: law\nGender: any"]
    assert found(spark, texts) == {2, 3, 4, 5, 6, 9}


def test_marks_of_any_length():
    long = "scheme." + "x" * 80
    for mark in ("{{%s}}", "${%s}", "[[%s]]", "<%%= %s %%>", "<?php echo $%s->title; ?>", "{%s}"):
        assert [(x, sure) for _, x, sure in residue.slots(f"Award of {mark % long} here")] == [(mark % long, True)]


def test_loose_marks_that_other_records_fill(spark):
    about = "The stipend stops during the summer break.\n"
    texts = [f"{about}The award is {v} a year for {n} pupils." for v, n in (("[amount]", 9), ("[amount]", 12), ("Rs. 5,000", 40))]
    texts += [f"{about}Write your name as {v} in the box." for v in ("[your name]", "[full name]", "[your name]")]
    texts += [about + "Leave the box marked {office use} empty.", about + "Leave the box marked office use empty."]
    texts += [f"{about}Given by\n{v}" for v in ("[Insert provider]", "Rimo Trust")]
    texts += [about] * 2
    assert found(spark, texts, {10: "[Scheme Name]", 11: "Rimo Tasa Travel Grant"}) == {0, 1, 8, 10}


def test_repeated_pages_of_unknown_words(spark):
    texts = ["Zufokalu wemipo qatrebu"] * residue.REPEATED + ["Vrilto gansu"] * (residue.REPEATED - 1) + ["The stipend stops during the summer break.\nZufokalu wemipo qatrebu"] + [ABOUT] * 40
    assert found(spark, texts) == set(range(residue.REPEATED))



def kinds(spark, texts):
    rows = [(i, f"https://s.example/p{i}", None, None, t) for i, t in enumerate(texts)]
    got = {}
    for p, e in residue.evidence(spark.createDataFrame(rows, PAGES)).collect():
        got.setdefault(p, set()).add(e)
    return got


def test_marks_are_settled_by_alignment(spark):
    texts = [f"{ABOUT}\nSelected pupils receive {m} each." for m in ("{{amount}}", "%%deadline%%")]
    texts += [f"{ABOUT}\n{line}" for line in ("Zonal camp at {{venue}} only.", "Books worth ${price} are given.")]
    assert kinds(spark, texts) == {0: {"slot"}, 1: {"slot"}, 2: {"notation"}, 3: {"form"}}


def test_whole_page_templates_are_told_by_their_frames(spark):
    odd = [f"Vrilto gansu\nZufokalu wemipo qatrebu {x}7." for x in "abcdefgh"]
    tails = [f"The {w} of this place is zur mekolt." for w in ("sum", "note", "sheet", "kern", "tip", "bill", "sign", "rule")]
    full = [ABOUT + "\nVrinto kelso damun.", "Vrinto kelso damun.", ABOUT] + ["Two reference letters are needed."] * 8 + [ABOUT] * 40
    got = kinds(spark, odd + tails + full)
    assert got == {i: {"template"} for i in range(16)}


def test_frames_in_blocks_give_the_same(spark):
    rows = spark.createDataFrame([(None, "Given [a b] to x.\nGiven 5 to x."), (None, "Sent [c d] by y.\nSent z by y.")], "title string, text string")
    open_slots = spark.createDataFrame([("0 given \1 to x.",), ("0 sent \1 by y.",)], "frame string")
    want = {tuple(r) for r in residue.filled(rows, open_slots).collect()}
    assert len(want) == 2 and {tuple(r) for r in residue.filled(rows, open_slots, block=1).collect()} == want


def test_lines_are_classified_together_as_alone(monkeypatch):
    model = residue.model()
    lines = ["Home", "Zufokalu wemipo", "Zufokalu 12, 2026.", "12. Send the form.", "Send the form. 5² ΣΑΣ İzmir.", "< back ^ top", "...", "©", "The page you asked for cannot be found.", ABOUT.replace("\n", " "), "x" * 5000, "Home"]
    for got, x in zip(Scores(model).of(lines), lines):
        assert np.allclose(got, model.score(x), atol=1e-12)
    assert Scores(model).of([]).shape == (0, 4) and not Scores(model).of(["zufokalu", "wemipo, vrilto"]).any()
    alone, together = residue.Reader(model), residue.Reader(model)
    odd = [*lines, "  Home\t ", "Lorem ipsum dolor sapien tortor.", "LOREM ıpsum dolor sapien", "Rimo Tasa Travel Grant"]
    want = [alone.line(x) for x in odd]
    asked = []
    monkeypatch.setattr(Scores, "of", lambda self, x, of=Scores.of: asked.append(len(x)) or of(self, x))
    monkeypatch.setattr(type(model), "score", None)
    together.learn(odd)
    assert len(asked) == 1
    got = [together.line(x) for x in odd]
    assert len(asked) == 1 and [k for k, _ in got] == [k for k, _ in want] and np.allclose([m for _, m in got], [m for _, m in want])
    assert got[0][0] == "furniture" and got[8][0] == "error" and got[-3][0] == "filler" and got[-2][0] == "filler" and got[-1][0] == "name"


def test_sentences_that_come_again_are_numbered_once(monkeypatch):
    made = []
    monkeypatch.setattr(residue, "number", lambda x, number=residue.number: made.append(x) or number(x))
    reader = residue.Reader(residue.model())
    got = {reader.frames(f"Late forms are not entertained. Rimo sent {i}  letters!  Is it so? Ends") for i in range(100)}
    assert len(got) == 1 and len(made) == 8
    assert made[::2] == ["late forms are not entertained.", "rimo sent \2 letters!", "is it so?", "ends"]
