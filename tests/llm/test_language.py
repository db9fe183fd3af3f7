import random

from siftlake.llm import language

DOC = "doc_id bigint, text string, lang string"


def test_short_closed_sentences_are_full():
    full = lambda t: [f for _, f in language.sentences(t)]
    assert full("Bewerbungen sind geschlossen. விண்ணப்பம் மூடப்பட்டது. மூடப்பட்டது. It is so ok.") == [True] * 4
    assert full("Bewerbungen sind geschlossen") == full("Go on.") == [False]
    assert full("Ask Prof. Kilo or Shri. Banu about it.") == [True]


def test_documents_of_short_sentences(spark):
    de = "Bewerbungen sind geschlossen|Anträge werden geprüft|Gebühren entfallen heute|Unterlagen bitte einreichen|Stipendien werden gezahlt|Ergebnisse folgen später".split("|")
    en = "Applications are closed|Requests are being checked|Charges are waived today|Please submit the papers|Stipends are being paid|Results will follow later".split("|")
    rnd = random.Random(2)
    rows = [(i, " ".join(f"{x}." for x in rnd.sample(v, 4)), c) for i, (c, v) in enumerate([("de", de), ("en", en)] * 60)]
    rows += [(200, de[0] + ".", None), (201, "Requests are being checked today. " + de[0] + ".", "en")]
    got = {tuple(r) for r in language.mislabelled(spark.createDataFrame(rows, DOC)).collect()}
    assert got == {(200, "de"), (201, "en"), (201, "de")}
