import random

import numpy as np
import pytest

from siftlake.llm import bpe, leak
from siftlake.llm.boilerplate import Flow, Lines, cut, furniture_lines, model
from siftlake.llm.language import LanguageModel, sentences, voted
from siftlake.llm.names import alike, programme, provider, same_provider
from siftlake.llm.residue import Reader, slots
from siftlake.llm.residue import model as residue_model
from siftlake.llm.sitelines import TemplateTrees


def test_bpe_equals_public_library():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(f"{bpe.FOLDER}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    e = bpe.Encoder(bpe.parse_ranks(open(f"{bpe.FOLDER}/byte_bpe_50k.tiktoken", "rb").read()))
    rnd = random.Random(1)
    texts = ["", " ", "don't  stop\n\n", "<|endoftext|>", "आवेदन की अंतिम तिथि", "a" * 5000, "".join(rnd.choice("abcdefgh") for _ in range(20000)), "🎓✅ naïve Ünïcode", "x​y  z"]
    texts += ["".join(rnd.choice("abc XYZ09'ñक-\n") for _ in range(60)) for _ in range(200)]
    assert [e.encode(x) for x in texts] == [t.encode(x, add_special_tokens=False).ids for x in texts]
    assert e.encode(None) == []


def test_rank_queue_is_a_queue():
    rnd, q, want = random.Random(2), bpe.RankQueue(), []
    for _ in range(500):
        r, p = rnd.randrange(200_000), rnd.randrange(100)
        q.push(r, p)
        want.append((r, p))
    assert [q.pop() for _ in want] == sorted(want)
    assert q.pop() is None


def test_suffix_order_and_search_against_brute_force():
    rnd = np.random.default_rng(3)
    text = rnd.integers(0, 5, 400)
    index = leak.FmIndex(text, 4)
    pats = [rnd.integers(1, 5, n) for n in (1, 2, 3, 3, 4, 5)]
    m = np.zeros((len(pats), 5), np.int64)
    for i, p in enumerate(pats):
        m[i, 5 - len(p) :] = p
    lo, hi = index.search(m, np.array([len(p) for p in pats]))
    for p, a, b in zip(pats, lo, hi):
        want = {i for i in range(len(text) - len(p) + 1) if (text[i : i + len(p)] == p).all()}
        assert set(index.locate(np.arange(a, max(a, b))).tolist()) == want


def test_leaks_planted():
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(rnd.choice(words) for _ in range(48))) for i in range(5)]
    probe = leak.Probe(items)
    first = items[0][1].split()
    close = first[:]
    for k in range(0, 48, 8):
        close[k] = "other"
    far = close[:]
    far[1] = far[9] = "other"
    docs = {1: " ".join(first[3:15]).upper(), 2: " ".join(first[3:14]), 3: "x " + ", ".join(close), 4: " ".join(far), 5: "", 6: "<b>" + "</b>  ".join(first) + " y", 7: "z"}
    codes = [np.array([probe.vocabulary.get(w, 0) for w in leak.words(t)], np.int64) for t in docs.values()]
    got = probe.find(list(docs), codes)
    assert sorted(zip(got.doc_id, got.item_id)) == [(1, 0), (3, 0), (6, 0)]
    assert probe.find([], []).empty


def test_cut_is_minimal():
    rnd = random.Random(6)
    for _ in range(60):
        n = rnd.randrange(1, 8)
        cost = [rnd.uniform(-2, 2) for _ in range(n)]
        edges = [(i, j, rnd.uniform(0, 2)) for i in range(n) for j in range(i + 1, n) if rnd.random() < 0.6]
        energy = lambda x: sum(max(0, -c) if v else max(0, c) for c, v in zip(cost, x)) + sum(c for i, j, c in edges if x[i] != x[j])
        best = min(energy([bool(m >> i & 1) for i in range(n)]) for m in range(2**n))
        assert energy(cut(cost, edges)) == pytest.approx(best)
    f = Flow(2)
    f.join(0, 1, 1.5)
    assert f.source_side(0, 1) == [True, False]


def test_furniture_of_a_page():
    page = "Home Contact Tenders RTI\nYou are here: Start » Awards » Rimo Tasa Travel Grant\nQuick links\nKipipu Tupomi Research Fellowship\nVidato Kurasa Sports Scholarship\n\nRimo Tasa Travel Grant\nEligibility\nThe stipend stops during the summer break.\n* Caste certificate\nShare (12)\n© 2001 Rimo Memorial Trust. All rights reserved."
    assert furniture_lines(page, "https://x.example/schemes/rimo-tasa-travel-grant-12", Lines(model())) == [1, 2, 3, 4, 5, 11, 12]
    assert furniture_lines("\n \n", None, Lines(model())) == []


def test_residue():
    assert [s[1] for s in slots("Award of {{ Amount }} for %(level)s, see [[x]]")] == ["{{ amount }}", "%(level)s", "[[x]]"]
    assert [s[2] for s in slots("Leave the box marked {office use} empty.")] == [False]
    r = Reader(residue_model())
    sure = lambda title, text: any(e[3] for e in r.page(title, text)) or bool(r.body(text)[0])
    assert sure("Grant", "Home\nThe page you asked for cannot be found.\nBack to top")
    assert sure(None, "Eligibility\nLorem ipsum dolor sapien tortor velit nulla.")
    assert sure("{{scheme_title}}", None)
    assert not sure("Page not found", "The stipend stops during the summer break.\nApplicants should enable JavaScript in the browser before opening the online form.")
    assert not sure(None, None) and not sure("x", "")


def test_template_trees():
    t, u = TemplateTrees(), TemplateTrees()
    assert t.parse("s", "Visitors:  12", 5) == t.parse("s", "visitors: 9981 ", 6) != t.parse("s", "Visitors: many", 5)
    assert t.parse("s", "  ") == 0 and t.parse("z", "Visitors: 1") not in (1, 2)
    u.parse("s", "back to top")
    u.parse("s", "VISITORS: 7")
    assert t.templates[0] == u.templates[1] and t.places[0] == {5, 6}


def test_names():
    a, b = programme("Rimō Tāsā Research F'ship for School Stud. of Std. 9 & 10 2025-26"), programme("Research Fellowship (School Students of Class 9 and 10) - Tasa, Rimo")
    assert a[1:] == b[1:] == ("research fellowship", "school 9 10")
    assert alike(a.name, b.name, 2) == 0
    assert programme("Rimo Tasa Research Fellowship for School Students of Class 11 and 12").level != a.level
    assert same_provider(provider("VJSSB, Nonu"), provider("Jolonu, Vojaja St. Schol. Board"))
    assert not same_provider(provider("Vojaja Jolonu State Scholarship Board"), provider("Vojaja Jolonu Research Council"))
    assert provider(None) is None and programme(None).name == ()


def test_language_held_out():
    en = "the pupils of this school may ask for help before the end of the term|no money is paid to those who leave early|each form needs the name of a teacher and of a parent|we answer letters on working days".split("|")
    fr = "les élèves de cette école peuvent demander une aide avant la fin du trimestre|aucune somme n'est versée à ceux qui partent tôt|chaque dossier doit porter le nom d'un professeur|nous répondons aux lettres les jours ouvrables".split("|")
    rnd = random.Random(1)
    texts = [(" ".join(rnd.sample(v[rnd.randrange(4)].split(), 6)), c) for c, v in (("en", en), ("fr", fr)) for _ in range(150)]
    m = LanguageModel([t for t, _ in texts], [c for _, c in texts])
    assert m.predict(["help for the pupils of the school", "une aide pour les élèves de l'école"])[0] == ["en", "fr"]
    assert m.held_out > 0.95
    assert m.predict([])[0] == []


def test_sentences_and_votes():
    assert [f for _, f in sentences("Guidelines for 2021\n\nIt costs Rs. 500 for all of them. Cut off h")] == [False, True, False]
    assert sentences("\n--- 2026\n") == []
    assert voted([("It is Rimo here.", "en"), ("It is Tasa here.", "en"), ("It is Kilo here.", "de")])[2][1] == "en"
