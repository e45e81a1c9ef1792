"""Sentence units and personal information."""

import pytest

from lodestone.llm import pii as I
from lodestone.llm import sentences as S

MODEL = {
    "en": S.Model(abbreviations={"dr", "no", "fig", "al", "prof"}, starters={"the", "it", "in", "about", "dr"}, collocations=set()),
    "de": S.Model(abbreviations={"vgl", "abb", "z", "b"}, starters={"der", "das", "abb"}, collocations={("##", "märz"), ("vgl", "abb")}),
}


def cut(text):
    return [text[a:b] for a, b in S.units(text, MODEL)]


@pytest.mark.parametrize(
    "text, want",
    [
        ("The pH fell. It rose to 3.5 again. The end", ["The pH fell.", "It rose to 3.5 again.", "The end"]),
        ("Dr. Ulra of the hall saw No. 21 and Fig. 3. In 1900 it fell.", ["Dr. Ulra of the hall saw No. 21 and Fig. 3.", "In 1900 it fell."]),
        ("It was 5 p.m. The bell rang at 6 a.m. on the day.", ["It was 5 p.m.", "The bell rang at 6 a.m. on the day."]),
        ('The sign read "Closed. Ask at the bay." in red letters. The end.', ['The sign read "Closed. Ask at the bay." in red letters.', "The end."]),
        ('The guide warned, "Never move it." About 3 of the men left.', ['The guide warned, "Never move it."', "About 3 of the men left."]),
        ("“Is the sea dark?” asked the nurse of the ward.", ["“Is the sea dark?” asked the nurse of the ward."]),
        ("The valley fell.The hill (see the map) rose!In it was a well.", ["The valley fell.", "The hill (see the map) rose!", "In it was a well."]),
        ("The thing ... or what was left of it ... moved.", ["The thing ... or what was left of it ... moved."]),
        ("# Notes on the sea\n- first item of the list\n2. second item\n> a quote of the man\n", ["Notes on the sea", "first item of the list", "2. second item", "a quote of the man"]),
        ("(The motive was left out.) The rest of it stayed.", ["(The motive was left out.)", "The rest of it stayed."]),
        ("Am 3. März war das Tor zu. Vgl. Abb. 4 und das Heft.", ["Am 3. März war das Tor zu.", "Vgl. Abb. 4 und das Heft."]),
        ("古い酵母は谷に運ばれた。「触れないこと。」と札に書かれていた。まさに脆い！！終", ["古い酵母は谷に運ばれた。", "「触れないこと。」と札に書かれていた。", "まさに脆い！！", "終"]),
        ("馆员说：“请勿触碰。”从展厅运来的有3件。", ["馆员说：“请勿触碰。”", "从展厅运来的有3件。"]),
        ("ในห้องสมุดมีดิน ปี 1538 ทำนองยาว 3.2 มม. ใกล้โรงงาน", ["ในห้องสมุดมีดิน", "ปี 1538 ทำนองยาว 3.2 มม. ใกล้โรงงาน"]),
        ("क्या तंत्रिका नम है? नहर घना है। अंत", ["क्या तंत्रिका नम है?", "नहर घना है।", "अंत"]),
        (" \n\t ", []),
        ("", []),
    ],
)
def test_units(text, want):
    assert cut(text) == want


def test_learned_from_text(spark):
    body = ["Dr. %s saw the hall.\nThe end of it was near." % n for n in ("Ulra", "Venn", "Orra", "Kell", "Marn", "Sevv", "Tamm", "Lunn", "Dorr", "Hall", "Brenn", "Falk")] * 6
    rows = [(str(i), t, 1) for i, t in enumerate(body)] + [("x", None, 1), ("y", "  ", 1), ("0", body[0], 1)]
    df = spark.createDataFrame(rows, "id string, text string, start_pos int")
    model = S.learn(df)
    assert "dr" in model["en"].abbreviations and "the" in model["en"].starters
    got = S.sentences(df).groupBy("id").count().collect()
    assert {r["count"] for r in got} == {2} and len(got) == len(body)
    assert S.sentences(df.limit(0)).count() == 0


LEX = frozenset({"ada", "xander", "brill", "noor", "\nmarlhaven"})


def hits(text):
    return [(k, text[a:b]) for k, a, b in I.detect(text, LEX)]


@pytest.mark.parametrize(
    "text, want",
    [
        ("Write to ada.xander+n@mail.shop.example. Bye", [("EMAIL", "ada.xander+n@mail.shop.example")]),
        ("ada (at) shop [dot] example, ada AT shop DOT example", [("EMAIL", "ada (at) shop [dot] example"), ("EMAIL", "ada AT shop DOT example")]),
        ("cc <noor @ shop.example>; 61@35 rpm; tag #6@xyz marks it", [("EMAIL", "noor @ shop.example")]),
        ("аda@shop.example", [("EMAIL", "аda@shop.example")]),  # Cyrillic first letter
        ("Please call +44 20 7946 0123 or 555-0100.", [("PHONE", "+44 20 7946 0123"), ("PHONE", "555-0100")]),
        ("Ring zero one six three two nine six zero now", [("PHONE", "zero one six three two nine six zero")]),
        ("电话００００－０１１５－０４５１。批号05411489", [("PHONE", "００００－０１１５－０４５１")]),
        ("هاتف ٥٥٥-٠١٨٩ اليوم", [("PHONE", "٥٥٥-٠١٨٩")]),
        ("Readings: 907 883 3044; batch 52-8223-265", []),
        ("Her passport QX9239675 and tax number KC 00 74 57 P may go", [("ID_NUMBER", "QX9239675"), ("ID_NUMBER", "KC 00 74 57 P")]),
        ("证件号码0000 1213 0570。", [("ID_NUMBER", "0000 1213 0570")]),
        ("born at Flat 7, 21 Merrow Rd, Quarrington, QZ 04526 there", [("ADDRESS", "Flat 7, 21 Merrow Rd, Quarrington, QZ 04526")]),
        ("Address: 9 Long Lane\nMarlhaven 04526\nPhone: 555-0100", [("ADDRESS", "9 Long Lane\nMarlhaven 04526"), ("PHONE", "555-0100")]),
        ("Calm. 94 Long Street scenes were painted.", []),
        ("Adresse : 49 bis avenue de Pell, 00673 Bford.", [("ADDRESS", "49 bis avenue de Pell, 00673 Bford")]),
        ("Vive en Calle Merrow 3, 2.º B, 00245 Castra.", [("ADDRESS", "Calle Merrow 3, 2.º B, 00245 Castra")]),
        ("寄到青岚市望溪区松影路2号7单元。", [("ADDRESS", "青岚市望溪区松影路2号7单元")]),
        ("Mr. XANDER Ada met Xander, Noor and J. T. van der Brill.", [("NAME", "XANDER Ada"), ("NAME", "Xander, Noor"), ("NAME", "J. T. van der Brill")]),
        ("The Xander scale and the Noor syndrome are no one.", []),
        ("Ada O'Xander-Brill wrote. 担当はNOOR BRILL、", [("NAME", "Ada O'Xander-Brill"), ("NAME", "NOOR BRILL")]),
        ("Selon Ada, brill is a fish", [("NAME", "Ada")]),
        ("", []),
    ],
)
def test_detect(text, want):
    assert hits(text) == want


def test_offsets_survive_disguises():
    t = "😀 x ada [at] shop [dot] example und Ada Brill"
    assert hits(t) == [("EMAIL", "ada [at] shop [dot] example"), ("NAME", "Ada Brill")]
    assert I.redact_text(t, I.detect(t, LEX)) == "😀 x [EMAIL] und [NAME]"


def test_operator(spark):
    text = "Name: Ada Brill, write to ada.brill@shop.example or noor.brill@shop.example"
    rows = [(i, text + "!" * i, "x") for i in range(6)] + [(9, None, "x"), (10, "", "x"), (0, text, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kind string")
    got = I.find_pii(df)
    assert got.where("kind = 'EMAIL'").count() == 12 and got.where("kind = 'NAME'").count() == 6
    red = {r["doc_id"]: r["text"] for r in I.redact(df).collect()}
    assert red[1] == "Name: [NAME], write to [EMAIL] or [EMAIL]!" and red[9] is None and red[10] == ""
    assert I.find_pii(df.limit(0)).count() == 0


@pytest.mark.parametrize(
    "text, want",
    [
        ("Then Dr. Unheard Ofname spoke.", ["Unheard Ofname"]),
        ("Mr. Vexley and Frau Quorn met Prof. Dr. J. Tullamar.", ["Vexley", "Quorn", "J. Tullamar"]),
        ("Frau von Quorn, Mr. Vexley Brill", ["von Quorn", "Vexley Brill"]),
        ("Frau Brill Kaffee", ["Brill"]),
        ("Ada Brill Sr. The end. The Dr. Vexley Institute stands.", ["Ada Brill"]),
        ("Nom : Vexley Quorn", ["Vexley Quorn"]),
    ],
)
def test_names_after_titles_need_no_lexicon(text, want):
    assert [t for k, t in hits(text) if k == "NAME"] == want


def test_lexicon_does_not_depend_on_the_size_of_the_table(spark, monkeypatch):
    rows = [("Thanks to Vexley for it.",)] * 3 + [("Patient MacAbernaught came.",)] * 3 + [(f"{'filler ' * 20000}",)] * 200
    df = spark.createDataFrame(rows, "text string")
    assert {"vexley", "abernaught"} <= I.learn_lexicon(df)
    monkeypatch.setattr(I, "MOST_NAMES", 1)
    with pytest.raises(ValueError):
        I.learn_lexicon(df)


@pytest.mark.parametrize("street", ["Karl-Marx-Straße 12", "Hafen-Str. 5", "Georg-Brauchle-Ring 3", "Alter-Damm 7", "Nord-Ufer 9", "HAUPTSTRASSE 4", "HAUPTSTRAßE 4"])
def test_german_streets_in_any_case(street):
    assert ("ADDRESS", street) in hits(f"Sie wohnt in {street}, sagt man.")


@pytest.mark.parametrize("mail", ["ada { at } shop.example", "ada < at > shop.example", "ada{@}shop.example", "ada@shop ( point ) example", "ada [\tAT\t] shop.example"])
def test_disguised_addresses_in_any_brackets(mail):
    assert hits(f"Write to {mail} now") == [("EMAIL", mail)]
