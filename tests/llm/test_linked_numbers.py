"""Pseudonyms link spellings of one number, and stay valid numbers; names are learnt from other texts."""

from __future__ import annotations

import re

import pytest

from cadenza.llm import piirules as R
from cadenza.llm.pii import find_items, phone_parts, pseudonym, redact_documents, written_digits


def _own(value: str) -> str:
    """The digits of the number itself in a phone number's pseudonym."""
    new = pseudonym("phone", value)
    digits = re.sub(r"\D", "", new)
    return digits[phone_parts(R.normalized(value) if re.search(r"\d{2}", value) else written_digits(value))[0] :]


@pytest.mark.parametrize(
    "spellings",
    [
        ["+8613812345678", "+86 138 1234 5678", "138-1234-5678", "008613812345678", "一三八一二三四五六七八"],
        ["+14155550155", "+1 (415) 555-0155", "415.555.0155", "(415) 555-0155", "four one five five five five oh one double five"],
        ["+44 20 7946 0958", "020 7946 0958", "+44 (0)20 7946 0958", "+442079460958"],
        ["+49 30 23125550", "030 23125550", "+49 (0)30 23125550"],
    ],
)
def test_one_number_has_one_pseudonym(spellings):
    assert len({_own(s) for s in spellings}) == 1
    assert pseudonym("phone", spellings[0]) != spellings[0]


def test_what_says_how_to_dial_stays():
    assert pseudonym("phone", "+8613812345678").startswith("+86") and pseudonym("phone", "020 7946 0958")[0] == "0"
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", pseudonym("phone", "+1 (415) 555-0155"))


def test_checked_numbers_stay_valid():
    nie = pseudonym("identity_number", "X1234567L")
    assert re.fullmatch(r"X\d{7}[A-Z]", nie) and R.dni_letter(nie[:8]) == nie[8]
    cpf = re.sub(r"\D", "", pseudonym("identity_number", "123.456.789-09"))
    assert R.cpf_checks(cpf[:9]) == cpf[9:]
    first = "1234567890"
    steuer = pseudonym("identity_number", first + R.steuer_check(first))
    assert R.steuer_check(steuer[:10]) == steuer[10]
    body = "2840675123456"
    french = pseudonym("identity_number", f"{body}{97 - int(body) % 97:02d}")
    assert int(french[13:]) == 97 - int(french[:13]) % 97 and 1 <= int(french[3:5]) <= 12 and french[0] == "2"


def test_tags_are_long_and_linked():
    a, b = pseudonym("person_name", "Tomasz  Kowalski"), pseudonym("person_name", "tomasz kowalski")
    assert a == b and len(a) == 32


@pytest.mark.parametrize(
    ("text", "item"),
    [
        ("Abita in Via Roma 12, Milano da anni", ("street_address", "Via Roma 12, Milano")),
        ("CPF 123.456.789-09 please", ("identity_number", "123.456.789-09")),
        ("tel 06-12345678", ("phone", "06-12345678")),
        ("id card 12345678901 was lost", ("identity_number", "12345678901")),
        ("You can reach Petra Birkenby at petra.birkenby@example.org or so", ("email", "petra.birkenby@example.org")),
    ],
)
def test_forms(text, item):
    assert item in [(k, text[a:b]) for k, a, b in R.find(text)]


def test_names_known_from_other_texts(spark):
    texts = [
        "Mr Tomasz Kowalski called.", "Contact: Tomasz Nowak", "We met Tomasz Wiatr in the park.", "We saw Monte Rosa in the fog.",
        "请联系张伟", "刚才宓昀进来把水壶拿走了。", "联系人：宓朔", "收件人：宓淮", "谢谢，再见。", None, "", "We met Tomasz Wiatr in the park.",
    ]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id int, text string, items string")
    out = {r["doc_id"]: r for r in redact_documents(df, "doc_id", "text").collect()}
    names = {i: [r["pii_type"] for r in out[i]["items"]] for i in out}
    assert names == {0: ["person_name"], 1: ["person_name"], 2: ["person_name"], 3: [], 4: ["person_name"], 5: ["person_name"], 6: ["person_name"], 7: ["person_name"], 8: [], 9: [], 10: [], 11: ["person_name"]}
    assert re.fullmatch(r"We met \[PERSON_NAME [0-9a-f]{32}\] in the park\.", out[2]["text"]) and out[9]["text"] is None and out[3]["text"] == texts[3]
    assert find_items(df.limit(0), "text").count() == 0


def test_gates_hold_all_that_a_pattern_needs():
    texts = ["Reviewed-by: Ann Bell", "Laut Ausweis der Dame ist das Ida Holm.", "Bonjour Paul Roux", "Hola, Eva Ruiz", "— Jo Day", "Paul Roux et Ann Bell watched"]
    for text in texts:
        gate, _ = R.gates(R.lowered(text))
        for i, (p, _) in enumerate(R._BEFORE_CONTEXTS):
            assert not p.search(text) or gate & R.GATE[f"lead{i}"]
        assert not R._CLOSING.search(text) or gate & R.GATE["closing"]
