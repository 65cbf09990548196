import pytest

from quern.llm import personal as P

LEXICON = [("Halisa", "given"), ("Velolda", "given"), ("Joranth", "given"), ("Zéira", "given"), ("Vasberton", "family"), ("Mornind", "family"), ("Lindvawick", "family"), ("Calvask", "family"), ("Brastosk", "family"), ("Ember", "family")]


@pytest.fixture(scope="module")
def names():
    return P.Names(LEXICON)


def kinds(text, names):
    return {k for _, _, k in P.find_in(text, names)}


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("mail bob.x+memo@db1.foo.example now", "mail [EMAIL] now"),
        ("mail bob [at] foo [dot] example!", "mail [EMAIL]!"),
        ("mail bob(at)foo.example", "mail [EMAIL]"),
        ("mail bob @ foo.example, please", "mail [EMAIL], please"),
        ("mail ｂob＠foo.example", "mail [EMAIL]"),
        ("mail bo​b@fоо.example.", "mail [EMAIL]."),
        ("admin_mail=A.B@FOO.EXAMPLE", "admin_mail=[EMAIL]"),
        ("call +49 (0)30 5550 398 or (330) 555-0163 ext. 12", "call [PHONE] or [PHONE]"),
        ("tel: 01.99.00.85.65, 030/5550398, 020 7946 0417", "tel: [PHONE], [PHONE], [PHONE]"),
        ("call 1‑358‑555‑0103.", "call [PHONE]."),
        ("SSN 958031970, 921-73-8771", "SSN [NATIONAL_ID], [NATIONAL_ID]"),
        ("NI number QQ857738B; QQ 85 48 66 A", "NI number [NATIONAL_ID]; [NATIONAL_ID]"),
        ("NIR 1 82 69 51 910 300 47, DNI 44007863P", "NIR [NATIONAL_ID], DNI [NATIONAL_ID]"),
        ("Steuer-ID 33 524 620 129 Ausweisnummer L15X07626 passport no. X24624425", "Steuer-ID [NATIONAL_ID] Ausweisnummer [NATIONAL_ID] passport no. [NATIONAL_ID]"),
        ("at 1372 N Pinder Blvd, Suite 137, Northwick on", "at [STREET_ADDRESS] on"),
        ("an Hafenstraße 55, 00611 Neuhafen!", "an [STREET_ADDRESS]!"),
        ("au 80 ter, impasse des Glycines, Hautepierre-sur-Lise;", "au [STREET_ADDRESS];"),
        ("en Avenida Encina 47, 6.º C, Robledal.", "en [STREET_ADDRESS]."),
        ("by Halisa Vasberton <h@x.example>", "by [PERSON_NAME] <[EMAIL]>"),
        ("by Halisa X. Ember and VELOLDA MORNIND", "by [PERSON_NAME] and [PERSON_NAME]"),
        ("by Ember, Halisa; Dr. Calvask", "by [PERSON_NAME]; Dr. [PERSON_NAME]"),
    ],
)
def test_found_and_replaced(text, want, names):
    assert P.replaced(text, P.find_in(text, names)) == want


@pytest.mark.parametrize(
    "text",
    [
        "Clone from git@git.foo.example:team/x.git", "psql postgres://reader@db.foo.example/app", "ssh svc@foo.example", "nectar@2x.png", "forge-ui@2.08.7", "@cached",
        "Counter went from 8576596469 to 3224014383.", "Ratio 0.092-0.954-35.", "Stock code 90-543-5618", "Host 10.96.0.90 answered on port 8628.",
        "The Ember queue drained.", "Trace 1b55a1c2-e31e-76a1-0bb390af4cda", "at 2025-03-15 10:22:31.", "Section 41 moved to lane 1.", "Fill in <email> and <phone>", "", None,
    ],
)
def test_not_personal(text, names):
    assert kinds(text, names) == set()


def test_spelled_digits(names):
    assert kinds("call zero two zero seven nine four six zero one two three", names) == {"phone"}


@pytest.mark.parametrize(
    "text",
    ["call six one four seven two eight nine three one two", "call (oh two one seven oh six four nine three one).", "Tel. un-deux-trois-quatre-six-sept-huit-neuf-un-deux", "llame DOS, TRES, SEIS, SIETE, OCHO, NUEVE, UNO, DOS, TRES"],
)
def test_spelled_digits_without_nought_or_five(text, names):
    assert kinds(text, names) == {"phone"}


def test_gates_let_every_word_of_the_patterns_through(names):
    for word in P.AT_WORDS:
        for o, c in ("[]", "()", "{}", "<>"):
            for gap in ("", " "):
                assert kinds(f"mail bob {o}{gap}{word.upper()}{gap}{c} foo.example now", names) == {"email"}
    for word in P.BARE_AT_WORDS:
        for dot in P.DOT_WORDS:
            assert kinds(f"mail bob {word} foo {dot} example now", names) == {"email"}
    streets = [f"12 Pinder {w}, Northwick" for w in P.STREETS_EN.split("|")] + [f"Hafen{w} 12, 75001 Neuhafen".replace("\\", "") for w in P.STREETS_DE.split("|")]
    for way in (str.lower, str.upper, str.capitalize):
        streets += [f"12 {way(w)} Victor Hugo, 75001 Paris".replace("\\", "") for w in P.STREETS_FR.split("|")]
        streets += [f"{way(w)} Encina 47, Robledal".replace("\\.?", "") for w in P.STREETS_ES.split("|")]
    for text in streets:
        assert kinds(f"an {text}.", names) == {"street_address"}, text
    assert kinds("passport no. A1B2C3D4E5F6.", names) == {"national_id"}


def test_everything_else_is_unchanged(names):
    text = "ünï​ ｗide mail a.b@foo.example énd"
    assert P.replaced(text, P.find_in(text, names)) == "ünï​ ｗide mail [EMAIL] énd"


def test_table(spark, names):
    rows = [("a", "x a@b.example"), ("b", None), ("c", ""), ("a", "x a@b.example"), (None, "+1 659 555 0191"), ("d", "word " * 60_000 + "a@b.example")]
    df = spark.createDataFrame(rows, "id string, content string").selectExpr("*", "1 AS redacted", "'z' AS k")
    lex = spark.createDataFrame([*LEXICON, (None, "given")], "name_text string, name_part string")
    got = sorted(P.scan(df, lex).collect(), key=lambda r: str(r.id))
    assert [(r.id, r.pii_types) for r in got] == [(None, ["phone"]), ("a", ["email"]), ("a", ["email"]), ("b", []), ("c", []), ("d", ["email"])]
    assert [r.redacted for r in got][:5] == ["[PHONE]", "x [EMAIL]", "x [EMAIL]", None, ""]
    assert P.scan(df.limit(0), lex.limit(0)).count() == 0
