import pytest
from pyspark.sql import functions as F

from umbra.functions import validators as V
from umbra.operators import patterns as P
from umbra.plans.queries import GOLDEN, STATEMENT
from umbra.sources.runs import placed, text_runs

# A line for each pattern and what must be found in it.
LINES = [
    ("iban_de", "IBAN: DE89 3704 0044 0532 0130 00", ["DE89 3704 0044 0532 0130 00"]),
    ("iban_de", "Ueberweisung auf DE89370400440532013000 ausgefuehrt", ["DE89370400440532013000"]),
    ("iban_de", "IBAN: DE88 3704 0044 0532 0130 00", []),
    ("iban_de", "Glaeubiger-ID: DE98ZZZ09999999999", []),
    ("glaeubiger_id", "Glaeubiger-ID: DE98ZZZ09999999999", ["DE98ZZZ09999999999"]),
    ("glaeubiger_id", "Lastschrift PAYPAL EUROPE Glaeubiger-ID LU96ZZZ0000000000000000058", ["LU96ZZZ0000000000000000058"]),
    ("glaeubiger_id", "Glaeubiger-ID: DE99ZZZ09999999999", []),
    ("konto_nr", "Kto. 4711 0815 BLZ 50010517  Rechnung Nr. 2026-0042", ["4711 0815"]),
    ("konto_nr", "Vertragskonto 30012345 Abschlag Strom", ["30012345"]),
    ("konto_nr", "Lohn/Gehalt 01/2026 Personalnummer 8891234", []),
    ("konto_nr", "Bankleitzahl: 37040044", []),
    ("blz", "BLZ 20040000 (Commerzbank)", ["20040000"]),
    ("blz", "Kontonummer: 87654321", []),
    ("bic", "BIC: COBADEFFXXX", ["COBADEFFXXX"]),
    ("bic", "Empfaengerbank BIC DEUTDEFF", ["DEUTDEFF"]),
    ("bic", "RECHNUNG ABSENDER MAHNUNGS", []),
    ("bic", "KREDITKARTE GENODEF1S01", ["GENODEF1S01"]),
    ("steuer_id", "Steuernummer 98765432109", ["98765432109"]),
    ("steuer_id", "Vorgangsnummer 20260105001 gebucht", []),
    ("email", "Rueckfragen an service@musterbank.de bitte", ["service@musterbank.de"]),
    ("email", "Verwendungszweck: Rechnung@Januar", []),
    ("phone_de", "Filiale Berlin-Mitte, Telefon 030 987654321", ["030 987654321"]),
    ("phone_de", "IBAN: DE89 3704 0044 0532 0130 00", []),
    ("credit_card", "Kreditkarte 4539 1488 0343 6467 belastet", ["4539 1488 0343 6467"]),
    ("credit_card", "Kreditkarte 4539 1488 0343 6468 belastet", []),
    ("iban_de", "DE89 3704 0044 0532 0130 00 and DE02 1203 0000 0000 2020 51", ["DE89 3704 0044 0532 0130 00", "DE02 1203 0000 0000 2020 51"]),
]


def runs(spark, texts):
    return placed(spark.createDataFrame(list(enumerate(texts)), "run_seq int, text string").withColumn("doc_id", F.lit(1).cast("long")))


def test_lines_of_each_pattern(spark):
    found = {}
    for r in P.find(runs(spark, [line for _, line, _ in LINES])).collect():
        found.setdefault((r.run_seq, r.pattern_id), []).append((r.start, r.text))
        line = LINES[r.run_seq][1]
        assert line[r.start : r.start + len(r.text)] == r.text and r.llx == 5.0 * r.start
    for k, (name, line, want) in enumerate(LINES):
        assert [t for _, t in sorted(found.get((k, name), []))] == want, line


def test_statement_and_low_threshold(spark):
    rows = P.find(runs(spark, STATEMENT)).collect()
    assert sorted((r.run_seq, r.pattern_id, r.text, r.confidence, r.start) for r in rows) == sorted(GOLDEN)
    low = {r.text for r in P.find(runs(spark, STATEMENT), None, 0.25).collect()}
    assert {r.text for r in rows} < low and {"8891234", "90123456"} <= low


@pytest.mark.parametrize(
    "check, good, bad",
    [
        (V.iban, ["DE89370400440532013000", "de89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32"], ["DE88370400440532013000", "DE89370400", "DE89-3704-0044-0532-0130-00", "DE98ZZZ09999999999", "", "é"]),
        (V.creditor_id, ["DE98ZZZ09999999999", "AT61ZZZ01234567890", "DE24ABC00000561652", "FR72ZZZ123456"], ["DE99ZZZ09999999999", "DE98ZZZ", "XX98ZZZ09999999999", "DE89370400440532013000"]),
        (V.bic, ["DEUTDEFF", "COBADEFFXXX", "GENODEF1S01", "MARKDEF1100"], ["RECHNUNG", "KUNDENNUMMER", "DEUTDEF", "DEUT1EFF"]),
        (V.luhn, ["4539 1488 0343 6467", "79927398713"], ["4539 1488 0343 6468", "1234567890123", "7"]),
    ],
)
def test_validators(spark, check, good, bad):
    rows = spark.createDataFrame([(x,) for x in good + bad], "s string").select("s", check(F.col("s")).alias("ok")).collect()
    assert {r.s for r in rows if r.ok} == set(good)


def test_configuration():
    merged = P.resolve({"patterns": [{"id": "bic", "validator": None, "confidence_without_context": None}, {"id": "new", "regex": "X+"}]})
    by = {p.id: p for p in merged}
    assert by["bic"].validator is None and by["bic"].confidence == 0.8 and by["new"].enabled and len(merged) == 13
    assert [p.id for p in P.resolve({"extend_builtins": False, "patterns": [{"id": "only", "regex": "X"}]})] == ["only"]
    for bad in ({"patterns": [{"id": "new"}]}, {"patterns": [{"id": " "}]}, {"other": 1}, {"patterns": [{"id": "x", "regex": "y", "confidence": 2}]}):
        with pytest.raises(ValueError):
            P.resolve(bad)
    with pytest.raises(ValueError):
        P.select(["nothing"])
    assert [p.id for p in P.select(["date_de"]) if p.enabled] == ["date_de"] and "date_de" in P.notice(P.BUILTIN)
    assert P.load_config("x.yaml", "extend_builtins: false\npatterns:\n  - id: a\n    regex: 'b+'\n    enabled: false\n") == {"extend_builtins": False, "patterns": [{"id": "a", "regex": "b+", "enabled": False}]}


def test_marks_in_the_text_and_many_hits(spark):
    text = "\u0001a@b.de\u0002 c@d.de \u0003" + " x@y.org" * 300
    rows = P.find(runs(spark, [text]), P.select(["email"])).collect()
    assert len(rows) == 302 and all(text[r.start : r.start + len(r.text)] == r.text for r in rows)


def test_runs(spark):
    rows = text_runs(spark.createDataFrame([(1, "a\n\nb"), (2, None), (3, "")], "doc_id long, text string")).collect()
    assert {(r.doc_id, r.run_seq, r.page, r.text, r.lly) for r in rows} == {(1, 0, 0, "a", 780.0), (1, 2, 0, "b", 752.0)}


def test_disabled_patterns_are_not_in_the_plan(spark):
    plan = P.find(runs(spark, ["x"]), P.select(["email"]))._jdf.queryExecution().toString()
    assert "konto" not in plan and "Python" not in plan
