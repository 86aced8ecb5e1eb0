"""Registered queries of the redaction engine and their SQL oracles.

Every query has a twin in SQL that takes another way to the same rows. Small inputs that both sides share are VALUES
tables, which both dialects read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from umbra.functions import geometry as G
from umbra.functions import text as T
from umbra.functions import validators as V
from umbra.operators import booking, conflict, effects, leaks, lines, mask, patterns, summary
from umbra.plans import redaction
from umbra.plans.storage import cut
from umbra.sources.runs import page_boxes, text_runs

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The default run: hits of all patterns that are on, by language and pattern."""
    return _by_lang(spark, sf_dir, None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _values(columns: str, rows: list[tuple]) -> str:
    """A VALUES table that Spark and DuckDB both read."""

    def literal(v):
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return "TRUE" if v else "FALSE"
        if isinstance(v, float):
            return f"CAST('{'NaN' if v != v else 'Infinity' if v == float('inf') else '-Infinity' if v == -float('inf') else repr(v)}' AS DOUBLE)"
        if isinstance(v, int):
            return f"CAST({v} AS BIGINT)"
        return "'" + v.replace("'", "''") + "'"

    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in rows)}) AS t({columns}))"


# ---------------------------------------------------------------- lines and places

RUNS = """(SELECT doc_id, CAST(k AS BIGINT) AS run_seq, CAST(k // 50 AS BIGINT) AS page, ls[k + 1] AS text, 780.0::DOUBLE - 14.0::DOUBLE * (k % 50) AS lly
  FROM (SELECT doc_id, ls, unnest(range(len(ls))) AS k FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))
  WHERE ls[k + 1] <> '')"""


def _runs(spark, sf_dir):
    return text_runs(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query(f"SELECT doc_id, page, COUNT(*) AS n_lines, CAST(SUM(length(text)) AS BIGINT) AS n_chars, MIN(lly) AS lowest, CAST(SUM(run_seq) AS BIGINT) AS seqs FROM {RUNS} GROUP BY doc_id, page")
def runs_extract(spark, sf_dir):
    return _runs(spark, sf_dir).groupBy("doc_id", "page").agg(F.count("*").alias("n_lines"), F.sum(F.length("text")).alias("n_chars"), F.min("lly").alias("lowest"), F.sum("run_seq").alias("seqs"))


@query(f"SELECT doc_id, MAX(page) + 1 AS pages, 0.0::DOUBLE AS sheet_llx, 0.0::DOUBLE AS sheet_lly, 595.0::DOUBLE AS sheet_urx, 842.0::DOUBLE AS sheet_ury FROM {RUNS} GROUP BY doc_id")
def page_count(spark, sf_dir):
    return page_boxes(_runs(spark, sf_dir))


@query(f"SELECT doc_id, page, string_agg(text, chr(10) ORDER BY run_seq) AS content FROM {RUNS} GROUP BY doc_id, page")
def page_text(spark, sf_dir):
    return leaks.page_texts(_runs(spark, sf_dir))


# ---------------------------------------------------------------- geometry

NAN, INF = float("nan"), float("inf")
_PAIRS = _values(
    "id, llx, lly, urx, ury, o_llx, o_lly, o_urx, o_ury",
    [
        (k, *map(float, r))
        for k, r in enumerate(
            [
                (0, 0, 10, 10, 0, 0, 10, 10), (0, 0, 10, 10, 5, 5, 15, 15), (0, 0, 10, 10, 10, 0, 20, 10), (0, 0, 100, 10, 40, 0, 200, 10), (0, 0, 100, 10, 60, 0, 200, 10),
                (0, 0, 0, 10, -1, -1, 1, 11), (5, 5, 5, 5, 0, 0, 10, 10), (5, 5, 5, 5, 6, 6, 10, 10), (10, 10, 0, 0, 0, 0, 10, 10), (0, 0, 1e308, 1e308, 0, 0, 1e308, 1e308),
                (NAN, 0, 10, 10, 0, 0, 10, 10), (0, NAN, 10, 10, 0, 0, 10, 10), (0, 0, NAN, 10, 0, 0, 10, 10), (0, 0, 10, NAN, 0, 0, 10, 10), (0, 0, 10, 10, NAN, 0, 10, 10),
                (0, 0, 10, 10, 0, 0, INF, 10), (-INF, 0, 10, 10, 0, 0, 10, 10), (0, 0, INF, INF, 0, 0, 10, 10), (0, 0, 1010, 10, 0, 0, 1000, 10), (0, 0, 1000.5, 10, 0, 0, 1000, 10),
            ]
        )
    ],
)


def _sql_rect(p):
    c = [f"{p}llx", f"{p}lly", f"{p}urx", f"{p}ury"]
    return " AND ".join(f"isfinite({x})" for x in c)


_UA, _UB = f"({_sql_rect('')})", f"({_sql_rect('o_')})"
_SQL_AREA = f"(CASE WHEN {_UA} THEN greatest(urx - llx, 0.0::DOUBLE) * greatest(ury - lly, 0.0::DOUBLE) ELSE 0.0::DOUBLE END)"
_SQL_INTER = f"(CASE WHEN {_UA} AND {_UB} THEN greatest(least(urx, o_urx) - greatest(llx, o_llx), 0.0::DOUBLE) * greatest(least(ury, o_ury) - greatest(lly, o_lly), 0.0::DOUBLE) ELSE 0.0::DOUBLE END)"
_SQL_COVER = (
    f"(CASE WHEN {_SQL_AREA} <= 2.220446049250313e-16 THEN (CASE WHEN {_UB} AND isfinite((llx + urx) / 2) AND isfinite((lly + ury) / 2) AND (llx + urx) / 2 BETWEEN o_llx AND o_urx AND (lly + ury) / 2 BETWEEN o_lly AND o_ury THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)"
    f" WHEN isfinite({_SQL_INTER} / {_SQL_AREA}) THEN {_SQL_INTER} / {_SQL_AREA} ELSE 0.0::DOUBLE END)"
)


@query(
    f"SELECT id, {_UA} AS usable, (NOT {_UA} OR urx - llx <= 0 OR ury - lly <= 0) AS is_empty, {_SQL_COVER} AS covered,"
    f" ({_UA} AND {_UB} AND llx < o_urx AND o_llx < urx AND lly < o_ury AND o_lly < ury) AS meets, ({_UA} AND {_UB} AND llx <= o_urx AND o_llx <= urx AND lly <= o_ury AND o_lly <= ury) AS touches FROM {_PAIRS}"
)
def geo_covered_fraction(spark, sf_dir):
    a, b = G.rect(), G.rect("o_")
    return spark.sql(f"SELECT * FROM {_PAIRS}").select("id", G.usable(a).alias("usable"), G.empty(a).alias("is_empty"), G.covered_fraction(a, b).alias("covered"), G.intersects(a, b).alias("meets"), G.touches(a, b).alias("touches"))


@query(
    f"""SELECT id, good, CASE WHEN good THEN llx ELSE 0 END AS llx, CASE WHEN good THEN lly ELSE 0 END AS lly, CASE WHEN good THEN urx ELSE 595.276 END AS urx, CASE WHEN good THEN ury ELSE 841.89 END AS ury
    FROM (SELECT *, {_UA} AND urx - llx BETWEEN 1 AND 200000 AND ury - lly BETWEEN 1 AND 200000 AS good FROM {_PAIRS})"""
)
def geo_sane_box(spark, sf_dir):
    box, replaced = G.sane_box(G.rect())
    return spark.sql(f"SELECT * FROM {_PAIRS}").select("id", (~replaced).alias("good"), *box.named())


@query(
    """SELECT l_orderkey, l_linenumber, a*x + c*y + e AS px, b*x + d*y + f AS py, round(x - (( d*(px0 - e) - c*(py0 - f)) / (a*d - b*c)), 6) + 0.0 AS ex
    FROM (SELECT *, a*x + c*y + e AS px0, b*x + d*y + f AS py0 FROM (SELECT l_orderkey, l_linenumber, l_quantity AS x, l_discount AS y, 2.0::DOUBLE AS a, 0.5::DOUBLE AS b, -1.0::DOUBLE AS c, 3.0::DOUBLE AS d, l_tax AS e, 7.0::DOUBLE AS f FROM lineitem))"""
)
def geo_matrix(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("x"), F.col("l_discount").alias("y"), "l_tax")
    m = [F.lit(2.0), F.lit(0.5), F.lit(-1.0), F.lit(3.0), F.col("l_tax"), F.lit(7.0)]
    px, py = G.matrix_apply(m, F.col("x"), F.col("y"))
    back, _ = G.matrix_apply(G.matrix_invert(m), px, py)
    return li.select("l_orderkey", "l_linenumber", px.alias("px"), py.alias("py"), (F.round(F.col("x") - back, 6) + 0.0).alias("ex"))


# ---------------------------------------------------------------- validators

_CODES = [
    "DE89370400440532013000", "de89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32", "DE88370400440532013000", "DE89370400", "DE89-3704-0044-0532-0130-00", "DE98ZZZ09999999999",
    "AT61ZZZ01234567890", "DE24ABC00000561652", "FR72ZZZ123456", "DE99ZZZ09999999999", "DE98ZZZ", "XX98ZZZ09999999999", "DEUTDEFF", "COBADEFFXXX", "GENODEF1S01", "MARKDEF1100", "RECHNUNG",
    "KUNDENNUMMER", "DEUTDEF", "DEUT1EFF", "4539 1488 0343 6467", "79927398713", "4539 1488 0343 6468", "1234567890123", "", "0", "00", "é1",
]
_CODE_TABLE = _values("s", [(c,) for c in _CODES])
_COUNTRY_SQL = ", ".join(f"'{c}'" for c in V.COUNTRIES)


def _sql_mod97(s):
    digits = f"string_split(regexp_replace(list_reduce(list_transform(string_split(substr({s}, 5) || substr({s}, 1, 4), ''), lambda c: CASE WHEN c BETWEEN 'A' AND 'Z' THEN CAST(ascii(c) - 55 AS VARCHAR) ELSE c END), lambda a, b: a || b), '', ''), '')"
    return f"(CASE WHEN regexp_full_match({s}, '[A-Z]{{2}}[0-9]{{2}}[0-9A-Z]+') THEN list_reduce(list_transform({digits}, lambda d: CAST(d AS BIGINT)), lambda a, d: (a * 10 + d) % 97) = 1 ELSE FALSE END)"


@query(
    f"""SELECT s, (length(c) BETWEEN 15 AND 34 AND {_sql_mod97("c")}) AS iban,
    (regexp_full_match(c, '[\\x00-\\x7F]*') AND length(c) BETWEEN 8 AND 35 AND substr(c, 1, 2) IN ({_COUNTRY_SQL}) AND {_sql_mod97("(substr(c, 1, 4) || substr(c, 8))")}) AS creditor,
    (regexp_full_match(c, '[A-Z]{{6}}[A-Z0-9]{{2}}([A-Z0-9]{{3}})?') AND substr(c, 5, 2) IN ({_COUNTRY_SQL})) AS bic
    FROM (SELECT s, upper(regexp_replace(s, '\\s', '', 'g')) AS c FROM {_CODE_TABLE})"""
)
def val_codes(spark, sf_dir):
    return spark.sql(f"SELECT * FROM {_CODE_TABLE}").select("s", *(f(F.col("s")).alias(n) for n, f in (("iban", V.iban), ("creditor", V.creditor_id), ("bic", V.bic))))


_SQL_LUHN = "(CASE WHEN length(d) < 2 THEN FALSE ELSE list_sum(list_transform(range(1, length(d) + 1), lambda i: CASE WHEN i % 2 = 1 THEN CAST(substr(reverse(d), i, 1) AS BIGINT) ELSE (CAST(substr(reverse(d), i, 1) AS BIGINT) * 2) // 10 + (CAST(substr(reverse(d), i, 1) AS BIGINT) * 2) % 10 END)) % 10 = 0 END)"


@query(f"SELECT s, {_SQL_LUHN} AS ok FROM (SELECT s, regexp_replace(s, '[^0-9]', '', 'g') AS d FROM (SELECT s FROM {_CODE_TABLE} UNION ALL SELECT CAST(o_orderkey * 7919 AS VARCHAR) FROM orders))")
def val_luhn(spark, sf_dir):
    codes = spark.sql(f"SELECT s FROM {_CODE_TABLE}").union(table(spark, sf_dir, "orders").select((F.col("o_orderkey") * 7919).cast("string")))
    return codes.select("s", V.luhn(F.col("s")).alias("ok"))


# ---------------------------------------------------------------- patterns

# An account statement of thirty lines and what a run with the default patterns finds in it.
STATEMENT = [
    "Musterbank AG - Kontoauszug Nr. 1/2026", "Kontoinhaber: Max Mustermann", "Musterstrasse 12, 10115 Berlin", "IBAN: DE89 3704 0044 0532 0130 00", "BIC: COBADEFFXXX", "Kontonummer: 532013000",
    "Bankleitzahl: 37040044", "Auszug vom 01.01.2026 bis 31.01.2026", "Alter Kontostand: 2.480,15 EUR", "Datum       Vorgang                                     Betrag",
    "05.01.2026  Ueberweisung an Musterfirma GmbH       1.234,56 EUR", "            Kto. 4711 0815 BLZ 50010517  Rechnung Nr. 2026-0042", "12.01.2026  Gehalt Arbeitgeber XY AG                3.500,00 EUR",
    "            Lohn/Gehalt 01/2026 Personalnummer 8891234", "18.01.2026  Lastschrift Stadtwerke Musterstadt         89,90 EUR", "            Vertragskonto 30012345 Abschlag Strom",
    "23.01.2026  Ueberweisung an Musterfirma GmbH          420,00 EUR", "            Verwendungszweck: Miete Februar 2026", "25.01.2026  Kartenzahlung Supermarkt Filiale 4021       67,45 EUR",
    "27.01.2026  Dauerauftrag Versicherung Police 90123456   58,00 EUR", "29.01.2026  Gutschrift Erstattung Finanzamt            215,30 EUR", "31.01.2026  Entgeltabrechnung Kontofuehrung              4,90 EUR",
    "Neuer Kontostand: 5.795,60 EUR", "Empfaenger-IBAN: DE02 1203 0000 0000 2020 51", "Glaeubiger-ID: DE98ZZZ09999999999", "Kontakt: max.mustermann@example.org", "Telefon: +49 30 123456789",
    "Steuer-ID: 12345678901", "Filiale Berlin-Mitte, Telefon 030 987654321", "Seite 1 von 1 - erstellt am 01.02.2026",
]
GOLDEN = [
    (3, "iban_de", "DE89 3704 0044 0532 0130 00", 0.99, 6), (4, "bic", "COBADEFFXXX", 0.99, 5), (5, "konto_nr", "532013000", 0.85, 13), (6, "blz", "37040044", 0.8, 14),
    (11, "konto_nr", "4711 0815", 0.85, 17), (11, "blz", "50010517", 0.8, 31), (15, "konto_nr", "30012345", 0.85, 26), (23, "iban_de", "DE02 1203 0000 0000 2020 51", 0.99, 17),
    (24, "glaeubiger_id", "DE98ZZZ09999999999", 0.99, 15), (25, "email", "max.mustermann@example.org", 0.9, 9), (26, "phone_de", "+49 30 123456789", 0.85, 9), (27, "steuer_id", "12345678901", 0.9, 11),
    (28, "phone_de", "030 987654321", 0.85, 30),
]
_STATEMENT_TABLE = _values("doc_id, text", [(-1, "\n".join(STATEMENT))])


def _statement(spark):
    return text_runs(spark.createDataFrame([(-1, "\n".join(STATEMENT))], "doc_id long, text string"))


_GOLDEN_TABLE = _values("run_seq, pattern_id, text, confidence, start", GOLDEN)


@query(f"SELECT CAST(run_seq AS BIGINT) AS run_seq, pattern_id, text, confidence, start, 5.0::DOUBLE * start AS llx, 780.0::DOUBLE - 14.0::DOUBLE * run_seq AS lly, 5.0::DOUBLE * (start + length(text)) AS urx FROM {_GOLDEN_TABLE}")
def pat_statement(spark, sf_dir):
    return patterns.find(_statement(spark)).select("run_seq", "pattern_id", "text", "confidence", "start", "llx", "lly", "urx")


_EMAIL = "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)*\\.[A-Za-z]{2,}"
_EMAIL_HITS = f"(SELECT doc_id, run_seq, page, lly, unnest(regexp_extract_all(text, '({_EMAIL})\\b', 1)) AS hit FROM {RUNS})"


@query(f"SELECT doc_id, run_seq, page, hit AS text, 0.9::DOUBLE AS confidence FROM {_EMAIL_HITS}")
def pat_email(spark, sf_dir):
    return patterns.find(_runs(spark, sf_dir), patterns.select(["email"])).select("doc_id", "run_seq", "page", "text", "confidence")


_CARD = "[0-9]{13,19}|[0-9]{4}(?:[\\s-][0-9]{4}){3}(?:[\\s-][0-9]{3})?|[0-9]{4}[\\s-][0-9]{6}[\\s-][0-9]{4,5}"
_CARD_HITS = f"(SELECT * FROM (SELECT doc_id, run_seq, page, hit, regexp_replace(hit, '[^0-9]', '', 'g') AS d FROM (SELECT doc_id, run_seq, page, unnest(regexp_extract_all(text, '\\b({_CARD})\\b', 1)) AS hit FROM {RUNS})) WHERE {_SQL_LUHN})"


@query(f"SELECT doc_id, run_seq, page, hit AS text, 0.99::DOUBLE AS confidence FROM {_CARD_HITS}")
def pat_credit_card(spark, sf_dir):
    return patterns.find(_runs(spark, sf_dir), patterns.select(["credit_card"])).select("doc_id", "run_seq", "page", "text", "confidence")


_PHONE = "(?:\\+49|0049)[ /-]?(?:\\(0\\)[ /-]?)?[1-9][0-9 /-]{5,14}[0-9]|0[1-9][0-9 /-]{5,14}[0-9]|\\(0[1-9][0-9]{1,4}\\)[ /-]?[0-9][0-9 /-]{3,12}[0-9]"
_DEFAULT_HITS = f"""(SELECT doc_id, 'email' AS pattern_id FROM {_EMAIL_HITS} UNION ALL SELECT doc_id, 'credit_card' FROM {_CARD_HITS})"""


@query(f"SELECT lang, pattern_id, COUNT(*) AS hits, COUNT(DISTINCT doc_id) AS docs FROM {_DEFAULT_HITS} JOIN documents USING (doc_id) WHERE pattern_id IN ('email', 'credit_card') GROUP BY lang, pattern_id")
def detect_by_lang(spark, sf_dir):
    return _by_lang(spark, sf_dir, patterns.select(["credit_card", "email"]))


def _by_lang(spark, sf_dir, wanted):
    docs = table(spark, sf_dir, "documents")
    found = patterns.find(text_runs(docs.select("doc_id", "text")), wanted)
    return found.join(docs.select("doc_id", "lang"), "doc_id").groupBy("lang", "pattern_id").agg(F.count("*").alias("hits"), F.count_distinct("doc_id").alias("docs"))


_BOTH_TABLE = f"(SELECT doc_id, text FROM documents UNION ALL SELECT doc_id, text FROM {_STATEMENT_TABLE})"
_BOTH = RUNS.replace("FROM documents", f"FROM {_BOTH_TABLE}")
_GAP = r"(?:[:.]?[ \t]+|[:.])"  # between a keyword and its number
_ENDS = r"(?:[^0-9A-Za-z]|$)"


def _taken(pattern_id: str, regex: str, group: int, test: str = "TRUE") -> str:
    """Hits of one pattern in the lines of documents and statement, with a test of the compact hit ``c``."""
    found = f"(SELECT upper(regexp_replace(hit, '\\s', '', 'g')) AS c FROM (SELECT unnest(regexp_extract_all(text, '{regex}', {group})) AS hit FROM {_BOTH}))"
    return f"SELECT '{pattern_id}' AS pattern_id FROM {found} WHERE c <> '' AND {test}"


_SQL_CREDITOR = f"length(c) BETWEEN 8 AND 35 AND substr(c, 1, 2) IN ({_COUNTRY_SQL}) AND {_sql_mod97('(substr(c, 1, 4) || substr(c, 8))')}"
_BIC_TEST = f"substr(c, 5, 2) IN ({_COUNTRY_SQL}) AND (regexp_matches(c, '[0-9]') OR regexp_matches(c, '^.{{8}}XXX$'))"
_DEFAULT_SQL = " UNION ALL ".join([
    _taken("iban_de", r"(?:^|[^0-9A-Za-z])((?i:DE)\s?[0-9]{2}(?:\s{0,2}[0-9]){18})(?:[^0-9]|$)", 1, f"length(c) BETWEEN 15 AND 34 AND {_sql_mod97('c')}"),
    _taken("glaeubiger_id", rf"(?:^|[^0-9A-Za-z])((?i:[A-Z]{{2}}[0-9]{{2}}[0-9A-Z]{{3}}[0-9A-Z]{{6,28}})){_ENDS}", 1, _SQL_CREDITOR),
    _taken("konto_nr", rf"(?i:konto(?:nummer|[- ]?(?:nr\.?|nummer))?|kto\.?(?:-?nr\.?)?){_GAP}([0-9]{{4,10}}(?:\s[0-9]{{2,6}})+|[0-9]{{6,10}}){_ENDS}", 1),
    _taken("blz", rf"(?i:blz|bankleitzahl){_GAP}([0-9]{{8}}|[0-9]{{3}}\s[0-9]{{3}}\s[0-9]{{2}}){_ENDS}", 1),
    _taken("bic", r"\b([A-Z]{6}[A-Z0-9]{2}(?:[A-Z0-9]{3})?)\b", 1, _BIC_TEST),
    _taken("steuer_id", rf"(?i:steuer-?(?:id|nr\.?|nummer|identifikationsnummer)|identifikationsnummer|id-?nr\.?){_GAP}([0-9]{{11}}|[0-9]{{2}}\s[0-9]{{3}}\s[0-9]{{3}}\s[0-9]{{3}}){_ENDS}", 1),
    _taken("email", rf"({_EMAIL})\b", 1),
    _taken("phone_de", rf"(?:(?i:telefonnummer|telefon|tel\.?|mobil|handy|fax|fon){_GAP}|(?:^|[^0-9A-Za-z+]))((?:\+49|0049)[ /-]?(?:\(0\)[ /-]?)?[1-9][0-9 /-]{{5,14}}[0-9]){_ENDS}", 1),
    _taken("phone_de", rf"(?i:telefonnummer|telefon|tel\.?|mobil|handy|fax|fon){_GAP}(0[1-9][0-9 /-]{{5,14}}[0-9]|\(0[1-9][0-9]{{1,4}}\)[ /-]?[0-9][0-9 /-]{{3,12}}[0-9]){_ENDS}", 1),
    "SELECT 'credit_card' FROM " + _CARD_HITS.replace("FROM documents", f"FROM {_BOTH_TABLE}"),
])


@query(f"SELECT pattern_id, COUNT(*) AS hits FROM ({_DEFAULT_SQL}) GROUP BY pattern_id")
def pat_default_run(spark, sf_dir):
    """Hits of all default patterns over the documents and the statement, by pattern."""
    texts = table(spark, sf_dir, "documents").select("doc_id", "text").union(spark.sql(f"SELECT doc_id, text FROM {_STATEMENT_TABLE}"))
    return patterns.find(text_runs(texts)).groupBy("pattern_id").agg(F.count("*").alias("hits"))


#: Numbers of the statement that look like an account, a bank code or a telephone number but have no keyword.
_LOW = [
    (3, "konto_nr", "3704 0044 0532 0130 00", 0.3, 11), (3, "phone_de", "0532 0130 00", 0.35, 21), (6, "konto_nr", "37040044", 0.3, 14), (11, "konto_nr", "50010517", 0.3, 31), (13, "konto_nr", "8891234", 0.3, 47),
    (15, "blz", "30012345", 0.25, 26), (19, "konto_nr", "90123456", 0.3, 45), (19, "blz", "90123456", 0.25, 45), (23, "konto_nr", "1203 0000 0000 2020 51", 0.3, 22), (26, "konto_nr", "123456789", 0.3, 16),
    (28, "konto_nr", "987654321", 0.3, 34),
]


@query(f"SELECT run_seq, pattern_id, text, confidence, start FROM {_GOLDEN_TABLE} UNION ALL SELECT run_seq, pattern_id, text, confidence, start FROM {_values('run_seq, pattern_id, text, confidence, start', _LOW)}")
def pat_low_threshold(spark, sf_dir):
    """A low threshold adds numbers without a keyword: all hits, none left out."""
    return patterns.find(_statement(spark), None, 0.25).select("run_seq", "pattern_id", "text", "confidence", "start")


_CUSTOM = {"extend_builtins": False, "patterns": [{"id": "order_no", "regex": r"Nr\. (?<target>[0-9/-]+)", "confidence": 0.7}, {"id": "amount", "regex": r"[0-9.]+,[0-9]{2}(?= EUR)", "confidence": 0.6}]}
_STATEMENT_RUNS = RUNS.replace("FROM documents", f"FROM {_STATEMENT_TABLE}")


@query(
    f"""SELECT run_seq, 'order_no' AS pattern_id, unnest(regexp_extract_all(text, 'Nr\\. ([0-9/-]+)', 1)) AS text FROM {_STATEMENT_RUNS}
    UNION ALL SELECT run_seq, 'amount', unnest(regexp_extract_all(text, '([0-9.]+,[0-9]{{2}}) EUR', 1)) FROM {_STATEMENT_RUNS}"""
)
def pat_custom(spark, sf_dir):
    return patterns.find(_statement(spark), patterns.resolve(_CUSTOM)).select("run_seq", "pattern_id", "text")


@query(f"SELECT run_seq, pattern_id, text FROM {_GOLDEN_TABLE} WHERE pattern_id NOT IN ('konto_nr', 'blz')")
def pat_disabled(spark, sf_dir):
    return patterns.find(_statement(spark), patterns.without(patterns.BUILTIN, ["konto_nr", "blz"])).select("run_seq", "pattern_id", "text")


# ---------------------------------------------------------------- booking list

ENTRIES = [
    booking.Entry("p1", "positive", "de la"), booking.Entry("n1", "negative", "de la que"), booking.Entry("p2", "positive", "the"), booking.Entry("p3", "positive", "  Aux   Mentre "),
    booking.Entry("n2", "negative", "and the"), booking.Entry("p4", "positive", "of", "the", None), booking.Entry("p5", "positive", "para", None, "la"), booking.Entry("p6", "positive", "ü"),
]
_ENTRY_TABLE = _values("entry_seq, booking_id, match_type, needle, bef, aft", booking.compiled(ENTRIES))
_BOOKED = f"""(SELECT doc_id, run_seq, page, lly, entry_seq, booking_id, match_type, needle, bef, aft, norm, CAST(list_sum(list_transform(parts[:k], lambda p: length(p))) + (k - 1) * length(needle) AS BIGINT) AS start
  FROM (SELECT *, unnest(range(1, len(parts))) AS k FROM (SELECT *, string_split(norm, needle) AS parts FROM (SELECT *, lower(text) AS norm FROM {RUNS}) JOIN {_ENTRY_TABLE} e ON contains(norm, needle))))"""
_BOOKED_OK = f"""(SELECT * FROM {_BOOKED} WHERE (bef IS NULL OR (contains(norm, bef) AND strpos(norm, bef) - 1 + length(bef) <= start)) AND (aft IS NULL OR (contains(norm, aft) AND length(norm) - strpos(reverse(norm), reverse(aft)) - length(aft) + 1 >= start + length(needle))))"""


def _booked(spark, sf_dir):
    return booking.find(_runs(spark, sf_dir), ENTRIES)


@query(f"SELECT doc_id, booking_id, match_type, COUNT(*) AS hits, CAST(SUM(start) AS BIGINT) AS starts, CAST(SUM(run_seq) AS BIGINT) AS runs FROM {_BOOKED_OK} GROUP BY doc_id, booking_id, match_type")
def book_hits(spark, sf_dir):
    return _booked(spark, sf_dir).groupBy("doc_id", "booking_id", "match_type").agg(F.count("*").alias("hits"), F.sum("start").alias("starts"), F.sum("run_seq").alias("runs"))


@query(f"SELECT doc_id, run_seq, booking_id, start, 5.0::DOUBLE * start - 2 AS llx, lly - 2 AS lly, 5.0::DOUBLE * (start + length(needle)) + 2 AS urx, lly + 12 AS ury FROM {_BOOKED_OK} WHERE match_type = 'negative'")
def book_negative(spark, sf_dir):
    return _booked(spark, sf_dir).where("match_type = 'negative'").select("doc_id", "run_seq", "booking_id", "start", "llx", "lly", "urx", "ury")


@query(f"SELECT doc_id, run_seq, booking_id, start FROM {_BOOKED_OK} WHERE booking_id IN ('p4', 'p5')")
def book_context(spark, sf_dir):
    return _booked(spark, sf_dir).where("booking_id IN ('p4', 'p5')").select("doc_id", "run_seq", "booking_id", "start")


@query(
    f"""SELECT doc_id, run_seq, n_name, CAST(len(string_split(lower(text), lower(n_name))) - 1 AS BIGINT) AS hits FROM {RUNS}, (SELECT n_name FROM nation UNION ALL SELECT s_name FROM supplier UNION ALL SELECT DISTINCT regexp_extract(text, '^(\\S+ \\S+)', 1) FROM benchmark WHERE regexp_matches(text, '^\\S+ \\S+'))
    WHERE contains(lower(text), lower(n_name))"""
)
def book_large_list(spark, sf_dir):
    """A list of some hundred entries goes through the automaton."""
    names = [r[0] for r in table(spark, sf_dir, "nation").select("n_name").collect()] + [r[0] for r in table(spark, sf_dir, "supplier").select("s_name").collect()]
    names += sorted({" ".join(r[0].split(" ")[:2]) for r in table(spark, sf_dir, "benchmark").where(r"text rlike '^\\S+ \\S+'").select(F.regexp_extract("text", r"^(\S+ \S+)", 1)).collect()})
    entries = [booking.Entry(n, "positive", n) for n in names]
    found = booking.find(_runs(spark, sf_dir), entries)
    return found.groupBy("doc_id", "run_seq", F.col("booking_id").alias("n_name")).agg(F.count("*").alias("hits"))


# ---------------------------------------------------------------- conflicts

#: Regions in several layouts; rows of kind booking and negative block others.
_LAYOUT = [
    (1, 0, 0, "pattern", "iban_de", None, 0.99, "a", 10, 10, 50, 20), (1, 0, 1, "booking", "b003", "negative", None, "neg", 0, 0, 100, 30), (1, 0, 2, "booking", "b004", "negative", None, "later", 0, 0, 100, 30),
    (1, 1, 3, "pattern", "iban_de", None, 0.99, "other page", 10, 10, 50, 20), (1, 0, 4, "manual", "by hand", None, None, "m", 10, 10, 50, 20),
    (2, 0, 0, "pattern", "blz", None, 0.8, "sixty", 0, 0, 100, 10), (2, 0, 1, "booking", "n", "negative", None, "x", 40, 0, 200, 10),
    (3, 0, 0, "pattern", "blz", None, 0.8, "forty", 0, 0, 100, 10), (3, 0, 1, "booking", "n", "negative", None, "x", 60, 0, 200, 10),
    (4, 0, 0, "pattern", "p", None, 0.9, "99.0", 0, 0, 1010, 10), (4, 0, 1, "pattern", "p", None, 0.9, "inner", 0, 0, 1000, 10), (4, 0, 2, "pattern", "p", None, 0.9, "right", 500, 0, 1400, 10),
    (5, 0, 0, "pattern", "p", None, 0.9, "99.95", 0, 0, 1000.5, 10), (5, 0, 1, "pattern", "p", None, 0.9, "inner", 0, 0, 1000, 10),
    (6, 0, 0, "pattern", "p", None, 0.9, "same", 0, 0, 10, 10), (6, 0, 1, "pattern", "q", None, 0.9, "same", 0, 0, 10, 10), (6, 0, 2, "pattern", "p", None, 0.9, "again", 0, 0, 10, 10), (6, 0, 3, "pattern", "p", None, 0.8, "other confidence", 0, 0, 10, 10),
    (7, 0, 0, "pattern", "p", None, 0.9, "nan", NAN, 0, 10, 10), (7, 0, 1, "booking", "n", "negative", None, "inf", 0, 0, INF, 10), (7, 0, 2, "pattern", "p", None, 0.9, "fine", 0, 0, 10, 10), (7, 0, 3, "booking", "n2", "negative", None, "flat", 0, 5, 10, 5),
    (8, 0, 0, "pattern", "p", None, 0.9, "point", 5, 5, 5, 5), (8, 0, 1, "booking", "big", "negative", None, "wide", -5000, -5000, 5000, 5000),
]
_LAYOUT_TABLE = _values("doc_id, page, seq, kind, ref, match_type, confidence, text, llx, lly, urx, ury", [(*r[:8], *map(float, r[8:])) for r in _LAYOUT])
_NEG = f"(SELECT doc_id AS d, page AS p, seq AS s, ref AS o_ref, text AS o_text, llx AS o_llx, lly AS o_lly, urx AS o_urx, ury AS o_ury FROM {_LAYOUT_TABLE} WHERE kind = 'booking' AND match_type = 'negative')"
_CANDS = f"(SELECT * FROM {_LAYOUT_TABLE} WHERE NOT (kind = 'booking' AND coalesce(match_type, '') = 'negative'))"
_BLOCKED_SQL = f"(SELECT doc_id, page, seq, arg_min(o_ref, s) AS booking_id, arg_min(o_text, s) AS pattern FROM {_CANDS} JOIN {_NEG} ON doc_id = d AND page = p WHERE kind <> 'manual' AND {_SQL_COVER} >= 0.5 GROUP BY doc_id, page, seq)"


def _layout(spark):
    return spark.sql(f"SELECT * FROM {_LAYOUT_TABLE}")


@query(f"SELECT b.doc_id, b.page, b.seq, b.booking_id, b.pattern, CASE kind WHEN 'pattern' THEN 'pattern: ' || ref || ' (confidence ' || printf('%.2f', confidence) || ')' ELSE ref END AS blocked_reason FROM {_BLOCKED_SQL} b JOIN {_LAYOUT_TABLE} USING (doc_id, page, seq)")
def conflict_blocked(spark, sf_dir):
    return conflict.resolve(_layout(spark))[1].select("doc_id", "page", "seq", "booking_id", "pattern", "blocked_reason")


_LEFT = f"(SELECT * FROM {_CANDS} c ANTI JOIN {_BLOCKED_SQL} b USING (doc_id, page, seq))"
_OTHER = f"(SELECT doc_id AS d, page AS p, seq AS s, kind AS k, ref AS r, match_type AS m, confidence AS c, llx AS o_llx, lly AS o_lly, urx AS o_urx, ury AS o_ury FROM {_LEFT})"


@query(
    f"""SELECT doc_id, page, seq, text FROM {_LEFT} x WHERE NOT EXISTS (SELECT 1 FROM {_OTHER} WHERE d = doc_id AND p = page AND k = kind AND r = ref AND m IS NOT DISTINCT FROM match_type AND c IS NOT DISTINCT FROM confidence
    AND (o_llx < llx OR (o_llx = llx AND s < seq)) AND {_SQL_COVER} >= 0.999)"""
)
def conflict_redact(spark, sf_dir):
    return conflict.resolve(_layout(spark))[0].select("doc_id", "page", "seq", "text")


@query(f"SELECT doc_id, COUNT(*) AS n FROM {_LAYOUT_TABLE} GROUP BY doc_id")
def candidate_budget(spark, sf_dir):
    return conflict.within_budget(_layout(spark), 10).groupBy("doc_id").agg(F.count("*").alias("n"))


_BOOK_NEG_SQL = "(SELECT doc_id, run_seq, page, start, 5.0::DOUBLE * start - 2 AS a, 5.0::DOUBLE * (start + length(needle)) + 2 AS b, lly - 2 AS c, lly + 12 AS d FROM {} WHERE match_type = 'negative')"
_COMMON = [booking.Entry("pos", "positive", "the of"), booking.Entry("neg", "negative", "in the of")]
_COMMON_TABLE = _values("entry_seq, booking_id, match_type, needle, bef, aft", booking.compiled(_COMMON))
_COMMON_SQL = _BOOKED.replace(_ENTRY_TABLE, _COMMON_TABLE)


def _common(spark, sf_dir):
    runs = _runs(spark, sf_dir)
    return runs, cut(conflict.collect(None, booking.find(runs, _COMMON), patterns.find(runs, patterns.select(["email", "credit_card"]))))


_COMMON_LEFT = f"""(SELECT doc_id, page, run_seq, start, length(needle) AS n, lly FROM {_COMMON_SQL} p WHERE booking_id = 'pos' AND NOT EXISTS (SELECT 1 FROM {_BOOK_NEG_SQL.format(_COMMON_SQL)} q
   WHERE q.doc_id = p.doc_id AND q.run_seq = p.run_seq AND least(q.b, 5.0::DOUBLE * (p.start + length(needle))) - greatest(q.a, 5.0::DOUBLE * p.start) >= 0.5 * 5.0 * length(needle)))"""
_ALL_LEFT = f"""(SELECT doc_id, page, run_seq, start, n, lly FROM {_COMMON_LEFT} UNION ALL SELECT doc_id, page, run_seq, CAST(list_sum(list_transform(ps[:k], lambda p: length(p))) + (k - 1) * length(hit) AS BIGINT), length(hit), lly FROM (SELECT *, unnest(range(1, len(ps))) AS k FROM (SELECT DISTINCT r.*, h.hit, string_split(r.text, h.hit) AS ps FROM {RUNS} r JOIN (SELECT doc_id, run_seq, hit FROM {_EMAIL_HITS} UNION ALL SELECT doc_id, run_seq, hit FROM {_CARD_HITS}) h USING (doc_id, run_seq))))"""


@query(f"SELECT doc_id, COUNT(*) AS n, CAST(SUM(start) AS BIGINT) AS starts FROM {_ALL_LEFT} GROUP BY doc_id")
def conflict_documents(spark, sf_dir):
    """Lists and patterns over all documents, negative entries respected."""
    _, regions = _common(spark, sf_dir)
    kept, _ = conflict.resolve(regions)
    return kept.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("seq.start").alias("starts"))


# ---------------------------------------------------------------- masking and effects


@query(
    f"""SELECT doc_id, run_seq, list_reduce(list_prepend('', list_transform(range(length(text)), lambda i: CASE WHEN list_bool_or(list_transform(hs, lambda h: i BETWEEN h[1] AND h[2])) THEN '█' ELSE substr(text, CAST(i + 1 AS BIGINT), 1) END)), lambda a, b: a || b) AS masked,
    CAST(len(list_filter(range(length(text)), lambda i: list_bool_or(list_transform(hs, lambda h: i BETWEEN h[1] AND h[2])))) AS BIGINT) AS removed
    FROM (SELECT doc_id, run_seq, text, list([start, start + n - 1]) AS hs FROM {_ALL_LEFT} JOIN (SELECT doc_id, run_seq, text FROM {RUNS}) USING (doc_id, run_seq) GROUP BY doc_id, run_seq, text)"""
)
def mask_text(spark, sf_dir):
    runs, regions = _common(spark, sf_dir)
    kept, _ = conflict.resolve(regions)
    return mask.mask(runs, mask.hidden_spans(runs, kept)).where("removed > 0").select("doc_id", "run_seq", "masked", "removed")


@query(f"SELECT doc_id, run_seq, regexp_replace(text, '({_EMAIL})\\b', '[GESCHWÄRZT]', 'g') AS masked FROM {RUNS} WHERE regexp_matches(text, '({_EMAIL})\\b')")
def mask_replace(spark, sf_dir):
    runs = _runs(spark, sf_dir)
    regions = conflict.collect(None, None, patterns.find(runs, patterns.select(["email"])))
    return mask.mask(runs, mask.hidden_spans(runs, regions), "replace").where("removed > 0").select("doc_id", "run_seq", "masked")


_RECTS = _values("doc_id, page, seq, kind, ref, match_type, confidence, text, llx, lly, urx, ury", [
    (-1, 0, k, "manual", f"r{k}", None, None, None, *map(float, r))
    for k, r in enumerate([(0, 780, 50, 790), (52, 780, 61, 790), (0, 785, 30, 800), (0, 787.6, 30, 800), (0, 766, 3, 776), (600, 752, 900, 762), (-50, 0, -10, 10), (5, 5, 5, 5), (700, 900, 800, 950), (NAN, 0, 1, 1), (10, 745, 40, 775), (33, 724, 34, 734)])
] + [(-1, 4, 50, "manual", "gone", None, None, None, 0.0, 0.0, 10.0, 10.0)])
_PADDED = f"(SELECT seq, page, llx - 1 AS x0, lly - 1 AS y0, urx + 1 AS x1, ury + 1 AS y1, llx, lly, urx, ury FROM {_RECTS})"
_GLYPH_HITS = f"""(SELECT seq, r.page, run_seq, i FROM (SELECT *, unnest(range(length(text))) AS i FROM {_STATEMENT_RUNS}) g JOIN {_PADDED} r ON r.page = g.page AND isfinite(x0) AND isfinite(y0) AND isfinite(x1) AND isfinite(y1) AND x1 > x0 AND y1 > y0
   WHERE greatest(least(x1, 5.0 * (i + 1)) - greatest(x0, 5.0 * i), 0) * greatest(least(y1, g.lly + 10) - greatest(y0, g.lly), 0) / 50.0 >= 0.25 OR (5.0 * i + 2.5 BETWEEN x0 AND x1 AND g.lly + 5 BETWEEN y0 AND y1))"""


def _manual_rects(spark):
    return spark.sql(f"SELECT * FROM {_RECTS}")


@query(f"SELECT seq, run_seq, MIN(i) AS lo, MAX(i) AS hi FROM {_GLYPH_HITS} GROUP BY seq, run_seq")
def glyph_select(spark, sf_dir):
    return mask.hidden_spans(_statement(spark), _manual_rects(spark)).select("seq", "run_seq", "lo", "hi")


_EFFECT_SQL = f"""(SELECT p.seq, p.page, coalesce(n, 0) AS removed_glyphs, CASE WHEN p.page >= 1 THEN 'missing_page' WHEN NOT (isfinite(x0) AND isfinite(y0) AND isfinite(x1) AND isfinite(y1)) OR x1 <= x0 OR y1 <= y0 THEN 'degenerate'
   WHEN NOT (least(urx, 595) > greatest(llx, 0) AND least(ury, 842) > greatest(lly, 0)) THEN 'off_page' WHEN coalesce(n, 0) > 0 THEN 'applied' ELSE 'covered' END AS effect
   FROM {_PADDED} p LEFT JOIN (SELECT seq, COUNT(*) AS n FROM {_GLYPH_HITS} GROUP BY seq) USING (seq))"""


def _statement_effects(spark):
    runs, rects = _statement(spark), _manual_rects(spark)
    spans = mask.hidden_spans(runs, rects)
    return effects.with_effects(mask.removed_by_region(rects, spans), page_boxes(runs))


@query(f"SELECT seq, page, removed_glyphs, effect FROM {_EFFECT_SQL}")
def effects_entries(spark, sf_dir):
    return _statement_effects(spark).select("seq", "page", "removed_glyphs", "effect")


_EFFECT_SUMS = ", ".join(f"COUNT(*) FILTER (WHERE effect = '{e}') AS {e}" for e in effects.EFFECTS)


@query(
    f"SELECT COUNT(*) AS requested, {_EFFECT_SUMS}, CAST(SUM(removed_glyphs) AS BIGINT) AS removed_glyphs, COUNT(*) FILTER (WHERE effect IN ('degenerate', 'missing_page', 'off_page')) AS ineffective, CAST(COUNT(DISTINCT effect) FILTER (WHERE effect <> 'applied') AS INTEGER) AS n_warnings FROM {_EFFECT_SQL}"
)
def effects_by_class(spark, sf_dir):
    measured = effects.warnings(effects.measure(_statement_effects(spark)))
    return measured.select("requested", *effects.EFFECTS, "removed_glyphs", "ineffective", F.size("warnings").alias("n_warnings"))


_NOTES = _values("doc_id, page, note", [(1, 3, "box replaced"), (1, 1, "box replaced"), (1, 1, "font unreadable"), (1, 3, "box replaced"), (2, 0, "stream lost"), (2, 5, "copy made of an image")])


@query(f"SELECT doc_id, note, COUNT(DISTINCT page) AS n_pages, MIN(page) AS first_page, string_agg(DISTINCT CAST(page AS VARCHAR), ',' ORDER BY CAST(page AS VARCHAR)) AS pages FROM {_NOTES} GROUP BY doc_id, note")
def healed_pages(spark, sf_dir):
    out = effects.healed_pages(spark.sql(f"SELECT * FROM {_NOTES}"))
    return out.select("doc_id", "note", F.size("pages").cast("long").alias("n_pages"), "first_page", F.array_join(F.transform("pages", lambda p: p.cast("string")), ",").alias("pages"))


@query(f"SELECT doc_id, CAST(COUNT(DISTINCT note) FILTER (WHERE NOT (contains(note, 'encoded anew') OR contains(note, 'copy made') OR contains(note, 'box replaced'))) AS INTEGER) AS gaps FROM {_NOTES} GROUP BY doc_id")
def coverage_gaps(spark, sf_dir):
    texts = spark.sql(f"SELECT * FROM {_NOTES}").groupBy("doc_id").agg(F.collect_set("note").alias("notes"))
    return texts.select("doc_id", F.size(effects.gaps(F.col("notes"))).alias("gaps"))


@query("SELECT user_id, COUNT(*) AS islands, CAST(SUM(hi - lo + 1) AS BIGINT) AS covered FROM (SELECT user_id, isl, MIN(lo) AS lo, MAX(hi) AS hi FROM (SELECT *, SUM(fresh) OVER (PARTITION BY user_id ORDER BY lo, hi, event_id) AS isl FROM (SELECT *, CASE WHEN lo > MAX(hi) OVER (PARTITION BY user_id ORDER BY lo, hi, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 1 WHEN row_number() OVER (PARTITION BY user_id ORDER BY lo, hi, event_id) = 1 THEN 1 ELSE 0 END AS fresh FROM (SELECT user_id, event_id, event_id % 997 AS lo, event_id % 997 + event_id % 7 AS hi FROM events))) GROUP BY user_id, isl) GROUP BY user_id")
def span_islands(spark, sf_dir):
    """Merging of overlapping and adjacent intervals, over the events' numbers."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), F.lit(0).alias("page"), F.lit(0).alias("run_seq"), F.col("event_id").alias("seq"), (F.col("event_id") % 997).alias("lo"), (F.col("event_id") % 997 + F.col("event_id") % 7).alias("hi"))
    return mask.islands(e).groupBy(F.col("doc_id").alias("user_id")).agg(F.count("*").alias("islands"), F.sum(F.col("hi") - F.col("lo") + 1).alias("covered"))


# ---------------------------------------------------------------- review and audit


def _email_regions(spark, sf_dir):
    runs = _runs(spark, sf_dir)
    return runs, conflict.collect(None, None, patterns.find(runs, patterns.select(["email"])))


@query(f"SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY run_seq) - 1 AS INTEGER) AS item, page, hit AS text, 'blackout' AS action, 'email' AS ref, 0.9::DOUBLE AS confidence, sha256((SELECT text FROM documents d WHERE d.doc_id = e.doc_id)) AS sha256 FROM {_EMAIL_HITS} e")
def review_items(spark, sf_dir):
    """Regions written as review files and read again."""
    runs, regions = _email_regions(spark, sf_dir)
    files = effects.review_files(regions, table(spark, sf_dir, "documents"), page_boxes(runs))
    return effects.read_reviews(files).select("doc_id", "item", "page", "text", "action", "ref", "confidence", "sha256")


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 2 THEN 'unverified' WHEN doc_id % 3 = 0 THEN 'match' ELSE 'mismatch' END AS identity, doc_id % 3 = 0 AS accepted FROM documents")
def review_identity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    sha = F.when(F.col("doc_id") % 3 == 0, F.sha2("text", 256)).when(F.col("doc_id") % 3 == 1, F.sha2(F.concat("text", F.lit("!")), 256))
    return effects.identity(docs.select("doc_id", sha.alias("sha256")), docs)


@query(f"SELECT doc_id, page, 'auto' AS source, 'pattern: email (confidence 0.90)' AS reason, CASE WHEN 5.0 * (strpos(text, hit) - 1) >= 595 THEN 'off_page' ELSE 'applied' END AS effect, CAST(length(hit) AS BIGINT) AS removed_glyphs FROM {_EMAIL_HITS} JOIN (SELECT doc_id, run_seq, text FROM {RUNS}) USING (doc_id, run_seq)")
def audit_entries(spark, sf_dir):
    runs, regions = _email_regions(spark, sf_dir)
    counted = mask.removed_by_region(regions, mask.hidden_spans(runs, regions))
    return effects.audit_entries(effects.with_effects(counted, page_boxes(runs))).select("doc_id", "page", "source", "reason", "effect", "removed_glyphs")


@query("SELECT source, CASE WHEN bool_or(doc_id % 701 = 0) THEN 1 WHEN bool_or(n_chars % 97 = 0) THEN 3 ELSE 0 END AS exit_code FROM documents GROUP BY source")
def exit_code(spark, sf_dir):
    """A run for each source: some documents fail, some are inspected in part only."""
    status = table(spark, sf_dir, "documents").select("source", (F.col("doc_id") % 701 == 0).alias("failed"), (F.col("n_chars") % 97 == 0).alias("incomplete"))
    return effects.exit_codes(status, ["source"])


_OUTPUTS = _values("input, output", [("a.pdf", "x.pdf"), ("b.pdf", "x.pdf"), ("c.pdf", "a.pdf"), ("d.pdf", "d2.pdf")])


@query(f"SELECT output, COUNT(*) > 1 AS collides, output IN (SELECT input FROM {_OUTPUTS}) AS over_input FROM {_OUTPUTS} GROUP BY output")
def batch_collisions(spark, sf_dir):
    return effects.output_collisions(spark.sql(f"SELECT * FROM {_OUTPUTS}")).select("output", "collides", "over_input")


# ---------------------------------------------------------------- leaks


def _needles(spark, sf_dir):
    rows = table(spark, sf_dir, "benchmark").orderBy("item_id").collect()  # four words an item are kept
    return [" ".join(r.text.split(" ")[:4]) for r in rows]


def _leaks_of(spark, sf_dir, needles):
    """Findings of all needles in the documents, searched for in blocks of as many as one search takes."""
    carriers = leaks.text_carriers(table(spark, sf_dir, "documents"), "doc_id", {"text": leaks.DECODED})
    found = None
    for at in range(0, max(len(needles), 1), leaks.MAX_NEEDLES):
        some = leaks.search_text(carriers, needles[at : at + leaks.MAX_NEEDLES]).withColumn("needle_id", F.col("needle_id") + F.lit(at))
        found = found.union(some) if found else some
    return found


_NEEDLE_SQL = "(SELECT CAST(row_number() OVER (ORDER BY item_id) - 1 AS INTEGER) AS needle_id, array_to_string(string_split(text, ' ')[1:4], ' ') AS needle FROM benchmark)"


@query(f"SELECT doc_id AS carrier_id, CAST(7 AS INTEGER) AS view, needle_id, contains(text, needle) AS literal FROM documents, {_NEEDLE_SQL} WHERE contains(text, needle) OR (regexp_matches(needle, '\\s') AND contains(regexp_replace(text, '\\s', '', 'g'), regexp_replace(needle, '\\s', '', 'g')))")
def leaks_literal(spark, sf_dir):
    return _leaks_of(spark, sf_dir, _needles(spark, sf_dir))


_WORDS = ["example", "class ad", "footer>&copy", "the of", "Erin."]
_WORD_TABLE = _values("k, needle", list(enumerate(_WORDS)))


@query(f"SELECT page_id AS carrier_id, view, CAST(k AS INTEGER) AS needle_id, contains(content, needle) AS literal FROM (SELECT page_id, CAST(1 AS INTEGER) AS view, html AS content FROM pages UNION ALL SELECT page_id, CAST(5 AS INTEGER), url FROM pages), {_WORD_TABLE} WHERE contains(content, needle) OR (contains(needle, ' ') AND contains(regexp_replace(content, '\\s', '', 'g'), replace(needle, ' ', '')))")
def leaks_squeezed(spark, sf_dir):
    return leaks.search_text(leaks.text_carriers(table(spark, sf_dir, "pages"), "page_id", {"html": leaks.RAW, "url": leaks.NAMES}), _WORDS)


@query(f"SELECT needle_id, needle, COUNT(doc_id) AS found, coalesce(bool_or(contains(text, needle)), FALSE) AS literal FROM {_NEEDLE_SQL} LEFT JOIN documents ON contains(text, needle) OR (regexp_matches(needle, '\\s') AND contains(regexp_replace(text, '\\s', '', 'g'), regexp_replace(needle, '\\s', '', 'g'))) GROUP BY needle_id, needle")
def leaks_summary(spark, sf_dir):
    needles = _needles(spark, sf_dir)
    return leaks.summary(_leaks_of(spark, sf_dir, needles), needles).drop("views")


_CODED = ["0000001", "Customer#", "mer#00", "nothing"]
_CODED_TABLE = _values("k, form, h", [(k, f, n.encode(c).hex().upper()) for k, n in enumerate(_CODED) for f, c in enumerate(("utf-8", "utf-16-be", "utf-16-le"))])
_CARRIERS = """(SELECT c_custkey, view, CASE view WHEN 1 THEN h WHEN 2 THEN regexp_replace(h, '(..)', '00\\1', 'g') WHEN 3 THEN hex(encode(h)) ELSE hex(encode(lower(h))) END AS h
   FROM (SELECT c_custkey, hex(encode(c_name)) AS h, unnest([1, 2, 3, 4]) AS view FROM customer))"""


@query(f"SELECT c_custkey AS carrier_id, CAST(view AS INTEGER) AS view, CAST(k AS INTEGER) AS needle_id, CAST(form AS INTEGER) AS form FROM {_CARRIERS} c, {_CODED_TABLE} n WHERE regexp_matches(c.h, '^(?:..)*' || n.h) OR regexp_matches(c.h, '^(?:..)*' || hex(encode(n.h))) OR regexp_matches(c.h, '^(?:..)*' || hex(encode(lower(n.h))))")
def leaks_encoded(spark, sf_dir):
    """Customers' names as bytes, as UTF-16 and as hex in either case, and needles under every form."""
    name = F.encode("c_name", "UTF-8")
    forms = [name, F.encode("c_name", "UTF-16BE"), F.encode(F.hex(name), "UTF-8"), F.encode(F.lower(F.hex(name)), "UTF-8")]
    rows = F.array(*(F.struct(F.lit(k).alias("view"), c.alias("content")) for k, c in enumerate(forms, 1)))
    return leaks.search_bytes(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("carrier_id"), F.inline(rows)), _CODED)


_MAIL = "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)*\\.[A-Za-z]{2,}"


@query(f"SELECT doc_id, needle, CASE WHEN doc_id % 2 = 0 THEN 'gone' WHEN doc_id % 3 = 0 THEN 'kept' ELSE 'leak' END AS verdict FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '({_MAIL})\\b', 1)) AS needle FROM documents)")
def leaks_half_masked(spark, sf_dir):
    """Addresses that only every other document hides; in every third they were also kept on purpose."""
    lines_ = _runs(spark, sf_dir)
    hits = patterns.find(lines_, patterns.select(["email"])).select("doc_id", "text")
    hidden = F.regexp_replace("text", f"{_MAIL}\\b", "[X]")
    masked = lines_.select("doc_id", "run_seq", F.when(F.col("doc_id") % 2 == 0, hidden).otherwise(F.col("text")).alias("masked"))
    return leaks.export_check(masked, leaks.export_needles(hits, hits.where("doc_id % 3 = 0")))


@query("SELECT doc_id, needle, CASE WHEN contains(text, needle) THEN 'gone' END AS verdict FROM (SELECT DISTINCT doc_id, text, unnest(regexp_extract_all(text, '([A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)*\\.[A-Za-z]{2,})\\b', 1)) AS needle FROM documents)")
def leaks_after_export(spark, sf_dir):
    """The texts that a run hid are searched for in what remains."""
    config = redaction.RunConfig(patterns=patterns.select(["email"]))
    return redaction.run(table(spark, sf_dir, "documents").select("doc_id", "text"), config).check()


# ---------------------------------------------------------------- text functions


@query("SELECT c_custkey, lower(c_name) AS norm, regexp_replace(c_name, '\\s', '', 'g') AS squeezed, CASE WHEN length(c_name) > 12 THEN substr(c_name, 1, 11) || '…' ELSE c_name END AS short, lower(hex(encode(c_name))) AS hexed FROM customer")
def text_functions(spark, sf_dir):
    c = F.col("c_name")
    return table(spark, sf_dir, "customer").select("c_custkey", T.normalize(c).alias("norm"), T.squeeze(c).alias("squeezed"), T.shorten(c, 12).alias("short"), F.lower(F.hex(F.encode(c, "UTF-8"))).alias("hexed"))


@query("SELECT c_mktsegment, CAST(COUNT(*) AS BIGINT) AS n, CAST(SUM(CASE WHEN c_nationkey % 2 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS removed FROM customer GROUP BY c_mktsegment")
def meta_whitelist(spark, sf_dir):
    """Of each customer's properties only the listed keys stay."""
    props = F.map_from_entries(F.filter(F.array(F.struct(F.lit("name").alias("k"), F.col("c_name").alias("v")), F.when(F.col("c_nationkey") % 2 == 0, F.struct(F.lit("secret").alias("k"), F.col("c_name").alias("v")))), lambda x: x.isNotNull()))
    kept = lines.keep_listed(table(spark, sf_dir, "customer").select("c_mktsegment", props.alias("props")), "props", ["name", "address"])
    return kept.groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.sum("removed").alias("removed"))


@query("WITH RECURSIVE e AS (SELECT CAST(p_partkey AS BIGINT) AS src, unnest([p_partkey * 2, p_partkey * 3]) AS dst FROM part), r(node) AS (SELECT 1::BIGINT UNION SELECT CAST(e.dst AS BIGINT) FROM r JOIN e ON r.node = e.src) SELECT CAST(0 AS BIGINT) AS doc_id, node FROM r")
def reachable(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("k"))
    edges = p.select(F.lit(0).cast("long").alias("doc_id"), F.col("k").alias("src"), F.explode(F.array(F.col("k") * 2, F.col("k") * 3)).alias("dst"))
    return lines.reachable(spark.createDataFrame([(0, 1)], "doc_id long, node long"), edges)




@query(f"SELECT doc_id, page, trim(regexp_replace(text, ' +', ' ', 'g')) AS text FROM {_STATEMENT_RUNS}")
def lines_rebuild(spark, sf_dir):
    """Lines from single characters: those of the statement, with the blanks left out and found again by their gaps."""
    runs = _statement(spark)
    glyphs = runs.select("doc_id", "page", "lly", F.posexplode(F.split("text", "")).alias("i", "ch")).where("ch <> ' '")
    glyphs = glyphs.select("doc_id", "page", "ch", (F.col("i") * 5.0).alias("x"), F.col("lly").alias("y"), F.lit(5.0).alias("advance"), F.lit(1.0).alias("dx"), F.lit(0.0).alias("dy"), F.lit(5.0).alias("space"))
    return lines.lines(glyphs).select("doc_id", "page", "text")


# ---------------------------------------------------------------- PDF files


@query("SELECT item_id, CAST(SUM(length(l)) AS BIGINT) AS n_glyphs, md5(string_agg(l, '' ORDER BY k)) AS digest FROM (SELECT item_id, k, ls[k + 1] AS l FROM (SELECT item_id, ls, unnest(range(len(ls))) AS k FROM (SELECT item_id, string_split(text, chr(10)) AS ls FROM benchmark)) WHERE ls[k + 1] <> '') GROUP BY item_id")
def pdf_round_trip(spark, sf_dir):
    """Every benchmark text as a PDF file, read again glyph by glyph."""
    from umbra.sources import pdf

    def made(batches):
        import pyarrow as pa

        for batch in batches:
            pages = [[(50.0, 780.0 - 14 * k, 10.0, line) for k, line in enumerate((t or "").split("\n")) if line] for t in batch.column("text").to_pylist()]
            ids = [str(i) for i in batch.column("item_id").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([pdf.build([p]) for p in pages], pa.binary())], ["path", "content"])

    files = table(spark, sf_dir, "benchmark").select("item_id", "text").mapInArrow(made, "path string, content binary")
    whole = pdf.glyph_rows(files).where("kind = 'glyph'").groupBy("path").agg(F.count("*").alias("n_glyphs"), F.array_sort(F.collect_list(F.struct("seq", "ch"))).alias("xs"))
    text = F.array_join(F.transform("xs", lambda x: x["ch"]), "")
    return whole.select(F.col("path").cast("long").alias("item_id"), "n_glyphs", F.md5(text).alias("digest"))


_ITEM_LINES = "(SELECT item_id, k, ls[k + 1] AS l FROM (SELECT item_id, ls, unnest(range(len(ls))) AS k FROM (SELECT item_id, string_split(text, chr(10)) AS ls FROM benchmark)))"


@query(f"SELECT item_id, CAST(SUM(CASE WHEN k = 0 THEN length(l) ELSE 0 END) AS BIGINT) AS removed, coalesce(string_agg(l, '' ORDER BY k) FILTER (WHERE k > 0), '') AS left_text FROM {_ITEM_LINES} GROUP BY item_id")
def pdf_redact(spark, sf_dir):
    """Every benchmark text as a PDF file without its first line: what was removed, and what a second reading finds."""
    from umbra.sources import pdf

    files = _redacted_items(spark, sf_dir)
    texts = pdf.glyph_rows(files.select("path", "content")).where("kind = 'glyph'").groupBy("path").agg(F.array_sort(F.collect_list(F.struct("seq", "ch"))).alias("xs"))
    read = files.select("path", "removed").join(texts, "path", "left")
    return read.select(F.col("path").cast("long").alias("item_id"), "removed", F.coalesce(F.array_join(F.transform("xs", lambda x: x["ch"]), ""), F.lit("")).alias("left_text"))


def _redacted_items(spark, sf_dir):
    """(path, content, removed): files of the benchmark's texts without their first lines."""
    from umbra.sources import pdf

    def made(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                lines_ = (text or "").split("\n")
                data = pdf.build([[(50.0, 780.0 - 14 * k, 10.0, line) for k, line in enumerate(lines_) if line]])
                out.append(pdf.redact(data, [(0, 0.0, 776.0, 100_000.0, 792.0)]))
            yield pa.RecordBatch.from_arrays([pa.array(map(str, batch.column("item_id").to_pylist())), pa.array([o for o, _ in out], pa.binary()), pa.array([sum(n) for _, n in out], pa.int64())], ["path", "content", "removed"])

    return table(spark, sf_dir, "benchmark").select("item_id", "text").mapInArrow(made, "path string, content binary, removed long")


# ---------------------------------------------------------------- other carriers

_NOTES_RECTS = _values("doc_id, page, annotation, llx, lly, urx, ury", [(1, 0, 1, 0.0, 0.0, 10.0, 10.0), (1, 0, 2, 20.0, 0.0, 30.0, 10.0), (1, 1, 3, 0.0, 0.0, 10.0, 10.0), (2, 0, 4, 10.0, 0.0, 20.0, 10.0), (1, 0, 5, NAN, 0.0, 10.0, 10.0)])
_ZONES = _values("doc_id, page, llx, lly, urx, ury", [(1, 0, 5.0, 5.0, 20.0, 20.0), (2, 0, 0.0, 0.0, 10.0, 10.0), (1, 0, 0.0, 0.0, 7.0, 7.0)])


@query(
    f"""SELECT annotation, NOT EXISTS (SELECT 1 FROM {_ZONES} z WHERE z.doc_id = a.doc_id AND z.page = a.page AND isfinite(a.llx) AND a.llx < z.urx AND z.llx < a.urx AND a.lly < z.ury AND z.lly < a.ury) AS kept FROM {_NOTES_RECTS} a"""
)
def annotations_split(spark, sf_dir):
    from umbra.operators import carriers

    kept, removed = carriers.split_annotations(spark.sql(f"SELECT * FROM {_NOTES_RECTS}"), spark.sql(f"SELECT * FROM {_ZONES}"))
    return kept.select("annotation", F.lit(True).alias("kept")).union(removed.select("annotation", F.lit(False).alias("kept")))


_MARKED = _values("doc_id, stream, section, first_op, last_op", [(1, "s", 1, 0, 5), (1, "s", 2, 6, 9), (1, "t", 3, 0, 9), (2, "s", 4, 0, 9)])
_HIDDEN = _values("doc_id, stream, op", [(1, "s", 5), (1, "s", 4), (2, "s", 10), (1, "t", 10)])


@query(f"SELECT DISTINCT section FROM {_MARKED} m JOIN {_HIDDEN} h ON m.doc_id = h.doc_id AND m.stream = h.stream AND op BETWEEN first_op AND last_op")
def mirrors_to_clear(spark, sf_dir):
    from umbra.operators import carriers

    return carriers.mirrors_to_clear(spark.sql(f"SELECT * FROM {_MARKED}"), spark.sql(f"SELECT * FROM {_HIDDEN}")).select("section")


def _samples(scale: int):
    """A vector as samples of eight bits, scaled in its own type: a product of a float and an integer would be a double here."""
    return F.transform("embedding", lambda v: F.floor(F.abs(v) * F.lit(scale).cast("float")) % 256)


@query("SELECT e.vec_id, list_sum(list_transform(range(len(px)), lambda k: CASE WHEN k % 8 < 5 AND k % 8 + 1 > 2 AND k // 8 < 3 AND k // 8 + 1 > 1 THEN 0 ELSE px[k + 1] END))::BIGINT AS total, len(list_filter(px, lambda s: s BETWEEN 50 - 24 AND 60 + 24))::INTEGER AS hidden FROM (SELECT vec_id, list_transform(embedding, lambda v: CAST(floor(abs(v) * 1000) AS BIGINT) % 256) AS px FROM embeddings) e")
def image_redact(spark, sf_dir):
    """Vectors as images of eight pixels a row: a zone is overwritten, and a colour key's reach is counted."""
    from umbra.operators import carriers

    px = table(spark, sf_dir, "embeddings").select("vec_id", _samples(1000).alias("px"))
    zone = G.Rect(F.lit(2), F.lit(1), F.lit(5), F.lit(3))
    done = F.aggregate(carriers.overwrite_pixels(F.col("px"), F.lit(8), zone, 0), F.lit(0).cast("long"), lambda n, p: n + p)
    return px.select("vec_id", done.alias("total"), carriers.key_reach(F.col("px"), F.lit(50), F.lit(60)).alias("hidden"))


_STREAMS = _values("doc_id, object, digest", [(1, 1, "a"), (1, 2, "b"), (1, 4, "d")])
_RAW_STREAMS = _values("doc_id, object, digest", [(1, 1, "a"), (1, 2, "c"), (1, 3, "x")])


@query(f"SELECT object, CASE WHEN a.digest IS NULL THEN 'not loaded' WHEN b.digest IS NULL THEN 'not in the file' ELSE 'differs' END AS finding FROM {_STREAMS} a FULL JOIN {_RAW_STREAMS} b USING (doc_id, object) WHERE a.digest IS DISTINCT FROM b.digest")
def misread_streams(spark, sf_dir):
    from umbra.operators import carriers

    return carriers.misread_streams(spark.sql(f"SELECT * FROM {_STREAMS}"), spark.sql(f"SELECT * FROM {_RAW_STREAMS}")).select("object", "finding")


@query("SELECT user_id, CAST(least(COUNT(*), 51) AS INTEGER) AS shown, CASE WHEN COUNT(*) > 50 THEN 'and ' || (COUNT(*) - 50) || ' more' END AS last FROM events GROUP BY user_id")
def capped_notes(spark, sf_dir):
    from umbra.operators import carriers

    notes = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("text"))
    out = carriers.capped_list(notes)
    return out.select(F.col("doc_id").alias("user_id"), F.size("notes").alias("shown"), F.when(F.size("notes") > 50, F.element_at("notes", -1)).alias("last"))


# ---------------------------------------------------------------- accounts of a run

_ZIG = "CAST(p_partkey * 37 % 500 AS DOUBLE) AS llx, CAST(p_partkey * 53 % 700 AS DOUBLE) AS lly, CAST(p_partkey * 37 % 500 + p_size AS DOUBLE) AS urx, CAST(p_partkey * 53 % 700 + p_size % 7 AS DOUBLE) AS ury"


def _zig(spark, sf_dir):
    """Parts as rectangles on ten pages, one in fifty of them unusable."""
    parts = table(spark, sf_dir, "part").selectExpr("p_partkey AS seq", "p_partkey % 10 AS page", *_ZIG.split(", "))
    return parts.withColumn("llx", F.when(F.col("seq") % 50 == 0, F.lit(NAN)).otherwise(F.col("llx")))


@query(f"SELECT page, MIN(llx) AS llx, MIN(lly) AS lly, MAX(urx) AS urx, MAX(ury) AS ury FROM (SELECT p_partkey AS seq, p_partkey % 10 AS page, {_ZIG} FROM part) WHERE seq % 50 <> 0 GROUP BY page")
def geo_hull(spark, sf_dir):
    return summary.hull(_zig(spark, sf_dir), ["page"])


@query(f"WITH z AS (SELECT p_partkey AS seq, p_partkey % 10 AS page, {_ZIG} FROM part WHERE p_partkey % 50 <> 0) SELECT a.page, a.seq, b.seq AS o_seq FROM z a JOIN z b ON a.page = b.page AND a.llx <= b.urx AND b.llx <= a.urx AND a.lly <= b.ury AND b.lly <= a.ury WHERE a.seq % 3 = 0")
def conflict_touching(spark, sf_dir):
    z = _zig(spark, sf_dir)
    return conflict.touching(z.where("seq % 3 = 0"), z, ["page"])


@query("SELECT l_suppkey % 20 AS doc_id, l_partkey % 7 AS stream, COUNT(DISTINCT (l_linenumber, l_quantity)) AS glyphs, COUNT(DISTINCT l_linenumber) AS operations FROM lineitem GROUP BY l_suppkey % 20, l_partkey % 7")
def hidden_once(spark, sf_dir):
    """Line items as hidden glyphs of streams that are drawn at many places."""
    li = table(spark, sf_dir, "lineitem").selectExpr("l_suppkey % 20 AS doc_id", "l_partkey % 7 AS stream", "l_orderkey AS placement", "l_linenumber AS op", "l_quantity AS glyph")
    return summary.hidden_once(li)


@query("SELECT DISTINCT o_custkey AS doc_id, o_orderkey AS stream, o_orderpriority AS name, c_nationkey AS object FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def property_homes(spark, sf_dir):
    uses = table(spark, sf_dir, "orders").selectExpr("o_custkey AS doc_id", "o_orderkey AS stream", "o_custkey % 3 AS owner", "o_orderpriority AS name")
    names = F.explode(F.array(F.lit("1-URGENT"), F.lit("2-HIGH")))
    known = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), (F.col("c_custkey") % 3).alias("owner"), names.alias("name"), F.col("c_nationkey").alias("object"))
    return summary.property_homes(uses, known)


_KEPT_SQL = f"(SELECT doc_id, page, seq FROM {_LEFT} x WHERE NOT EXISTS (SELECT 1 FROM {_OTHER} WHERE d = doc_id AND p = page AND k = kind AND r = ref AND m IS NOT DISTINCT FROM match_type AND c IS NOT DISTINCT FROM confidence AND (o_llx < llx OR (o_llx = llx AND s < seq)) AND {_SQL_COVER} >= 0.999))"
_OUTCOME_SQL = f"(SELECT doc_id, page, seq, CASE WHEN seq = 4 THEN 'disabled' WHEN (doc_id, page, seq) IN (SELECT doc_id, page, seq FROM {_KEPT_SQL}) THEN CASE WHEN page >= 1 THEN 'missing_page' ELSE 'redacted' END WHEN (doc_id, page, seq) IN (SELECT doc_id, page, seq FROM {_BLOCKED_SQL}) THEN 'blocked' ELSE 'duplicate' END AS outcome FROM {_CANDS})"


def _outcomes(spark):
    regions = _layout(spark)
    kept, blocked = conflict.resolve(regions)
    effect = kept.select("doc_id", "page", "seq", F.when(F.col("page") >= 1, "missing_page").otherwise("applied").alias("effect"))
    return summary.outcomes(regions, kept, blocked, effect, regions.where("seq = 4"))


@query("SELECT " + ", ".join(f"COUNT(*) FILTER (WHERE outcome = '{o}') AS {o}" for o in summary.OUTCOMES) + f", COUNT(*) AS hits FROM {_OUTCOME_SQL}")
def hit_summary(spark, sf_dir):
    return summary.hit_summary(_outcomes(spark))


@query(f"SELECT doc_id, page, COUNT(*) FILTER (WHERE outcome = 'redacted') AS redactions FROM {_OUTCOME_SQL} GROUP BY doc_id, page")
def redactions_per_page(spark, sf_dir):
    return summary.redactions_per_page(_outcomes(spark))


@query("SELECT vec_id, len(list_filter(embedding, lambda v: CAST(floor(abs(v) * 10000) AS BIGINT) % 256 < 255)) / len(embedding) AS ratio FROM embeddings")
def non_white_ratio(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", summary.non_white_ratio(_samples(10000)).alias("ratio"))


_PDF_NEEDLES = ["the", "ción", "er er", "Of", "that and", "ÖÄ"]
_PDF_NEEDLE_TABLE = _values("k, needle", list(enumerate(_PDF_NEEDLES)))
_PDF_LEFT = f"(SELECT item_id, coalesce(string_agg(l, '' ORDER BY k) FILTER (WHERE k > 0), '') AS t FROM {_ITEM_LINES} GROUP BY item_id)"


@query(f"SELECT item_id, CAST(k AS INTEGER) AS needle_id, contains(t, needle) AS literal FROM {_PDF_LEFT}, {_PDF_NEEDLE_TABLE} WHERE contains(t, needle) OR (contains(needle, ' ') AND contains(replace(t, ' ', ''), replace(needle, ' ', '')))")
def pdf_leaks(spark, sf_dir):
    """What the drawn text of redacted benchmark files still holds, among all views of the files."""
    from umbra.sources import pdf_carriers

    found = pdf_carriers.search(_redacted_items(spark, sf_dir).select("path", "content"), _PDF_NEEDLES)
    return found.where(F.col("view") == leaks.DECODED).select(F.col("carrier_id").cast("long").alias("item_id"), "needle_id", "literal")


@query("SELECT CAST(c_custkey AS VARCHAR) AS doc_id, CAST(1 AS INTEGER) AS regions, CAST(length(CAST(c_custkey + 100000 AS VARCHAR)) AS BIGINT) AS removed, c_name || ' Kontonummer:' AS left_text, 'gone' AS verdict FROM customer")
def pdf_run(spark, sf_dir):
    """Every customer's account number in a PDF file: found on its line, removed from the file, searched for afterwards."""
    from umbra.plans import files as runs_of_files
    from umbra.sources import pdf

    def made(batches):
        import pyarrow as pa

        for batch in batches:
            rows = list(zip(batch.column("c_custkey").to_pylist(), batch.column("c_name").to_pylist(), strict=True))
            data = [pdf.build([[(50.0, 700.0, 10.0, name), (50.0, 660.0, 10.0, f"Kontonummer: {key + 100000}")]]) for key, name in rows]
            yield pa.RecordBatch.from_arrays([pa.array([str(k) for k, _ in rows], pa.string()), pa.array(data, pa.binary())], ["path", "content"])

    # A file of customers may be one partition; all that reads and writes their PDF files would then be one task.
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name").repartition(4 * spark.sparkContext.defaultParallelism, "c_custkey")
    content = cut(customers.mapInArrow(made, "path string, content binary"))
    analysis = runs_of_files.analyze(content)
    done = cut(runs_of_files.redacted(content, analysis.regions))
    left = runs_of_files.line_runs(pdf.glyph_rows(done.select("path", "content"))).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("run_seq", "text"))).alias("xs"))
    text = left.select("doc_id", F.array_join(F.transform("xs", lambda x: x["text"]), " ").alias("left_text"))
    total = F.aggregate("removed", F.lit(0).cast("long"), lambda n, x: n + x)
    counted = done.select(F.col("path").alias("doc_id"), F.size("removed").alias("regions"), total.alias("removed"))
    return counted.join(text, "doc_id").join(runs_of_files.check(done, analysis).select("doc_id", "verdict"), "doc_id")


# ---------------------------------------------------------------- the same rules over whole tables

_NOTE_SQL = f"(SELECT p_partkey AS annotation, p_partkey % 10 AS page, {_ZIG} FROM part)"
_ZONE_SQL = "(SELECT s_suppkey % 10 AS page, CAST(s_suppkey * 13 % 500 AS DOUBLE) AS llx, CAST(s_suppkey * 29 % 700 AS DOUBLE) AS lly, CAST(s_suppkey * 13 % 500 + 40 AS DOUBLE) AS urx, CAST(s_suppkey * 29 % 700 + 25 AS DOUBLE) AS ury FROM supplier)"


@query(f"SELECT annotation, NOT EXISTS (SELECT 1 FROM {_ZONE_SQL} z WHERE z.page = a.page AND a.annotation % 50 <> 0 AND a.llx < z.urx AND z.llx < a.urx AND a.lly < z.ury AND z.lly < a.ury) AS kept FROM {_NOTE_SQL} a")
def annotations_split_items(spark, sf_dir):
    """Parts as annotations and suppliers as regions of one document."""
    from umbra.operators import carriers

    zones = table(spark, sf_dir, "supplier").selectExpr("0 AS doc_id", "s_suppkey % 10 AS page", "CAST(s_suppkey * 13 % 500 AS DOUBLE) AS llx", "CAST(s_suppkey * 29 % 700 AS DOUBLE) AS lly", "CAST(s_suppkey * 13 % 500 + 40 AS DOUBLE) AS urx", "CAST(s_suppkey * 29 % 700 + 25 AS DOUBLE) AS ury")
    notes = _zig(spark, sf_dir).withColumnRenamed("seq", "annotation").withColumn("doc_id", F.lit(0))
    kept, removed = carriers.split_annotations(notes, zones)
    return kept.select("annotation", F.lit(True).alias("kept")).union(removed.select("annotation", F.lit(False).alias("kept")))


@query("SELECT output, COUNT(*) > 1 AS collides, output IN (SELECT c_name FROM customer) AS over_input FROM (SELECT CASE WHEN c_custkey % 5 = 0 THEN 'Customer#' || lpad(CAST(c_custkey // 7 AS VARCHAR), 9, '0') ELSE c_name || '_out' END AS output FROM customer) GROUP BY output")
def batch_collisions_customers(spark, sf_dir):
    output = F.when(F.col("c_custkey") % 5 == 0, F.concat(F.lit("Customer#"), F.lpad(F.floor(F.col("c_custkey") / 7).cast("string"), 9, "0"))).otherwise(F.concat("c_name", F.lit("_out")))
    return effects.output_collisions(table(spark, sf_dir, "customer").select(F.col("c_name").alias("input"), output.alias("output"))).select("output", "collides", "over_input")
