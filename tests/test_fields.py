"""Golden values of the guards and of field extraction, one table per operator."""

import pytest
from pyspark.sql import functions as F

from shelf.functions import fields, guards

# --- fixed values: inputs and what has to come of them -------------------------------
COMPONENTS = (
    "80% São Benedito Origin: Piatã, Bahia, Brazil Variety: Catuaí Processing Method: Pulped Natural "
    "Producers: Silvio Leite Relationship Length: Since 2020 20% San Antonio Origin: Inzá, Cauca, "
    "Colombia Varieties: Caturra Processing Method: Washed"
)
ONE_LOT = (
    "Origin: Chirinos, Cajamarca, Peru Producer: Various Process: Fully Washed "
    "Altitude: 1700-1900 masl Varietal: Caturra, Bourbon, Catimor"
)

GUARD_CASES = {
    "process": [
        ("Fully Washed ALTITUDE", "Fully Washed"),
        ("Pulped Natural Producers", "Pulped Natural"),
        ("WASHED & NATURAL REGION", "Washed, Natural"),
        ("NATURAL then WASHED", "Washed, Natural"),
        ("Carbonic Maceration", "Carbonic Maceration"),
        ("pulped natural", "Pulped Natural"),
        ("Single Origin Goodness", ""),
        ("", ""),
        (None, ""),
    ],
    "varietal": [
        ("Caturra In the hills of Cauca, Colombia", "Caturra"),
        ("his farm has pink bourbon, bourbon aji, caturra", ""),
        ("Caturra & Catuaí", "Caturra & Catuaí"),
        ("Catuaí", "Catuaí"),
        ("Caturra, Bourbon, Catimor", "Caturra, Bourbon, Catimor"),
        ("HEIRLOOM, CASTILLO, CATURRA, COLOMBIA CUP", "HEIRLOOM, CASTILLO, CATURRA"),
        ("GESHA CUP: HONEY, JASMINE, FRUIT TEA", "GESHA"),
        ("COLOMBIA CUP: BERRY, TAMARIND", ""),
        ("Gesha, , Brazil,", "Gesha"),
        ("x" * 81, ""),
        ("x" * 80, "x" * 80),
        (" ".join("a" * 13), ""),
        ("", ""),
    ],
    "origin": [
        ("Limu Kossa, Ethiopia, delivers notes of smooth milk chocolate", "Limu Kossa, Ethiopia"),
        ("Unex Exporters based in coffee", ""),
        ("the highlands of Tarqui where the family built a farm", ""),
        ("Carmo de Minas, Minas Gerais, Brazil", "Carmo de Minas, Minas Gerais, Brazil"),
        ("South America", "South America"),
        ("Nicaragua", "Nicaragua"),
        ("Known Kenya", "Known Kenya"),
        ("Kenya | Nyeri", "Kenya"),
        ("", ""),
    ],
    "flavour": [
        ("FILTER RECIPE + V60 RECIPE This is just a starting place", ""),
        ("DARK CHOCOLATE, CHERRY, VANILLA 50% BRAZIL | Samba - Natural", "DARK CHOCOLATE, CHERRY, VANILLA"),
        ("Milk chocolate, caramel, stone fruit The thoughtful combination",
         "Milk chocolate, caramel, stone fruit"),
        ("with enough clarity to hold your attention, and enough familiarity", ""),
        ("will deliver flavours of chocolate and cherry through both espresso", ""),
        ("Milk chocolate, red apple + almond praline Our Seasonal Blend is",
         "Milk chocolate, red apple + almond praline"),
        ("Floral, Nutty", "Floral, Nutty"),
        ("Citrus, Floral, Stone Fruit", "Citrus, Floral, Stone Fruit"),
        ("PLUM, DARK CHOCOLATE, PEACH, MACADAMIA, APRICOT, MAPLE SYRUP",
         "PLUM, DARK CHOCOLATE, PEACH, MACADAMIA, APRICOT, MAPLE SYRUP"),
        ("sweet caramel and", "sweet caramel"),
        ("", ""),
    ],
}

TAG_CASES = [
    (["COFFEE_Espresso", "FLAVOUR_Chocolate", "FLAVOUR_Nutty", "ORIGIN_Brazil", "ORIGIN_Ethiopia",
      "PROCESSING_Natural", "PROCESSING_Washed"],
     ("Brazil, Ethiopia", "Natural, Washed", "", "Chocolate, Nutty")),
    (["Brew Method.Pour over", "Coffee Type.Filter", "Origin.South America", "Taste Notes.Floral",
      "Taste Notes.Nutty", "Rare Coffee"], ("South America", "", "", "Floral, Nutty")),
    (["Feeling: Mild", "For: Espresso", "From: Nicaragua", "Process: Washed", "Type: Single Origin"],
     ("Nicaragua", "Washed", "", "")),
    (["coffee", "All Products", "SINGLE ORIGIN"], ("", "", "", "")),
    (["COUNTRY: PERU", "Country: Peru", "origin_Peru"], ("Peru", "", "", "")),
    (None, ("", "", "", "")),
]

LABEL_CASES = [
    (COMPONENTS, ("Piatã, Bahia, Brazil", "Pulped Natural", "Catuaí", "")),
    (ONE_LOT, ("Chirinos, Cajamarca, Peru", "Fully Washed", "Caturra, Bourbon, Catimor", "")),
    ("A delicious everyday espresso blend.", ("", "", "", "")),
    ("Notes - plum; more. Notes: fig", ("", "", "", "plum")),
    ("Origin: Process: Washed Origin: Kenya", ("Kenya", "Washed", "", "")),
    (None, ("", "", "", "")),
]


@pytest.mark.parametrize("name", list(GUARD_CASES))
def test_guards(spark, name):
    rows = [(i, given, want) for i, (given, want) in enumerate(GUARD_CASES[name])]
    df = spark.createDataFrame(rows, "i int, given string, want string")
    got = df.select("given", "want", guards.GUARDS[name](F.col("given")).alias("got")).collect()
    assert [r for r in got if r.got != r.want] == []


def _struct_rows(df, column):
    return [tuple(r[0]) for r in df.select(column.alias("x")).collect()]


def test_tag_fields(spark):
    df = spark.createDataFrame([(t,) for t, _ in TAG_CASES], "tags array<string>")
    assert _struct_rows(df, fields.tag_fields(F.col("tags"))) == [w for _, w in TAG_CASES]


def test_tag_aliases_of_a_shop(spark):
    df = spark.createDataFrame(
        [(["Region: Huila", "Notes: Plum"], {"origin": ["Region"], "varietal": ["notes"]})],
        "tags array<string>, aliases map<string,array<string>>")
    got = _struct_rows(df, fields.tag_fields(F.col("tags"), F.col("aliases")))
    assert got == [("Huila", "", "Plum", "")]


def test_label_fields(spark):
    df = spark.createDataFrame([(t,) for t, _ in LABEL_CASES], "text string")
    assert _struct_rows(df, fields.label_fields(F.col("text"))) == [w for _, w in LABEL_CASES]


def test_tags_win_before_the_guard(spark):
    rows = [
        (["ORIGIN_Brazil", "PROCESSING_Washed"], "Origin: Somewhere Else Process: Natural", None),
        ([], ONE_LOT, None),
        (["PROCESS: Fully Washed ALTITUDE"], "", None),
        ([], ONE_LOT, ["body"]),
        (["Process: secret"], ONE_LOT, None),
    ]
    df = spark.createDataFrame(rows, "tags array<string>, body string, skip array<string>")
    raw = fields.raw_fields(F.col("tags"), F.col("body"), F.col("skip"))
    got = _struct_rows(df.withColumn("raw", raw), fields.guard_fields(F.col("raw")))
    assert got[0][:2] == ("Brazil", "Washed")
    assert got[1] == ("Chirinos, Cajamarca, Peru", "Fully Washed", "Caturra, Bourbon, Catimor", "")
    assert got[2][1] == "Fully Washed"
    assert got[3] == ("", "", "", "")
    # a tag value that the guard rejects is not replaced by the body value
    assert got[4][1] == ""


FREE_TEXT = [
    (fields.origin_from_text, "Origin: Huila, Colombia. Sweet", "Huila, Colombia"),
    (fields.origin_from_text, "country - nowhere at all", "nowhere at all"),
    (fields.origin_from_text, "beans from Yirga, Ethiopia roast light", "Yirga, Ethiopia"),
    (fields.origin_from_text, "from a friend. A lot of dr congo and png", "Congo, Dr Congo, PNG"),
    (fields.origin_from_text, "nothing", ""),
    (fields.varietal_from_text, "Variety: Pink Bourbon, Sidra notes of plum", "Pink Bourbon, Sidra"),
    (fields.varietal_from_text, "none", ""),
    (fields.flavour_from_text, "CUP: CITRUS, SUGARCANE, SWEET HERBALS Process: Washed",
     "CITRUS, SUGARCANE, SWEET HERBALS Process"),
    (fields.flavour_from_text, "Tastes like tropical fruit, marzipan and dark chocolate",
     "tropical fruit, marzipan and dark chocolate"),
    (fields.flavour_from_text, "notes: easy to drink chocolate", ""),
    (fields.flavour_from_text, "cup citrus, sugarcane. more", "citrus, sugarcane"),
    (fields.flavour_from_text, "cup citrus peel", ""),
    (fields.process_from_text, "Process: Washed at source Origin: x", "Washed at source"),
    (fields.process_from_text, "a co ferment, then NATURAL", "Natural, Co-Ferment"),
]


def test_free_text(spark):
    df = spark.createDataFrame([(i, t) for i, (_, t, _) in enumerate(FREE_TEXT)], "i int, t string")
    columns = [f(F.col("t")).alias(f"c{i}") for i, (f, _, _) in enumerate(FREE_TEXT)]
    rows = {r.i: r for r in df.select("i", *columns).collect()}
    wrong = [(t, rows[i][f"c{i}"], want) for i, (_, t, want) in enumerate(FREE_TEXT)
             if rows[i][f"c{i}"] != want]
    assert wrong == []


def test_process_prefers_title_then_address(spark):
    df = spark.createDataFrame([
        ("honey in the text", "Washed lot", "https://a.b/products/natural-x"),
        ("honey in the text", "lot", "https://a.b/products/natural-x?x=washed"),
        ("honey in the text", "lot", "https://a.b/products/x"),
    ], "text string, title string, url string")
    got = df.select(fields.process_from_text(F.col("text"), F.col("title"), F.col("url")).alias("p"))
    assert [r.p for r in got.collect()] == ["Washed", "Natural", "Honey"]
