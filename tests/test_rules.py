"""Rules on literal rows."""

import sys
import unicodedata

import pytest
from pyspark.sql import functions as F

from folioflux.config import Profile
from folioflux.functions import catalogue as C
from folioflux.functions import rules as R
from folioflux.functions import text as T
from folioflux.operators import bundles, changes

PROFILE = Profile(sources={"shop": ("shop", "Shop"), "lib": ("library", "Bibliothek")})
c = F.col


def values(df, *columns):
    return [tuple(r) for r in df.orderBy("n").select(*columns).collect()]


@pytest.mark.parametrize(
    "price, struck, previous, label",
    [
        (499, None, None, "Strong Deal"), (0, None, None, None), (None, None, None, None),
        (500, None, None, None), (700, 1000, None, "Deal"), (800, 1000, None, None),
        (750, None, 1000, "Deal"), (999, None, 2000, "Deal"), (1000, 4000, 4000, None),
        (700, 700, 700, None), (700, 0, None, None),
    ],
)
def test_deal_label(spark, price, struck, previous, label):
    df = spark.createDataFrame([(price, struck, previous)], "p int, s int, v int")
    got = df.select(R.deal_label(c("p"), c("s"), c("v"), PROFILE)).first()[0]
    assert got == label


def test_junk_reasons(spark):
    rows = [
        (1, 0, "watchlist", "Irgendwas", "gratis"),
        (2, 99, "genre_category", "4 Spuk Thriller: Sommer", "Sammelband"),
        (3, 99, "profile_author", "David Hunter: 3in1 Bundle", None),
        (4, 99, "genre_category", "5 Cottages - Haus der dunklen Geister", None),
        (5, 99, "genre_category", "Nacht - Folge 12", "Fortsetzungsheft"),
        (6, 99, "genre_category", "FÜNFMAL Grauen", "Sammelband"),
        (7, 99, "genre_category", "7 Momente in Angst", None),
        (8, None, "genre_category", "Gesamtausgabe", "Sammelband"),
    ]
    df = spark.createDataFrame(rows, "n int, p int, r string, t string, want string")
    got = values(df.withColumn("got", R.junk_reason(c("p"), c("r"), c("t"))), "got", "want")
    assert all(a == b for a, b in got)


OBS = "n int, price_cents int, availability string, match_reason string, title string, previous struct<price_cents:int,availability:string>"


@pytest.mark.parametrize(
    "price, stock, reason, before, kinds",
    [
        (999, None, "watchlist", None, ["first_seen"]),
        (999, None, "genre_category", None, []),
        (399, None, "genre_category", None, ["first_seen"]),
        (None, "available", "profile_author", None, ["first_seen"]),
        (999, "available", "watchlist", (999, "unavailable"), ["became_available"]),
        (999, "unavailable", "watchlist", (999, "available"), ["became_unavailable"]),
        (999, "unknown", "watchlist", (999, "unavailable"), []),
        (None, "available", "watchlist", (999, None), []),
        (799, "available", "watchlist", (999, "unknown"), ["became_available", "price_drop"]),
        (1199, None, "watchlist", (999, None), ["price_rise"]),
        (1149, None, "genre_category", (1199, None), []),
        (999, None, "watchlist", (999, None), []),
    ],
)
def test_change_kinds(spark, price, stock, reason, before, kinds):
    df = spark.createDataFrame([(1, price, stock, reason, "Titel", before)], OBS)
    assert df.select(changes.change_kinds(PROFILE)).first()[0] == kinds


def finds(spark, rows):
    return spark.createDataFrame(
        rows,
        "id long, profile_slug string, source string, source_item_id string, match_reason string, "
        "title string, isbn string, price_cents int",
    )


SINGLES = [
    (1, "p", "shop", "1", "watchlist", "Der Kruzifix-Killer", "9780000000001", 1099),
    (2, "p", "shop", "2", "watchlist", "Der Vollstrecker", "9780000000002", 1099),
]


@pytest.mark.parametrize("price, pct", [(1299, 41), (1700, None), (2300, None)])
def test_bundle_by_title(spark, price, pct):
    log = finds(spark, SINGLES)
    bundle = finds(
        spark, [(9, "p", "shop", "9", "watchlist", "Der Kruzifix-Killer / Der Vollstrecker", None, price)]
    )
    edges = spark.createDataFrame([], "isbn string, contained string")
    got = bundles.with_advantage(
        bundle, bundles.last_prices(log, "title"), bundles.last_prices(log, "isbn"), edges, PROFILE
    ).select("advantage.saved_pct", "advantage.singles").first()
    assert got[0] == pct
    assert got[1] == (2198 if pct else None)


def test_a_record_with_a_missing_price_silences_the_title(spark):
    log = finds(spark, SINGLES)
    bundle = finds(
        spark,
        [(9, "p", "shop", "9", "watchlist", "Der Kruzifix-Killer / Der Vollstrecker", "9780000000009", 1299)],
    )
    known = [("9780000000009", "9780000000001"), ("9780000000009", "9780000000002")]
    for edges, want in ((known, 41), (known + [("9780000000009", "9780000000003")], None)):
        frame = spark.createDataFrame(edges, "isbn string, contained string")
        got = bundles.with_advantage(
            bundle, bundles.last_prices(log, "title"), bundles.last_prices(log, "isbn"), frame, PROFILE
        ).select("advantage.saved_pct").first()[0]
        assert got == want


def test_titles_normalise(spark):
    pairs = [
        ("Der Schwarm", "schwarm"), ("Die Straße", "strasse"), ("Faust [Neue Auflage]", "faust"),
        ("The Lord of the Rings", "lord of the rings"), ("Café: Ein Roman", "cafe"),
        ("20,000 Meilen", "20000 meilen"), ("R - Ein Roman", "r ein roman"),
        ("Der Schwarm (Roman) (Band 2)", "schwarm"), ("Das Hörbuch", ""),
    ]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "n int, t string, want string")
    assert all(a == b for a, b in values(df.withColumn("got", T.normalize_title(c("t"))), "got", "want"))


def test_volumes(spark):
    pairs = [
        ("Der Schwarm - Band 2", 2), ("Red Rising Teil 1", 1), ("Fahrenheit 451", None), ("1984", None),
        ("Die sieben Schwestern 8", 8), ("Zimmer 1408", None), ("Nacht, Bd. 12", 12), ("Passagier 23", None),
    ]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "n int, t string, want int")
    assert all(a == b for a, b in values(df.withColumn("got", T.volume_of(c("t"))), "got", "want"))


def test_fold_equals_the_full_tables(spark):
    def form(text):
        plain = "".join(x for x in unicodedata.normalize("NFKD", text) if not "\u0300" <= x <= "\u036f")
        return "".join(T.LETTER_FOLDS.get(x, x) for x in plain).casefold()

    every = [chr(i) for i in range(1, sys.maxunicode + 1)]
    letters = [x for x in every if unicodedata.category(x) not in ("Cn", "Cs", "Co")]
    # A letter between two others, so that no marks meet.
    texts = ["x".join(letters[i : i + 40]) for i in range(0, len(letters), 40)]
    df = spark.createDataFrame([(x,) for x in texts], "x string")
    assert all(r["a"] == form(r["x"]) for r in df.select("x", T.fold(c("x")).alias("a")).collect())


def test_blurbs(spark):
    rows = [
        (1, "Ein Text … Mehr navigate_next", "Ein Text …"),
        (2, "Ein Text weniger anzeigen expand_less", "Ein Text"),
        (3, "  ", None), (4, "A navigate_next B", "A B"),
    ]
    df = spark.createDataFrame(rows, "n int, b string, want string")
    assert all(a == b for a, b in values(df.withColumn("got", C.clean_blurb(c("b"))), "got", "want"))
    doubled = [
        (1, "Ein Fall... alles anzeigen expand_more Ein Fall und mehr.", "Ein Fall und mehr."),
        (2, "Die Ausstellung will alles anzeigen, was war", "Die Ausstellung will alles anzeigen, was war"),
        (3, "Ende alles anzeigen", "Ende alles anzeigen"), (4, "", None),
    ]
    df = spark.createDataFrame(doubled, "n int, b string, want string")
    assert all(a == b for a, b in values(df.withColumn("got", C.without_teaser(c("b"))), "got", "want"))


def test_authors(spark):
    rows = [
        (1, "Barnes, S. A.", "s a barnes"), (2, "Anna Meier, Bernd Schulz", "anna meier|bernd schulz"),
        (3, "Riley, Lucinda; Whittaker, Harry", "lucinda riley|harry whittaker"),
        (4, "Johann Wolfgang von Goethe", "johann wolfgang goethe"),
        (5, "Marc-Uwe Kling und Anna Beispiel", "marc uwe kling|anna beispiel"), (6, "unbekannt", ""),
        (7, "Heyne Verlag", "heyne verlag"), (8, None, ""),
    ]
    df = spark.createDataFrame(rows, "n int, a string, want string")
    got = df.withColumn("got", F.array_join(T.full_names(T.normalize_authors(c("a"))), "|"))
    assert all(a == b for a, b in values(got, "got", "want"))


def test_numbers_and_texts(spark):
    df = spark.createDataFrame([(1, "ab 1.299,00 €")], "n int, t string").select(
        C.parse_price(c("t")), C.money(F.lit(1299)), C.isbn_in_text(F.lit("978-3-8437-2915-4")),
        C.isbn_in_text(F.lit("39783843729154")), C.author_slug(F.lit("Scalzi, John")),
        C.media_id(F.lit("https://x/mediaInfo,0-0-373164461-200-0.html")), C.theme_name(F.lit("a/space-opera/")),
        C.theme_name(F.lit("a/true-CRIME")), C.is_truncated(F.lit("Text … ")),
    )
    assert tuple(df.first()) == (
        129900, "12,99 €", "9783843729154", None, "john-scalzi", "373164461", "Space Opera",
        "True crime", True,
    )
