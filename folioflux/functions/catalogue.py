"""Expressions over catalogue fields: blurbs, prices, identifiers, addresses, texts."""

from __future__ import annotations

import re

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioflux.config import label_map
from folioflux.functions.text import let, squeeze, strip, words

# ---------------------------------------------------------------- fixed values
ICON_NAMES = [
    "navigate_next", "navigate_before", "expand_more", "expand_less", "chevron_right",
    "arrow_forward", "more_horiz",
]
MORE_LABELS = ["Mehr", "Weiterlesen", "mehr lesen"]
CONTROL_LABELS = ["alles anzeigen", "weniger anzeigen", "mehr anzeigen", "weiterlesen"]
TEASER_CONTROL = r"(?iuU)\s*(?:\.\.\.|…)?\s*alles anzeigen\s*(?:expand_more)?\s*"
#: A cut needs the rest to repeat this many characters of the teaser.
TEASER_PROBE = 60
MARKED_LETTERS = "øØłŁæÆœŒðÐþÞđĐßẞ"
THEME_NAMES = {
    "psychothriller": "Psychothriller",
    "horror-mystery-allgemein": "Horror & Mystery",
    "science-fiction-allgemein": "Science-Fiction",
    "space-opera": "Space Opera",
    "military-sf": "Military SF",
    "spionage": "Spionage",
}
THEME = "Thema"
PRICE_PATTERN = r"(\d{1,3}(?:\.\d{3})*|\d+),(\d{2})"
ISBN13 = r"97[89]\d{10}"
IMAGE_SUFFIXES = {".jpg": ".jpg", ".jpeg": ".jpg", ".png": ".png", ".webp": ".webp", ".gif": ".gif"}
SLUG_FOLDS = {"ä": "ae", "ö": "oe", "ü": "ue", "ß": "ss"}
RELATION_LABELS = {
    "watching": "in Beobachtung", "owned": "im Besitz", "liked": "Mag ich",
    "disliked": "Kein Interesse", "dismissed": "Ausgeschlossen",
}
ACTION_LABELS = {
    "dismissed": "Ausschließen", "owned": "Hab ich", "watching": "Beobachten",
    "liked": "Mag ich", "disliked": "Doof",
}
CONFIDENCE_LABELS = {
    "belegt": "im Text belegt", "teils": "teilweise belegt", "vermutet": "nur vermutet",
}
AVAILABILITY_LABELS = {"available": "ausleihbar", "unavailable": "verliehen", "unknown": "unklar"}
OUTCOME_LABELS = {
    "linked": "gefunden", "confirmed": "bestätigt", "unsure": "unklar",
    "not_found": "nicht im Katalog",
}
ORIGIN_LABELS = {
    "model": "Leseprofil", "conversation": "deine Bewertung", "reader": "deine Bewertung",
    "onleihe_readers": "Leser:innen der Onleihe",
}
# ------------------------------------------------------------------------------

_ICONS = "|".join(ICON_NAMES)


def empty_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


# ---------------------------------------------------------------------- blurbs


#: Longest end of a text that holds a control, and the longest blank in it.
_TAIL, _BLANK = 200, 64


def _at_end(text: Column, pattern: str, width: int) -> Column:
    """Cut what matches ``pattern`` at the end of a text; only the end is searched."""
    head = F.substring(text, F.lit(1), F.length(text) - width)
    return F.concat(head, F.regexp_replace(F.right(text, F.lit(width)), pattern, ""))


def clean_blurb(blurb: Column) -> Column:
    """Blurb without page controls; the closing dots stay, the text is cut.

    The controls at the end are looked for in the end alone, and those inside by plain
    searches, as most texts have none: patterns over whole texts are what costs.
    """
    more = r"(?iuU)\s*+(?:(?:" + "|".join(MORE_LABELS) + r")\s*+)?(?:" + _ICONS + r")\s*+$"
    label = r"(?iu) ?(?:" + "|".join(CONTROL_LABELS) + ") ?$"
    inside = r"(?U)\s*+\b(?:" + _ICONS + r")\b\s*+"

    def without_more(text: Column) -> Column:
        # Blanks so long that a control may reach beyond the end are very rare.
        far = F.right(text, F.lit(_TAIL)).rlike(r"(?U)\s{%d}" % _BLANK)
        return F.when(far, F.regexp_replace(text, more, "")).otherwise(_at_end(text, more, _TAIL))

    def without_icons(text: Column) -> Column:
        holds = F.lit(False)
        for icon in ICON_NAMES:
            holds |= text.contains(icon)
        return F.when(holds, F.regexp_replace(text, inside, " ")).otherwise(text)

    def without_label(text: Column) -> Column:
        return F.trim(_at_end(text, label, max(map(len, CONTROL_LABELS)) + 2))

    plain = let(let(blurb, without_more), without_icons)
    # Blanks are single spaces from here on.
    return empty_to_null(let(F.trim(squeeze(plain)), without_label))


def without_teaser(blurb: Column) -> Column:
    """Cut a teaser in front of the full text, only where the text repeats it."""
    def cut(parts: Column) -> Column:
        rest = strip(parts["rest"])
        teaser = F.regexp_replace(strip(squeeze(parts["teaser"])), r"[. …]+$", "")
        repeats = F.startswith(squeeze(rest), F.substring(teaser, 1, TEASER_PROBE))
        return F.when(parts["found"] & (rest != "") & repeats, rest).otherwise(blurb)

    pieces = F.split(blurb, TEASER_CONTROL, 2)
    return empty_to_null(
        let(
            pieces,
            lambda p: cut(
                F.struct(
                    (F.size(p) > 1).alias("found"),
                    p[0].alias("teaser"),
                    F.coalesce(F.get(p, F.lit(1)), F.lit("")).alias("rest"),
                )
            ),
        )
    )


def is_truncated(blurb: Column) -> Column:
    return F.coalesce(
        F.regexp_replace(blurb, r"(?U)\s+$", "").rlike(r"(\.\.\.|…)$"), F.lit(False)
    )


def _accented() -> tuple[str, str]:
    """Letters whose decomposition holds one or two marks, by rule from Unicode tables."""
    found = []
    for point in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        marks = [c for c in unicodedata.normalize("NFD", chr(point)) if unicodedata.combining(c)]
        found.append((chr(point), len(marks)))
    return (
        "".join(c for c, n in found if n == 1),
        "".join(c for c, n in found if n == 2),
    )


_ONE_MARK, _TWO_MARKS = _accented()


def diacritics(name: Column) -> Column:
    """Marks and special letters a spelling keeps."""
    def held(letters: str) -> Column:
        return F.length(name) - F.length(F.translate(name, letters, ""))

    loose = F.length(name) - F.length(F.regexp_replace(name, r"\p{Mn}", ""))
    return (
        held(_ONE_MARK + MARKED_LETTERS) + held(_TWO_MARKS) * 2 + loose
    ).cast("int")


# ---------------------------------------------------------------------- reasons


def theme_name(category: Column) -> Column:
    """Readable name of the last part of a category path."""
    last = F.element_at(F.split(F.btrim(category, F.lit("/")), "/"), -1)
    text = strip(F.replace(last, F.lit("-"), F.lit(" ")))
    readable = F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substr(text, F.lit(2))))
    return let(last, lambda t: empty_to_null(label_map(THEME_NAMES, t, readable)))


def why_shown(reason: Column, author: Column, category: Column) -> Column:
    who = empty_to_null(strip(author))
    theme = theme_name(category)
    return (
        F.when(reason == "watchlist", "steht auf deiner Watchlist")
        .when(
            reason == "profile_author",
            F.coalesce(
                F.concat(F.lit("neu von "), who, F.lit(", der du folgst")),
                F.lit("neu von einer Autor:in, der du folgst"),
            ),
        )
        .otherwise(
            F.coalesce(
                F.concat(F.lit(f"neu im {THEME} "), theme),
                F.lit(f"neu in einem {THEME}, dem du folgst"),
            )
        )
    )


def short_why(reason: Column, category: Column) -> Column:
    return (
        F.when(reason == "watchlist", "Watchlist")
        .when(reason == "profile_author", "Autor:in")
        .otherwise(F.coalesce(theme_name(category), F.lit(THEME)))
    )


# ----------------------------------------------------------- prices, identifiers


def parse_price(text: Column) -> Column:
    """German price text to cents."""
    whole = F.replace(F.regexp_extract(text, PRICE_PATTERN, 1), F.lit("."), F.lit(""))
    cents = F.regexp_extract(text, PRICE_PATTERN, 2)
    return F.when(cents != "", whole.cast("int") * 100 + cents.cast("int"))


def money(cents: Column, missing: str | None = None) -> Column:
    text = F.replace(F.format_string("%.2f €", cents / 100), F.lit("."), F.lit(","))
    return F.when(cents.isNotNull(), text).otherwise(F.lit(missing))


def isbn_of_order_number(number: Column) -> Column:
    return empty_to_null(F.regexp_extract(number, f"^SW({ISBN13})", 1))


def isbn_in_text(text: Column) -> Column:
    """Thirteen digits with no digit on either side, hyphens ignored."""
    digits = F.replace(text, F.lit("-"), F.lit(""))
    return empty_to_null(F.regexp_extract(digits, rf"(?<!\d)({ISBN13})(?!\d)", 1))


def canonical_url(url: Column, base: str | None = None) -> Column:
    """The address without query and fragment; a relative one is joined with the base."""
    plain = F.regexp_replace(url, r"[?#].*$", "")
    if base is None:
        return plain
    scheme, host = re.match(r"([a-z][a-z0-9+.-]*:)(//[^/?#]*)", base).groups()
    folder = re.match(r"[^?#]*/|[^?#]*", base[len(scheme + host) :])[0] or "/"
    return (
        F.when(plain.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), plain)
        .when(plain.startswith("//"), F.concat(F.lit(scheme), plain))
        .when(plain.startswith("/"), F.concat(F.lit(scheme + host), plain))
        .otherwise(F.concat(F.lit(scheme + host + folder), plain))
    )


def product_id(url: Column) -> Column:
    """Last part of the path that consists of digits only."""
    parts = F.filter(F.split(F.substring_index(url, "?", 1), "/"), lambda p: p.rlike(r"^\d+$"))
    return F.try_element_at(parts, F.lit(-1))


def trailing_id(url: Column) -> Column:
    """Last path part if it is a number."""
    tail = F.element_at(F.split(F.rtrim(url, F.lit("/")), "/"), -1)
    return F.when(tail.rlike(r"^\d+$"), tail)


def media_id(url: Column) -> Column:
    """Third part of a ``mediaInfo,0-0-<id>-…`` file name."""
    return empty_to_null(F.regexp_extract(url, r"(?:^|/)mediaInfo,[^-/]*-[^-/]*-(\d+)(?:-[^/]*)?$", 1))


def author_slug(author: Column) -> Column:
    name = strip(author)
    name = F.when(
        name.contains(","),
        strip(
            F.concat(
                strip(F.regexp_extract(name, r"(?s)^[^,]*,(.*)$", 1)),
                F.lit(" "),
                strip(F.substring_index(name, ",", 1)),
            )
        ),
    ).otherwise(name)
    name = F.lower(name)
    for source, target in SLUG_FOLDS.items():
        name = F.replace(name, F.lit(source), F.lit(target))
    return F.array_join(words(name), "-")


def file_name(url: Column) -> Column:
    """Content-addressed name of an image: hash of the address plus suffix."""
    path = F.regexp_replace(url, r"^[a-zA-Z]+://[^/?#]*", "")
    suffix = F.lower(F.regexp_extract(F.regexp_replace(path, r"[?#].*$", ""), r"(\.[A-Za-z]{3,4})$", 1))
    return F.concat(
        F.substring(F.sha2(url, 256), 1, 12), label_map(IMAGE_SUFFIXES, suffix, F.lit(".jpg"))
    )


# ------------------------------------------------------------------------- keys


def subject_of(isbn: Column, source: Column, item: Column) -> Column:
    """What a judgement hangs on: the ISBN where there is one, else the find."""
    return F.when(F.length(isbn) > 0, F.concat(F.lit("isbn:"), isbn)).otherwise(
        F.concat_ws(":", F.lit("item"), source, item)
    )


def book_subject(book_id: Column) -> Column:
    return F.concat(F.lit("book:"), book_id.cast("string"))


def entry_key(title: Column, author: Column) -> Column:
    return F.lower(F.concat_ws("|", title, F.coalesce(author, F.lit(""))))


def find_key(source: Column, item: Column) -> Column:
    return F.concat_ws(":", source, item)


def availability_of_copies(owned: Column, available: Column) -> Column:
    return (
        F.when(owned <= 0, "unknown").when(available > 0, "available").otherwise("unavailable")
    )


def library_availability(available: Column) -> Column:
    return F.when(available >= 1, "available").otherwise("unavailable")


# ------------------------------------------------------------------- sentences


def bundle_sentence(volumes: Column, price: Column, singles: Column, saved_pct: Column) -> Column:
    text = F.format_string(
        "%d Bände für %.2f € statt %.2f € — %d %% gespart",
        volumes, price / 100, singles / 100, saved_pct,
    )
    return F.replace(text, F.lit("."), F.lit(","))


def gate_sentence(
    held_back: Column, threshold: int, over_budget: Column, unrated: Column, unsure: Column
) -> Column:
    """What the gate did, only the counters that are not zero; NULL for a quiet gate."""
    parts = F.concat_ws(
        ", ",
        F.when(
            held_back > 0,
            F.concat(
                held_back.cast("string"),
                F.when(held_back == 1, " Vorschlag").otherwise(" Vorschläge"),
                F.lit(f" unter {threshold} Sternen zurückgehalten"),
            ),
        ),
        F.when(
            over_budget > 0,
            F.concat(
                over_budget.cast("string"),
                F.lit(" heute nicht bewertet (Budget erschöpft) und deshalb ungeprüft gezeigt"),
            ),
        ),
        F.when(
            unrated > 0,
            F.concat(
                unrated.cast("string"),
                F.lit(" konnten nicht bewertet werden und werden ungeprüft gezeigt"),
            ),
        ),
        F.when(
            unsure > 0,
            F.concat(
                unsure.cast("string"),
                F.lit(" lagen darunter, ruhten aber nur auf Vermutung und werden deshalb gezeigt"),
            ),
        ),
    )
    return F.when(parts != "", F.concat(F.lit("Bewertungstor: "), parts))


def free_text_parts(entry: Column) -> Column:
    """struct(title, author, note) of a line like ``Title - Author (note)``."""
    note_pattern = r"(?U)^(.*?)\s*\(([^()]*)\)\s*$"
    body_pattern = r"(?U)^(.+?)\s+[-–—]\s+([^-–—\d]+)$"

    def split_body(s: Column) -> Column:
        body = F.when(s.rlike(note_pattern), strip(F.regexp_extract(s, note_pattern, 1))).otherwise(s)
        note = empty_to_null(strip(F.regexp_extract(s, note_pattern, 2)))
        return let(
            body,
            lambda b: F.struct(
                F.when(b.rlike(body_pattern), strip(F.regexp_extract(b, body_pattern, 1)))
                .otherwise(b)
                .alias("title"),
                empty_to_null(strip(F.regexp_extract(b, body_pattern, 2))).alias("author"),
                note.alias("note"),
            ),
        )

    return let(strip(squeeze(entry)), split_body)


def book_facts(
    title: Column, subtitle: Column, author: Column, series: Column, category: Column,
    price: Column, blurb: Column,
) -> Column:
    """The public facts of a book as lines of prompt text."""
    def present(value: Column, line: Column) -> Column:
        return F.when(F.length(value) > 0, line)

    cut = F.when(is_truncated(blurb), " (von der Quelle abgeschnitten)").otherwise("")
    return F.concat_ws(
        "\n",
        F.concat(F.lit("Titel: "), title),
        present(subtitle, F.concat(F.lit("Untertitel: "), subtitle)),
        F.concat(F.lit("Autor:in: "), F.coalesce(empty_to_null(author), F.lit("unbekannt"))),
        present(series, F.concat(F.lit("Reihe: "), series)),
        present(category, F.concat(F.lit(f"{THEME}: "), theme_name(category))),
        F.when(price.isNotNull(), F.format_string("Preis: %.2f EUR", price / 100)),
        present(blurb, F.concat(F.lit("Klappentext"), cut, F.lit(": "), blurb)),
    )


def label_date(text: Column) -> Column:
    """Date inside a label text (``dd.mm.yyyy``)."""
    return F.try_to_date(F.regexp_extract(text, r"\b(\d{2}\.\d{2}\.\d{4})\b", 1), "dd.MM.yyyy")
