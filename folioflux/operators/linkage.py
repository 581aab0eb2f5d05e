"""Record linkage: scoring, ranking and confidence, and linking to known books."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflux.functions import catalogue, similarity, text
from folioflux.operators import ordered
from folioflux.session import materialize

# ---------------------------------------------------------------- fixed values
NO_MATCH_BELOW = 85
STRONG_TITLE = 95
STRONG_AUTHOR = 90
TIE_MARGIN = 3
MAX_CANDIDATES = 5
UNKNOWN_YEAR_DELTA = 9999
AUTO_ACCEPT, PROVISIONAL, NO_MATCH = "auto_accept", "provisional", "no_match"
# ------------------------------------------------------------------------------


def preferred_spelling(names: DataFrame, key: Column, name: str = "author") -> DataFrame:
    """Best spelling per person: no comma, most marks, longest, then alphabetical."""
    spelled = names.withColumn(name, F.trim(name)).filter(F.length(name) > 0)
    rank = F.struct(
        F.col(name).contains(","),
        -catalogue.diacritics(F.col(name)),
        -F.length(name),
        F.col(name),
    )
    return spelled.groupBy(key).agg(F.min_by(name, rank).alias(name))


def preferred(rows: DataFrame, keys: list[str], wanted: Column) -> DataFrame:
    """Keep wanted rows, but all rows of a key that has none."""
    has = rows.groupBy(*keys).agg(F.bool_or(wanted).alias("_has"))
    return rows.join(has, keys).filter(~F.col("_has") | wanted).drop("_has")


def entry_of_book(books: DataFrame, watchlist: DataFrame) -> DataFrame:
    """Watchlist entry of a book by trimmed, case-folded title and author."""
    def key(name: str) -> Column:
        return F.lower(F.trim(F.coalesce(F.col(name), F.lit(""))))

    left = books.select("book_id", key("title").alias("_t"), key("author").alias("_a"))
    right = watchlist.select("entry_id", key("title").alias("_t"), key("author").alias("_a"))
    return left.join(right, ["_t", "_a"]).drop("_t", "_a")


# --------------------------------------------------------------------- scoring


def with_keys(rows: DataFrame) -> DataFrame:
    """Comparable forms of ``title`` and ``author`` as columns, computed once per row."""
    first = rows.withColumns(
        {
            "norm": text.normalize_title(F.col("title")),
            "volume": text.volume_of(F.col("title")),
            "bundle": text.looks_like_bundle(F.col("title")),
            "_people": text.normalize_authors(F.col("author")),
            "author": F.nullif("author", F.lit("")),
        }
    )
    return first.withColumns(
        {
            "tokens": text.title_tokens(F.col("norm")),
            "names": text.full_names(F.col("_people")),
            "short_names": text.substantial_names(F.col("_people")),
            "name_tokens": text.substantial_tokens(F.col("_people")),
        }
    ).drop("_people")


KEYS = [
    "norm", "volume", "bundle", "tokens", "names", "short_names", "name_tokens", "author",
]


def score(pairs: DataFrame) -> DataFrame:
    """Scores of pairs; wanted columns carry the prefix ``q_``, found ones ``c_``."""
    return _compared(_measured(pairs))


def _measured(pairs: DataFrame) -> DataFrame:
    """The measures that run in Python."""
    q, c = (lambda n: F.col(f"q_{n}")), (lambda n: F.col(f"c_{n}"))
    return pairs.withColumn("title_fuzzy", similarity.title_similarity(q("norm"), c("norm"))).withColumn(
        "_author",
        similarity.name_scores(q("names"), q("short_names"), c("names"), c("short_names")),
    )


def _q(name: str) -> Column:
    return F.col(f"q_{name}")


def _c(name: str) -> Column:
    return F.col(f"c_{name}")


def _of_titles() -> list[Column]:
    """What follows from the two titles alone."""
    return [
        ((_q("norm") != "") & (_q("norm") == _c("norm"))).alias("title_exact"),
        text.title_contained(_q("tokens"), _c("tokens")).alias("title_contained"),
        text.volumes_conflict(_q("volume"), _c("volume")).alias("volume_conflict"),
        (_c("bundle") & ~_q("bundle")).alias("is_bundle"),
    ]


def _of_people() -> list[Column]:
    """What follows from the two credits alone, and their measures."""
    tokens_apart = ~F.arrays_overlap(_q("name_tokens"), _c("name_tokens"))
    named = (F.size(_q("names")) > 0) & (F.size(_c("names")) > 0)
    return [
        (named & F.arrays_overlap(_q("names"), _c("names"))).alias("author_exact"),
        F.col("_author.fuzzy").alias("author_fuzzy"),
        (
            _q("author").isNotNull() & _c("author").isNotNull() & named
            & (F.col("_author.strict") < STRONG_AUTHOR) & tokens_apart
        ).alias("author_conflict"),
        (_q("author").isNotNull() & _c("author").isNull()).alias("author_missing"),
    ]


def _compared(measured: DataFrame) -> DataFrame:
    """All that follows from the measures and the keys."""
    given_id = (F.length(_q("identifier")) > 0) & (F.length(_c("identifier")) > 0)
    return measured.select(
        "*",
        F.coalesce(given_id & (_q("identifier") == _c("identifier")), F.lit(False)).alias("id_match"),
        F.coalesce(given_id & (_q("identifier") != _c("identifier")), F.lit(False)).alias("id_conflict"),
        *_of_titles(), *_of_people(),
        F.coalesce(F.abs(_q("year") - _c("year")), F.lit(UNKNOWN_YEAR_DELTA)).alias("year_delta"),
    ).drop("_author")


def rank_key() -> Column:
    """Lexicographic key, ascending is better. Scores count in buckets of five."""
    def down(name: str) -> Column:
        return -F.floor(F.col(name) / 5)

    return F.struct(
        ~F.col("id_match"),
        F.col("id_conflict"),
        F.col("author_conflict"),
        ~F.col("title_exact"),
        F.col("volume_conflict"),
        F.col("is_bundle"),
        ~F.col("title_contained"),
        F.col("author_missing"),
        down("title_fuzzy").alias("title_bucket"),
        ~F.col("author_exact"),
        down("author_fuzzy").alias("author_bucket"),
        F.col("year_delta"),
        F.col("c_rank"),
    )


SCORED = [
    "c_rank", "id_match", "id_conflict", "title_exact", "title_fuzzy", "title_contained",
    "volume_conflict", "is_bundle", "author_exact", "author_fuzzy", "author_conflict",
    "author_missing", "year_delta",
]
SAME_IN_A_TIE = ["title_exact", "is_bundle", "volume_conflict", "author_conflict"]


def tied(best: Column, other: Column) -> Column:
    """Two hits that cannot honestly be told apart."""
    same = (F.abs(best["title_fuzzy"] - other["title_fuzzy"]) <= TIE_MARGIN) & (
        F.floor(best["author_fuzzy"] / 5) == F.floor(other["author_fuzzy"] / 5)
    )
    for name in SAME_IN_A_TIE:
        same = same & (best[name] == other[name])
    return F.coalesce(same, F.lit(False))


def confidence(best: Column, has_author: Column, is_tied: Column) -> Column:
    """struct(confidence, reason) of a winner."""
    def answer(level: str, why: Column | str) -> Column:
        why = F.lit(why) if isinstance(why, str) else why
        return F.struct(F.lit(level).alias("confidence"), why.alias("reason"))

    confirmable = ~(best["author_conflict"] | best["author_missing"])
    sure = (best["title_exact"] & (best["author_fuzzy"] >= STRONG_AUTHOR)) | (
        (best["title_fuzzy"] >= STRONG_TITLE) & best["author_exact"]
    )
    weak = best["title_fuzzy"] < NO_MATCH_BELOW
    held = best["title_contained"]
    return (
        F.when(best.isNull(), answer(NO_MATCH, "keine Kandidaten"))
        .when(best["id_match"], answer(AUTO_ACCEPT, "Kennung stimmt überein"))
        .when(
            weak & held & confirmable,
            answer(PROVISIONAL, "der gesuchte Titel steckt im gefundenen — bitte bestätigen"),
        )
        .when(
            weak & held & best["author_conflict"],
            answer(NO_MATCH, "der Titel steckt im gefundenen, aber dort steht eine andere Autor:in"),
        )
        .when(
            weak & held,
            answer(NO_MATCH, "der Titel steckt im gefundenen, aber dort steht keine Autor:in"),
        )
        .when(
            weak,
            answer(
                NO_MATCH,
                F.format_string(f"bester Titelwert %d liegt unter {NO_MATCH_BELOW}", best["title_fuzzy"]),
            ),
        )
        .when(
            best["volume_conflict"],
            answer(PROVISIONAL, "der Treffer nennt einen anderen Band der Reihe"),
        )
        .when(best["id_conflict"], answer(PROVISIONAL, "die Kennungen widersprechen sich"))
        .when(has_author & sure & is_tied, answer(PROVISIONAL, "zwei Kandidaten sind gleich gut"))
        .when(has_author & sure, answer(AUTO_ACCEPT, "Titel und Autor stimmen beide"))
        .when(
            has_author,
            answer(
                PROVISIONAL,
                F.format_string(
                    "Titel %d, Autor %d — nicht eindeutig", best["title_fuzzy"], best["author_fuzzy"]
                ),
            ),
        )
        .when(
            best["title_exact"] & ~is_tied,
            answer(AUTO_ACCEPT, "exakter Titel, kein konkurrierender Treffer, kein Autor angegeben"),
        )
        .otherwise(
            answer(
                PROVISIONAL, "kein Autor am Eintrag, mit dem sich der Titel bestätigen ließe"
            )
        )
    )


def _prefixed(rows: DataFrame, prefix: str, keep: list[str]) -> DataFrame:
    return rows.select(*[F.col(n).alias(n if n == "query_id" else prefix + n) for n in keep])


def _keyed(rows: DataFrame) -> DataFrame:
    """``with_keys``, worked out once for each different title and author."""
    spelled = rows.select("title", "author").distinct()
    keys = with_keys(spelled.withColumns({"_title": F.col("title"), "_author": F.col("author")}))
    renamed = rows.withColumnsRenamed({"title": "_t", "author": "_a"})
    same = F.col("_t").eqNullSafe(F.col("_title")) & F.col("_a").eqNullSafe(F.col("_author"))
    kept = [c for c in rows.columns if c not in ("title", "author")]
    return renamed.join(keys.select("_title", "_author", *KEYS), same).select(*kept, *KEYS)


def scored_pairs(queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """Every candidate of a query with its scores.

    ``queries(query_id, title, author, year, identifier)``; candidates add ``rank``,
    their place in the result list of the source. Titles and names are few beside the
    candidates: each different pair is scored once and joined back.
    """
    left = _prefixed(_keyed(queries), "q_", ["query_id", *KEYS, "year", "identifier"])
    right = _prefixed(_keyed(candidates), "c_", ["query_id", "rank", *KEYS, "year", "identifier"])
    pairs = left.join(right, "query_id")
    return _compared(_with_measures(pairs))


MEASURED = ["q_norm", "c_norm", "q_names", "c_names", "q_short_names", "c_short_names"]


def _with_measures(pairs: DataFrame) -> DataFrame:
    """Pairs with their measures, each different pair of forms measured once."""
    forms = pairs.select(*MEASURED).distinct()
    measured = _measured(forms).select(*[F.col(c).alias(f"_{c}") for c in MEASURED], "title_fuzzy", "_author")
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in MEASURED]
    return pairs.join(measured, same).drop(*[f"_{c}" for c in MEASURED])


def best_two(scored: DataFrame, keys: list[str], extra: list[str] | None = None) -> DataFrame:
    """Winner and runner-up per query as structs ``best`` and ``second``."""
    facts = F.struct(*SCORED, *(extra or []))
    top = ordered.top_per_key(scored.withColumn("_key", rank_key()), keys, [F.col("_key")], 2, "_place")
    return top.groupBy(*keys).agg(
        F.min_by(facts, "_place").alias("best"),
        F.max_by(F.when(F.col("_place") == 2, facts), "_place").alias("second"),
    )


def match(queries: DataFrame, candidates: DataFrame) -> DataFrame:
    """One row per query: confidence, reason and the winner's place and scores."""
    two = best_two(scored_pairs(queries, candidates), ["query_id"])
    has_author = F.coalesce(F.length("author") > 0, F.lit(False))
    return (
        queries.select("query_id", "author")
        .join(two, "query_id", "left")
        .withColumn("_a", confidence(F.col("best"), has_author, tied(F.col("best"), F.col("second"))))
        .select("query_id", "_a.confidence", "_a.reason", "best", "second")
    )


def indistinguishable(scored: DataFrame, keys: list[str], most: int = MAX_CANDIDATES) -> DataFrame:
    """Winner and the candidates tied with it, at most so many, winner first."""
    facts = F.struct("c_rank", "title_fuzzy", "author_fuzzy", *SAME_IN_A_TIE)
    best = scored.groupBy(*keys).agg(F.min_by(facts, rank_key()).alias("_best"))
    # The winner ties with itself and leads by its rank key.
    same = scored.join(best, keys).filter(tied(F.col("_best"), facts)).withColumn("_key", rank_key())
    return ordered.top_per_key(same, keys, [F.col("_key")], most, "place").drop("_best", "_key")


# --------------------------------------------------- linking to the known books

# Both sides are first reduced to signatures: rows that no score can tell apart.
SIGNATURE = ["norm", "volume", "bundle", "author", "has_isbn"]


def _edits(length: Column, slack: float) -> Column:
    """Most edits between a string of this length and one that is still close enough."""
    reach = (1 + slack) / (1 - slack)
    return F.floor(length * (slack * (1 + reach)) + 1e-9).cast("int")


def _piece_start(length: Column, edits: Column, i: Column) -> Column:
    return F.floor(length * i / (edits + 1)).cast("int")


def _pieces(value: Column, slack: float) -> Column:
    """Even pieces of a string, one more than edits are allowed: one must survive."""
    length = F.length(value)
    edits = _edits(length, slack)

    def piece(i: Column) -> Column:
        start = _piece_start(length, edits, i)
        size = _piece_start(length, edits, i + 1) - start
        return F.concat_ws(":", length, i, value.substr(start + 1, size))

    return F.transform(F.sequence(F.lit(0), edits), piece)


def _probes(value: Column, slack: float) -> Column:
    """Every cut of a string that may equal a piece of a close enough string.

    Piece ``i`` of a string with ``t + 1`` pieces survives at a shift of at most
    ``i`` seen from the left and ``t - i`` seen from the right (the multi-match-aware
    selection of partition-based similarity joins), which keeps the cuts few and
    loses no pair.
    """
    reach = (1 + slack) / (1 - slack)
    size_of = F.length(value)

    def of_length(length: Column) -> Column:
        edits, delta = _edits(length, slack), size_of - length

        def of_piece(i: Column) -> Column:
            start = _piece_start(length, edits, i)
            size = _piece_start(length, edits, i + 1) - start
            low = F.greatest(F.lit(0), start - i, start + delta - (edits - i))
            high = F.least(size_of - size, start + i, start + delta + (edits - i))
            cuts = F.transform(
                F.sequence(low, F.greatest(low, high)),
                lambda at: F.concat_ws(":", length, i, value.substr(at + 1, size)),
            )
            return F.when(low <= high, cuts).otherwise(F.array().cast("array<string>"))

        return F.flatten(F.transform(F.sequence(F.lit(0), edits), of_piece))

    shortest = F.ceil(size_of / reach - 1e-9).cast("int")
    longest = F.floor(size_of * reach + 1e-9).cast("int")
    return F.array_distinct(F.flatten(F.transform(F.sequence(shortest, longest), of_length)))


def _close_keys(value: Column, slack: float, own: bool) -> Column:
    return _pieces(value, slack) if own else _probes(value, slack)


def _sorted_words(value: Column) -> Column:
    return F.array_join(F.array_sort(text.words(value)), " ")


NAME_SLACK = 0.105  # names that score 89.5 or more
TITLE_SLACK = 0.085  # titles that score 91.5 or more, so that ties are seen too


def _name_keys(own: bool) -> Column:
    """Blocking keys of a credit: name tokens, and pieces for misspelled names."""
    names = F.array_distinct(F.concat("names", "short_names"))
    tokens = F.array_distinct(F.flatten(F.transform(names, lambda n: F.split(n, " "))))
    pieces = F.flatten(
        F.transform(names, lambda n: text.let(_sorted_words(n), lambda v: _close_keys(v, NAME_SLACK, own)))
    )
    nobody = F.array(F.lit("-"))
    keys = F.concat(tokens, F.transform(pieces, lambda p: F.concat(F.lit("~"), p)))
    # A wanted name also has to see books that name nobody.
    return F.when(F.size("names") == 0, nobody).otherwise(
        keys if own else F.concat(keys, nobody)
    )


def _blocked(queries: DataFrame, books: DataFrame) -> DataFrame:
    """Pairs of signatures that can decide a query with an author."""
    wanted = queries.filter("author is not null")

    same_title = wanted.select(
        "q_id", F.col("norm").alias("_n"), F.explode(_name_keys(False)).alias("_k")
    ).filter("_n <> ''").join(
        books.select(
            "b_id", F.col("norm").alias("_n"), F.explode(_name_keys(True)).alias("_k")
        ),
        ["_n", "_k"],
    )

    def by_person(rows: DataFrame, id_: str, own: bool) -> DataFrame:
        tokens = F.array_distinct(
            F.flatten(F.transform("names", lambda n: F.split(n, " ")))
        )
        return (
            rows.filter("norm <> ''")
            .select(id_, F.explode(tokens).alias("_t"), _sorted_words(F.col("norm")).alias("_s"))
            .select(id_, "_t", F.explode(_close_keys(F.col("_s"), TITLE_SLACK, own)).alias("_k"))
        )

    near_title = by_person(wanted, "q_id", False).join(by_person(books, "b_id", True), ["_t", "_k"])
    return same_title.select("q_id", "b_id").unionByName(near_title.select("q_id", "b_id")).distinct()


def _pairs(ids: DataFrame, queries: DataFrame, books: DataFrame, all_editions: bool = False) -> DataFrame:
    left = queries.select(
        "q_id", *[F.col(n).alias(f"q_{n}") for n in (*KEYS, "has_isbn")],
        F.lit(None).cast("int").alias("q_year"), F.lit("").alias("q_identifier"),
    )
    right = books.select(
        "b_id", *[F.col(n).alias(f"c_{n}") for n in (*KEYS, "has_isbn")],
        F.col("book_id").alias("c_rank"), F.col("copies").alias("c_copies"),
        F.lit(None).cast("int").alias("c_year"), F.lit("").alias("c_identifier"),
    )
    joined = ids.join(left, "q_id").join(right, "b_id")
    # A find with an ISBN never becomes a book that has another one.
    return joined if all_editions else joined.filter(~(F.col("q_has_isbn") & F.col("c_has_isbn")))


TITLE, PEOPLE = ["norm", "volume", "bundle", "tokens"], ["names", "short_names", "name_tokens", "author"]


def _numbered(rows: DataFrame, names: list[str], into: str) -> DataFrame:
    """The different forms of some columns, each with a number."""
    return materialize(rows.select(*names).distinct().withColumn(into, F.monotonically_increasing_id()), into)


def _by_form(rows: DataFrame, forms: DataFrame, names: list[str]) -> DataFrame:
    renamed = forms.withColumnsRenamed({n: f"_{n}" for n in names})
    same = [F.col(n).eqNullSafe(F.col(f"_{n}")) for n in names]
    return rows.join(renamed, same).drop(*[f"_{n}" for n in names])


def _scored_forms(ids: DataFrame, queries: DataFrame, books: DataFrame) -> DataFrame:
    """Scores of pairs of signatures, as ``score(_pairs(…))`` gives them.

    Signatures pair a few titles with a few people in every way, so titles are compared
    once for each pair of different titles and people once for each pair of different
    credits; a pair of signatures is numbers only.
    """
    def side(rows: DataFrame, p: str, id_: str, facts: list[Column]) -> tuple[DataFrame, DataFrame, DataFrame]:
        # Of a credit's spelling only counts whether there is one.
        plain = rows.withColumn("author", F.when(F.col("author").isNotNull(), F.lit("-")))
        titles, people = _numbered(plain, TITLE, f"{p}_title"), _numbered(plain, PEOPLE, f"{p}_people")
        placed = _by_form(_by_form(plain, titles, TITLE), people, PEOPLE)
        return (
            placed.select(id_, f"{p}_title", f"{p}_people", F.col("has_isbn").alias(f"{p}_has_isbn"), *facts),
            titles.withColumnsRenamed({n: f"{p}_{n}" for n in TITLE}),
            people.withColumnsRenamed({n: f"{p}_{n}" for n in PEOPLE}),
        )

    wanted, wanted_titles, wanted_people = side(queries, "q", "q_id", [])
    found, found_titles, found_people = side(
        books, "c", "b_id", [F.col("book_id").alias("c_rank"), F.col("copies").alias("c_copies")]
    )
    # A find with an ISBN never becomes a book that has another one.
    pairs = materialize(
        ids.join(wanted, "q_id").join(found, "b_id").filter("not (q_has_isbn and c_has_isbn)"), "signature-pairs"
    )
    titles = (
        pairs.select("q_title", "c_title").distinct().join(wanted_titles, "q_title").join(found_titles, "c_title")
        .withColumn("title_fuzzy", similarity.title_similarity(_q("norm"), _c("norm")))
        .select("q_title", "c_title", "title_fuzzy", *_of_titles())
    )
    people = (
        pairs.select("q_people", "c_people").distinct().join(wanted_people, "q_people").join(found_people, "c_people")
        .withColumn("_author", similarity.name_scores(_q("names"), _q("short_names"), _c("names"), _c("short_names")))
        .select("q_people", "c_people", *_of_people())
    )
    return (
        pairs.join(materialize(titles, "title-pairs"), ["q_title", "c_title"])
        .join(materialize(people, "people-pairs"), ["q_people", "c_people"])
        .select(
            "q_id", "c_copies", F.lit(False).alias("id_match"), F.lit(False).alias("id_conflict"),
            F.lit(UNKNOWN_YEAR_DELTA).alias("year_delta"),
            *[n for n in SCORED if n not in ("id_match", "id_conflict", "year_delta")],
        )
    )


def _signatures(rows: DataFrame, id_: str) -> DataFrame:
    keyed = _keyed(rows).withColumn(
        "has_isbn", F.coalesce(F.length("isbn") > 0, F.lit(False))
    )
    parts = [F.coalesce(F.col(n).cast("string"), F.lit("\u0000")) for n in SIGNATURE]
    return keyed.withColumn(id_, F.md5(F.concat_ws("\u0001", *parts)))


def find_books(items: DataFrame, books: DataFrame) -> DataFrame:
    """Existing book of each item, by ISBN or by an unattended match.

    ``items(item_id, isbn, title, author)``, ``books(book_id, isbn, title, author)``
    -> ``(item_id, book_id, how)`` for the items that have one.

    Only signatures meet, and only inside blocks that lose no decisive pair: equal
    titles with a related or missing author, or near titles of a shared name.
    Unlike other operators this one writes intermediate tables when it is called.
    """
    by_isbn = (
        items.filter(F.length("isbn") > 0)
        .join(books.groupBy("isbn").agg(F.min("book_id").alias("book_id")), "isbn")
        .select("item_id", "book_id", F.lit("isbn").alias("how"))
    )
    open_ = items.join(by_isbn.select("item_id"), "item_id", "left_anti")
    # Keys are costly and used by several joins: written once, and read as columns.
    needed = ["isbn", "title", "author"]
    keyed = materialize(_signatures(open_.select("item_id", *needed), "q_sig"), "item-keys")
    queries = materialize(
        keyed.groupBy("q_sig").agg(*[F.first(n).alias(n) for n in (*KEYS, "has_isbn")])
        .withColumn("q_id", F.monotonically_increasing_id()),
        "queries",
    )
    known = materialize(
        _signatures(books.select("book_id", *needed), "b_sig").groupBy("b_sig").agg(
            *[F.first(n).alias(n) for n in (*KEYS, "has_isbn")],
            F.min("book_id").alias("book_id"),
            F.count("*").alias("copies"),
        ).withColumn("b_id", F.monotonically_increasing_id()).drop("b_sig"),
        "book-keys",
    )
    scored = _scored_forms(_blocked(queries, known), queries, known)
    two = best_two(scored, ["q_id"], ["c_copies"])
    best = F.col("best")
    # Two copies with one signature are a tie of the winner with itself.
    is_tied = tied(best, F.col("second")) | (best["c_copies"] > 1)
    accepted = materialize(
        two.filter(confidence(best, F.lit(True), is_tied)["confidence"] == AUTO_ACCEPT).select(
            "q_id", best["c_rank"].alias("book_id"), best["title_exact"].alias("exact")
        ),
        "accepted",
    )

    near = accepted.filter("not exact").select("q_id")
    overruled = _containing(queries.join(near, "q_id", "left_semi"), known)
    with_author = accepted.select("q_id", "book_id").join(overruled, "q_id", "left_anti")
    decided = with_author.unionByName(_without_author(queries, known))
    by_match = keyed.select("item_id", "q_sig").join(
        queries.select("q_sig", "q_id").join(decided, "q_id"), "q_sig"
    ).select(
        "item_id", "book_id", F.lit("match").alias("how")
    )
    return by_isbn.unionByName(by_match)


def _containing(queries: DataFrame, books: DataFrame) -> DataFrame:
    """Queries for which a longer title holding all wanted words would rank first."""
    scored = _scored_forms(_container_ids(queries, books), queries, books)
    first = ~F.col("author_conflict") & ~F.col("volume_conflict") & ~F.col("is_bundle")
    accepted = (F.col("title_fuzzy") >= STRONG_TITLE) & F.col("author_exact")
    return scored.filter(first & ~accepted).select("q_id").distinct()


def _container_ids(queries: DataFrame, books: DataFrame) -> DataFrame:
    """(q_id, b_id) where the longer title of a book holds all words of the wanted one.

    An inverted index of the titles' words, with words in the order of how many titles
    hold them: a title that holds all wanted words holds the rarest of them, so a query
    looks there only. A word that all titles share is looked up by no query that has
    another one. Queries are few beside the books and of one form each: titles of one
    set of words are looked up once.
    """
    wanted = queries.select("q_id", F.array_sort("tokens").alias("_wanted"))
    forms = materialize(
        wanted.groupBy("_wanted").agg(F.count("*").alias("_n")).select("_wanted"), "wanted-words"
    )
    asked = forms.select(F.explode(F.array_distinct("_wanted")).alias("_word")).distinct()
    found = books.select("b_id", F.array_sort("tokens").alias("_found"))
    # Titles of one set of words stand for one another here.
    titles = found.select("_found").distinct()
    index = materialize(
        titles.select(F.explode(F.array_distinct("_found")).alias("_word"), "_found").join(asked, "_word", "left_semi"),
        "title-words",
    )
    held = index.groupBy("_word").agg(F.count("*").alias("_titles"))
    # A word that no title holds is the rarest of all: such a query has no container.
    rarest = (
        forms.select("_wanted", F.explode(F.array_distinct("_wanted")).alias("_word"))
        .join(held, "_word", "left")
        .groupBy("_wanted")
        .agg(F.min(F.struct(F.coalesce("_titles", F.lit(0)).alias("n"), F.col("_word").alias("w"))).alias("_r"))
        .filter("_r.n > 0")
        .select("_wanted", F.col("_r.w").alias("_word"))
    )
    pairs = materialize(
        materialize(rarest, "rarest-words").join(index, "_word")
        .filter(text.title_contained(F.col("_wanted"), F.col("_found")))
        .select("_wanted", "_found"),
        "contained-titles",
    )
    return wanted.join(pairs, "_wanted").join(found, "_found").select("q_id", "b_id")


def _without_author(queries: DataFrame, books: DataFrame) -> DataFrame:
    """Queries without an author take the one book with their exact title.

    Books are counted per title, volume and form, so a title with many books
    brings a few rows only.
    """
    forms = books.filter("norm <> ''").groupBy("norm", "volume", "bundle", "has_isbn").agg(
        F.min("book_id").alias("book_id"), F.sum("copies").alias("copies")
    )
    left = queries.filter("author is null").select(
        "q_id", "norm", F.col("volume").alias("q_volume"), F.col("bundle").alias("q_bundle"),
        F.col("has_isbn").alias("q_isbn"),
    )
    ranked = (
        left.join(forms, "norm")
        .filter(~(F.col("q_isbn") & F.col("has_isbn")))
        .withColumn("conflict", text.volumes_conflict(F.col("q_volume"), F.col("volume")))
        .withColumn("worse", F.col("bundle") & ~F.col("q_bundle"))
        .groupBy("q_id", "conflict", "worse")
        .agg(F.sum("copies").alias("copies"), F.min("book_id").alias("book_id"))
    )
    best = ordered.first(ranked, ["q_id"], ["conflict", "worse"])
    return best.filter("not conflict and copies = 1").select("q_id", "book_id")


def _new_leaders(reps: DataFrame, books: DataFrame) -> DataFrame:
    """(q_id, leader) for new books that a book made before them in the batch takes in.

    ``reps(q_id, item_id, isbn, title, author)`` are the first items of the batch's new
    books. The result is that of inserting them one by one in the order of ``item_id``.
    All pairs that can decide are blocked and scored once. Then, round by round, each rep
    without an undecided earlier one among its pairs is decided: its candidates are the
    known books and the leaders before it, and if none is accepted it is a leader itself.
    A leader without an ISBN learns the first one that joins it, and takes no other.
    """
    def keyed(rows: DataFrame, id_: str, rank: Column) -> DataFrame:
        has = F.coalesce(F.length("isbn") > 0, F.lit(False))
        return with_keys(rows).withColumns({"has_isbn": has, "c_order": rank}).select(
            F.col(id_), *KEYS, "has_isbn", "isbn", "c_order"
        )

    new = materialize(
        keyed(reps, "q_id", F.struct(F.lit(True).alias("new"), F.col("item_id").cast("long").alias("id")))
        .filter("author is not null and norm <> ''"),
        "new-books",
    )
    others = new.withColumnRenamed("q_id", "b_id")
    near = _blocked(new, others).unionByName(_container_ids(new, others)).distinct().filter("q_id <> b_id")
    order = new.select("q_id", F.col("c_order").alias("_q")), others.select("b_id", F.col("c_order").alias("_b"))
    earlier = materialize(
        near.join(order[0], "q_id").join(order[1], "b_id").filter("_b < _q").select("q_id", "b_id"), "new-pairs"
    )
    asking = new.join(earlier.select("q_id").distinct(), "q_id", "left_semi")
    known = keyed(
        books.withColumn("b_id", F.concat(F.lit("book:"), "book_id")), "b_id",
        F.struct(F.lit(False).alias("new"), F.col("book_id").cast("long").alias("id")),
    )
    known = materialize(known, "old-books")
    old = _blocked(asking, known).unionByName(_container_ids(asking, known)).distinct()

    def scored(ids: DataFrame, found: DataFrame, all_editions: bool) -> DataFrame:
        ranked = found.withColumnsRenamed({"c_order": "book_id"}).withColumn("copies", F.lit(1).cast("long"))
        return score(_pairs(ids, asking, ranked, all_editions)).select(
            "q_id", "b_id", (F.col("q_has_isbn") & F.col("c_has_isbn")).alias("apart"), *SCORED
        )

    every = scored(earlier, others, True).unionByName(scored(old, known, False))
    alone = confidence(F.struct(*SCORED), F.lit(True), F.lit(False))["confidence"]
    every = materialize(
        every.withColumns({"_sure": alone == AUTO_ACCEPT, "_key": rank_key()}), "scored-new"
    )
    # Most reps have no pair that could ever be accepted, and are leaders at once. For the
    # others only what ranks up to such a pair, or could be tied with it, has a say.
    reach = every.filter("_sure and not apart").groupBy("q_id").agg(
        F.max("_key").alias("_worst"), F.min("title_fuzzy").alias("_low")
    )
    has_a_say = (F.col("_key") <= F.col("_worst")) | (F.col("title_fuzzy") >= F.col("_low") - TIE_MARGIN)
    pairs = materialize(
        every.join(materialize(reach, "reach"), "q_id")
        .filter(has_a_say & (~F.col("apart") | F.col("_sure")))
        .drop("_sure", "_key", "_worst", "_low"),
        "deciding-pairs",
    )
    asking = asking.join(pairs.select("q_id").distinct(), "q_id", "left_semi")
    # What is decided: the leader of each rep, its own id for a leader, and its ISBN.
    decided = materialize(
        new.join(asking.select("q_id"), "q_id", "left_anti")
        .select("q_id", F.col("q_id").alias("leader"), "isbn"),
        "decided",
    )
    open_ = asking.select("q_id", F.nullif("isbn", F.lit("")).alias("isbn"), "c_order")
    while not open_.isEmpty():
        waiting = pairs.join(open_.select(F.col("q_id").alias("b_id")), "b_id", "left_semi").select("q_id")
        ready = materialize(open_.join(waiting, "q_id", "left_anti"), "ready")
        # A leader's ISBN: its own, or the one it has learned.
        editions = decided.groupBy("leader").agg(F.max("isbn").alias("_isbn")).withColumnRenamed("leader", "b_id")
        is_leader = decided.filter("q_id = leader").select(F.col("q_id").alias("b_id"))
        leaders = is_leader.join(editions, "b_id")
        visible = pairs.filter("b_id not like 'book:%' and not apart").join(leaders, "b_id").unionByName(
            pairs.filter("b_id like 'book:%'").withColumn("_isbn", F.lit(None).cast("string"))
        )
        visible = visible.join(ready, "q_id").filter(
            F.col("isbn").isNull() | F.col("_isbn").isNull() | (F.length("_isbn") == 0) | (F.col("isbn") == F.col("_isbn"))
        )
        two = best_two(visible, ["q_id"], ["b_id"])
        best = F.col("best")
        sure = confidence(best, F.lit(True), tied(best, F.col("second")))["confidence"] == AUTO_ACCEPT
        accepted = two.filter(sure).select("q_id", best["b_id"].alias("leader"))
        done = materialize(
            ready.join(accepted, "q_id", "left")
            .select("q_id", F.coalesce("leader", "q_id").alias("leader"), "isbn"),
            "decided",
        )
        open_ = materialize(open_.join(done, "q_id", "left_anti"), "open")
        decided = materialize(decided.unionByName(done), "decided")
    return decided.filter("q_id <> leader").select("q_id", "leader")


def _led(grouped: DataFrame, items: DataFrame, books: DataFrame) -> DataFrame:
    """(_group, _first): the first item of the new book that each group ends up in."""
    firsts = materialize(grouped.groupBy("_group").agg(F.min("item_id").alias("item_id")), "new-firsts")
    reps = firsts.join(items.select("item_id", "isbn", "title", "author"), "item_id").withColumnRenamed("_group", "q_id")
    merged = _new_leaders(reps, books).withColumnRenamed("q_id", "_group")
    led = firsts.join(merged, "_group", "left").select("_group", F.coalesce("leader", "_group").alias("_leader"))
    names = firsts.select(F.col("_group").alias("_leader"), F.col("item_id").alias("_first"))
    return led.join(names, "_leader").select("_group", "_first")


def find_or_create(
    items: DataFrame, books: DataFrame, one_by_one: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Book of every item, and the books after the batch.

    Known books are linked first. The rest is grouped by ISBN, and without one by
    normalised title and people; a group becomes one new book named after its first
    item. ``one_by_one``: groups that match the new book of an earlier one join it, as if
    the items had been inserted one by one (``_new_leaders``); that takes a round for each
    link of the longest chain of similar new titles. Without it fuzzy matches among new
    items are not merged, and an ISBN that alone goes with a work takes its items. An item without people joins the one new
    work of its title, volume and form; one whose title normalises to nothing stands alone.

    ``items(item_id, isbn, title, author, series)``,
    ``books(book_id, isbn, title, author, series)``.
    """
    # The scores are costly and used three times, so they are written once.
    found = materialize(find_books(items, books), "found-books")
    open_ = items.join(found.select("item_id"), "item_id", "left_anti")
    # Used four times.
    keyed = materialize(_keyed(open_.select("item_id", "isbn", "title", "author")), "open-keys").withColumn(
        "_work",
        F.concat_ws("|", "norm", F.coalesce(F.col("volume").cast("string"), F.lit("")),
                    F.array_join(F.array_sort("names"), "&")),
    )
    by_isbn = F.when(F.length("isbn") > 0, F.concat(F.lit("isbn:"), "isbn"))
    # A work that exactly one new ISBN carries also takes the items without one.
    single = (
        keyed.filter(by_isbn.isNotNull()).groupBy("_work")
        .agg(F.min(by_isbn).alias("_low"), F.max(by_isbn).alias("_high"))
        .filter("_low = _high").select("_work", F.col("_low").alias("_isbn"))
    )
    taken = F.lit(None).cast("string") if one_by_one else F.col("_isbn")
    # A title that normalises to nothing tells nothing: such an item stands alone.
    alone = F.when(F.col("norm") == "", F.concat(F.lit("item:"), "item_id"))
    works = keyed.join(single, "_work", "left").withColumn(
        "_group", F.coalesce(by_isbn, alone, taken, F.concat(F.lit("work:"), "_work"))
    )
    # An item without people joins the one new work of its title, volume and form.
    form = ["norm", F.coalesce("volume", F.lit(-1)).alias("_volume"), "bundle"]
    named = (
        works.filter((F.size("names") > 0) & (F.col("norm") != "")).groupBy(*form)
        .agg(F.min("_group").alias("_low"), F.max("_group").alias("_high"))
        .filter("_low = _high").select("norm", "_volume", "bundle", F.col("_low").alias("_named"))
    )
    nameless = (F.size("names") == 0) & by_isbn.isNull()
    grouped = (
        works.withColumn("_volume", F.when(nameless, F.coalesce("volume", F.lit(-1))))
        .join(named, ["norm", "_volume", "bundle"], "left")
        .withColumn("_group", F.coalesce(F.when(nameless, F.col("_named")), F.col("_group")))
    )
    firsts = grouped.groupBy("_group").agg(F.min("item_id").alias("_first"))
    if one_by_one:
        grouped = materialize(grouped.select("item_id", "_group"), "new-groups")
        firsts = _led(grouped, items, books)
    created = grouped.join(firsts, "_group").select(
        "item_id", F.concat(F.lit("new:"), "_first").alias("book_key")
    )
    assigned = found.select(
        "item_id", F.concat(F.lit("book:"), "book_id").alias("book_key")
    ).unionByName(created)

    spelled = F.struct(
        F.col("author").contains(","), -catalogue.diacritics(F.col("author")),
        -F.length("author"), F.col("author"),
    )
    facts = items.join(assigned, "item_id").groupBy("book_key").agg(
        F.min_by("title", "item_id").alias("new_title"),
        F.min_by("isbn", F.when(F.length("isbn") > 0, F.col("item_id"))).alias("new_isbn"),
        F.min_by("series", F.when(F.col("series").isNotNull(), F.col("item_id"))).alias("new_series"),
        F.min_by("author", F.when(F.length("author") > 0, spelled)).alias("new_author"),
    )
    old = books.withColumn("book_key", F.concat(F.lit("book:"), "book_id"))
    after = old.join(facts, "book_key", "full").select(
        "book_key",
        F.coalesce("title", "new_title").alias("title"),
        F.coalesce("isbn", "new_isbn").alias("isbn"),
        F.coalesce("series", "new_series").alias("series"),
        better_spelling(F.col("author"), F.col("new_author")).alias("author"),
    )
    return assigned, after


def better_spelling(kept: Column, seen: Column) -> Column:
    """The better spelling of one person; a different person never replaces."""
    def rank(name: Column) -> Column:
        return F.struct(
            name.contains(","), -catalogue.diacritics(name), -F.length(name), name
        )

    same = text.author_key(kept) == text.author_key(seen)
    return (
        F.when(kept.isNull(), seen)
        .when(seen.isNotNull() & same & (rank(seen) < rank(kept)), seen)
        .otherwise(kept)
    )


def learn_isbns(books: DataFrame, observations: DataFrame) -> DataFrame:
    """ISBNs for books without one: the first observed that no other book carries.

    ``observations(id, book_id, isbn)``. Where two books would learn one ISBN, the
    earlier observation wins; the other book learns nothing in this batch.
    """
    lacking = books.filter("isbn is null").select("book_id")
    seen = observations.filter(F.length("isbn") > 0).join(lacking, "book_id", "left_semi")
    free = seen.join(books.filter("isbn is not null").select("isbn"), "isbn", "left_anti")
    per_book = ordered.first(free.select("book_id", "isbn", "id"), ["book_id"], ["id"])
    return ordered.first(per_book, ["isbn"], ["id"]).select("book_id", "isbn")


# ------------------------------------------------------------ watchlist entries


def resolve_entries(
    entries: DataFrame, links: DataFrame, candidates: DataFrame, now: Column
) -> tuple[DataFrame, DataFrame]:
    """Link rows of one catalogue for watchlist entries, and questions for a reader.

    ``entries(query_id, book_id, title, author, year, identifier, pinned)``; a
    pinned address wins over a remembered one, a failed search is trusted for seven
    days, and only the rest is matched against ``candidates`` (with ``url``).
    """
    remembered = links.select("book_id", F.col("url").alias("_url"), "resolved_at")
    known = entries.join(remembered, "book_id", "left").withColumn(
        "how",
        F.when(F.col("pinned").isNotNull(), "pinned")
        .when(F.col("_url").isNotNull(), "remembered")
        .when(now - F.col("resolved_at") < F.expr("INTERVAL 7 DAYS"), "waiting")
        .otherwise("searched"),
    )
    searched = known.filter("how = 'searched'")
    scored = scored_pairs(
        searched.select("query_id", "title", "author", "year", "identifier"),
        candidates.join(searched.select("query_id"), "query_id", "left_semi"),
    )
    two = best_two(scored, ["query_id"])
    has_author = F.coalesce(F.length("author") > 0, F.lit(False))
    judged = (
        searched.select("query_id", "book_id", "title", "author")
        .join(two, "query_id", "left")
        .withColumn("_a", confidence(F.col("best"), has_author, tied(F.col("best"), F.col("second"))))
        .select("query_id", "book_id", "title", "author", "_a.confidence", "_a.reason",
                F.col("best.c_rank").alias("rank"))
    )
    places = candidates.select(
        "query_id", "rank", F.col("title").alias("matched_title"),
        F.col("author").alias("matched_author"), F.col("url").alias("found_url"),
    )
    matched = judged.join(places, ["query_id", "rank"], "left")
    outcome = (
        F.when(F.col("confidence") == AUTO_ACCEPT, "linked")
        .when(F.col("confidence") == PROVISIONAL, "unsure").otherwise("not_found")
    )
    new = matched.select(
        "book_id", outcome.alias("outcome"),
        F.when(F.col("confidence") == AUTO_ACCEPT, F.col("found_url")).alias("url"),
        F.when(F.col("confidence") != NO_MATCH, F.col("matched_title")).alias("matched_title"),
        "reason", F.lit("searched").alias("how"),
    )
    kept = known.filter("how <> 'searched'").select(
        "book_id",
        F.when(F.col("how") == "waiting", "not_found").otherwise("linked").alias("outcome"),
        F.coalesce("pinned", "_url").alias("url"),
        F.lit(None).cast("string").alias("matched_title"),
        F.lit(None).cast("string").alias("reason"), "how",
    )
    attention = matched.filter(F.col("confidence") == PROVISIONAL).select(
        F.col("title").alias("entry_title"), F.col("author").alias("entry_author"), "reason",
        F.col("matched_title").alias("best_guess"), F.col("found_url").alias("best_guess_url"),
    )
    return kept.unionByName(new), attention


def resolve_numbers(
    numbers: DataFrame, links: DataFrame, sources: DataFrame, items: DataFrame
) -> DataFrame:
    """Old product-number dismissals with a status: known, paused, no source, no item or new.

    ``sources(source, enabled)``; ``items(source, source_item_id, …)`` is what the
    sources know. Numbers already linked need no question, even at a paused source.
    """
    known = links.filter("source_item_id is not null").groupBy("source", "source_item_id").agg(
        F.min("book_id").alias("book_id")
    )
    there = items.select("source", "source_item_id", F.lit(True).alias("_item")).distinct()
    return (
        numbers.join(known, ["source", "source_item_id"], "left")
        .join(sources, "source", "left")
        .join(there, ["source", "source_item_id"], "left")
        .withColumn(
            "status",
            F.when(F.col("book_id").isNotNull(), "known")
            .when(~F.col("enabled"), "paused")
            .when(F.col("enabled").isNull(), "no source")
            .when(F.col("_item").isNull(), "no item")
            .otherwise("new"),
        )
        .drop("_item", "enabled")
    )


def missing_relations(books: DataFrame, relations: DataFrame, kinds: list[str]) -> DataFrame:
    """Relation rows to add; an existing row, even an inactive one, stays untouched."""
    wanted = books.select("profile_slug", "book_id").distinct().withColumn(
        "kind", F.explode(F.array(*[F.lit(k) for k in kinds]))
    )
    return wanted.join(relations, ["profile_slug", "book_id", "kind"], "left_anti")
