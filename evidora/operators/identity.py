"""Names and attribution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Accented letters of European names, and their plain ones.
FROM = "àáâãäåāăąçćčďđèéêëēęěğìíîïīłñńňòóôõöøőŕřśşšťţùúûüūůűýÿźżž"
TO = "aaaaaaaaacccddeeeeeeegiiiiilnnnooooooorrsssttuuuuuuuyyzzz"


def plain(name: Column) -> Column:
    """A name in lower case, without accents and punctuation, single spaces."""
    return F.trim(F.regexp_replace(F.translate(F.lower(name), FROM, TO), "[^a-z0-9]+", " "))


def words_of(name: Column) -> Column:
    return F.filter(F.split(plain(name), " "), lambda x: x != "")


def coauthor_keys(name: Column) -> Column:
    """Both readings of a name's order: last|first initial and first|last
    initial, of its plain words; a single word is its own key."""
    w = words_of(name)
    last, first = F.try_element_at(w, F.lit(-1)), F.try_element_at(w, F.lit(1))
    both = F.array(F.concat(last, F.lit("|"), F.substring(first, 1, 1)), F.concat(first, F.lit("|"), F.substring(last, 1, 1)))
    return F.when(F.size(w) >= 2, F.array_distinct(both)).when(F.size(w) == 1, w).otherwise(F.array().cast("array<string>"))


def surname_forms(surname: Column, aliases: Column | None = None) -> Column:
    """The plain forms of a surname and its aliases; a form may have several words."""
    every = F.array(surname) if aliases is None else F.concat(F.array(surname), F.coalesce(aliases, F.array().cast("array<string>")))
    return F.array_distinct(F.filter(F.transform(every, plain), lambda f: f.isNotNull() & (f != "")))


def names_match(author: Column, forms: Column, initials: Column) -> Column:
    """Whether an author string can be a person: one of the surname forms stands
    in it as whole words, and the first letters of the other words, together,
    and one of the initials begin alike. Without other words the surname is
    enough only if no initials are declared; with them, initials have to be."""
    w = words_of(author)
    known = F.filter(F.transform(F.coalesce(initials, F.array().cast("array<string>")), lambda i: F.replace(plain(i), F.lit(" "), F.lit(""))), lambda i: i != "")

    def stands(form: Column, at: Column) -> Column:
        n = F.size(F.split(form, " "))
        before, behind = F.slice(w, F.lit(1), at - 1), F.slice(w, at + n, F.greatest(F.size(w) - at - n + 1, F.lit(0)))
        first = F.array_join(F.transform(F.concat(before, behind), lambda x: F.substring(x, 1, 1)), "")
        fits = F.when(first == "", F.size(known) == 0).otherwise(F.exists(known, lambda i: first.startswith(i) | i.startswith(first)))
        return (F.array_join(F.slice(w, at, n), " ") == form) & fits

    places = F.when(F.size(w) > 0, F.sequence(F.lit(1), F.size(w))).otherwise(F.array().cast("array<int>"))
    return F.exists(forms, lambda f: F.exists(places, lambda at: stands(f, at)))


def attribute(seats: DataFrame, documents: DataFrame, known: DataFrame | None = None, least: int = 2) -> DataFrame:
    """(name, doc_id, state, shared): the documents under a seat's topics, with
    what became of each. ``seats`` has (name, forms, initials, own_topics,
    ambiguous), ``documents`` (doc_id, authors, topics), ``known`` (name, key)
    the co-author keys of each seat's verified work.

    state: accepted, name_absent (no author matches), or, for a seat whose name
    is ambiguous, few_shared: fewer than ``least`` other authors are known to
    it. People count, not keys. Candidates come from the join on topics, so a
    seat meets only its own field; a seat without a surname has none.
    """
    who = seats.where(F.size("forms") > 0).select("name", "forms", "initials", "ambiguous", F.explode(F.array_distinct("own_topics")).alias("topic"))
    held = documents.select("doc_id", F.array_distinct(F.coalesce("authors", F.array().cast("array<string>"))).alias("authors"), F.explode(F.array_distinct("topics")).alias("topic"))
    met = held.join(who, "topic").dropDuplicates(["name", "doc_id"])
    met = met.withColumn("mine", F.filter("authors", lambda a: names_match(a, F.col("forms"), F.col("initials")))).withColumn("others", F.array_except("authors", "mine"))
    if known is None:
        met = met.withColumn("shared", F.lit(0).cast("bigint"))
    else:
        each = met.where("ambiguous and size(mine) > 0").select("name", "doc_id", F.explode("others").alias("author")).withColumn("key", F.explode(coauthor_keys(F.col("author"))))
        n = each.join(known.select("name", "key").distinct(), ["name", "key"], "left_semi").groupBy("name", "doc_id").agg(F.count_distinct("author").alias("shared"))
        met = met.join(n, ["name", "doc_id"], "left").fillna(0, ["shared"])
    state = F.when(F.size("mine") == 0, "name_absent").when(F.col("ambiguous") & (F.col("shared") < least), "few_shared").otherwise("accepted")
    return met.select("name", "doc_id", state.alias("state"), "shared")


def given_names_conflict(a: Column, b: Column) -> Column:
    """Whether two names spell different given names out: the words before the
    last one are given names; one letter, or up to three that are the other's
    initials, is no given name."""
    x, y = words_of(a), words_of(b)
    one, two = F.slice(x, F.lit(1), F.greatest(F.size(x) - 1, F.lit(0))), F.slice(y, F.lit(1), F.greatest(F.size(y) - 1, F.lit(0)))
    first, second = F.try_element_at(one, F.lit(1)), F.try_element_at(two, F.lit(1))

    def short(word: Column, other: Column) -> Column:
        letters = F.array_join(F.transform(other, lambda w: F.substring(w, 1, 1)), "")
        return (F.length(word) == 1) | ((F.length(word) <= 3) & letters.startswith(word))

    return F.when((F.size(x) < 2) | (F.size(y) < 2), False).otherwise(~short(first, two) & ~short(second, one) & (first != second))


def resolve_author_ids(accepted: DataFrame, authorships: DataFrame, least: int = 2) -> DataFrame:
    """(name, author_id, n, conflict, accepted, hazard): author ids of an
    outside catalogue, counted over a seat's verified works. ``accepted`` has
    (name, display, forms, initials, work), ``authorships`` (work, author_id,
    author). An id is taken from ``least`` works on, unless it spells another
    given name; ``hazard`` marks seats with more than one taken id."""
    met = accepted.join(authorships, "work").where(names_match(F.col("author"), F.col("forms"), F.col("initials")))
    per = met.groupBy("name", "author_id").agg(F.count_distinct("work").alias("n"), F.bool_or(given_names_conflict(F.col("display"), F.col("author"))).alias("conflict"))
    per = per.withColumn("accepted", (F.col("n") >= least) & ~F.col("conflict"))
    return per.withColumn("hazard", F.count_if("accepted").over(Window.partitionBy("name")) > 1)


def coauthor_counts(authored: DataFrame) -> DataFrame:
    """(a, b, n_docs): how often two author keys share a document. Documents of
    more than 30 authors count as consortia and are left out, which bounds the
    pairs of a document."""
    keyed = authored.select("doc_id", F.try_element_at(coauthor_keys(F.col("author")), F.lit(1)).alias("k")).where("k is not null").distinct()
    few = keyed.groupBy("doc_id").agg(F.sort_array(F.collect_set("k")).alias("ks")).where(F.size("ks") <= 30)
    a = few.select("ks", F.posexplode("ks").alias("i", "a"))
    return a.select("a", F.explode(F.slice("ks", F.col("i") + 2, F.size("ks"))).alias("b")).groupBy("a", "b").agg(F.count("*").alias("n_docs"))


def full_name_key(name: Column) -> Column:
    """Sorted words of more than one letter; empty for fewer than two."""
    w = F.array_sort(F.filter(F.split(plain(name), " "), lambda x: F.length(x) > 1))
    return F.when(F.size(w) >= 2, F.array_join(w, " ")).otherwise("")


# Particles that belong to the surname behind them.
PARTICLES = ("van", "von", "der", "den", "de", "del", "della", "di", "da", "dos", "du", "la", "le", "ter", "ten", "bin", "al", "el")


def surname_of(author: Column) -> Column:
    """The surname in an author string: what stands before a comma; all but a
    last word of up to three capitals (initials); else the last word with the
    particles before it. Letters and digits only."""
    squeezed = F.regexp_replace(F.trim(F.coalesce(author, F.lit(""))), r"\s+", " ")
    w = F.split(squeezed, " ")
    last, rest = F.element_at(w, -1), F.slice(w, F.lit(1), F.greatest(F.size(w) - 1, F.lit(0)))
    named = F.regexp_extract(F.array_join(rest, " "), rf"(?i)(?:^|\s)((?:(?:{'|'.join(PARTICLES)})(?:\s|$))+)$", 1)
    initials = (F.size(w) > 1) & (F.length(last) <= 3) & (F.upper(last) == last)
    found = F.when(squeezed.contains(","), F.substring_index(squeezed, ",", 1)).when(initials, F.array_join(rest, " ")).otherwise(F.concat(named, F.lit(" "), last))
    return F.replace(plain(found), F.lit(" "), F.lit(""))


def document_id(first_author: Column, year: Column, venue: Column, fallback: Column | None = None) -> Column:
    """surname + year + the first twelve letters of the venue (na without one);
    without a year, surname + venue; without a surname, anon + year + ten
    places of the hash of the fallback, the venue or "unknown"."""
    surname, y = surname_of(first_author), F.coalesce(F.nullif(year, F.lit(0)).cast("string"), F.lit(""))
    token = F.coalesce(F.nullif(F.substring(F.replace(plain(F.coalesce(venue, F.lit(""))), F.lit(" "), F.lit("")), 1, 12), F.lit("")), F.lit("na"))
    seed = F.coalesce(*([F.nullif(fallback, F.lit(""))] if fallback is not None else []), F.nullif(venue, F.lit("")), F.lit("unknown"))
    return F.when(surname != "", F.concat(surname, y, token)).otherwise(F.concat(F.lit("anon"), y, F.substring(F.sha2(seed, 256), 1, 10)))


def disambiguated(rows: DataFrame, base: str, order: str) -> DataFrame:
    """Adds ``id``: ``base``, with the suffixes a to z, then v2 on, for the
    second and further rows of the same base in ``order``."""
    n = F.row_number().over(Window.partitionBy(base).orderBy(order))
    suffix = F.when(n == 1, "").when(n <= 27, F.chr(n + F.lit(95))).otherwise(F.concat(F.lit("v"), (n - 26).cast("string")))
    return rows.withColumn("id", F.concat(base, suffix))


def shard(doc_id: Column) -> Column:
    """The two characters under which a document is kept."""
    return F.substring(F.when(F.length(doc_id) < 2, F.concat(doc_id, F.lit("__"))).otherwise(doc_id), 1, 2)
