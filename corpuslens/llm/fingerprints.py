"""I-Match document fingerprints over several randomised lexicons.

Terms whose inverse document frequency lies in a band make the lexicon. A text's distinct terms from
the lexicon are sorted, and for each of several random subsets of the lexicon those that belong to
the subset are hashed together. Two texts are alike to the share of equal subset hashes, of the
subsets from which either has a term. Every subset is a chain of nested ones, each half as large as the
one before it, and a text takes the link that holds about one of its terms, so a long text's subsets
outlast as large an edit as a short one's. It keeps ``FURTHER`` smaller links too, and two
texts are compared at the first link that both have; those without one differ in terms by a factor of about
ten and are not alike.

All of it is column expressions. The lexicon is a bounded table: where the band holds more than
``LEXICON_TERMS`` terms, its rare end is raised until it does not. It goes with the plan as a constant
array of small buckets, so that looking up a term is two steps inside the row and texts meet no join.

Results: one row per row. Null and empty texts count as ''. A text without a term of the lexicon gets
a hash of the whole text as its fingerprint, so only equal ones of these are alike. The document after
a row is the next one by (id, text), after the last the first; a table of one row is its own next.
Rows with a null id come before all others and are no row's first.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from corpuslens.plans.storage import stored

LEAST_IDF, MOST_IDF = 1.5, 7.0
LEXICON_TERMS = 32_768
#: Chains of nested subsets, the first link that texts take and the last; a link is half of the one before it.
#: The links before the first would let one new term touch every subset of a very short text.
SUBSETS, LEAST_LINK, LINKS = 32, 3, 30
#: Further links a text keeps, to be compared with texts of more terms.
FURTHER = 3
ROWS_PER_PART, MOST_PARTS = 4_000, 50_000


def terms(text: Column) -> Column:
    """Ids of the distinct words of a text (the hash of each); '' is no word but has an id."""
    words = F.array_distinct(F.split(F.lower(text), r"[^\p{L}\p{N}]+"))
    return F.transform(words, lambda w: F.xxhash64(w))


def build_lexicon(docs: DataFrame, text: str = "text") -> DataFrame:
    """(term) of the band; counts cover every row. At most about ``LEXICON_TERMS`` rows."""
    n = docs.count()
    rare, common = n * math.exp(-MOST_IDF), n * math.exp(-LEAST_IDF)
    found = docs.select(F.explode(terms(F.coalesce(text, F.lit("")))).alias("term"))
    counted = found.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    empty = F.xxhash64(F.lit(""))
    band = stored(
        counted.where(F.col("n").between(max(rare, 1.0), max(common, 1.0)) & (F.col("term") != empty))
    )
    size = band.count()
    if size > LEXICON_TERMS:
        share = 1 - LEXICON_TERMS / size
        least = band.agg(F.percentile_approx("n", share, 10_000)).first()[0]
        band = band.where(F.col("n") > least)
    return band.select("term")


def buckets(lexicon: DataFrame) -> tuple[Column, int]:
    """(the lexicon as a constant array of small arrays, their number); a term's hash tells which."""
    count = 1 << max(lexicon.count() - 1, 0).bit_length()
    place = F.pmod("term", F.lit(count)).alias("place")
    filled = lexicon.groupBy(place).agg(F.collect_list("term").alias("terms"))
    places = lexicon.sparkSession.range(count).withColumnRenamed("id", "place")
    rows = places.join(filled, "place", "left").select(
        F.struct("place", F.coalesce("terms", F.array().cast("array<bigint>")).alias("terms")).alias("b")
    )
    packed = F.transform(F.sort_array(F.collect_list("b")), lambda b: b["terms"])
    written = rows.agg(F.to_json(packed)).first()[0]
    return F.from_json(F.lit(written), "array<array<bigint>>"), count


def parts(text: Column, table: Column, count: int) -> tuple[Column, ...]:
    """(sorted terms of a text, link, terms by subset, (link, own hashes, hashes by link)), each from those before;
    a hash is null without a term of the subset."""
    known = F.sort_array(
        F.filter(terms(text), lambda t: F.array_contains(F.get(table, F.pmod(t, F.lit(count)).cast("int")), t))
    )
    size = F.size("known")
    # the power of two nearest to the number of terms, so that a link holds one or a little more or less
    nearest = F.when(size > 0, F.round(F.log2(size.cast("double"))).cast("int")).otherwise(0)
    link = F.greatest(nearest, F.lit(LEAST_LINK))

    def chosen(among: Column, k: Column, level: Column) -> Column:
        limit = F.call_function("shiftright", F.lit(1 << LINKS), F.least(level, F.lit(LINKS)))
        return F.filter(among, lambda t: F.xxhash64(t, k).bitwiseAND((1 << LINKS) - 1) < limit)

    def hash_of(found: Column) -> Column:
        return F.when(F.size(found) > 0, F.xxhash64(found))

    own = F.transform(
        F.sequence(F.lit(0), F.lit(SUBSETS - 1)), lambda k: chosen(F.col("known"), k, F.col("link"))
    )
    further = [
        F.transform(F.col("own"), lambda found, k: hash_of(chosen(found, k, F.col("link") + d)))
        for d in range(1, FURTHER + 1)
    ]
    own_hashes = F.transform(F.col("own"), hash_of)
    hashes = F.struct(F.col("link"), own_hashes.alias("own"), F.array(own_hashes, *further).alias("links"))
    return known, link, own, hashes


def with_parts(rows: DataFrame, text: str, name: str, table: Column, count: int) -> DataFrame:
    known, link, own, hashes = parts(F.col(text), table, count)
    found = rows.withColumn("known", known).withColumn("link", link).withColumn("own", own)
    return found.withColumn(name, hashes).drop("known", "link", "own")


def fingerprint(hashes: Column, text: Column) -> Column:
    own = hashes["own"]
    written = F.array_join(F.transform(own, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "", "-")
    return F.when(F.exists(own, lambda h: h.isNotNull()), written).otherwise(F.md5(text))


def likeness(mine: Column, others: Column, left: Column, right: Column) -> Column:
    """Share of equal hashes among the subsets that either has; 1 for equal fingerprints."""

    def at(side: Column, link: Column) -> Column:
        return F.get(side["links"], link - side["link"])

    link = F.greatest(mine["link"], others["link"])
    pairs = F.arrays_zip(at(mine, link).alias("a"), at(others, link).alias("b"))
    equal = F.size(F.filter(pairs, lambda p: p["a"] == p["b"]))
    either = F.size(F.filter(pairs, lambda p: p["a"].isNotNull() | p["b"].isNotNull()))
    common = F.abs(mine["link"] - others["link"]) <= FURTHER
    share = F.when(common & (either > 0), equal / either).otherwise(0.0)
    return F.when(left == right, 1.0).otherwise(share)


def numbers(df: DataFrame, column: str) -> list[int]:
    """First ids of stretches of about ``ROWS_PER_PART`` rows; the first is the least id."""
    row = df.agg(F.count(column).alias("n"), F.min(column).alias("least")).first()
    if not row["n"]:
        return []
    count = min(-(-row["n"] // ROWS_PER_PART), MOST_PARTS)
    shares = [i / count for i in range(1, count)]
    cuts = df.agg(F.percentile_approx(column, shares, 8 * count)).first()[0] if shares else []
    return sorted({row["least"], *cuts})


def stretch(value: Column, firsts: list[int]) -> Column:
    """The number of the stretch an id falls into, found in two steps."""
    if not firsts:
        return F.lit(0)
    width = math.isqrt(len(firsts) - 1) + 1
    rows = [firsts[i : i + width] for i in range(0, len(firsts), width)]

    def upto(array: Column) -> Column:
        return F.size(F.filter(array, lambda first: first <= value))

    heads = F.array(*[F.lit(row[0]).cast("bigint") for row in rows])
    inner = F.array(*[F.array(*[F.lit(x).cast("bigint") for x in row]) for row in rows])
    row = F.greatest(upto(heads) - 1, F.lit(0))
    return F.greatest(row * width + upto(F.get(inner, row)) - 1, F.lit(0))


def with_next(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Add ``next_<column>`` from the following row by (key, first column), after the last the first.

    Rows are dealt by stretches of ids. The rows that open a stretch also go, marked as guests, to
    the stretch before it, so one shuffle brings every row together with its follower.
    """
    firsts = numbers(rows, key)
    own = stretch(F.col(key), firsts)
    opens = F.col(key).isin(firsts) if len(firsts) <= 16 else F.array_contains(
        F.array(*[F.lit(x).cast("bigint") for x in firsts]), F.col(key).cast("bigint")
    )
    before = F.pmod(own - 1, F.lit(max(len(firsts), 1)))
    guest = F.struct(before.cast("int").alias("part"), F.lit(1).alias("guest"))
    self = F.struct(own.cast("int").alias("part"), F.lit(0).alias("guest"))
    spread = F.explode(F.when(opens, F.array(self, guest)).otherwise(F.array(self)))
    dealt = rows.select("*", spread.alias("at")).select("*", "at.part", "at.guest").drop("at")
    order = Window.partitionBy("part").orderBy("wraps", F.asc_nulls_first(key), columns[0], "guest")
    # in the last stretch the guests are the least ids and come last
    wraps = F.when((F.col("guest") == 1) & (F.col("part") == max(len(firsts), 1) - 1), 1).otherwise(0)
    return (
        dealt.withColumn("wraps", wraps)
        .withColumns({f"next_{c}": F.lead(c).over(order) for c in columns})
        .where(F.col("guest") == 0)
        .drop("part", "guest", "wraps")
    )


def edited_text(text: Column, following: Column) -> Column:
    """The last quarter of the characters gives way to as many first ones of the next document."""
    size = F.length(text)
    cut = F.floor(size / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), size - cut), F.substring(following, F.lit(1), cut))


def fingerprint_documents(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text, fingerprint): the general form, for any table of texts."""
    rows = docs.select(F.col(key).alias("key"), F.coalesce(text, F.lit("")).alias("text"))
    table, count = buckets(build_lexicon(rows))
    found = with_parts(rows, "text", "hashes", table, count)
    print_ = fingerprint(F.col("hashes"), F.col("text"))
    return found.select(F.col("key").alias(key), "text", print_.alias("fingerprint"))


def compare_edits(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)."""
    rows = docs.select(F.col(key).alias("key"), F.coalesce(text, F.lit("")).alias("text"))
    table, count = buckets(build_lexicon(rows))
    hashed = with_parts(rows, "text", "hashes", table, count)
    beside = with_next(hashed, "key", ["text", "hashes"])
    edited = beside.select(
        "key",
        F.length("text").cast("bigint").alias("n_chars"),
        edited_text(F.col("text"), F.coalesce("next_text", F.lit(""))).alias("edited"),
        "hashes",
        fingerprint(F.col("hashes"), F.col("text")).alias("fingerprint"),
        F.col("next_hashes"),
        fingerprint(F.col("next_hashes"), F.col("next_text")).alias("next_fingerprint"),
    )
    found = with_parts(edited, "edited", "edited_hashes", table, count)
    printed = found.withColumn("edited_fingerprint", fingerprint(F.col("edited_hashes"), F.col("edited")))
    mine, changed, other = F.col("hashes"), F.col("edited_hashes"), F.col("next_hashes")
    return printed.select(
        F.col("key").alias(key),
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        likeness(mine, changed, F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        F.coalesce(
            likeness(mine, other, F.col("fingerprint"), F.col("next_fingerprint")), F.lit(0.0)
        ).alias("near_next"),
    )
