"""Benchmark decontamination by template canonicalisation.

Numbers (in digits or words), names and units become typed placeholders, so that a re-parameterised question has the windows
of its template. Names are known by their capitals, so a copy in other letters has other placeholders:
windows are taken with and without names, and a window is held in either form. Windows of canonical words
are hash-joined with those of the benchmark; a document that holds most of an item's windows is aligned with it, and each placeholder's values must map to the same
values throughout. Everything is DataFrame code: no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

WINDOW, SHARE, CONSISTENT = 5, 0.8, 0.8
#: Rows of a table of (hash) or of (id, hash) that is broadcast at most; larger ones are joined by shuffle.
BROADCAST_ROWS = 1_000_000


def any_of(words: list) -> str:
    """A pattern of these words (letters), branching letter by letter, with sets of letters before more than four branches.

    A list of words would be tried word for word at every place.
    """
    rest: dict = {}
    for w in words:
        if w:
            rest.setdefault(w[0], []).append(w[1:])

    def branches(letters: list) -> str:
        if len(letters) <= 4:
            return "|".join(c + any_of(rest[c]) for c in letters)
        half = len(letters) // 2
        return "|".join(f"(?=[{''.join(x)}])(?:{branches(x)})" for x in (letters[:half], letters[half:]))

    return f"(?:{branches(sorted(rest))})" + ("?" if "" in words else "") if rest else ""


NUMBER = r"[0-9]+(?:[.,:/-][0-9]+)*"
#: Units of measurement, as words of their own.
UNITS = "mm cm m km in ft yd mi mg g kg lb oz ml l gal s sec min h hr hrs kb mb gb tb hz khz mhz ghz w kw v a c f k usd eur gbp percent meters metres miles feet inches grams kilograms pounds ounces liters litres gallons seconds minutes hours days weeks months years dollars euros cents degrees"
UNIT = r"(?<![\p{L}\p{N}<>])" + any_of(UNITS.split()) + r"(?![\p{L}\p{N}<>])"
#: Numbers as words.
SPELLED = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion"
SPELLED_NUMBER = r"(?<![\p{L}\p{N}<>])" + any_of(SPELLED.split()) + r"(?![\p{L}\p{N}<>])"
NAME = r"(?<![\p{L}\p{N}<>])\p{Lu}\p{Ll}+(?![\p{L}\p{N}<>])"


def marked(text: Column) -> Column:
    """Text or word with placeholders for numbers and, after a number, units, and with marks around names; lower case, without punctuation.

    White space is neither made nor removed, so it may run on texts or on their words alike.
    """
    for mark in "\x01\x03":
        text = F.replace(text, F.lit(mark), F.lit("\x02"))
    text = F.regexp_replace(text, NAME, "\x01$0\x03")
    text = F.regexp_replace(text, NUMBER, "<num>")
    text = F.regexp_replace(F.regexp_replace(F.lower(text), UNIT, "<unit>"), SPELLED_NUMBER, "<num>")
    return F.regexp_replace(text, r"[^\p{L}\p{N}<>\x20\x09-\x0D\x01\x03]+", "")


def named(text: Column) -> Column:
    """Of a marked text: names as placeholders."""
    return F.regexp_replace(text, r"\x01[^\x03]*\x03", "<name>")


def unnamed(text: Column) -> Column:
    """Of a marked text: names as the words they are, whatever their capitals."""
    return F.replace(F.replace(text, F.lit("\x01"), F.lit("")), F.lit("\x03"), F.lit(""))


def canonical(text: Column) -> Column:
    return named(marked(text))


def split_words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))


def canonical_words(rows: DataFrame, text: Column) -> DataFrame:
    """`rows` and hashes of the words of a text in both forms, `words` and `plain`: one of each to a word."""
    rows = rows.withColumn("own", split_words(marked(F.coalesce(text, F.lit("")))))
    form = lambda of: F.transform("own", lambda w: F.xxhash64(F.when(F.contains(w, F.lit("\x01")), of(w)).otherwise(w)))
    return rows.withColumn("words", form(named)).withColumn("plain", form(unnamed)).drop("own")


def windows(words: Column, plain: Column, width: int = WINDOW) -> Column:
    """Array of (position, hash, plain hash) of the windows of words in both forms; fewer words than a window are one, none has none."""
    of = lambda x, i: F.xxhash64(F.get(x, i), *(F.get(x, i + k) for k in range(1, width)))
    at = lambda _, i: F.struct(i.alias("pos"), of(words, i).alias("hash"), of(plain, i).alias("plain"))
    return F.transform(F.slice(words, 1, F.greatest(F.size(words) - (width - 1), F.lit(1))), at)


def forms(rows: DataFrame, *keep: str) -> DataFrame:
    """`keep`, pos, window (the hash with placeholders for names) and hash of the windows of `rows` in either form; a form equal to the other is left out."""
    rows = rows.select(*keep, F.explode(windows(F.col("words"), F.col("plain"))).alias("w")).select(*keep, "w.pos", F.col("w.hash").alias("window"), "w.plain")
    return rows.select(*keep, "pos", "window", F.explode(F.when(F.col("plain") == F.col("window"), F.array("window")).otherwise(F.array("window", "plain"))).alias("hash"))


def aligned_words(text: Column) -> Column:
    """Array of (canonical, original) of the words whose canonical form is not empty."""
    own = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    return F.filter(F.transform(own, lambda w: F.struct(canonical(w).alias("canon"), F.lower(w).alias("word"))), lambda x: x["canon"] != "")


def join_small(left: DataFrame, right: DataFrame, rows: int, on, how: str) -> DataFrame:
    return left.join(F.broadcast(right) if rows <= BROADCAST_ROWS else right, on, how)


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", share: float = SHARE, consistent: float = CONSISTENT) -> DataFrame:
    """(id, item_id, n_windows, item_windows, n_slots, consistency, exact, text_hash): a row for each document and item that it holds.

    A document holds an item if it has at least `share` of the item's distinct windows, each with
    placeholders for names or with its words in any case, and, aligned at the
    most frequent offset, at least `consistent` of the item's placeholders keep one value each, and no two the same. exact: all
    placeholders have the item's own values. Null and empty texts hold nothing and are held by nothing;
    items of fewer than WINDOW words match documents of exactly their words. Equal items each get their
    rows; repeated documents are found by (id, text_hash) and get one row. Empty tables give no rows.
    """
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    d = d.withColumn("text_hash", F.xxhash64("text"))
    bench = items.where(F.col(item_text_col).isNotNull()).select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text"))
    bench = cut(canonical_words(bench, F.col("text")))
    own = cut(forms(bench, "item_id").groupBy("item_id", "window", "hash").agg(F.min("pos").alias("ipos")))
    hashes = own.select("hash").distinct()
    n = hashes.count()
    each = forms(canonical_words(d, F.col("text")), "doc_id", "text_hash").select("doc_id", "text_hash", "pos", "hash")
    hits = cut(join_small(each, hashes, n, "hash", "left_semi"))
    totals = own.select("item_id", "window").distinct().groupBy("item_id").agg(F.count("*").alias("item_windows"))
    held = hits.select("doc_id", "text_hash", "hash").distinct().join(own.select("item_id", "window", "hash"), "hash").select("doc_id", "text_hash", "item_id", "window").distinct()
    held = held.groupBy("doc_id", "text_hash", "item_id").agg(F.count("*").alias("n_windows"))
    found = cut(held.join(totals, "item_id").where(F.col("n_windows") >= share * F.col("item_windows")))
    m = found.count()
    keys = ["doc_id", "text_hash", "item_id"]
    f, h = found.alias("f"), hits.alias("h")
    same = F.col("h.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("h.text_hash") == F.col("f.text_hash"))
    offsets = h.join(f, same).select("f.doc_id", "f.text_hash", "f.item_id", "h.pos", "h.hash").join(own.groupBy("item_id", "hash").agg(F.min("ipos").alias("ipos")), ["item_id", "hash"])
    offsets = offsets.groupBy(*keys, (F.col("pos") - F.col("ipos")).alias("offset")).agg(F.count("*").alias("k"))
    best = offsets.groupBy(*keys).agg(F.max(F.struct("k", (-F.col("offset")).alias("back"))).alias("b")).select(*keys, (-F.col("b.back")).alias("offset"))
    marked = d.alias("d")
    b = best.alias("b")
    pair = F.col("d.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("d.text_hash") == F.col("b.text_hash"))
    texts = join_small(marked, b, m, pair, "inner").select("b.doc_id", "b.text_hash", "b.item_id", "b.offset", aligned_words(F.col("d.text")).alias("have")).dropDuplicates(keys)
    want = bench.select("item_id", aligned_words(F.col("text")).alias("want"))
    both = texts.join(want.dropDuplicates(["item_id"]), "item_id")
    slots = F.filter(F.transform("want", lambda x, i: F.struct(x["canon"].alias("canon"), x["word"].alias("was"), F.get("have", i + F.col("offset")).alias("now"))), lambda s: s["canon"].rlike("<num>|<name>|<unit>") & ((s["now"]["canon"] == s["canon"]) | (s["now"]["word"] == s["was"])))
    slot = both.select(*keys, F.explode_outer(slots).alias("s")).select(*keys, F.col("s.was").alias("was"), F.col("s.now.word").alias("now"))
    pairs = slot.groupBy(*keys, "was", "now").agg(F.count("was").alias("k"))
    # a pair of values counts if each is the other's most frequent one, so that two names do not both become a third
    first = lambda one, other: F.row_number().over(Window.partitionBy(*keys, one).orderBy(F.desc("k"), F.col(one) != F.col(other), other)) == 1
    pairs = pairs.withColumn("good", first("was", "now") & first("now", "was"))
    judged = pairs.groupBy(*keys).agg(F.sum("k").alias("n_slots"), F.sum(F.when(F.col("good"), F.col("k")).otherwise(0)).alias("most"), F.bool_and(F.coalesce(F.col("was") == F.col("now"), F.lit(True))).alias("exact"))
    judged = judged.withColumn("consistency", F.when(F.col("n_slots") > 0, F.col("most") / F.col("n_slots")).otherwise(F.lit(1.0))).where(F.col("consistency") >= consistent)
    j = judged.alias("j")
    on = F.col("j.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("j.text_hash") == F.col("f.text_hash")) & (F.col("j.item_id") == F.col("f.item_id"))
    return f.join(j, on).select(F.col("f.doc_id").alias(id_col), F.col("f.item_id").alias(item_col), "f.n_windows", "f.item_windows", "j.n_slots", "j.consistency", "j.exact", "f.text_hash")


def clean_documents(docs: DataFrame, items: DataFrame, share: float = SHARE, consistent: float = CONSISTENT) -> DataFrame:
    """`docs` without those that hold a benchmark item."""
    bad = cut(contamination(docs, items, share=share, consistent=consistent).select(F.col("doc_id").alias("bad_id"), F.col("text_hash").alias("bad_hash")).distinct())
    return join_small(docs, bad, bad.count(), docs.doc_id.eqNullSafe(bad.bad_id) & (F.xxhash64(docs.text) == bad.bad_hash), "left_anti")
