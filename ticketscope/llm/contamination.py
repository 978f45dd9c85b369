"""Benchmark decontamination through a distributed positional inverted index.

The items of a benchmark are cut into windows of consecutive words. For every window the two terms that are rarest in
the training documents are looked up: the index holds the postings (document, position) of just those terms, shifted
by the term's offset so that both lists speak of the window's start. Where the two lists agree (or, for proximity,
lie within a given distance) the window is a candidate; an exact phrase match is then compared word by word. A window
with a term that no document holds cannot match and is dropped at once.

Documents are known by the digest of their text, so copies share postings, and null or repeated ids do no harm. Null
and empty texts have no words and match nothing. An item shorter than a window is one window; an item without words
is none. Items with equal texts all count; an item without an id is named by the empty string. Empty tables give empty or clean results. Further columns are not read.

Only DataFrame functions run here.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ticketscope.llm.storage import scratch, small, stored

WINDOW = 10
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_BETWEEN_ANY_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def parts(text: Column) -> Column:
    """The lower-cased text cut between words; the first and last part may be empty, all others are words.

    Only A-Z are lowered, which for a text without characters beyond ASCII is what the faster `lower` does.
    """
    text = F.coalesce(text.cast("string"), F.lit(""))
    plain = F.octet_length(text) == F.char_length(text)
    return F.split(F.when(plain, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER)), _BETWEEN)


def words(text: Column) -> Column:
    """Lower-cased words: digits, letters and all characters beyond ASCII; null has none."""
    return F.filter(parts(text), lambda w: w != "")


def word_count(text: Column) -> Column:
    whole = F.split(F.coalesce(text.cast("string"), F.lit("")), _BETWEEN_ANY_CASE)
    return F.size(F.filter(whole, lambda w: w != "")).cast("long")


def text_key(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text.cast("string"), F.lit(""))))


def windows(items: DataFrame, item_id: str = "item_id", text: str = "text", width: int = WINDOW) -> DataFrame:
    """(item_id, phrase) of all windows; the words of a phrase are parted by spaces."""
    cut = items.select(items[item_id].alias("item_id"), words(items[text]).alias("words")).filter(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("words") - F.lit(width - 1)))
    phrases = F.transform(starts, lambda i: F.array_join(F.slice("words", i, F.lit(width)), " "))
    return cut.select("item_id", F.explode(phrases).alias("phrase")).distinct()


def anchors(docs: DataFrame, phrases: DataFrame, text: str = "text", count: int = 2) -> DataFrame:
    """(phrase, term, offset, rank): the `count` rarest terms of each phrase whose terms all occur in the documents."""
    places = stored(phrases.select("phrase", F.posexplode(F.split("phrase", " ")).alias("offset", "term")), "places")
    vocabulary = stored(places.select("term").distinct(), "vocabulary")
    seen = docs.select(F.explode(parts(docs[text])).alias("term")).join(small(vocabulary), "term")
    frequencies = stored(seen.groupBy("term").agg(F.count(F.lit(1)).alias("df")), "frequencies")
    known = places.join(frequencies, "term")
    rarest = Window.partitionBy("phrase").orderBy("df", "offset")
    ranked = known.select("phrase", "term", "offset", F.row_number().over(rarest).alias("rank"), F.count(F.lit(1)).over(Window.partitionBy("phrase")).alias("known"))
    whole = F.col("known") == F.size(F.split("phrase", " "))
    ranked = ranked.withColumn("id", F.xxhash64("phrase"))
    return stored(ranked.filter(whole & (F.col("rank") <= count)).drop("known"), "anchors")


def postings(docs: DataFrame, terms: DataFrame, text: str = "text") -> DataFrame:
    """The positional index of the given terms: (term, key, position), kept in the shared folder."""
    spread = docs.select(text_key(docs[text]).alias("key"), F.posexplode(parts(docs[text])).alias("position", "term"))
    return stored(spread.join(small(terms), "term").select("term", "key", "position").distinct(), "postings")


def candidates(index: DataFrame, chosen: DataFrame, slop: int = 0) -> DataFrame:
    """(id, key, start, shift): where the offset-adjusted lists of a phrase's rarest terms agree; id is its hash.

    `shift` is how far the second list is off, at most `slop` words. Starts fall into blocks of slop + 1 words, and the
    second list is entered in its own block and its two neighbours, so equal keys are all a join needs.
    """
    places = chosen.select("term", "id", "offset", "rank", (F.instr("phrase", " ") == 0).alias("alone"))
    starts = index.join(small(places), "term").withColumn("start", F.col("position") - F.col("offset"))
    block = F.floor(F.col("start") / (slop + 1)).cast("int")
    first = starts.filter("rank = 1").select("id", "key", "start", block.alias("block"), "alone")
    near = F.array(*((block + d) for d in ((0,) if slop == 0 else (-1, 0, 1))))
    second = starts.filter("rank = 2").select("id", "key", F.col("start").alias("other"), F.explode(near).alias("block"))
    met = first.join(second, ["id", "key", "block"]).withColumn("shift", F.col("other") - F.col("start"))
    both = met.filter(F.abs("shift") <= slop).select("id", "key", "start", "shift")
    return both.unionByName(first.filter("alone").select("id", "key", "start", F.lit(0).alias("shift")))


def exact_matches(docs: DataFrame, found: DataFrame, phrases: DataFrame, text: str = "text") -> DataFrame:
    """(key, start, width, phrase) of the candidates that the document holds word by word."""
    named = stored(phrases.select("phrase", F.xxhash64("phrase").alias("id")), "phrases")
    wanted = found.filter("shift = 0 and start >= 0").join(named, "id")
    wanted = stored(wanted.groupBy("key").agg(F.collect_list(F.struct("start", "phrase")).alias("wanted")), "wanted")
    texts = docs.select(text_key(docs[text]).alias("key"), docs[text].alias("text"))
    # Only documents with candidates are shuffled to meet them.
    near = texts.join(small(wanted.select("key")), "key", "left_semi")
    held = near.join(wanted, "key").groupBy("key").agg(F.first("text").alias("text"), F.first("wanted").alias("wanted"))
    split = held.select("key", parts(F.col("text")).alias("words"), "wanted")
    width = lambda w: F.size(F.split(w.phrase, " "))
    right = F.filter("wanted", lambda w: F.array_join(F.slice("words", w.start + 1, width(w)), " ") == w.phrase)
    return split.select("key", F.inline(F.transform(right, lambda w: F.struct(w.start.alias("start"), width(w).alias("width"), w.phrase.alias("phrase")))))


def matches(docs: DataFrame, items: DataFrame, width: int = WINDOW, item_id: str = "item_id", item_text: str = "text", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """All exact window matches (key, start, width, phrase), and the windows (item_id, phrase) they come from."""
    with scratch(docs.sparkSession):
        cut = stored(windows(items, item_id, item_text, width), "windows", result=True)
        phrases = cut.select("phrase").distinct()
        chosen = anchors(docs, phrases, text)
        index = postings(docs, chosen.select("term").distinct(), text)
        return stored(exact_matches(docs, candidates(index, chosen), phrases, text), "matches", result=True), cut


def proximity_matches(docs: DataFrame, items: DataFrame, slop: int, width: int = WINDOW, item_id: str = "item_id", item_text: str = "text", text: str = "text") -> DataFrame:
    """(item_id, phrase, key, start, shift): the two rarest terms of a window stand at most `slop` words out of place."""
    cut = stored(windows(items, item_id, item_text, width), "windows")
    chosen = anchors(docs, cut.select("phrase").distinct(), text)
    index = postings(docs, chosen.select("term").distinct(), text)
    named = cut.withColumn("id", F.xxhash64("phrase"))
    return candidates(index, chosen, slop).distinct().join(named, "id").select("item_id", "phrase", "key", "start", "shift")


def report(docs: DataFrame, items: DataFrame, width: int = WINDOW, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per document: words, words inside matches, and the items whose windows occur."""
    found, cut = matches(docs, items, width, item_id, item_text, text)
    covered = F.aggregate(
        F.sort_array(F.collect_list(F.struct("start", "width"))),
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("hit")),
        lambda s, m: F.struct(
            F.greatest(s.end, m.start + m.width).alias("end"),
            (s.hit + F.greatest(F.lit(0), m.start + m.width - F.greatest(s.end, m.start))).alias("hit"),
        ),
        lambda s: s.hit,
    )
    hits = found.groupBy("key").agg(covered.alias("n_hit"))
    named = found.select("key", "phrase").distinct().join(cut, "phrase").select("key", F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item")).distinct()
    items_of = named.groupBy("key").agg(F.sort_array(F.collect_list("item")).alias("items"))
    per_text = hits.join(items_of, "key", "left")
    all_docs = docs.select(docs[doc_id].alias("doc_id"), text_key(docs[text]).alias("key"), word_count(docs[text]).alias("n_words"))
    joined = all_docs.join(per_text, "key", "left")
    n_hit, items_found = F.coalesce("n_hit", F.lit(0).cast("long")), F.coalesce("items", F.array().cast("array<string>"))
    return joined.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size(items_found).cast("long").alias("n_items"),
        F.sha2(F.array_join(items_found, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def keep_clean(docs: DataFrame, items: DataFrame, text: str = "text", **settings) -> DataFrame:
    """The documents without any match, with all their columns."""
    found, _ = matches(docs, items, text=text, **settings)
    bad = stored(found.select(F.col("key").alias("__key")).distinct(), "contaminated")
    return docs.join(small(bad), text_key(docs[text]) == F.col("__key"), "left_anti")
