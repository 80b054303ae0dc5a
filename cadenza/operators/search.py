"""Lookup of songs by several terms in order, over an inverted index of their words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.sources.shared import stored

#: Fields of a song whose words are found.
FIELDS = ("id", "title", "path", "album", "artist")
#: A term with at most so many rows or songs is met by comparing each of its rows with each of its songs.
FEW = 32
WORD = r"[\p{L}\p{N}]+"


def words_of(text: Column) -> Column:
    """The different runs of letters and digits of a text, in lower case."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != ""))


def _pieces(hits: DataFrame, needles: DataFrame) -> DataFrame:
    """(term, needle, song_id): the first song of each term that has a text of letters and digits in its haystack.

    Such a text lies within a run of the characters that `needles` (needle) are made of, so the parts of these runs are taken
    which are as long as a needle: their number follows from the songs, not from songs times rows.
    """
    known = needles.select(F.length("needle").alias("n"), F.split("needle", "").alias("c"))
    known = known.agg(F.collect_set("n").alias("lengths"), F.array_join(F.array_distinct(F.flatten(F.collect_set("c"))), "").alias("letters"))
    other = F.concat(F.lit("[^"), F.col("letters"), F.lit("]+"))
    runs = F.array_distinct(F.split(F.regexp_replace("haystack", other, F.lit(" ")), " "))
    parts = lambda w, n: F.transform(F.sequence(F.lit(1), F.length(w) - n + 1), lambda i: w.substr(i, n))
    cut = lambda w: F.flatten(F.transform(F.filter("lengths", lambda n: n <= F.length(w)), lambda n: parts(w, n)))
    every = hits.crossJoin(F.broadcast(known)).where("letters <> ''").withColumn("runs", runs)
    every = every.select("term", "song_id", F.explode(F.array_distinct(F.flatten(F.transform("runs", cut)))).alias("needle"))
    return every.groupBy("term", "needle").agg(F.min("song_id").alias("song_id"))


def term_search(rows: DataFrame, songs: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """(track_id, term, song_id, marked): the song found for each row (track_id, terms), null where no term finds any.

    A term finds the songs that have all its words. The first term of a row that finds any counts (empty ones find none):
    of its songs the first by id whose fields contain the row's track_id (`marked`), else the first by id. Each different term is looked up once, by
    the postings of its rarest word, whose songs are then held against its other words; so frequent words move no postings.
    A term of many rows and many songs is not met by pairs of them, but by the parts of its songs' texts that can be ids.
    """
    text = F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in fields])
    indexed = songs.select(F.col("id").alias("song_id"), F.lower(text).alias("haystack")).withColumn("song_words", words_of(F.col("haystack")))
    postings = indexed.select("song_id", F.explode("song_words").alias("word"))
    counts = postings.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    asked = rows.select("track_id", F.posexplode("terms").alias("place", "term")).where("trim(term) <> ''")
    terms = asked.select("term").distinct().withColumn("words", words_of(F.col("term"))).where("size(words) > 0")
    rare = terms.select("term", "words", F.explode("words").alias("word")).join(counts, "word", "left")
    rare = rare.groupBy("term", "words").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word")).alias("rare")).where("rare.n > 0")
    rare = rare.select("term", "words", F.col("rare.word").alias("word"))
    met = postings.join(rare.select("word").distinct().hint("merge"), "word", "left_semi").join(indexed.hint("merge"), "song_id")
    hits = met.join(rare.hint("merge"), "word").where(F.size(F.array_except("words", "song_words")) == 0)
    hits = stored(hits.select("term", "song_id", "haystack"), "hits")
    sizes = hits.groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.min("song_id").alias("least"))
    first = asked.join(sizes.hint("merge"), "term").groupBy("track_id").agg(F.min(F.struct("place", "term", "n", "least")).alias("f")).select("track_id", "f.term", "f.n", "f.least")
    first = first.withColumn("needle", F.lower(F.col("track_id").cast("string")))
    rows_of = first.groupBy("term").agg(F.count(F.lit(1)).alias("n_rows"))
    pairs = F.col("needle").rlike(f"^{WORD}$") & (F.least("n", "n_rows") > FEW)
    first = stored(first.join(rows_of.hint("merge"), "term").select("track_id", "term", "least", "needle", pairs.alias("many")), "first")

    few, many = first.where("NOT many").select("track_id", "term", "needle"), first.where("many")
    marked = F.contains("haystack", "needle")
    best = few.join(hits.hint("merge"), "term").groupBy("track_id", "term").agg(F.min(F.struct((~marked).alias("unmarked"), "song_id")).alias("b"))
    found = best.select("track_id", "term", F.col("b.song_id").alias("song_id"), (~F.col("b.unmarked")).alias("marked"))
    held = _pieces(hits.join(many.select("term").distinct().hint("merge"), "term", "left_semi"), many)
    late = many.join(held.hint("merge"), ["term", "needle"], "left")
    found = found.unionByName(late.select("track_id", "term", F.coalesce("song_id", "least").alias("song_id"), F.col("song_id").isNotNull().alias("marked")))
    return rows.select("track_id").join(found.hint("merge"), "track_id", "left").select("track_id", "term", "song_id", "marked")
