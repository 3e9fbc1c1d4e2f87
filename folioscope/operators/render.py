"""Pages of HTML, one per division, and tokens tied to words."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions.align import align
from folioscope.functions.text import classified_tokens, html_escape, mark_html, page_file, slug, tokens_and_marks


def page_tokens(verses: DataFrame) -> DataFrame:
    """Rows (surah, name, verse, at, kind, text, word, index): words numbered within the verse and the surah."""
    t = verses.select("surah", "name", "verse", F.posexplode(tokens_and_marks(F.col("text"))).alias("at", "t")).select("surah", "name", "verse", "at", "t.*")
    number = F.sum(F.when(F.col("kind") == "word", 1).otherwise(0))
    in_verse = Window.partitionBy("surah", "verse").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    in_surah = Window.partitionBy("surah").orderBy("verse", "at").rowsBetween(Window.unboundedPreceding, 0)
    word = F.col("kind") == "word"
    return t.withColumns({"word": F.when(word, number.over(in_verse)).cast("int"), "index": F.when(word, number.over(in_surah)).cast("int")})


def pages(verses: DataFrame, morphology: DataFrame) -> DataFrame:
    """Rows (surah, file, html); morphology (surah, verse, word, rows) gives each word its segments."""
    tokens = page_tokens(verses).join(morphology.select("surah", "verse", "word", F.to_json("rows").alias("rows")), ["surah", "verse", "word"], "left")
    word = F.concat(
        F.lit('<span class="quran-word" data-surah="'), F.col("surah"), F.lit('" data-ayah="'), F.col("verse"), F.lit('" data-word="'), F.col("word"), F.lit('" data-index="'), F.col("index"),
        F.lit("\" data-morphology='"), html_escape(F.coalesce("rows", F.lit("[]"))), F.lit("'>"), html_escape(F.col("text")), F.lit("</span>"),
    )
    spans = tokens.withColumn("span", F.when(F.col("kind") == "word", word).otherwise(mark_html(F.col("text"))))
    lines = spans.groupBy("surah", "name", "verse").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "span"))), lambda s: s["span"]), "\n").alias("line"))
    lines = verses.select("surah", "name", "verse").join(lines, ["surah", "name", "verse"], "left")
    section = F.concat(
        F.lit('<section class="ayah" id="ayah-'), F.col("verse"), F.lit('" data-ayah="'), F.col("verse"), F.lit('"><h2 class="ayah-number">'), F.col("verse"), F.lit('</h2><p class="ayah-text">'),
        F.coalesce("line", F.lit("")), F.lit("</p></section>"),
    )
    body = lines.withColumn("section", section).groupBy("surah", "name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("verse", "section"))), lambda s: s["section"]), "\n").alias("body"))
    title = html_escape(F.col("name"))
    html = F.concat(
        F.lit('<!doctype html>\n<html lang="ar" dir="rtl"><head><meta charset="utf-8"><title>'), title, F.lit('</title></head><body>\n<main class="quran" data-surah-number="'), F.col("surah"),
        F.lit('"><header class="surah-header"><h1 class="surah-name">'), title, F.lit("</h1></header>\n"), F.col("body"), F.lit("\n</main></body></html>\n"),
    )
    return body.select("surah", page_file(F.col("surah"), slug(F.col("name"))).alias("file"), html.alias("html"))


def aligned_tokens(verses: DataFrame, words: DataFrame, most: int = 1) -> DataFrame:
    """Rows (surah, verse, word, match, word_token, token): each listed word and the tokens it is tied to.

    ``word_token`` counts word tokens alone, ``token`` counts all tokens, so
    that marks between words shift nothing; a token that two entries claim is
    in both rows.
    """
    listed = words.groupBy("surah", "verse").agg(F.array_sort(F.collect_list(F.struct("word", "token"))).alias("listed"))
    tokens = classified_tokens(F.col("text"))
    rows = verses.select("surah", "verse", tokens.alias("tokens")).join(listed, ["surah", "verse"])
    places = F.filter(F.transform("tokens", lambda t, i: F.struct(i.alias("at"), t["type"].alias("type"), t["text"].alias("text"))), lambda t: t["type"] == "word")
    rows = rows.withColumn("places", places)
    entries = align(F.transform("listed", lambda w: w["token"]), F.transform("places", lambda p: p["text"]), most)
    out = rows.withColumn("e", F.explode(entries)).select("surah", "verse", F.get("listed", F.col("e.index"))["word"].alias("word"), F.col("e.match").alias("match"), "places", F.explode_outer("e.tokens").alias("word_token"))
    return out.withColumn("token", F.get("places", F.col("word_token"))["at"]).drop("places")


def token_words(aligned: DataFrame) -> DataFrame:
    """One word for each token, the last that claims it."""
    return aligned.filter("token is not null").groupBy("surah", "verse", "token").agg(F.max("word").alias("word"))
