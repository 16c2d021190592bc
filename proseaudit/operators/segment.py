"""Page text -> elements, elements -> sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proseaudit.functions import lexicons as lx
from proseaudit.functions import text as tx
from proseaudit.functions import visual

LONG_PARAGRAPH = 1000
PACKED_PARAGRAPH = 500
SHELF = 1000
SENTENCE_GAP = rf"(?<=[.!?]){tx.WS}+"
PARAGRAPH_GAP = SENTENCE_GAP + "(?=[A-Z])"
_G = lx.BULLET_GLYPHS
BULLET_LINE = rf"(?m)^{tx.WS}*[{_G}]{tx.WS}+"
BULLET_START = rf"^{tx.WS}*[{_G}]{tx.WS}+"
BULLET_BREAK = rf"\n(?={tx.WS}*[{_G}]{tx.WS}+)"
NUMBER_LINE = rf"(?m)^{tx.WS}*[0-9]+\.{tx.WS}+"
NUMBER_START = rf"^{tx.WS}*[0-9]+\.{tx.WS}+"
NUMBER_BREAK = rf"\n(?={tx.WS}*[0-9]+\.{tx.WS}+)"


def paragraphs(page_text: Column) -> Column:
    """Line ends normalised, then split at blank lines."""
    nl, cr = F.lit("\n"), F.lit("\r")
    unix = F.when(
        page_text.contains("\r"), F.replace(F.replace(page_text, F.lit("\r\n"), nl), cr, nl)
    ).otherwise(page_text)
    return F.split(unix, "\n\n", -1)


def pack(sentences: Column, width: int = PACKED_PARAGRAPH) -> Column:
    """Join consecutive sentences; a new piece starts when the next one would pass ``width``. Sentences hold no blank line.

    Where a piece ends depends on everything before it, so this is a fold. Its state is the length of the open piece and, for each
    sentence, a character that says whether it starts a piece. Spark copies the state of a fold at each step, so sentences are
    folded on shelves of ``SHELF``, and the shelves by a second fold. The text is joined once, with a blank line in front of each
    start, and split there.
    """
    def step(acc: Column, s: Column) -> Column:
        size = F.length(s)
        starts = (acc["open"] > 0) & (acc["open"] + size > width)
        return F.struct(
            F.when(starts | (acc["open"] == 0), size).otherwise(acc["open"] + 1 + size).alias("open"),
            F.concat(acc["flags"], F.when(starts, "1").otherwise("0")).alias("flags"),
        )

    def shelve(acc: Column, shelf: Column) -> Column:
        start = F.struct(acc["open"].alias("open"), F.lit("").alias("flags"))
        return tx.let(F.aggregate(shelf, start, step), lambda done: F.struct(done["open"].alias("open"), F.array_append(acc["shelves"], done["flags"]).alias("shelves")))

    def pieces(all_sentences: Column) -> Column:
        count = F.ceil(F.size(all_sentences) / F.lit(SHELF)).cast("int")
        shelves = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.slice(all_sentences, i * SHELF + 1, F.lit(SHELF)))
        zero = F.struct(F.lit(0).cast("int").alias("open"), F.expr("cast(array() AS array<string>)").alias("shelves"))

        def joined(every: Column) -> Column:
            flags = F.aggregate(every, zero, shelve, lambda acc: acc["shelves"])
            lead = lambda f, i: F.when(F.substr(f, i + 1, F.lit(1)) == "1", "\n\n").otherwise(" ")
            return F.array_join(F.flatten(F.zip_with(every, flags, lambda shelf, f: F.transform(shelf, lambda s, i: F.concat(lead(f, i), s)))), "")

        return F.transform(F.split(tx.let(shelves, joined), "\n\n", -1), tx.strip)

    return tx.let(sentences, lambda all_sentences: F.when(F.size(all_sentences) > 0, pieces(all_sentences)).otherwise(all_sentences))


def refine(paragraph: Column) -> Column:
    """Array of pieces: long paragraphs are re-packed, bullet and numbered lines start new pieces."""
    return (
        F.when(F.length(paragraph) > LONG_PARAGRAPH, pack(F.split(paragraph, PARAGRAPH_GAP, -1)))
        .when(paragraph.rlike(f"[{_G}]") & paragraph.rlike(BULLET_LINE), F.split(paragraph, BULLET_BREAK, -1))
        .when(paragraph.rlike(r"[0-9]\.") & paragraph.rlike(NUMBER_LINE), F.split(paragraph, NUMBER_BREAK, -1))
        .otherwise(F.array(paragraph))
    )


def is_heading(c: Column) -> Column:
    """Short without a closing mark; or short and all capitals; or short with a heading word."""
    low = F.lower(c)
    named = F.lit(False)
    for w in lx.HEADING_WORDS:
        named = named | low.contains(w)
    n = F.length(c)
    return (
        ((n < 100) & ~c.rlike(r"[.!?]$"))
        | ((n < 50) & tx.is_all_upper(c))
        | ((n < 80) & tx.starts_upper(c) & named)
    )


def classify(c: Column) -> Column:
    """``struct<element_type, confidence>``; first match wins."""
    low = F.lower(c)
    caption = F.lit(False)
    for w in lx.CAPTION_WORDS:
        caption = caption | low.contains(w)

    def kind(name: str, confidence: float) -> Column:
        return F.struct(F.lit(name).alias("element_type"), F.lit(confidence).alias("confidence"))

    return (
        F.when(is_heading(c), kind("heading", 0.9))
        .when(c.rlike(BULLET_START), kind("bullet", 0.95))
        .when(c.rlike(NUMBER_START), kind("bullet", 0.9))
        .when((F.length(c) < 100) & caption, kind("caption", 0.8))
        .otherwise(kind("paragraph", 0.7))
    )


def elements_from_pages(pages: DataFrame, text: str = "raw_text") -> DataFrame:
    """Elements of page text. ``pages`` needs ``doc_id``, ``page_index`` and the text column.

    ``element_index`` counts pieces before blank ones are dropped. No shuffle: everything about a
    page comes from its own row.
    """
    # The array goes into the generator as an expression, not as a column: from a column the
    # optimizer derives a "not empty" filter below the generator and computes the array twice more.
    pieces = tx.let(
        F.flatten(F.transform(paragraphs(F.col(text)), refine)),
        lambda all_pieces: F.transform(all_pieces, lambda p: F.struct(F.size(all_pieces).alias("total"), p.alias("raw"))),
    )
    return (
        pages.where(tx.strip(text) != "")
        .select("doc_id", "page_index", F.posexplode(pieces).alias("element_index", "_piece"))
        .select("doc_id", "page_index", "element_index", F.col("_piece.total").alias("_total"), tx.strip("_piece.raw").alias("text"))
        .where("text <> ''")
        .withColumn("_kind", classify(F.col("text")))
        .select(
            "doc_id", "page_index", "element_index",
            F.col("_kind.element_type").alias("element_type"),
            visual.page_position(F.col("element_index"), F.col("_total")).alias("position"),
            "text",
            F.col("_kind.confidence").alias("confidence"),
        )
    )


def sentence_array(c: Column) -> Column:
    """Sentences of a text. The split takes all white space between them, so only the ends of the
    text itself need trimming."""
    return tx.split_at(tx.strip(c), SENTENCE_GAP)


def sentences(elements: DataFrame) -> DataFrame:
    """One row per sentence; keeps every input column but the text."""
    keep = [c for c in elements.columns if c != "text"]
    return elements.where(tx.strip("text") != "").select(*keep, F.posexplode(sentence_array(F.col("text"))).alias("sent_index", "sentence"))


CHUNK_FLOOR = 20_000


def chunks(c: Column, width: int, floor: int = CHUNK_FLOOR) -> Column:
    """``array<struct<chunk_index, chunk>>`` of fixed-width pieces, of ``floor`` characters at least."""
    width = max(width, floor)
    count = F.ceil(F.length(c) / F.lit(width)).cast("int")
    return F.when(
        count > 0,
        F.transform(
            F.sequence(F.lit(0), count - 1),
            lambda i: F.struct(i.alias("chunk_index"), F.substr(c, i * width + 1, F.lit(width)).alias("chunk")),
        ),
    )


def word_chunks(c: Column, width: int) -> Column:
    """Chunks cut at the last space once past the middle, else at ``width``.

    The pattern spells the rule: a remainder that fits; or more than half, up to a space; or
    ``width`` characters. Greedy matching makes the cut at the *last* such space.
    """
    half = int(width * 0.5) + 1
    pattern = rf"(?s).{{1,{width}}}\z|.{{{half},{width - 1}}}(?= )|.{{{width}}}"
    return F.when(F.length(c) <= width, F.array(c)).otherwise(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)))
