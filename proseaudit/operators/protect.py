"""Protected terms: which terms occur in which texts, at any scale."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proseaudit.functions import gates
from proseaudit.functions import text as tx
from proseaudit.sources import sinks


def attach_terms(texts: DataFrame, protected: DataFrame, keys: str = "doc_id") -> DataFrame:
    """Adds ``terms``, the array of a document's protected terms (empty when it has none).

    Joined on the document; terms are grouped before the join, texts are not.
    """
    per_doc = protected.groupBy(keys).agg(F.collect_set("term").alias("terms"))
    empty = F.expr("cast(array() as array<string>)")
    return texts.join(per_doc, keys, "left").withColumn("terms", F.coalesce("terms", empty))


def mark_protected(texts: DataFrame, text: str = "text") -> DataFrame:
    return texts.withColumn("is_protected", gates.text_protected(F.col(text), F.col("terms")))


SMALL = 200_000  # rows of short strings; a table that was counted and is not larger goes to every task
FEW = 64  # terms that are looked for one by one
CHUNK = 256  # characters of text that travel with a piece
FILTER_BITS = 27  # of a broadcast bit filter, 16 MB at most


def sized(right: DataFrame, limit: int = SMALL) -> DataFrame:
    """The table, broadcast if it has at most ``limit`` rows; larger ones are joined by a shuffle."""
    return F.broadcast(right) if right.limit(limit + 1).count() <= limit else right


def passing(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """The rows of ``left`` whose key may occur in ``right``, found by one bit for each hash; some others pass, too.

    The bits, 16 for each row of ``right`` and 16 MB at most, are broadcast. Beyond that more rows pass in vain, but none is lost.
    """
    size = min(FILTER_BITS, max(16, (16 * right.count()).bit_length()))
    place = F.shiftrightunsigned(F.xxhash64(on), 64 - size)
    words = right.select((place / 64).cast("bigint").alias("id"), F.pmod(place, F.lit(64)).cast("int").alias("_bit")).distinct()
    words = words.groupBy("id").agg(F.expr("bit_or(shiftleft(1L, _bit))").alias("_word"))
    every = right.sparkSession.range(1 << (size - 6)).join(words.hint("merge"), "id", "left")
    bits = every.agg(F.transform(F.sort_array(F.collect_list(F.struct("id", F.coalesce("_word", F.lit(0)).alias("w")))), lambda x: x["w"]).alias("_bits"))
    bits = F.broadcast(sinks.written(bits, "bits"))
    hit = F.bit_get(F.get("_bits", (place / 64).cast("int")), F.pmod(place, F.lit(64)).cast("int"))
    return left.crossJoin(bits).where(hit == 1).drop("_bits")


def dealt(left: DataFrame, on: str, spread: int = 64, share: int = 1000) -> tuple[DataFrame, DataFrame]:
    """``left`` with a ``_salt`` that deals rows of heavy keys out over ``spread`` groups, and the heavy keys.

    A key is heavy if it holds 1/``share`` of the rows or more; so there are at most ``share`` of them, and they are broadcast.
    """
    left = sinks.written(left, "dealt")
    heavy = left.groupBy(on).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= max(2, left.count() // share)).select(on, F.lit(True).alias("_heavy"))
    heavy = sinks.written(heavy, "heavy")
    salt = F.when(F.col("_heavy"), F.pmod(F.xxhash64(*left.columns), F.lit(spread))).otherwise(0).cast("int")
    return left.join(F.broadcast(heavy), on, "left").withColumn("_salt", salt).drop("_heavy"), heavy


def split_join(left: DataFrame, right: DataFrame, on: str, spread: int = 64) -> DataFrame:
    """Inner join on one column by a shuffle of both sides, for a ``left`` that may hold a key very often.

    Rows that cannot match go first (``passing``). Rows of heavy keys go to ``spread`` tasks, each with a copy of the matching rows of ``right``.
    The join is hinted, here and in ``anchors``: a written table is small as compressed files, so Spark would broadcast millions of its rows.
    """
    left, heavy = dealt(passing(left, right, on), on, spread)
    salts = F.when(F.col("_heavy"), F.sequence(F.lit(0), F.lit(spread - 1))).otherwise(F.array(F.lit(0)))
    right = right.join(F.broadcast(heavy), on, "left").withColumn("_salt", F.explode(salts)).drop("_heavy")
    return left.join(right.hint("merge"), [on, "_salt"]).drop("_salt")


def _pieces(c: Column, size: int, step: int) -> Column:
    """Distinct pieces of a text at every ``step``-th place, in one linear pass."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(rf"(?s)(?=(.{{{size}}})).{{1,{step}}}"), F.lit(1)))


def anchors(terms: DataFrame, size: int, step: int, weights: DataFrame | None = None, term: str = "term") -> DataFrame:
    """``(term, piece)``: ``step`` neighbouring pieces of each term, so that one of them stands at a ``step``-th place of any text.

    Of all such runs a term has, it gets the one whose most frequent piece weighs least. A piece weighs as many as the terms that hold it,
    times its ``n`` of ``weights`` (``piece, n``), if given.
    """
    starts = F.sequence(F.lit(1), F.length(term) - size + 1)
    each = terms.select(term, F.posexplode(F.transform(starts, lambda i: F.substr(F.col(term), i, F.lit(size)))).alias("_at", "piece"))
    shared = each.groupBy("piece").agg(F.count(F.lit(1)).alias("_n"))
    if weights is not None:
        shared = shared.join(weights.hint("merge"), "piece", "left").select("piece", (F.col("_n") * (1 + F.coalesce("n", F.lit(0)))).alias("_n"))
    listed = each.join(shared.hint("merge"), "piece").groupBy(term).agg(F.array_sort(F.collect_list(F.struct("_at", "_n", "piece"))).alias("_all"))
    runs = F.transform(F.sequence(F.lit(1), F.size("_all") - step + 1), lambda i: F.struct(
        F.array_max(F.transform(F.slice("_all", i, step), lambda x: x["_n"])).alias("worst"), F.slice("_all", i, step).alias("run")))
    return listed.select(term, F.explode(F.array_min(runs)["run"]["piece"]).alias("piece")).distinct()


def containing_terms(
    texts: DataFrame, terms: DataFrame, keys: list[str], text: str = "text", term: str = "term", limit: int = SMALL, few: int = FEW
) -> DataFrame:
    """Distinct pairs ``(keys..., term)`` where the text contains the term, case-sensitively, anywhere. ``keys`` tell texts apart.

    A plain containment join compares every text with every term. Here terms are taken by length. Up to ``few`` of a kind are looked
    for in each text. Of more, every term has anchors: pieces of eight characters (three for terms under eight, else the term itself), of which
    one stands at an even place of any text that holds the term, if the term is longer than eight. A text is cut into chunks that
    overlap by the longest term; the pieces of a chunk meet the terms on their anchors, and the chunk goes along for the check, so the
    texts are never joined back. Up to ``limit`` anchors are broadcast. Beyond that anchors are chosen by how often they stand in the texts, and
    ``split_join`` shuffles only pieces that may be anchors, and deals out those that many texts hold.
    """
    c, n = F.col(text), F.length(term)
    terms = sinks.written(terms.select(term).where(n > 0).distinct(), "terms")
    size, step = F.when(n >= 8, 8).when(n >= 3, 3).otherwise(n), F.when(n > 8, 2).otherwise(1)
    kinds = terms.groupBy(size.alias("size"), step.alias("step")).agg(F.count(F.lit(1)).alias("n"), F.max(n).alias("longest")).collect()  # five at most
    found = texts.select(*keys, c.alias(term)).limit(0)
    single = [k for k in kinds if k.n <= few]
    if single:
        listed = terms.where(F.struct(size.alias("size"), step.alias("step")).isin(*[F.struct(F.lit(k.size), F.lit(k.step)) for k in single])).collect()
        here = F.array_compact(F.array(*[F.when(F.contains(c, F.lit(r[0])), F.lit(r[0])) for r in listed]))
        found = texts.select(*keys, F.explode(here).alias(term))
    for kind in kinds:
        if kind.n <= few:
            continue
        own, width = terms.where((size == kind.size) & (step == kind.step)), CHUNK + kind.longest - 1
        chunks = F.when(F.length(c) <= width, F.array(c)).otherwise(F.regexp_extract_all(c, F.lit(rf"(?s)(?=(.{{1,{width}}})).{{1,{CHUNK}}}"), F.lit(1)))
        rows = texts.select(*keys, F.explode(chunks).alias("_chunk")).select(*keys, "_chunk", F.explode(_pieces(F.col("_chunk"), kind.size, kind.step)).alias("piece"))
        if kind.n * kind.step <= limit:
            pairs = rows.join(F.broadcast(anchors(own, kind.size, kind.step, term=term).withColumnRenamed(term, "_term")), "piece")
        else:
            every = own.select(F.explode(_pieces(F.col(term), kind.size, 1)).alias("piece")).distinct()
            held = passing(rows.select("piece"), every, "piece").groupBy("piece").agg(F.count(F.lit(1)).alias("n"))
            right = sinks.written(anchors(own, kind.size, kind.step, held, term).withColumnRenamed(term, "_term"), "anchors")
            pairs = split_join(rows, right, "piece")
        found = found.union(pairs.where(F.contains(F.col("_chunk"), F.col("_term"))).select(*keys, F.col("_term").alias(term)))
    return found.distinct()


def occurring_terms(
    texts: DataFrame, protected: DataFrame, key: str = "doc_id", text: str = "text", per_kind: int | None = None, cap: int | None = None
) -> DataFrame:
    """Per document: its protected terms that occur in its texts, longest first.

    ``per_kind`` keeps only the first terms of each kind and ``cap`` only the longest hits; both are off by default."""
    if per_kind is not None:
        protected = protected.withColumn("_n", F.row_number().over(Window.partitionBy(key, "kind").orderBy("pos"))).where(F.col("_n") <= per_kind)
    first = protected.groupBy(key).agg(F.collect_set("term").alias("_terms"))
    c = F.col(text)
    hit = texts.join(first.hint("merge"), key).select(  # collected terms are larger than their files, by which Spark would broadcast them
        key, F.explode(F.filter("_terms", lambda t: (t != "") & F.contains(c, t))).alias("term")
    )
    longest = Window.partitionBy(key).orderBy(F.length("term").desc(), "term")
    ranked = hit.distinct().withColumn("rank", F.row_number().over(longest))
    return ranked if cap is None else ranked.where(F.col("rank") <= cap)


def replace_by_table(df: DataFrame, terms: DataFrame, keys: list[str], text: str = "text", max_words: int = 3, limit: int = SMALL) -> DataFrame:
    """Preferred-term hits against a term table of any size: ``(keys..., term, preferred, hits)``.

    ``terms`` is ``(term, preferred)`` with lower-case terms of up to ``max_words`` words. Texts
    become word n-grams. If there are at most ``limit`` terms, n-grams that are none of them go before any shuffle. Otherwise n-grams that
    cannot be terms go first, the others are counted per text, so a hot word costs one row per text, and ``split_join`` deals hot terms out.
    """
    token = F.regexp_extract_all(F.lower(F.col(text)), F.lit(rf"{tx.WORD}+(?:[-']{tx.WORD}+)*"), F.lit(0))
    grams = F.flatten(F.transform(
        F.sequence(F.lit(1), F.lit(max_words)),
        lambda n: F.when(
            F.size("_tok") >= n,
            F.transform(F.sequence(F.lit(1), F.size("_tok") - n + 1), lambda i: F.array_join(F.slice("_tok", i, n), " ")),
        ).otherwise(F.expr("cast(array() as array<string>)")),
    ))
    exploded = df.withColumn("_tok", token).select(*keys, F.explode(grams).alias("term"))
    right = sized(terms, limit)
    if right is not terms:
        return exploded.join(right, "term").groupBy(*keys, "term", "preferred").agg(F.count(F.lit(1)).alias("hits"))
    hits = passing(exploded, terms, "term").groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("hits"))
    return split_join(hits, terms, "term").select(*keys, "term", "preferred", "hits")


def uncached(docs: DataFrame, cached: DataFrame, key: str = "doc_id") -> DataFrame:
    """Documents whose terms are not in the cache yet."""
    return docs.join(cached.select(key).distinct(), key, "left_anti")
