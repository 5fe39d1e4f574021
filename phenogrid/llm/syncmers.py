"""Document fingerprints from closed syncmers, with DataFrame expressions only.

A run of ``K`` letters is an anchor if the smallest of its runs of ``S``
letters (by hash) stands first or last.  Whether a run is an anchor depends
on its own letters only, so an edit changes no anchor that it does not touch,
and any K - S runs in a row have one among them.  Letters are words; of words
of more than ``LONG_WORD`` characters, as text without blanks has, they are
the characters.  Texts of few words or characters have anchors of characters
besides, as half of them may hold no run of K words; two texts are compared
by the kinds of anchors that both have.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phenogrid.llm.common import Scratch

K, S = 8, 3
SMALL_K, SMALL_S = 3, 1
LONG_WORD = 16
FEW_WORDS, FEW_CHARS = 64, 64
ROWS_PER_BUCKET = 500
MOST_BUCKETS = 1 << 14


def closed(hashes: str, k: int, s: int) -> str:
    """SQL for the hashes of the closed syncmers among letters' ``hashes``, in order of place.

    The ``transform(array(x), v -> ...)`` forms bind an array to a name, so
    that it is worked out once and not for each letter.
    """
    inner = k - s  # last place of an inner run
    middle = [f"get(m, i + {j})" for j in range(1, inner)]
    run = f"xxhash64({', '.join(f'get(m, i + {j})' for j in (*range(0, inner, s), inner))})"
    test = f"least(get(m, i), get(m, i + {inner})) <= {middle[0] if len(middle) == 1 else 'least(' + ', '.join(middle) + ')'}"
    small = f"xxhash64({', '.join(['x'] + [f'get(h, i + {j})' for j in range(1, s)])})"
    many = f"get(transform(array(transform(h, (x, i) -> {small})), m -> filter(transform(sequence(0, size(h) - {k}), i -> if({test}, {run}, null)), a -> a is not null)), 0)"
    return f"get(transform(array({hashes}), h -> if(size(h) < {k}, cast(array() as array<bigint>), {many})), 0)"


def letters(text: str) -> str:
    """SQL for a text's words, the long ones as characters."""
    words = f"filter(split({text}, '\\\\s+'), w -> w != '')"
    return f"if({text} rlike '\\\\S{{{LONG_WORD + 1}}}', flatten(transform({words}, w -> if(length(w) > {LONG_WORD}, split(w, ''), array(w)))), {words})"


def word_anchors(text: str) -> str:
    """SQL for the anchors of a text's letters; a text of one to ``K`` - 1 of them is one anchor."""
    few = "if(size(g) = 0, cast(array() as array<bigint>), array(xxhash64(g)))"
    return f"get(transform(array(transform({letters(text)}, w -> xxhash64(w))), g -> if(size(g) < {K}, {few}, {closed('g', K, S)})), 0)"


SECTIONS = ("words", "eights", "threes")


def anchors(text: str) -> str:
    """SQL for a text's anchors by kind: of words, and for small texts of characters, by 8 and by 3; null where a text has none of a kind."""
    chars = f"transform(split({text}, ''), c -> xxhash64(c))"
    by_8 = f"if(length({text}) < {FEW_WORDS * LONG_WORD} and size(split({text}, '\\\\s+')) < {FEW_WORDS}, {closed(chars, K, S)}, null)"
    by_3 = f"if(length({text}) < {FEW_CHARS}, {closed(chars, SMALL_K, SMALL_S)}, null)"
    return f"struct({word_anchors(text)} as words, {by_8} as eights, {by_3} as threes)"


def as_text(found: str) -> str:
    """SQL for the anchors as eight hexadecimal digits each, in order, kinds apart by points."""
    hexed = [f"array_join(transform({found}.{k}, a -> lower(hex(shiftrightunsigned(a, 33) + 2147483648L))), '')" for k in SECTIONS]
    return f"trim(trailing '.' from concat_ws('.', {', '.join(hexed)}))"


def likeness(a: str, b: str) -> str:
    """SQL for shared distinct anchors, twice, over the anchors of both, of the kinds that both have; two empty ones are alike.

    A small text is so compared with a larger one by words alone.
    """
    def of_both(value: str) -> str:
        # array_size of null is null; no branches, in which equal expressions would be worked out again
        return " + ".join(f"coalesce({value.format(a=f'{a}.{k}', b=f'{b}.{k}')}, 0)" for k in SECTIONS)

    every = f"({of_both('array_size(array_distinct({a})) + array_size(array_distinct({b}))')})"
    return f"coalesce(2.0D * ({of_both('array_size(array_intersect({a}, {b}))')}) / nullif({every}, 0), 1.0D)"


def with_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows ``doc_id, text, tie, bucket, extra``: ranges of ascending id, each with a copy (extra 1) of the row that follows it.

    Rows are ordered by id, then by a hash of the text.  The ranges are cut
    at rows drawn by hash, some hundred rows apart: about four draws for a
    cut, so at most 65,536 narrow rows, which any type of id allows.  Beyond
    ``MOST_BUCKETS`` ranges they grow with the input; they are sorted and
    streamed, never held in memory.  What is broadcast is one row for a range.
    """
    scratch = Scratch(docs.sparkSession)
    source = docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    wanted = max(1, min(MOST_BUCKETS, source.count() // ROWS_PER_BUCKET))
    drawn = source.select("doc_id", "tie").orderBy(F.xxhash64("doc_id", "tie", F.lit(1)), "doc_id", "tie").limit(4 * wanted)
    cuts = drawn.distinct().agg(F.sort_array(F.collect_list(F.struct("doc_id", "tie"))).alias("cuts"))
    cuts = scratch.keep(cuts.selectExpr("filter(cuts, (c, i) -> i % 4 = 3) as cuts"))
    # binary search in the cuts: how many are below the row or equal to it
    powers = [1 << i for i in reversed(range(wanted.bit_length()))]
    bucket = F.expr(f"aggregate(array({', '.join(map(str, powers))}), 0, (at, p) -> if(at + p <= size(cuts) and get(cuts, at + p - 1) <= struct(doc_id, tie), at + p, at))")
    rows = source.crossJoin(F.broadcast(cuts)).withColumn("bucket", bucket).drop("cuts").withColumn("extra", F.lit(0))
    heads = scratch.keep(rows.groupBy("bucket").agg(F.min(F.struct("doc_id", "tie")).alias("head")))
    heads = heads.selectExpr("coalesce(lag(bucket) over (order by bucket), max(bucket) over ()) as before", "head.doc_id as head_id", "head.tie as head_tie")
    follow = rows.join(F.broadcast(heads), F.col("doc_id").eqNullSafe(F.col("head_id")) & (F.col("tie") == F.col("head_tie"))).dropDuplicates(["before"])
    return rows.unionByName(follow.select("doc_id", "text", "tie", F.col("before").alias("bucket"), F.lit(1).alias("extra")))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's fingerprint and that of its edited text, with the likeness of both and to the next row.

    The edited text's last half (floor of n_chars / 2) is replaced by as many
    first characters of the next row's text, or all of it.  Null texts count
    as empty, with an empty fingerprint.  Texts may be of any length.  Rows
    that share an id, or have none, follow each other by a hash of their
    texts, and may fall into several ranges; repeated rows follow each other.
    A null id comes before all others.  Other columns are not read, whatever
    their names.  An empty table gives an empty one.
    """
    # texts are shuffled once, without anchors
    rows = with_next(docs, id_col, text_col).repartition("bucket").withColumn("anchors", F.expr(anchors("text")))
    over = "over (partition by bucket order by extra, doc_id, tie)"
    rows = rows.selectExpr("*", f"lead(text) {over} as next_text", f"lead(anchors) {over} as next_anchors").where("extra = 0")
    rows = rows.withColumn("n_chars", F.length("text").cast("long"))
    edited = "concat(left(text, cast(n_chars - n_chars div 2 as int)), left(next_text, cast(n_chars div 2 as int)))"
    rows = rows.select("doc_id", "n_chars", "anchors", "next_anchors", F.expr(edited).alias("edited"))
    rows = rows.withColumn("both", F.expr(f"struct(sha2(edited, 256) as sha, {anchors('edited')} as anchors)"))
    return rows.selectExpr(
        "doc_id", "n_chars", "both.sha as edited_sha256", f"{as_text('anchors')} as fingerprint", f"{as_text('both.anchors')} as edited_fingerprint",
        f"{likeness('anchors', 'both.anchors')} as near_edited", f"{likeness('anchors', 'next_anchors')} as near_next",
    )
