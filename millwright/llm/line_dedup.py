"""Removal of repeated multi-line passages by content-defined chunks of lines, in DataFrame functions only.

A line's hash is the first 28 bits of its MD5; a rolling hash joins each line's hash with the one before. A chunk starts at the first
line and wherever the rolling hash has a local minimum, so boundaries depend on a few lines of content and survive
insertions before or after a passage, and inner chunks have two lines or more (three on average).
Chunks of two or more lines that occur more than once in the corpus are candidates by hash; their bytes are compared, and all
but the first occurrence (least doc_id, then place) are taken out of their texts.

Chunk boundaries need a few lines of content, so a passage of two to five lines seldom holds a whole chunk. The second half
takes repeated chunks as anchors and goes on from them by every two neighbouring lines: a run of two or more lines that occurred before goes
whole, whatever surrounds it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millwright.llm.common import broadcast_if_small, join_counted, remove, written

MODULUS, FACTOR = 2147483647, 1000003


def _before(values: str, first) -> F.Column:
    """An array moved one place on, ``first`` in front."""
    return F.concat(F.array(first), F.slice(values, F.lit(1), F.size(values) - 1))


def _after(values: str, last) -> F.Column:
    return F.concat(F.slice(values, F.lit(2), F.size(values)), F.array(last))


def _hash(line: F.Column) -> F.Column:
    return F.conv(F.substring(F.md5(line), 1, 7), 16, 10).cast("long")


def chunked(docs: DataFrame) -> DataFrame:
    """``docs`` with ``__lines`` and ``__chunks``: an array of (start, n, mark), mark being a 64-bit hash of the chunk's lines.

    Each step is a column of its own, so no array is computed again inside another's elements.
    """
    none = F.lit(None).cast("long")
    steps = docs.withColumn("__lines", F.split("text", "\n"))
    steps = steps.withColumn("__h", F.transform("__lines", _hash))
    steps = steps.withColumn("__r", F.zip_with(_before("__h", F.lit(0).cast("long")), "__h", lambda a, b: F.pmod(a * FACTOR + b, F.lit(MODULUS))))
    steps = steps.withColumn("__low", F.zip_with(_before("__r", none), "__r", lambda a, b: a.isNull() | (b < a)))
    steps = steps.withColumn("__low2", F.zip_with("__r", _after("__r", none), lambda a, b: b.isNotNull() & (a <= b)))
    # the first line always starts a chunk, the last one (nothing after it) never does unless it is the first
    steps = steps.withColumn("__cut", F.zip_with("__low", "__low2", lambda a, b: a & b))
    steps = steps.withColumn("__starts", F.filter(F.transform("__cut", lambda x, i: F.when(x | (i == 0), i)), lambda i: i.isNotNull()))
    steps = steps.withColumn("__ends", _after("__starts", F.size("__lines")))
    chunks = F.zip_with("__starts", "__ends", lambda s, e: F.struct(
        s.alias("start"), (e - s).alias("n"), F.xxhash64(F.slice("__lines", s + 1, e - s)).alias("mark")
    ))
    return steps.withColumn("__chunks", chunks).drop("__h", "__r", "__low", "__low2", "__cut", "__starts", "__ends")


def _occurrences(parts: DataFrame, with_bytes: bool = False) -> DataFrame:
    """(__id, __start, __mark, __n) of each chunk of two or more lines, and its __bytes if wanted (the chunk's own, not its text's)."""
    several = F.filter("__chunks", lambda c: c["n"] >= 2)
    if with_bytes:
        several = F.transform(several, lambda c: F.struct(
            c["start"].alias("start"), c["mark"].alias("mark"), c["n"].alias("n"), F.array_join(F.slice("__lines", c["start"] + 1, c["n"]), "\n").alias("bytes")
        ))
    rows = parts.select("__id", F.explode(several).alias("__c"))
    return rows.select("__id", *[F.col(f"__c.{c}").alias(f"__{c}") for c in ("start", "mark", "n", *["bytes"] * with_bytes)])


def repeated_chunks(docs: DataFrame) -> DataFrame:
    """(__id, __start, __mark, __n) of every chunk occurrence to take out."""
    base = docs.select(F.col("doc_id").alias("__id"), "text").where("doc_id is not null and text is not null")
    parts = chunked(base)
    marks, marks_path = written(_occurrences(parts).groupBy("__mark").agg(F.count("*").alias("__count")).where("__count > 1").select("__mark"), "marks")
    here = _occurrences(parts, True).join(broadcast_if_small(marks, marks.count()), "__mark", "left_semi").select("__id", "__start", "__mark", "__n", "__bytes")
    found, path = written(here, "chunks")
    firsts, firsts_path = written(_firsts(found), "firsts")
    surplus = join_counted(found, firsts, ["__mark", "__bytes"], "__count", F.octet_length("__bytes")).where(F.struct("__id", "__start") != F.col("__first"))
    result, _ = written(surplus.select("__id", "__start", "__mark", "__n").distinct(), "surplus")
    remove(docs.sparkSession, path, marks_path, firsts_path)
    return result


def _firsts(found: DataFrame) -> DataFrame:
    """(__mark, __bytes, __first, __count) of what occurs more than once; each partition sends one row for each of its passages."""
    return found.groupBy("__mark", "__bytes").agg(F.min(F.struct("__id", "__start")).alias("__first"), F.count("*").alias("__count")).where("__count > 1")


def drop_repeated_chunks(docs: DataFrame) -> DataFrame:
    """Every row of ``docs`` with ``text`` changed, ``removed_chunks`` and ``removed_lines`` added.

    Other columns are kept; columns already named like the two are replaced. The lines that stay are joined again by
    newlines. A null text stays null, an empty one empty (one line is no chunk); rows with a null doc_id stay as they are.
    Rows that repeat a doc_id are one document: a passage they share counts as one occurrence.
    """
    docs = docs.drop("removed_chunks", "removed_lines")
    surplus = repeated_chunks(docs)
    per_doc = surplus.groupBy("__id").agg(F.collect_set(_name("__start", "__n", "__mark")).alias("__gone"))
    n = surplus.agg(F.count("*"), F.approx_count_distinct("__id")).first()
    per_doc = broadcast_if_small(per_doc, n[0] + n[1], row_bytes=48)
    parts = chunked(docs.join(per_doc, F.col("doc_id") == F.col("__id"), "left").drop("__id"))
    # set operations on arrays of strings and numbers only: linear in a text's chunks and lines
    names = F.transform(F.filter("__chunks", lambda c: c["n"] >= 2), lambda c: _name(c["start"], c["n"], c["mark"]))
    number = lambda x, i: F.split_part(x, F.lit(":"), F.lit(i)).cast("int")
    parts = parts.withColumn("__out", F.array_intersect(names, "__gone"))
    parts = parts.withColumn("__off", F.flatten(F.transform("__out", lambda x: F.sequence(number(x, 1), number(x, 1) + number(x, 2) - 1))))
    parts = parts.withColumn("__kept", F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), "__off"))
    touched = F.col("__out").isNotNull()
    text = F.array_join(F.transform("__kept", lambda i: F.get("__lines", i)), "\n")
    return parts.select(
        *[F.when(touched, text).otherwise(F.col("text")).alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns],
        F.coalesce(F.size("__out"), F.lit(0)).cast("long").alias("removed_chunks"), F.coalesce(F.size("__off"), F.lit(0)).cast("long").alias("removed_lines"),
    )


def _name(start, n, mark) -> F.Column:
    return F.concat_ws(":", *[F.col(x).cast("string") if isinstance(x, str) else x.cast("string") for x in (start, n, mark)])


ORACLE = f"""
WITH docs AS (SELECT doc_id, text FROM documents),
lines AS (
  SELECT doc_id, i, arr[i] AS line, len(arr) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS arr FROM docs WHERE text IS NOT NULL), range(1, len(arr) + 1) AS t(i)
),
hashed AS (SELECT *, ('0x' || substr(md5(line), 1, 7))::BIGINT AS h FROM lines),
rolled AS (SELECT *, (coalesce(lag(h) OVER w, 0) * {FACTOR} + h) % {MODULUS} AS r FROM hashed WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
cuts AS (SELECT *, CASE WHEN i = 1 OR (r < lag(r) OVER w AND r <= lead(r) OVER w) THEN 1 ELSE 0 END AS cut FROM rolled WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
numbered AS (SELECT *, sum(cut) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS chunk FROM cuts),
chunks AS (SELECT doc_id, chunk, count(*) AS n, min(i) AS start, string_agg(line, chr(10) ORDER BY i) AS body FROM numbered GROUP BY doc_id, chunk),
ranked AS (SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id, start) AS place FROM chunks WHERE n >= 2),
gone AS (SELECT doc_id, chunk, n FROM ranked WHERE place > 1),
totals AS (SELECT doc_id, count(*) AS removed_chunks, sum(n)::BIGINT AS removed_lines FROM gone GROUP BY doc_id),
kept AS (SELECT c.doc_id, string_agg(c.body, chr(10) ORDER BY c.start) AS text FROM chunks c ANTI JOIN gone g ON c.doc_id = g.doc_id AND c.chunk = g.chunk GROUP BY c.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text,
  coalesce(t.removed_chunks, 0) AS removed_chunks, coalesce(t.removed_lines, 0) AS removed_lines
FROM docs d LEFT JOIN kept k ON d.doc_id = k.doc_id LEFT JOIN totals t ON d.doc_id = t.doc_id
"""


def _pairs(docs: DataFrame) -> DataFrame:
    """``docs`` with ``__lines`` and ``__marks``: a 64-bit hash of each two neighbouring lines, null where both are blank."""
    steps = docs.withColumn("__lines", F.split("text", "\n"))
    pairs = F.size("__lines") - 1
    return steps.withColumn("__marks", F.zip_with(
        F.slice("__lines", F.lit(1), pairs), F.slice("__lines", F.lit(2), pairs),
        lambda a, b: F.when(a.rlike("[^ \t\r]") | b.rlike("[^ \t\r]"), F.xxhash64(a, b)),
    ))


def _key(start: F.Column, mark: F.Column) -> F.Column:
    """A pair's place in the upper and half of its hash in the lower 32 bits of a long."""
    return F.shiftleft(start.cast("long"), 32).bitwiseOR(mark.bitwiseAND(F.lit(0xFFFFFFFF)))


def _repeated_marks(parts: DataFrame) -> DataFrame:
    """(__mark) of the pairs that occur more than once, from repeated chunks outward.

    Copies of a content-defined chunk meet by its hash (with its length and first pair: 128 bits): the pairs inside a chunk that occurs again are repeated
    with it and named once, however many copies there are. The pairs that reach over a chunk's border carry on beyond it: they are counted, with one of
    each other chunk's.
    """
    items = F.transform("__chunks", lambda c: F.struct(
        c["mark"].alias("chunk"), c["n"].alias("n"), F.slice("__marks", c["start"] + 1, c["n"] - 1).alias("inner"), F.slice("__marks", c["start"] + c["n"], F.lit(1)).alias("border")
    ))
    chunks = parts.select(F.explode(items).alias("c")).select("c.*")
    kinds = chunks.where("n >= 2").groupBy("chunk", "n", F.get("inner", F.lit(0)).alias("head")).agg(F.first("inner").alias("inner"), F.count("*").alias("copies"))
    inner = kinds.select(F.explode("inner").alias("__mark"), (F.col("copies") > 1).alias("again"))
    every = inner.unionByName(chunks.select(F.explode("border").alias("__mark"), F.lit(False).alias("again"))).where("__mark is not null")
    return every.groupBy("__mark").agg(F.count("*").alias("n"), F.bool_or("again").alias("again")).where("n > 1 or again").select("__mark")


def repeated_pairs(docs: DataFrame) -> DataFrame:
    """(__id, __start, __mark) of every pair of neighbouring lines to take out: one that occurred before, compared by bytes, and whose first occurrence stays whole.

    Content-defined chunks that occur more than once are the anchors: their pairs are repeated, and pairs of neighbouring lines carry on beyond them.
    A pair that overlaps its own first occurrence (three equal lines) is not a second one. A first occurrence of which a line belongs to a repeat
    of some other pair may lose that line, so nothing is taken out for its sake: what goes has a whole copy that nothing touches.
    """
    base = docs.select(F.col("doc_id").alias("__id"), "text").where("doc_id is not null and text is not null")
    parts = _pairs(chunked(base))
    marks, marks_path = written(_repeated_marks(parts), "marks")
    rows = parts.select("__id", F.explode(F.transform("__marks", lambda m, i: F.struct(
        i.alias("start"), m.alias("mark"), F.concat_ws("\n", F.get("__lines", i), F.get("__lines", i + 1)).alias("bytes")
    ))).alias("__c")).select("__id", *[F.col(f"__c.{c}").alias(f"__{c}") for c in ("start", "mark", "bytes")])
    found, path = written(rows.join(broadcast_if_small(marks, marks.count()), "__mark", "left_semi").select("__id", "__start", "__mark", "__bytes"), "pairs")
    firsts, firsts_path = written(_firsts(found), "firsts")
    overlaps = (F.col("__id") == F.col("__first.__id")) & F.col("__start").isin(F.col("__first.__start"), F.col("__first.__start") + 1)
    again = lambda of: join_counted(found, of, ["__mark", "__bytes"], "__count", F.octet_length("__bytes")).where(~overlaps).select("__id", "__start", "__mark").distinct()
    every, every_path = written(again(firsts), "repeats")
    both = F.explode(F.array("__start", F.col("__start") + 1)).alias("__line")
    touched = every.select("__id", both).distinct()
    of_first = firsts.select(F.col("__first.__id").alias("__id"), F.col("__first.__start").alias("__start")).select("__id", "__start", both)
    spoilt = of_first.join(touched, ["__id", "__line"], "left_semi").select(F.struct("__id", "__start").alias("__first")).distinct()
    whole, whole_path = written(firsts.join(spoilt, "__first", "left_anti"), "whole-firsts")
    result, _ = written(again(whole), "surplus")
    remove(docs.sparkSession, path, marks_path, firsts_path, every_path, whole_path)
    return result


def drop_repeated_passages(docs: DataFrame) -> DataFrame:
    """Every row of ``docs`` with ``text`` changed and ``removed_lines`` added: each run of two or more lines that occurred before is out.

    Earlier is by doc_id, then place. Every pair of neighbouring lines that goes has a first occurrence that stays whole (:func:`repeated_pairs`).
    Rows with a null doc_id, repeated ids, null and one-line texts are treated as by :func:`drop_repeated_chunks`.
    """
    docs = docs.drop("removed_lines")
    surplus = repeated_pairs(docs)
    per_doc = surplus.groupBy("__id").agg(F.collect_set(_key(F.col("__start"), F.col("__mark"))).alias("__gone"))
    n = surplus.agg(F.count("*"), F.approx_count_distinct("__id")).first()
    per_doc = broadcast_if_small(per_doc, n[0] + 4 * n[1], row_bytes=12)
    parts = _pairs(docs.join(per_doc, F.col("doc_id") == F.col("__id"), "left").drop("__id"))
    # set operations on arrays of numbers only: linear in a text's lines
    here = F.array_intersect(F.transform("__marks", lambda m, i: _key(i, m)), "__gone")
    starts = parts.withColumn("__starts", F.transform(here, lambda k: F.shiftright(k, 32).cast("int")))
    lines = F.array_union("__starts", F.transform("__starts", lambda i: i + 1))
    kept = starts.withColumn("__kept", F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), lines))
    touched = F.col("__kept").isNotNull()
    text = F.array_join(F.transform("__kept", lambda i: F.get("__lines", i)), "\n")
    return kept.select(
        *[F.when(touched, text).otherwise(F.col("text")).alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns],
        F.when(touched, F.size("__lines") - F.size("__kept")).otherwise(0).cast("long").alias("removed_lines"),
    )


PASSAGES_ORACLE = """
WITH lines AS (
  SELECT doc_id, i, arr[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS arr FROM documents WHERE text IS NOT NULL), range(1, len(arr) + 1) AS t(i)
),
paired AS (SELECT *, lead(line) OVER (PARTITION BY doc_id ORDER BY i) AS next FROM lines),
pairs AS (SELECT * FROM paired WHERE next IS NOT NULL AND (trim(line, chr(32) || chr(9) || chr(13)) <> '' OR trim(next, chr(32) || chr(9) || chr(13)) <> '')),
ranked AS (SELECT *, first_value(doc_id) OVER w AS d0, first_value(i) OVER w AS i0 FROM pairs WINDOW w AS (PARTITION BY line, next ORDER BY doc_id, i)),
repeats AS (SELECT * FROM ranked WHERE NOT (doc_id = d0 AND i IN (i0, i0 + 1))),
touched AS (SELECT doc_id, i FROM repeats UNION SELECT doc_id, i + 1 FROM repeats),
again AS (SELECT r.doc_id, r.i FROM repeats r ANTI JOIN touched t ON t.doc_id = r.d0 AND (t.i = r.i0 OR t.i = r.i0 + 1)),
gone AS (SELECT doc_id, i FROM again UNION SELECT doc_id, i + 1 FROM again),
totals AS (SELECT doc_id, count(*) AS removed_lines FROM gone GROUP BY doc_id),
kept AS (SELECT l.doc_id, string_agg(line, chr(10) ORDER BY l.i) AS text FROM lines l ANTI JOIN gone g ON l.doc_id = g.doc_id AND l.i = g.i GROUP BY l.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text, coalesce(t.removed_lines, 0) AS removed_lines
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id LEFT JOIN totals t ON d.doc_id = t.doc_id
"""
