"""Numbered books made from the driver's documents, by a fixed recipe that plain SQL can repeat.

Each ``source`` is a book and its documents, by doc_id, are the entries. Leading words become headings, and a made-up
opening sentence names a neighbour's heading, so that chains, cycles and ambiguous openings occur.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiloom.checkpoints import shared_table
from lexiloom.rules import RULES, RuleSet
from lexiloom.sources.line_ranges import store_of


def numbered_lines(documents: DataFrame) -> DataFrame:
    """Lines of all books, with ``file_line`` counted from 1."""
    # Windows and numbering see the leading words and the number of lines of a document; its text meets them by key.
    by_doc = Window.partitionBy("source").orderBy("doc_id")
    words = F.split(F.trim("text"), r"\s+", 5)
    word = lambda k: F.coalesce(F.get(words, F.lit(k)), F.lit("x"))
    n_prose = F.size(F.split("text", "\n"))
    brief = documents.select("source", "doc_id", n_prose.alias("n_prose"), *[word(k).alias(f"w{k + 1}") for k in range(4)])
    named = brief.withColumn("seq", F.row_number().over(by_doc)).withColumn("n", F.concat_ws(" ", "w1", "w2"))
    near = lambda k: F.coalesce(F.lag("n", k).over(by_doc) if k > 0 else F.lead("n", -k).over(by_doc), F.lit("x"))
    letters = lambda c: F.regexp_replace(c, r"[^\p{L}]", "")
    # Lines of a document: heading, statement and blank, its own, and what the first of a source or a chapter has before them.
    n_lines = 3 + F.col("n_prose") + F.when(F.col("seq") == 1, 1).otherwise(0) + F.when((F.col("seq") - 1) % 12 == 0, 3).otherwise(0)
    earlier = F.coalesce(F.sum(n_lines).over(by_doc.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int")
    placed = named.select(
        "source", "doc_id", "seq", "n", "w3", "w4", near(1).alias("n1"), near(2).alias("n2"), near(-1).alias("nn"), letters(F.first("w1").over(by_doc)).alias("m"),
        letters(F.lead("w1", 1).over(by_doc)).alias("b2"), letters(F.lead("w1", 2).over(by_doc)).alias("b3"), letters(F.col("w1")).alias("b1"), earlier.alias("earlier"),
    )
    rows = documents.select("source", "doc_id", "text").join(placed, ["source", "doc_id"])
    seq, block = F.col("seq"), lambda n: F.lit(n)
    made = lambda blk, pos, line, when: F.when(when, F.struct(blk.alias("blk"), F.lit(pos).alias("pos"), line.alias("text")))
    every: Column = F.lit(True)
    heading = F.concat(
        seq.cast("string"), F.lit("—"), "n", F.when(seq % 3 != 0, F.concat(F.lit(" OR "), "w3", F.lit(" "), "w4", F.lit(" SAUCE"))).when(seq % 2 == 0, " SAUCE").otherwise(""), F.when(seq % 7 == 0, " WITH RICE").otherwise("")
    )
    stated = (
        F.when(seq % 10 == 1, F.concat(F.lit("Blend with "), "nn", F.lit(".")))
        .when(seq % 10 == 2, F.concat(F.lit("Blend with "), "n1", F.lit(".")))
        .when(seq % 4 == 0, F.concat(F.lit("Add one pint of "), "n1", F.when(seq % 8 == 0, F.concat(F.lit(" or "), "n2")).otherwise(""), F.lit(".")))
        .when(seq % 11 == 0, F.concat(F.lit("Finish with "), "m", F.lit(".")))
        .otherwise("Reduce the wine.")
    )
    bases = F.concat(F.lit("The basic sauces: "), "b1", F.lit(", "), F.coalesce("b2", F.lit("x")), F.lit(", and "), F.coalesce("b3", F.lit("x")), F.lit("."))
    opens = (seq - 1) % 12 == 0
    chapter = F.when(F.floor((seq - 1) / 12) % 2 == 0, "COLD SAUCES").otherwise("SOUPS")
    fixed = F.array(
        made(block(-1), 0, bases, seq == 1), made(block(0), 0, F.lit("CHAPTER IV"), opens), made(block(0), 1, F.lit(""), opens), made(block(0), 2, chapter, opens), made(block(1), 0, heading, every),
        made(block(2), 0, stated, every), made(block(2), 1, F.lit(""), seq % 5 != 0), made(block(3), 3, F.lit(""), seq % 5 == 0),
    )
    prose = F.transform(F.split("text", "\n"), lambda line, i: F.struct(F.lit(3).alias("blk"), (2 * i).alias("pos"), line.alias("text")))
    each = rows.select("source", "earlier", F.posexplode(F.array_sort(F.concat(F.array_compact(fixed), prose))).alias("at", "line"))
    idx = F.col("earlier") + F.col("at")
    return each.select(F.col("source").alias("source_id"), idx.alias("idx"), (idx + 1).alias("file_line"), F.col("line.text").alias("text"))


def spoilt(lines: DataFrame) -> DataFrame:
    """Three faulty books of each: without headings, without a word of the kind, and with a name that folds to nothing."""
    book = lambda kind: F.concat("source_id", F.lit(f"/{kind}")).alias("source_id")
    headless = lines.filter(~F.rlike("text", F.lit(r"^\d{1,4}—"))).select(book("headless"), "idx", "file_line", "text")
    plain = lines.select(book("plain"), "idx", "file_line", F.replace(F.replace("text", F.lit("SAUCE"), F.lit("DISH")), F.lit("sauce"), F.lit("dish")).alias("text"))
    added = lines.groupBy("source_id").agg((F.max("idx") + 1).alias("idx")).select(book("nameless"), "idx", (F.col("idx") + 1).alias("file_line"), F.lit("9999—SAUCE OR ***").alias("text"))
    return headless.unionByName(plain).unionByName(lines.select(book("nameless"), "idx", "file_line", "text")).unionByName(added)


def write_books(lines: DataFrame, folder: str, rules: RuleSet = RULES) -> DataFrame:
    """Write each book as a file (source_id, lines): packaging around it, CRLF at line ends; three lines stand before its first. Lines go out as they come."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = store_of(folder)
        store.create_dir(root, recursive=True)
        out, book, n = None, None, 0
        closing = f"{rules.end_marker} ***\r\nLicence".encode()
        for b in batches:
            for source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if source != book:
                    if out is not None:
                        out.write(closing)
                        out.close()
                        yield pa.RecordBatch.from_arrays([pa.array([book]), pa.array([n])], ["source_id", "lines"])
                    book, n, out = source, 0, store.open_output_stream(f"{root}/{source}.txt")
                    out.write(f"\ufeffTitle\r\n\r\n{rules.start_marker} ***\r\n".encode())
                out.write(f"{text}\r\n".encode())
                n += 1
        if out is not None:
            out.write(closing)
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([book]), pa.array([n])], ["source_id", "lines"])

    ordered = lines.select("source_id", "idx", "text").repartition("source_id").sortWithinPartitions("source_id", "idx")
    return shared_table(ordered.select("source_id", "text").mapInArrow(run, "source_id string, lines long"), "books")


def write_pages(documents: DataFrame, folder: str, rules: RuleSet = RULES) -> DataFrame:
    """Write each document as a wrapped file, faulty by its id modulo 7: 0 has a byte that is no UTF-8, 1 no start, 2 no end, 3 its end before its start."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = store_of(folder)
        store.create_dir(root, recursive=True)
        opening, closing = f"{rules.start_marker} ***\n".encode(), f"{rules.end_marker} ***\n".encode()
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                body, kind = f"{text or ''}.\n".encode(), doc_id % 7
                parts = {0: (opening, body, b"\xff\n", closing), 1: (body, closing), 2: (opening, body), 3: (closing, body, opening)}.get(kind, (b"Title\n", opening, body, closing))
                with store.open_output_stream(f"{root}/{doc_id}.txt") as out:
                    out.write(b"".join(parts))
            yield pa.RecordBatch.from_arrays([b.column(0)], ["doc_id"])

    return shared_table(documents.select("doc_id", "text").mapInArrow(run, "doc_id long"), "pages")


def read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the driver's documents, written once, since a catalogue reads them several times."""
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    # Files of several shuffled parts each: making a file may start processes, and a row group is what later tasks read, not a file.
    files = max(2 * spark.sparkContext.defaultParallelism, documents.rdd.getNumPartitions() // 4)
    return shared_table(numbered_lines(documents).coalesce(files), "lines")


#: The same recipe in DuckDB SQL, as the common table expression ``lines(source_id, idx, text)``.
SQL = r"""
docs AS (
  SELECT source, doc_id, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS seq,
    string_split(regexp_replace(trim(text), '\s+', ' ', 'g'), ' ') AS w, string_split(text, chr(10)) AS ls FROM documents),
worded AS (SELECT *, coalesce(w[1], 'x') AS w1, coalesce(w[2], 'x') AS w2, coalesce(w[3], 'x') AS w3, coalesce(w[4], 'x') AS w4 FROM docs),
named AS (
  SELECT *, w1 || ' ' || w2 AS n, regexp_replace(first_value(w1) OVER s, '[^\p{L}]', '', 'g') AS m, regexp_replace(w1, '[^\p{L}]', '', 'g') AS b1,
    regexp_replace(coalesce(lead(w1, 1) OVER s, 'x'), '[^\p{L}]', '', 'g') AS b2, regexp_replace(coalesce(lead(w1, 2) OVER s, 'x'), '[^\p{L}]', '', 'g') AS b3
  FROM worded WINDOW s AS (PARTITION BY source ORDER BY seq)),
near AS (SELECT *, coalesce(lag(n, 1) OVER s, 'x') AS n1, coalesce(lag(n, 2) OVER s, 'x') AS n2, coalesce(lead(n, 1) OVER s, 'x') AS nn FROM named WINDOW s AS (PARTITION BY source ORDER BY seq)),
pieces AS (
  SELECT source, seq, -1 AS blk, 0 AS pos, 'The basic sauces: ' || b1 || ', ' || b2 || ', and ' || b3 || '.' AS text FROM near WHERE seq = 1
  UNION ALL SELECT source, seq, 0, 0, 'CHAPTER IV' FROM near WHERE (seq - 1) % 12 = 0
  UNION ALL SELECT source, seq, 0, 1, '' FROM near WHERE (seq - 1) % 12 = 0
  UNION ALL SELECT source, seq, 0, 2, CASE WHEN ((seq - 1) // 12) % 2 = 0 THEN 'COLD SAUCES' ELSE 'SOUPS' END FROM near WHERE (seq - 1) % 12 = 0
  UNION ALL SELECT source, seq, 1, 0, seq || '—' || n || CASE WHEN seq % 3 <> 0 THEN ' OR ' || w3 || ' ' || w4 || ' SAUCE' WHEN seq % 2 = 0 THEN ' SAUCE' ELSE '' END || CASE WHEN seq % 7 = 0 THEN ' WITH RICE' ELSE '' END FROM near
  UNION ALL SELECT source, seq, 2, 0, CASE WHEN seq % 10 = 1 THEN 'Blend with ' || nn || '.' WHEN seq % 10 = 2 THEN 'Blend with ' || n1 || '.'
      WHEN seq % 4 = 0 THEN 'Add one pint of ' || n1 || CASE WHEN seq % 8 = 0 THEN ' or ' || n2 ELSE '' END || '.' WHEN seq % 11 = 0 THEN 'Finish with ' || m || '.' ELSE 'Reduce the wine.' END FROM near
  UNION ALL SELECT source, seq, 2, 1, '' FROM near WHERE seq % 5 <> 0
  UNION ALL SELECT source, seq, 3, 3, '' FROM near WHERE seq % 5 = 0
  UNION ALL SELECT source, seq, 3, (2 * (i - 1))::INTEGER, ls[i] FROM near, unnest(range(1, len(ls) + 1)) AS t(i)),
lines AS (SELECT source AS source_id, (row_number() OVER (PARTITION BY source ORDER BY seq, blk, pos) - 1)::INTEGER AS idx, text FROM pieces)"""

#: Line ends in the syntax of DuckDB's patterns.
SQL_LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"
