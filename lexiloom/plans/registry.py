"""Queries of the catalogue engine over the driver's tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.checkpoints import shared_folder, shared_table
from lexiloom.functions.text import cut_prose, fold
from lexiloom.operators import derive, drafts, lineage, lint, names, query, structure
from lexiloom.plans import extraction, oracle
from lexiloom.plans.oracle import sql
from lexiloom.sources import catalogue_store, line_ranges, numbered_text, synthetic

FLAGSHIP = "census"
Query = Callable[[SparkSession, str], DataFrame]


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drafts without bodies."""
    return extraction.read_drafts(synthetic.read(spark, sf_dir)).drafts


def _named(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(drafts, candidates), written once as the extraction does."""
    lines = synthetic.read(spark, sf_dir)
    read = extraction.read_drafts(lines)
    bare = shared_table(read.drafts, "kept")
    return shared_table(drafts.with_bodies(bare, read.headings, lines), "drafts", few=True), shared_table(names.candidates(bare, read.bases), "candidates")


def fold_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", fold(F.col("text")).alias("concept"))


def line_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synthetic.read(spark, sf_dir).select("source_id", "idx", "text")


def entry_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.entries(synthetic.read(spark, sf_dir)).select("source_id", "entry", "idx", "title", "body", "in_kept_chapter")


def chapter_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.chapters(synthetic.read(spark, sf_dir))


def mothers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.declared_bases(synthetic.read(spark, sf_dir))


def sauce_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drafts(spark, sf_dir).select("source_id", "seq", F.col("ref.entry").alias("entry"), F.col("ref.line").alias("line"), "title", "concept")


def terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = _drafts(spark, sf_dir).select("source_id", "seq", F.posexplode("terms").alias("pos", "t"))
    return each.select("source_id", "seq", "pos", "t.surface", "t.language", "t.concept")


def names_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.first_names(_drafts(spark, sf_dir)).select("source_id", "name", "seq", "entry", "concept")


def parent_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = extraction.read_drafts(synthetic.read(spark, sf_dir))
    return names.candidates(shared_table(read.drafts, "kept"), read.bases).select("source_id", "name", "key_entry", "key_concept", "records", "base")


def _stated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive.statements(*_named(spark, sf_dir))


_PLACES = ("source_id", "seq", "entry", "seg", "start", "end", "name", "key", "records", "base")


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stated(spark, sf_dir).select(*_PLACES)


def unshadowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive.uncovered(_stated(spark, sf_dir)).select(*_PLACES)


def resolved_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive.stated_parents(derive.uncovered(_stated(spark, sf_dir)))


def cycle_clear(spark: SparkSession, sf_dir: str) -> DataFrame:
    draft, reached = _named(spark, sf_dir)
    parents = derive.parents_by_entry(draft, derive.stated_parents(derive.uncovered(derive.statements(draft, reached))))
    return derive.on_cycles(derive.parent_edges(parents.filter("parent is not null"), reached))


def _extracted(spark: SparkSession, sf_dir: str) -> extraction.Extracted:
    return extraction.extract(synthetic.read(spark, sf_dir))


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _extracted(spark, sf_dir).catalogue.select("source_id", "seq", "title", "concept", F.col("ref.entry").alias("entry"), F.col("ref.line").alias("line"), "body", "parent")


def census(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _extracted(spark, sf_dir)
    return query.census(out.catalogue, out.bases)


def diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = synthetic.read(spark, sf_dir)
    read = extraction.read_drafts(lines)
    return query.diagnostics(lines, read.headings, read.drafts, read.unfoldable)


def faulty_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statuses of books spoilt by a fixed recipe: no headings, no kept entry, a name that folds to nothing."""
    lines = synthetic.spoilt(synthetic.read(spark, sf_dir))
    read = extraction.read_drafts(lines)
    return query.diagnostics(lines, read.headings, read.drafts, read.unfoldable)


def wrapped_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines read back by byte ranges from one file for each book: packaging before and behind it, CRLF at every line's end."""
    folder = shared_folder(spark, "books")
    synthetic.write_books(synthetic.read(spark, sf_dir), folder)
    return numbered_text.scanned(line_ranges.pieces(spark, folder, 1 << 20))[0]


def file_statuses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status and number of body lines of one file for each document, some of them faulty in each way."""
    folder = shared_folder(spark, "pages")
    synthetic.write_pages(_documents(spark, sf_dir), folder)
    lines, files = numbered_text.scanned(line_ranges.pieces(spark, folder, 1 << 22))
    counts = lines.groupBy("source_id").agg(F.count("*").alias("lines"))
    return files.join(counts, "source_id", "left").select("source_id", "status", F.coalesce("lines", F.lit(0)).alias("lines"))


def quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is found wrong with stored rows that were spoilt by their place modulo 7: cut off, without a body, in an unknown language, with an empty parent, without an entry."""
    rows = _extracted(spark, sf_dir).catalogue
    kind = F.col("seq") % 7
    terms = F.transform("terms", lambda t: F.struct(t["surface"].alias("surface"), F.when(kind == 2, "de").otherwise(t["language"]).alias("language"), t["concept"].alias("concept")))
    ref = F.struct(F.col("ref.source_id").alias("source_id"), F.when(kind == 4, 0).otherwise(F.col("ref.entry")).alias("entry"), F.col("ref.line").alias("line"))
    row = F.struct("seq", "title", terms.alias("terms"), "concept", F.when(kind != 1, F.col("body")).alias("body"), ref.alias("ref"), F.when(kind == 3, "").otherwise(F.col("parent")).alias("parent"))
    said = F.to_json(row, {"ignoreNullFields": "false"})
    path = shared_folder(spark, "spoilt")
    rows.select("source_id", F.when(kind == 0, F.left(said, F.lit(20))).otherwise(said).alias("value")).write.partitionBy("source_id").text(path)
    return catalogue_store.sorted_out(spark, path)[1].select("source_id", F.when(F.col("raw").isNull(), F.col("seq")).alias("seq"), "reason")


def stored_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue, stored as JSON documents by source and loaded again with all checks."""
    path = shared_folder(spark, "stored")
    catalogue_store.save_table(_extracted(spark, sf_dir).catalogue, path)
    return catalogue_store.load_table(spark, path).select("source_id", "seq", "title", "concept", F.col("ref.entry").alias("entry"), F.col("ref.line").alias("line"), "parent")


def _questions(out: extraction.Extracted) -> DataFrame:
    """Every name, every first word of a name, every declared base, and a name that nothing has."""
    first = names.first_names(out.catalogue)
    words = first.select("source_id", F.explode(F.array("name", F.substring_index("name", "-", 1), F.lit("nowhere-named"))).alias("wanted"))
    return words.unionByName(out.bases.select("source_id", F.col("concept").alias("wanted"))).distinct()


def matches_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _extracted(spark, sf_dir)
    return query.matches(out.catalogue, out.bases, _questions(out)).select("source_id", "wanted", "rank", "seq", "title")


def matches_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same questions, answered from an index of runs that is stored in buckets."""
    out = _extracted(spark, sf_dir)
    path = shared_folder(spark, "runs")
    table = "runs_" + path.rsplit("-", 1)[-1]
    names.store_index(out.catalogue, table, path, 16)
    answers = names.indexed_lookups(spark.table(table), out.bases, _questions(out))
    return answers.join(out.catalogue.select("source_id", "seq", "title"), ["source_id", "seq"]).select("source_id", "wanted", "rank", "seq", "title")


def find_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _extracted(spark, sf_dir)
    return query.find(out.catalogue, out.bases, _questions(out)).select("source_id", "wanted", "seq", "title")


def children_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _extracted(spark, sf_dir)
    return query.children(out.catalogue, out.bases, _questions(out))


def derivation_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _extracted(spark, sf_dir)
    nodes = lineage.derivation_trees(out.catalogue, out.bases, out.bases.select("source_id", F.col("concept").alias("root")))
    return nodes.select("source_id", "root", F.array_join(F.transform("path", lambda x: x.cast("string")), "/").alias("path"), "depth", "title", "languages", "concept", "last")


def ancestor_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _extracted(spark, sf_dir)
    return lineage.ancestors(out.catalogue, out.bases)


def detail_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = F.coalesce("parent", F.lit("(unresolved)"))
    return _extracted(spark, sf_dir).catalogue.select("source_id", "seq", "title", shown.alias("parent"), cut_prose(F.col("body"), 600).alias("prose"), query.languages_label().alias("languages"))


def provenance_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = synthetic.read(spark, sf_dir)
    return query.misquoted(extraction.extract(lines).catalogue, lines).select("source_id", "seq", "entry", "line")


def misquoted_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations that do not hold in a catalogue where every fifth cites a line too far on, and every seventh one that is not there."""
    lines = synthetic.read(spark, sf_dir)
    line = F.col("ref.line") + F.when(F.col("seq") % 5 == 0, 1).otherwise(0) + F.when(F.col("seq") % 7 == 0, 100_000_000).otherwise(0)
    moved = extraction.extract(lines).catalogue.withColumn("ref", F.struct(F.col("ref.source_id").alias("source_id"), F.col("ref.entry").alias("entry"), line.alias("line")))
    return query.misquoted(moved, lines).select("source_id", "seq", "entry", "line")


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select(F.col("doc_id").cast("string").alias("path"), "text")


def prose_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Semicolons, em dashes, words of praise and long sentences in all documents."""
    return lint.prose_findings(_pages(spark, sf_dir))


def open_fences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose last code block is not closed, every eleventh having one opened."""
    opened = F.when(F.col("path").cast("long") % 11 == 0, F.concat("text", F.lit("\n```\ncode"))).otherwise(F.col("text"))
    return lint.open_fences(_pages(spark, sf_dir).withColumn("text", opened))


def term_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with a word that only the documents of one source may use, and allowances that nothing uses."""
    allowed = _documents(spark, sf_dir).filter("source = 'src0'").select(F.col("doc_id").cast("string").alias("path"))
    return lint.term_report(_pages(spark, sf_dir), "License", allowed)


def queries() -> dict[str, Query]:
    found = (
        fold_concepts, line_scan, entry_segments, chapter_spans, mothers, sauce_filter, terms, names_first_wins, parent_candidates, statements, unshadowed, resolved_parent, cycle_clear, catalogue, census, diagnostics,
        matches_ranked, find_best, children_of, derivation_tree, ancestor_chains, detail_view, provenance_check, faulty_sources, wrapped_source, stored_catalogue,
        matches_indexed, file_statuses, quarantine, misquoted_lines, prose_findings, open_fences, term_report,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    spot = 'source_id, seq, entry, seg, start, stop AS "end", name, key, records, base'
    ranked = "SELECT r.source_id, r.wanted, r.rank, r.seq, c.title FROM ranked r JOIN asked a ON r.source_id = a.source_id AND r.wanted = a.wanted JOIN catalogue c ON r.source_id = c.source_id AND r.seq = c.seq"
    return {
        "fold_concepts": f"SELECT doc_id, nullif({oracle.fold('text')}, '') AS concept FROM documents",
        "line_scan": sql("lines", "SELECT source_id, idx, text FROM lines"),
        "entry_segments": sql("entries", "SELECT source_id, entry, idx, title, body, inside AS in_kept_chapter FROM entries"),
        "chapter_spans": sql("chapters", "SELECT source_id, start_idx, end_idx, title, kept FROM chapters"),
        "mothers": sql("mothers", "SELECT source_id, concept FROM mothers"),
        "sauce_filter": sql("draft", "SELECT source_id, seq, entry, idx + 1 AS line, title, concept FROM draft"),
        "terms": sql("terms", "SELECT source_id, seq, pos, surface, language, concept FROM terms"),
        "names_first_wins": sql("names", "SELECT source_id, name, seq, entry, concept FROM names"),
        "parent_candidates": sql("candidates", "SELECT source_id, name, key_entry, key_concept, records, base FROM candidates"),
        "statements": sql("statements", f"SELECT {spot} FROM statements"),
        "unshadowed": sql("live", f"SELECT {spot} FROM live"),
        "resolved_parent": sql("stated", "SELECT source_id, seq, parent FROM stated"),
        "cycle_clear": sql("cyclic", "SELECT source_id, entry FROM cyclic"),
        "catalogue": sql("catalogue", "SELECT source_id, seq, title, concept, entry, line, body, parent FROM catalogue"),
        "census": sql(
            "catalogue",
            "SELECT c.source_id, coalesce((SELECT string_agg(concept, ', ' ORDER BY concept) FROM mothers m WHERE m.source_id = c.source_id), '') AS mothers, count(*) AS sauces, count(parent) AS derived, count(*) - count(parent) AS unresolved FROM catalogue c GROUP BY c.source_id",
        ),
        "diagnostics": sql("unfoldable", oracle.DIAGNOSTICS),
        "faulty_sources": sql("unfoldable", oracle.DIAGNOSTICS, oracle.FAULTY),
        "wrapped_source": sql("lines", oracle.READ_BACK),
        "file_statuses": oracle.STATUSES,
        "quarantine": sql("catalogue", oracle.DAMAGED),
        "misquoted_lines": sql("catalogue", "SELECT c.source_id, c.seq, c.entry, (c.line + CASE WHEN c.seq % 5 = 0 THEN 1 ELSE 0 END + CASE WHEN c.seq % 7 = 0 THEN 100000000 ELSE 0 END)::INTEGER AS line FROM catalogue c WHERE c.seq % 5 = 0 OR c.seq % 7 = 0"),
        "prose_findings": oracle.PROSE,
        "open_fences": oracle.FENCES,
        "term_report": oracle.TERMS,
        "stored_catalogue": sql("catalogue", "SELECT source_id, seq, title, concept, entry, line, parent FROM catalogue"),
        "matches_ranked": sql("found", ranked),
        "matches_indexed": sql("found", ranked),
        "find_best": sql("found", "SELECT r.source_id, r.wanted, r.seq, c.title FROM best r JOIN asked a ON r.source_id = a.source_id AND r.wanted = a.wanted JOIN catalogue c ON r.source_id = c.source_id AND r.seq = c.seq"),
        "children_of": sql("children", "SELECT h.source_id, h.wanted, h.seq FROM children h JOIN asked a ON h.source_id = a.source_id AND h.wanted = a.wanted"),
        "derivation_tree": sql("tree", "SELECT source_id, root, array_to_string(path, '/') AS path, len(path)::INTEGER AS depth, title, languages, concept, lead(path) OVER (PARTITION BY source_id, root, path[1:len(path) - 1] ORDER BY path) IS NULL AS last FROM nodes"),
        "ancestor_chains": sql("up", "SELECT source_id, seq, (len(path) - 1)::INTEGER AS depth, path[-1] AS ancestor FROM up"),
        "detail_view": sql(
            "catalogue",
            "SELECT c.source_id, c.seq, title, coalesce(parent, '(unresolved)') AS parent, CASE WHEN length(body) <= 600 THEN body ELSE left(body, 600) || '...' || chr(10) || '[' || (length(body) - 600) || ' more characters, raise --chars to read them]' END AS prose, coalesce((SELECT string_agg(DISTINCT language, '/' ORDER BY language) FROM terms t WHERE t.source_id = c.source_id AND t.seq = c.seq), '') AS languages FROM catalogue c",
        ),
        "provenance_check": sql("catalogue", "SELECT c.source_id, c.seq, c.entry, c.line FROM catalogue c LEFT JOIN lines l ON c.source_id = l.source_id AND c.line = l.idx + 1 WHERE NOT coalesce(starts_with(l.text, c.entry || '—'), false)"),
    }
