"""From lines to the catalogue."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from lexiloom.checkpoints import shared_table
from lexiloom.errors import NothingExtracted, UnfoldableTerm
from lexiloom.operators import derive, drafts, names, query, structure
from lexiloom.rules import RULES, RuleSet


@dataclass(frozen=True)
class Extracted:
    """Tables of all sources at once, keyed by source_id. The catalogue leaves out names that fold to nothing; ``unfoldable`` has them."""

    catalogue: DataFrame
    bases: DataFrame
    diagnostics: DataFrame
    unfoldable: DataFrame


@dataclass(frozen=True)
class Drafted:
    """What headings and declarations say, all of it written but the drafts: (source_id, name) declared, headings, bases, and drafts without bodies."""

    declared: DataFrame
    headings: DataFrame
    bases: DataFrame
    drafts: DataFrame
    unfoldable: DataFrame


def read_drafts(lines: DataFrame, rules: RuleSet = RULES) -> Drafted:
    """Headings are written, as drafts, their places, statuses and nameless ones read them; so are declared names."""
    declared = shared_table(structure.declared_names(lines, rules), "declared")
    # Headings are few among the lines whose windows find them, and are dealt anew into few files.
    found = shared_table(structure.headings(lines, rules).hint("rebalance"), "headings")
    bases = shared_table(structure.bases_of(declared), "bases")
    return Drafted(declared, found, bases, drafts.drafts(found, bases, rules), drafts.unfoldable(declared, found, bases, rules))


def extract(lines: DataFrame, rules: RuleSet = RULES) -> Extracted:
    """All catalogues. Drafts are read several times, so they and the names are written once."""
    read = read_drafts(lines, rules)
    bare = shared_table(read.drafts, "kept")
    draft = shared_table(drafts.with_bodies(bare, read.headings, lines), "drafts", few=True)
    reached = shared_table(names.candidates(bare, read.bases), "candidates")
    return Extracted(derive.with_parents(draft, reached, rules), read.bases, query.diagnostics(lines, read.headings, bare, read.unfoldable), read.unfoldable)


def extract_one(lines: DataFrame, rules: RuleSet = RULES) -> Extracted:
    """The catalogue of one source; without a usable row the reason is raised."""
    out = extract(lines, rules)
    row = out.diagnostics.first()
    name = row["source_id"] if row else "the source"
    if row is not None and row["status"] == "unfoldable":
        raise UnfoldableTerm(f"{name}: surface form yields an empty concept id: {out.unfoldable.agg({'surface': 'min'}).first()[0]!r}")
    if row is None or row["status"] == "no_entries":
        raise NothingExtracted(f"no numbered entries in {name}")
    if row["status"] == "none_kept":
        raise NothingExtracted(f"{row['entries']} entries in {name}, none of them a sauce")
    if faulty := drafts.faulty_refs(out.catalogue).first():
        raise ValueError(f"entry and line must be 1 or greater: {faulty['ref']['entry']}, {faulty['ref']['line']}")
    return out
