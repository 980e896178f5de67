"""Errors that a caller can expect; anything else is a defect."""


class CatalogueError(Exception):
    """Base of all expected errors."""


class SourceUnreadable(CatalogueError):
    """A source, or a stored catalogue, is missing, not text, cut short or damaged."""


class NothingExtracted(CatalogueError):
    """A source has no numbered entries, or none that belongs in a catalogue."""


class UnfoldableTerm(CatalogueError, ValueError):
    """A term has no letter or digit that a concept id could hold."""


class CatalogueUnwritable(CatalogueError):
    """A catalogue cannot be stored under its source id."""


class RootNotFound(CatalogueError):
    """No folder above the start holds the corpus."""
