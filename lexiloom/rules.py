"""What a source's own conventions are: markers, patterns and word lists of one kind of numbered book.

Another kind of book gets its own ``RuleSet``; no operator holds a pattern of its own. Patterns are in
Java syntax with Unicode classes on. Python's white space holds U+001C to U+001F, which Java's does not.
"""

from __future__ import annotations

from dataclasses import dataclass, field

GAP = r"[\s\x1c-\x1f]"


@dataclass(frozen=True)
class RuleSet:
    # They must equal the published conventions for right results.
    start_marker: str = "*** START OF THE PROJECT GUTENBERG EBOOK"
    end_marker: str = "*** END OF THE PROJECT GUTENBERG EBOOK"
    heading: str = r"(?Ud)^(\d{1,4})—(.+)$"
    declaration: str = r"(?isuU)basic sauces?:[\s\x1c-\x1f]*(.+?)\."
    declaration_opens: str = r"(?iuU)basic sauces?:"
    declaration_parts: str = r"(?U),|\band\b"
    alternatives: str = r"(?iuU)[\s\x1c-\x1f]+OR[\s\x1c-\x1f]+"
    alternative_edges: str = " .,—"
    chapter: str = r"(?U)^CHAPTER[\s\x1c-\x1f]+[IVXL]+$"
    chapter_edges: str = "="
    chapter_title_lines: int = 5
    chapter_kept: str = r"(?iuU)\bSAUCES?\b"
    kind: str = r"(?iuU)\bSAUCE\b"
    kind_served: str = r"(?iuU)\bWITH\b"
    kind_beside: str = r"(?iuU),[\s\x1c-\x1f]*SAUCE\b"
    french_opening: str = "SAUCE "
    french_words: tuple[str, ...] = field(default=("espagnole", "veloute", "bechamel", "hollandaise", "roux", "glace-de-viande"))
    sentence_end: str = r"[.!?;:]"
    paragraph_end: str = "\n\n"


RULES = RuleSet()
