"""Column expressions (all JVM-side built-ins)."""

from .text import (  # noqa: F401
    BLOCKED_HEADINGS, py_strip, article_section_texts, line_class,
    query_text, passage_text, section_headers, letter_to_index, index_to_letter,
)
from .vector import sq_l2, l2_normalize  # noqa: F401
