"""Column expressions for corpus cleaning (all JVM-side, codegen friendly).

Every function takes and returns a ``Column`` so that the cleaning plan is a
single projection that Catalyst can fuse into the scan stage.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference behaviour (do not edit).
# Action names of the cleaning step, in the order the reference applies them.
ACTION_REMOVE_NEWLINES = "remove_newline_and_carriage_returns"
ACTION_SZ_IN_MUSS = "replace_sz_in_muss"
ACTION_ALL_SZ = "replace_all_sz"
ACTION_PARAGRAPH_WORD = "replace_paragraphsign_with_word"
ACTION_NON_GERMAN = "replace_non_german_chars_with_space"
ACTION_PUNCTUATION = "replace_punctuation_with_space"
ACTION_PUNCTUATION_KEEP_HYPHEN = "replace_punctuation_with_space_except_hyphen"
ACTION_MIN_TWO_CHARS = "discard_words_less_two_characters"
ACTION_LOWERCASE = "transform_to_lowercase"
ACTION_SINGLE_LINE = "save_as_single_line"
ACTION_MULTIPLE_LINES = "save_as_multiple_lines"

# Default action list of the cleaning stage.
DEFAULT_CORPUS_ACTIONS = (
    ACTION_REMOVE_NEWLINES,
    ACTION_SZ_IN_MUSS,
    ACTION_PARAGRAPH_WORD,
    ACTION_NON_GERMAN,
    ACTION_MIN_TWO_CHARS,
    ACTION_LOWERCASE,
    ACTION_SINGLE_LINE,
)

# Replacement texts and character classes.
PARAGRAPH_SIGN = "§"
PARAGRAPH_WORD = "PARAGRAPHSIGN "
GERMAN_LETTERS_CLASS = "[^a-zA-ZüöäÜÖÄß]"
# Python's Unicode ``\s`` as a Java class: White_Space plus the four ASCII
# information separators \x1c-\x1f.
WHITESPACE_CLASS = r"\p{IsWhite_Space}\x1c-\x1f"
PUNCTUATION_CLASS = r"[^\p{L}\p{N}_" + WHITESPACE_CLASS + r"]|[0-9_]"
PUNCTUATION_KEEP_HYPHEN_CLASS = r"[^\p{L}\p{N}_" + WHITESPACE_CLASS + r"-]|[0-9_]"
LOOSE_HYPHEN_PATTERN = r"-[" + WHITESPACE_CLASS + r"]-|[" + WHITESPACE_CLASS + r"]-|-[" + WHITESPACE_CLASS + r"]"
# Transliteration used by the projector export (lower-case forms only).
TRANSLITERATION = (("ü", "ue"), ("ö", "oe"), ("ä", "ae"), ("ß", "ss"))
# ---------------------------------------------------------------------------


def doc_id_from_file_name(file_name: Column) -> Column:
    """Drop every ``.json`` and every ``RW40_`` from a file name."""
    return F.replace(F.replace(file_name, F.lit(".json"), F.lit("")), F.lit("RW40_"), F.lit(""))


def cut_at_own_id(text: Column, doc_id: Column) -> Column:
    """Keep the text before the first occurrence of its own id (whole text if absent)."""
    return F.when(F.length(doc_id) == 0, text).otherwise(F.call_function("substring_index", text, doc_id, F.lit(1)))


def remove_newlines(text: Column) -> Column:
    """Delete ``\\n`` and ``\\r`` (words across a line end fuse)."""
    return F.translate(text, "\n\r", "")


def replace_sz_in_muss(text: Column) -> Column:
    """T4: ``muß`` -> ``muss`` (case-sensitive, also inside longer words)."""
    return F.replace(text, F.lit("muß"), F.lit("muss"))


def replace_all_sz(text: Column) -> Column:
    """T5: every ``ß`` -> ``ss``."""
    return F.replace(text, F.lit("ß"), F.lit("ss"))


def replace_paragraph_sign(text: Column) -> Column:
    """``§`` -> ``PARAGRAPHSIGN `` (with trailing space)."""
    return F.replace(text, F.lit(PARAGRAPH_SIGN), F.lit(PARAGRAPH_WORD))


def replace_non_german(text: Column) -> Column:
    """Every character outside a-z, A-Z, umlauts and ß becomes one space."""
    return F.regexp_replace(text, GERMAN_LETTERS_CLASS, " ")


def replace_punctuation(text: Column) -> Column:
    """Punctuation, ASCII digits and ``_`` become one space (Unicode letters kept)."""
    return F.regexp_replace(text, PUNCTUATION_CLASS, " ")


def replace_punctuation_keep_hyphen(text: Column) -> Column:
    """As T8 but hyphens are kept, then hyphens next to whitespace are dropped."""
    kept = F.regexp_replace(text, PUNCTUATION_KEEP_HYPHEN_CLASS, " ")
    return F.regexp_replace(kept, LOOSE_HYPHEN_PATTERN, " ")


def split_on_space(text: Column) -> Column:
    """Split on the single space char, keeping empty tokens."""
    return F.split(text, " ", -1)


def drop_short_tokens(tokens: Column, min_len: int = 2) -> Column:
    """Drop tokens shorter than ``min_len`` characters."""
    return F.filter(tokens, lambda t: F.length(t) >= min_len)


def lowercase_tokens(tokens: Column) -> Column:
    """Lowercase every token."""
    return F.transform(tokens, lambda t: F.lower(t))


def join_tokens(tokens: Column) -> Column:
    """Rejoin tokens with one space."""
    return F.array_join(tokens, " ")


def whitespace_tokens(text: Column) -> Column:
    """Tokens separated by any run of (Unicode) whitespace, no empty tokens."""
    return F.filter(F.split(text, "[" + WHITESPACE_CLASS + "]+", -1), lambda t: t != "")


def transliterate(word: Column) -> Column:
    """``ü->ue ö->oe ä->ae ß->ss``."""
    out = word
    for src, dst in TRANSLITERATION:
        out = F.replace(out, F.lit(src), F.lit(dst))
    return out


def percent_text(part: Column, total: Column) -> Column:
    """Percentage with one decimal (as a number)."""
    return F.round(F.try_divide(part * 100.0, total), 1)


def parse_int_list(text: Column) -> Column:
    """``"[1, 2, 3]"`` -> array<int>."""
    return F.from_json(text, "array<int>")


def synset_node_name(synset: Column) -> Column:
    """Node naming ``synset_<id>``."""
    return F.concat(F.lit("synset_"), synset.cast("string"))
