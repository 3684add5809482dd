"""Column functions over text. All of them stay inside the JVM.

Fence state (is this line inside a fenced block?) is left to the regular-expression engine: an alternation whose first
branch swallows a whole fenced block makes every later branch see only text outside fences. NUL serves as separator,
because the document contract refuses documents that contain it.

Patterns use possessive quantifiers and look-behinds at run starts so that matching stays linear in the text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NUL = "\x00"
_WS = r"\p{javaWhitespace}"
#: The characters of that class.
_WS_CHARACTERS = "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2008\u2009\u200a\u2028\u2029\u205f\u3000"
_BLANK = r"[\p{javaWhitespace}&&[^\n]]"
_HEAD_WS = r"[ \t\x0B\f]"

# One ATX heading line: at most three blanks, one to six hashes, then blanks and a title, or the end of the line.
_HEADING = rf"{_HEAD_WS}{{0,3}}#{{1,6}}(?:{_HEAD_WS}[^\n\u0085\u2028\u2029]*)?$"


def _fence(tick_info: str) -> str:
    """A fenced block from its opening line to its closing line, or to the end of the text.

    ``tick_info`` matches the rest of an opening line made of backticks.
    """
    def block(mark: str, name: str, info: str) -> str:
        closing = rf"\n {{0,3}}\k<{name}>{mark}*+{_BLANK}*+$"
        return rf"(?<{name}>{mark}{{3,}}+){info}(?:[\s\S]*?{closing}|[\s\S]*+)"

    return rf"^ {{0,3}}(?:{block('`', 'tick', tick_info)}|{block('~', 'tilde', '[^' + chr(92) + 'n]*+$')})"


# The section rule accepts any info string; the chunk rule refuses a backtick in the info of a backtick fence.
SECTION_FENCE = _fence(r"[^\n]*+$")
CHUNK_FENCE = _fence(r"[^`\n]*+$")
_CHUNK_FENCE_OPENING = r"^ {0,3}(?:`{3,}+[^`\n]*+(?:\n|\z)|~{3,}+)"


def strip(text: Column) -> Column:
    """Remove white space at both ends (Unicode white space, not no-break spaces). Only the ends are looked at, not every blank between."""
    return F.btrim(text, F.lit(_WS_CHARACTERS))


def is_blank(text: Column) -> Column:
    return ~text.rlike(rf"[^{_WS}]")


def decode_text(content: Column) -> Column:
    """UTF-8 bytes to text: no byte order mark, all line ends as line feeds."""
    text = F.make_valid_utf8(content.cast("string"))
    return F.regexp_replace(F.regexp_replace(text, r"\A\ufeff", ""), r"\r\n?", "\n")


def trim_blank_lines(text: Column) -> Column:
    """Drop blank lines at the start and at the end; the remaining lines are untouched."""
    head = F.regexp_replace(text, rf"\A{_WS}*\n", "")
    both = F.regexp_replace(head, rf"(?<!{_WS})({_BLANK}*+)\n{_WS}*+\z", "$1")
    return F.when(is_blank(text), F.lit("")).otherwise(both)


def markdown_pieces(text: Column) -> Column:
    """Split Markdown before each heading outside fences; element 0 is the text before the first heading."""
    marked = F.regexp_replace(text, rf"(?dm)({SECTION_FENCE})|^(?={_HEADING})", "$1" + NUL)
    # The mark after a fence is followed by a line end, never by a heading, so only heading marks split.
    return F.split(marked, rf"(?dm)\x00(?={_HEADING})", -1)


def without_marks(piece: Column) -> Column:
    return F.translate(piece, NUL, "")


def heading_level(piece: Column) -> Column:
    return F.length(F.regexp_extract(piece, rf"\A{_HEAD_WS}{{0,3}}(#{{1,6}})", 1))


def heading_title(piece: Column) -> Column:
    """Title of a heading line: closing hashes removed, stripped."""
    raw = F.regexp_extract(piece, rf"(?d)\A{_HEAD_WS}{{0,3}}#{{1,6}}(?:{_HEAD_WS}+|(?=\n|\z))([^\n]*)", 1)
    return strip(F.regexp_replace(raw, rf"(?<!{_HEAD_WS}){_HEAD_WS}++#++{_HEAD_WS}*+\z", ""))


def after_first_line(piece: Column) -> Column:
    return F.regexp_replace(piece, r"\A[^\n]*+\n?", "")


def slug(normalised_title: Column) -> Column:
    """Lower case, runs of other than letters and digits to one dash, no dash at the ends, never empty."""
    dashed = F.regexp_replace(F.lower(normalised_title), r"[^\p{L}\p{N}]+", "-")
    trimmed = F.regexp_replace(dashed, r"\A-++|-++\z", "")
    return F.when(trimmed == "", F.lit("section")).otherwise(trimmed)


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits, in order."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def fence_lines(text: Column) -> Column:
    """One struct (line, in_fence) per line of the text; opening and closing lines count as inside."""
    # The added line feed ends the last line, so that every line has one.
    blocks = F.regexp_extract_all(
        F.concat(text, F.lit("\n")), F.lit(rf"(?dm)(?:{SECTION_FENCE})(?:\n|\z)|^[^\n]*+\n"), 0)

    def lines(block: Column) -> Column:
        fenced = block.rlike(r"\A {0,3}(?:`{3,}|~{3,})")
        return F.transform(
            F.split(F.regexp_replace(block, r"\n\z", ""), "\n", -1),
            lambda line: F.struct(line.alias("line"), fenced.alias("in_fence")),
        )

    return F.flatten(F.transform(blocks, lines))


# ---------------------------------------------------------------------------------------------- chunking

# A sentence ends after a strong stop, with or without white space behind it. It ends after a full stop only when white
# space follows and then an opening bracket, or a letter that is not lower case (quotes may stand in front of it).
# Closing quotes, brackets and further stops stay with the sentence.
STRONG_END = r"""([!?。！？][!?。！？.\p{Pe}\p{Pf}"']*+)\s*+(?=\S)"""
FULL_STOP_END = r"""(\.[.\p{Pe}\p{Pf}"']*+)\s++(?=\p{Ps}|[\p{Pi}"']*+[\p{Lu}\p{Lt}\p{Lm}\p{Lo}])"""


def mark_sentences(paragraph: Column) -> Column:
    """Replace the white space between sentences by NUL."""
    return F.regexp_replace(F.regexp_replace(paragraph, STRONG_END, "$1" + NUL), FULL_STOP_END, "$1" + NUL)


def chunk_units(content: Column) -> Column:
    """Fenced blocks and raw paragraphs of a section, in order (fences verbatim, paragraphs not yet normalised)."""
    marked = F.regexp_replace(content, rf"(?dm)({CHUNK_FENCE})|^{_BLANK}*+$", NUL + "$1" + NUL)
    return F.filter(F.split(marked, r"\x00+"), lambda u: ~is_blank(u))


def is_code_unit(unit: Column) -> Column:
    return unit.rlike(_CHUNK_FENCE_OPENING)


def normalise_paragraph(unit: Column) -> Column:
    return strip(F.regexp_replace(unit, r"(?U)\s+", " "))


def slice_code(unit: Column, n: int) -> Column:
    """Cut a fenced block every n characters; nothing is stripped."""
    return F.regexp_extract_all(unit, F.lit(rf"(?s).{{1,{n}}}"), 0)


def pack_sentences(paragraph: Column, n: int) -> Column:
    """Greedy packing of whole sentences into at most n characters; a longer single sentence stays whole.

    With breaks marked by NUL a pack is the longest run of at most n characters that ends at a mark, which is what a
    greedy quantifier finds.
    """
    marked = mark_sentences(paragraph)
    pattern = rf"(?s)(?<![^\x00])(?:[^\x00]{{{n + 1},}}+|[^\x00].{{0,{n - 1}}})(?![^\x00])"
    return F.transform(F.regexp_extract_all(marked, F.lit(pattern), 0), lambda p: F.translate(p, NUL, " "))


def hard_split(text: Column, n: int) -> Column:
    """Cut at the last white space inside each window of n characters, otherwise at n."""
    if n < 2:
        raise ValueError("n must be at least 2")
    stay = rf"[^{_WS}].{{0,{n - 1}}}\z"
    at_space = rf"[^{_WS}].{{0,{n - 2}}}(?={_WS})"
    pattern = rf"(?s){stay}|{at_space}|[^{_WS}].{{{n - 1}}}"
    return F.transform(F.regexp_extract_all(text, F.lit(pattern), 0), strip)


def chunk_texts(content: Column, n: int) -> Column:
    """Chunks of one section, each of at most n characters."""
    def paragraph_chunks(p: Column) -> Column:
        packs = F.flatten(F.transform(
            pack_sentences(p, n),
            lambda s: F.when(F.length(s) > n, hard_split(s, n)).otherwise(F.array(s)),
        ))
        return F.when(F.length(p) <= n, F.array(p)).otherwise(packs)

    def unit_chunks(u: Column) -> Column:
        return F.when(is_code_unit(u), slice_code(u, n)).otherwise(
            # A one-element transform binds the normalised paragraph, so that it is computed once.
            F.flatten(F.transform(F.array(normalise_paragraph(u)), paragraph_chunks))
        )

    return F.filter(F.flatten(F.transform(chunk_units(content), unit_chunks)), lambda c: c != "")
