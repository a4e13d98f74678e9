"""Detectors of single characters: invisible, bidirectional, tags, look-alikes.

Each takes files(path, content) and returns findings.  Columns count code
points.  Files and lines without a wanted character are dropped by a regular
expression; ``character_findings`` runs any of the detectors in one pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fixed import BIDI_NAMES, BIDI_SEVERITY, CONFUSABLES, INVISIBLE_RANGES, ZERO_WIDTH_NAMES
from ..functions.text import WORD, beside_emoji, char_class, chars, in_ranges, lines
from .findings import exploded, finding_columns, lookup

_INVISIBLE = [(a, b) for _, a, b, _ in INVISIBLE_RANGES]
_CRITICAL = [(a, b) for _, a, b, critical in INVISIBLE_RANGES if critical]
_SELECTORS = [(0xFE00, 0xFE0F), (0xE0100, 0xE01EF)]
_TAGS = [(0xE0000, 0xE007F)]
INVISIBLE_CLASS, TAG_CLASS = char_class(_INVISIBLE), char_class(_TAGS)
BIDI_CLASS = char_class([(c, c) for c in BIDI_NAMES])
CONFUSABLE_CLASS = char_class([(c, c) for c, *_ in CONFUSABLES])
#: What the quick check looks for: it knows fewer characters than the detector.
QUICK_CLASS = char_class([(0xFE00, 0xFE0F), (0x200B, 0x200F), (0x202A, 0x202E), (0xE0000, 0xE007F)])
FOREIGN = r"[^\p{IsLatin}\p{IsCommon}\p{IsInherited}]"


def _named(cp: Column) -> Column:
    return F.format_string("U+%04X", cp)


def is_invisible(cp: Column) -> Column:
    return in_ranges(cp, _INVISIBLE)


def is_critical(cp: Column) -> Column:
    return in_ranges(cp, _CRITICAL)


def is_selector(cp: Column) -> Column:
    return in_ranges(cp, _SELECTORS)


def bidi_name(cp: Column) -> Column:
    return lookup(BIDI_NAMES, cp.cast("int"))


def zero_width_name(cp: Column) -> Column:
    return lookup(ZERO_WIDTH_NAMES, cp.cast("int"))


def quick_severity(cp: Column) -> Column:
    """The classification helper's severity, which differs from the detectors'."""
    return F.when(is_critical(cp), "critical").when(bidi_name(cp).isNotNull() | zero_width_name(cp).isNotNull(), "high").otherwise("medium")


def invisible_severity(cp: Column) -> Column:
    return F.when(is_critical(cp) | is_selector(cp), "critical").when(bidi_name(cp).isNotNull() | zero_width_name(cp).isNotNull(), "high").otherwise("medium")


def _invisible(fixes: bool) -> tuple[Column, list[Column]]:
    cp = F.col("cp")
    kind = (
        F.when(bidi_name(cp).isNotNull(), F.concat(F.lit("Bidirectional control "), bidi_name(cp)))
        .when(zero_width_name(cp).isNotNull(), F.concat(F.lit("Zero-width character "), zero_width_name(cp)))
        .when(is_selector(cp), F.lit("Variation selector"))
        .otherwise(F.lit("Invisible character"))
    )
    shown = is_invisible(cp) & ~beside_emoji() & ((cp != 0xFFFD) if fixes else F.lit(True))
    return shown, finding_columns(
        "invisible", 0, code_point=cp, category="invisible_character", severity=invisible_severity(cp), description=F.concat(kind, F.lit(" ("), _named(cp), F.lit(")")),
        remediation="Remove the character, or check that it is meant (emoji, right-to-left text).", cwe_id="CWE-172", context=F.col("context"), character=F.col("character"),
    )


#: What a direction override can do, by name; others have no remark.
BIDI_DANGER = {"RLO": "reverses the text that follows", "RLE": "embeds text of the other direction", "LRO": "forces the text that follows left to right"}


def _bidi() -> tuple[Column, list[Column]]:
    cp = F.col("cp")
    name = bidi_name(cp)
    danger = lookup({k: f": {v}" for k, v in BIDI_DANGER.items()}, name)
    severity = F.coalesce(lookup(BIDI_SEVERITY, name), F.lit("medium"))
    return name.isNotNull(), finding_columns(
        "bidi", 2, code_point=cp, category="bidirectional_override", severity=severity,
        description=F.concat(F.lit("Bidirectional control "), name, F.lit(" ("), _named(cp), F.lit(")"), F.coalesce(danger, F.lit(""))),
        remediation="Remove the control and read the file's bytes in their stored order.", cwe_id="CWE-172", context=F.col("context"), character=F.col("character"),
        references=F.array(F.lit("https://unicode.org/reports/tr36/")),
    )


def tag_name(cp: Column) -> Column:
    shown = F.decode(F.unhex(F.lpad(F.hex(cp - 0xE0000), 2, "0")), "US-ASCII")
    return (
        F.when(cp == 0xE0001, "Language Tag").when(cp == 0xE007F, "Cancel Tag").when(cp.between(0xE0020, 0xE007E), F.concat(F.lit("Tag: "), shown)).otherwise(F.concat(F.lit("Tag ("), _named(cp), F.lit(")")))
    )


def _tags() -> tuple[Column, list[Column]]:
    return in_ranges(F.col("cp"), _TAGS), finding_columns(
        "tags", 4, code_point=F.col("cp"), category="unicode_tag", severity="medium", description=F.concat(F.lit("Unicode tag character: "), tag_name(F.col("cp"))),
        remediation="Remove the tag character.", cwe_id="CWE-172", context=F.col("context"), character=F.col("character"),
    )


def has_mixed_scripts(word: Column) -> Column:
    """An ASCII letter together with a character of another script than Latin."""
    return word.rlike("[A-Za-z]") & word.rlike(FOREIGN)


def is_pure_non_latin(word: Column) -> Column:
    return ~word.rlike("[A-Za-z]") & word.rlike(FOREIGN)


def is_pure_latin(word: Column) -> Column:
    return word.rlike(r"^[A-Za-z0-9_]*\z")


#: Scripts that are told by name, with Java's property.
SCRIPTS = {
    "Latin": "IsLatin", "Cyrillic": "IsCyrillic", "Greek": "IsGreek", "Han": "IsHan", "Hiragana": "IsHiragana", "Katakana": "IsKatakana", "Arabic": "IsArabic", "Hebrew": "IsHebrew",
    "Thai": "IsThai", "Hangul": "IsHangul", "Devanagari": "IsDevanagari", "Common": "IsCommon", "Inherited": "IsInherited",
}


def script_of(character: Column) -> Column:
    out = F.lit("Other")
    for name, prop in reversed(SCRIPTS.items()):
        out = F.when(character.rlike(rf"\p{{{prop}}}"), name).otherwise(out)
    return out


def scripts_in(word: Column) -> Column:
    """The word's scripts other than Common and Inherited, sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.split(word, ""), script_of), lambda s: ~s.isin("Common", "Inherited"))))


def is_high_risk(word: Column) -> Column:
    return word.rlike(r"[\p{IsCyrillic}\p{IsGreek}]")


def identifiers(line_rows: DataFrame, keep: tuple[str, ...] = ("path", "line")) -> DataFrame:
    """(*keep, identifier): runs of letters, digits and underscores longer than one byte."""
    words = F.filter(F.regexp_extract_all("text", F.lit(f"{WORD}+"), F.lit(0)), lambda w: F.octet_length(w) > 1)
    return line_rows.select(*keep, F.explode(words).alias("identifier"))


def _homoglyph() -> tuple[Column, list[Column]]:
    cp = F.col("cp").cast("int")
    similarity = lookup({c: s for c, _, _, s in CONFUSABLES}, cp)
    severity = F.when(similarity >= 0.99, "critical").when(similarity >= 0.95, "high").when(similarity >= 0.9, "medium").otherwise("low")
    base, script = lookup({c: b for c, b, _, _ in CONFUSABLES}, cp), lookup({c: s for c, _, s, _ in CONFUSABLES}, cp)
    text = F.concat(F.lit("Identifier '"), F.col("word"), F.lit("' mixes scripts: "), _named(F.col("cp")), F.lit(" ("), script, F.lit(") looks like '"), base, F.lit("'"))
    return ~F.col("comment") & (F.length("word") > 1) & has_mixed_scripts(F.col("word")), finding_columns(
        "homoglyph", 1, code_point=F.col("cp"), category="homoglyph", severity=severity, description=text, remediation="Write the identifier in one script.", cwe_id="CWE-172",
        context=F.col("word"), character=F.col("character"), references=F.array(F.lit("https://docs.github.com/en/security")),
    )


#: Families of characters, with their class and what they make of a hit.
CHARACTER_CLASSES = {"invisible": INVISIBLE_CLASS, "homoglyph": CONFUSABLE_CLASS, "bidi": BIDI_CLASS, "tags": TAG_CLASS}


def character_findings(files: DataFrame, families: tuple[str, ...] = tuple(CHARACTER_CLASSES), fixes: bool = False) -> DataFrame:
    """Findings of the chosen families in one pass over the files; lines are cut into characters once."""
    wanted = "|".join(CHARACTER_CLASSES[f] for f in families)
    rows = lines(files.where(F.col("content").rlike(wanted))).withColumn("comment", F.col("text").rlike(r"(?U)^\s*(//|#|/\*|\*|<!--)"))
    rows = chars(rows, wanted, ("path", "line", "comment"), words=CONFUSABLE_CLASS if "homoglyph" in families else None)
    made = {"invisible": lambda: _invisible(fixes), "homoglyph": _homoglyph, "bidi": _bidi, "tags": _tags}
    return exploded(rows, [made[f]() for f in families])


def invisible_characters(files: DataFrame, fixes: bool = False) -> DataFrame:
    """Invisible characters that do not stand beside an emoji.

    U+FFFD counts as invisible, being in the last range; ``fixes`` exempts it.
    """
    return character_findings(files, ("invisible",), fixes)


def homoglyphs(files: DataFrame) -> DataFrame:
    """Look-alike characters within identifiers of mixed scripts, outside comment lines."""
    return character_findings(files, ("homoglyph",))


def bidi_controls(files: DataFrame) -> DataFrame:
    """Bidirectional controls; emoji exempt nothing."""
    return character_findings(files, ("bidi",))


def tag_characters(files: DataFrame) -> DataFrame:
    return character_findings(files, ("tags",))


def confusables_of(base: str) -> list[int]:
    """The look-alike code points of a base character."""
    return [c for c, b, _, _ in CONFUSABLES if b == base]


def quick_flags(files: DataFrame) -> DataFrame:
    """(path, has_invisible, has_confusables) by one look at the whole content."""
    return files.select("path", F.col("content").rlike(QUICK_CLASS).alias("has_invisible"), F.col("content").rlike(CONFUSABLE_CLASS).alias("has_confusables"))
