"""Reading sample, group and spelling out of free-form file names."""

import unicodedata

from pyspark.sql import Column, DataFrame, functions as F

from granulith.session import settle

# Known words and the folder each one stands for.
REGION_WORDS = {"alt": "Alt", "asagi": "Alt", "ust": "Üst", "uest": "Üst", "yukari": "Üst",
                "karisik": "Karışık", "mixed": "Karışık"}
PATTERN_ALIASES = ["janus", "stripe", "striped", "cizgili", "lamellar", "lameller", "lamella",
                   "composite", "kompozit", "undercooled", "under cooled", "asiri sogutulmus",
                   "as produced", "asproduced", "uretildigi gibi"]
PATTERNED = "Patterned"
UNSORTED = "Unsorted"

# How a sample is written in a file name (letter code and number, or a leading number).
DASHES = r"\-–—"
PREFIXED = rf"(?:^|[|/\\_])\s*(\p{{L}}{{1,4}})\s*(?:[{DASHES}]\s*|\s+)(\d{{1,3}})(?!\d)"
LEADING = r"^\s*(\d{1,3})(?!\d)"
# What separates words, stands around a name and numbers a photo.
TIDY = [(r"[|/\\_]+", " "), (rf"[{DASHES}]+", " "), (r"\s+", " "), (rf"^[ {DASHES}.,*#~+]+|[ {DASHES}.,*#~+]+$", ""),
        (r"(?<=\p{L})\d{1,3}\s*$|(?<!\S)\d{1,3}\s*$", "")]

_ICU = "com.ibm.icu.text.Normalizer"
_NOT_ASCII = "[^\\x00-\\x7f]"


def _combining() -> str:
    """A pattern for every character that Unicode joins to the one before it (combining class above 0)."""
    runs: list[list[int]] = []
    for c in range(0x110000):
        if unicodedata.combining(chr(c)):
            if runs and runs[-1][1] == c - 1:
                runs[-1][1] = c
            else:
                runs.append([c, c])
    return "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in runs) + "]+"


MARKS = _combining()


def _normal(s: Column, how: str, compatible: bool) -> Column:
    """A normal form by the ICU library that Spark brings; plain ASCII is left alone."""
    return F.when(s.rlike(_NOT_ASCII), F.reflect(F.lit(_ICU), F.lit(how), s, F.lit(compatible))).otherwise(s)


def composed(s: Column) -> Column:
    """Letters with separate marks, as some systems write file names, as single letters: NFC of any script."""
    return _normal(s, "compose", False)


def bare(s: Column) -> Column:
    """Letters taken apart, in any script, without their marks; ligatures, Roman numerals and full-width forms become the
    plain ones, all Turkish i's become "i"."""
    t = F.translate(_normal(s, "decompose", True), "ıİI", "iii")
    return F.when(s.rlike(_NOT_ASCII), F.regexp_replace(t, MARKS, "")).otherwise(t)


def fold(s: Column) -> Column:
    """Lower case, no marks, separators as single spaces."""
    return folded(bare(s))


def folded(s: Column) -> Column:
    """`fold` of what is bare already."""
    t = F.regexp_replace(F.lower(s), rf"[|_/\\{DASHES}.,()\[\]*]+", " ")
    return F.trim(F.regexp_replace(t, r"[\s\x1c-\x1f\x85\p{Z}]+", " "))


def _has(folded: Column, word: str) -> Column:
    return folded.rlike(rf"(?<![a-z0-9]){word}(?![a-z])")


def region(folded: Column) -> Column:
    """Folder of the longest known region word present; null when there is none."""
    out = F.lit(None).cast("string")
    for word in sorted(REGION_WORDS, key=len):           # the last `when` added is tried first
        out = F.when(_has(folded, word), REGION_WORDS[word]).otherwise(out)
    return out


def has_pattern_word(folded: Column) -> Column:
    return folded.rlike("(?<![a-z0-9])(?:" + "|".join(PATTERN_ALIASES) + ")(?![a-z])")


def _found(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def _read(stem: Column, reading) -> Column:
    """`reading` of the composed name; a lambda binds the name once, so it is not composed again for each use."""
    return F.transform(F.array(composed(stem)), reading)[0]


def sample_prefix(stem: Column) -> Column:
    return _read(stem, lambda s: _found(F.regexp_extract(s, PREFIXED, 1)))


def sample_number(stem: Column) -> Column:
    """Two-digit sample number: after a letter code, leading, or alone between separators."""
    return _read(stem, _sample_number)


def _sample_number(stem: Column) -> Column:
    parts = F.transform(F.split(stem, r"[|/\\_]+"), lambda p: F.trim(p))
    alone = F.try_element_at(F.filter(parts, lambda p: p.rlike(r"^\d{1,3}$")), F.lit(1))
    n = F.coalesce(_found(F.regexp_extract(stem, PREFIXED, 2)),
                   _found(F.regexp_extract(stem, LEADING, 1)), alone)
    return F.when(F.length(n) < 2, F.lpad(n, 2, "0")).otherwise(n)


def leftover(stem: Column) -> Column:
    """What is left of a name without its sample marker and photo index; null if nothing readable."""
    return _read(stem, _leftover)


def _leftover(stem: Column) -> Column:
    marked = stem.rlike(PREFIXED)
    with_code = _replace_first(stem, PREFIXED)
    with_number = _replace_first(stem, LEADING)
    rest = F.when(marked, with_code).otherwise(with_number)
    for pattern, by in TIDY:
        rest = F.regexp_replace(rest, pattern, by)
    rest = F.trim(rest)
    return F.when(rest.rlike(r"[\p{L}\p{N}]"), rest)


def _replace_first(s: Column, pattern: str) -> Column:
    """Replace the first match by a space: the lazy head makes the match the earliest one."""
    at = F.regexp_instr(s, F.lit(pattern))
    hit = F.regexp_extract(s, pattern, 0)
    head = F.substring(s, F.lit(1), at - 1)
    tail = F.substring(s, at + F.length(hit), F.length(s))
    return F.when(at > 0, F.concat(head, F.lit(" "), tail)).otherwise(s)


def read_once(photos: DataFrame) -> DataFrame:
    """The photos with prefix, num, name, key and known read from their `stem`; each step is a column of its own, so no
    name is composed or folded twice."""
    s, reg, pat = F.col("_composed"), F.col("_region"), F.col("_pattern")
    out = settle(photos, {"_composed": composed(F.col("stem"))})
    out = settle(out, {"prefix": _found(F.regexp_extract(s, PREFIXED, 1)), "num": _sample_number(s), "_rest": _leftover(s), "_folded": fold(s)})
    out = settle(out, {"_region": region(F.col("_folded")), "_pattern": has_pattern_word(F.col("_folded"))})
    out = settle(out, {"name": F.when(reg.isNotNull(), reg).when(pat, PATTERNED).otherwise(F.col("_rest"))})
    return settle(out, {"key": fold(F.col("name")), "known": reg.isNotNull() | pat}).select(
        *photos.columns, "prefix", "num", "name", "key", "known")


def safe_name(s: Column) -> Column:
    """A file name without characters that file systems refuse."""
    t = F.trim(F.regexp_replace(s, r'[\\/:*?"<>|]', "_"))
    return F.when(t == "", "export").otherwise(t)


def image_number(stem: Column, title: Column) -> Column:
    """".3": the first number after the title, or "" when there is none."""
    suffix = F.when(F.startswith(stem, title),
                    F.substring(stem, F.length(title) + 1, F.length(stem))).otherwise(stem)
    n = F.regexp_extract(suffix, r"(\d+)", 1)
    return F.when(n != "", F.concat(F.lit("."), n)).otherwise("")
