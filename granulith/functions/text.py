"""Text helpers: titles, numbers typed by hand, share texts, common prefixes, sort keys."""

from pyspark.sql import Column, functions as F

# The category words a photo title ends on, with their ASCII spellings.
CATEGORY_WORDS = ["karışık", "karisik", "üst", "ust", "alt"]
# Fixed value: what counts as a number in an entry field.
NUMBER = r"(?i)^[+-]?(?:(?:\d+(?:_\d+)*\.?(?:\d+(?:_\d+)*)?|\.\d+(?:_\d+)*)(?:e[+-]?\d+(?:_\d+)*)?|inf|infinity|nan)$"


def stem(name: Column) -> Column:
    """File name without folders and without its last extension."""
    base = F.regexp_replace(name, r"^.*[/\\]", "")
    return F.regexp_replace(base, r"(?<=.)\.[^.]*$", "")


def clean_title(s: Column) -> Column:
    """The stem up to its last category word, else without a trailing index."""
    words = "|".join(CATEGORY_WORDS)
    to_word = F.regexp_extract(s, f"(?ius)^(.*(?:{words}))", 1)
    plain = F.trim(F.regexp_replace(s, r"[ \-_0-9]+$", ""))
    return F.when(to_word != "", F.trim(to_word)).when(plain != "", plain).otherwise(s)


def common_prefix(a: Column, b: Column) -> Column:
    """Longest common prefix of two strings."""
    n = F.least(F.length(a), F.length(b))
    split_at = F.array_min(F.filter(F.sequence(F.lit(1), n + 1),
                                    lambda i: (i > n) | (F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1)))))
    return F.substring(a, F.lit(1), (split_at - 1).cast("int"))


def parse_number(text: Column) -> Column:
    """A number typed by hand: decimal comma and single underscores between digits allowed, blank or invalid is null."""
    plain = F.replace(F.trim(text), F.lit(","), F.lit("."))
    return F.when(plain.rlike(NUMBER), F.replace(plain, F.lit("_"), F.lit(""))).try_cast("double")


def whole(value: Column) -> Column:
    """Half-even rounding to a whole number, as text."""
    return F.rint(value).cast("long").cast("string")


def share_text(k: Column, n: Column) -> Column:
    pct = 100.0 * k / F.nullif(n, F.lit(0))
    return (F.when(n.isNull() | (n == 0), "—")
            .when((pct > 0) & (pct < 0.5), "<1%")
            .when((pct >= 99.5) & (pct < 100), ">99%")
            .otherwise(F.concat(whole(pct), F.lit("%"))))


def _short(v: float) -> str:
    return f"{v:.1f}".rstrip("0").rstrip(".")


def range_sentence(k: Column, n: Column, mean: Column, lo: float | None, hi: float | None,
                   who: str = "measured particles") -> Column:
    """"23% of the measured particles (492 of 2138) are between 100 and 150 nm, …"; null if n = 0."""
    if lo is None and hi is None:
        return F.lit(None).cast("string")
    if lo is not None and hi is not None:
        where = f"between {_short(lo)} and {_short(hi)} nm"
    elif lo is not None:
        where = f"{_short(lo)} nm or larger"
    else:
        where = f"smaller than {_short(hi)} nm"
    where = where.replace(" ", "\u00a0")
    verb = F.when(k == 1, "is").otherwise("are")
    tail = F.when(k > 0, F.concat(F.lit(", with a mean size of "), whole(mean), F.lit(" nm.")))
    return F.when(n > 0, F.concat(
        share_text(k, n), F.lit(f" of the {who} ("), k.cast("string"), F.lit(" of "),
        n.cast("string"), F.lit(") "), verb, F.lit(" " + where), F.coalesce(tail, F.lit("."))))


def natural_key(s: Column) -> Column:
    """Sort key under which "Janus 2" comes before "Janus 10"; numbers of any length, their digit count in front.

    Full-width digits count as digits."""
    from granulith.functions.naming import bare, folded
    digits = lambda p: F.regexp_replace(p, r"^0+(?=\d)", "")
    # a call into a library can't stand inside a lambda, so the whole text is made bare before it is cut
    parts = F.regexp_extract_all(bare(s), F.lit(r"(\d+|\D+)"), F.lit(1))
    keyed = F.transform(parts, lambda p: F.when(
        p.rlike(r"^\d+$"),
        F.concat(F.lpad(F.length(digits(p)).cast("string"), F.lit(10), F.lit("0")), digits(p)))
        .otherwise(folded(p)))
    return F.array_join(keyed, "\u0001")
