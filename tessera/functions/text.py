"""Column functions on text; all built in, all by code point."""

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITE = " \t\n\r\x0b\x0c"
WORD = r"[\p{L}\p{N}_]+"


def words(text: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def with_bigrams(tokens: Column) -> Column:
    """tokens, then every two neighbours joined by an underscore."""
    n = F.size(tokens)
    pairs = F.zip_with(F.slice(tokens, 1, F.greatest(n - 1, F.lit(0))), F.slice(tokens, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.concat(a, F.lit("_"), b))
    return F.concat(tokens, F.when(n > 1, pairs).otherwise(F.slice(tokens, 1, 0)))


def first_truthy(*columns: Column) -> Column:
    """The first that is neither null nor empty, else the empty text."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns], F.lit(""))


def first_words(text: Column, n: int) -> Column:
    return F.array_join(F.slice(F.split(F.trim(text), r"\s+"), 1, n), " ")


def content_hash(task: Column, call: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.left(F.sha2(F.concat(task, F.lit("\n"), call).cast("binary"), 256), F.lit(20)))


def normalize_code(code: Column) -> Column:
    """Lines trimmed and lower-cased, blank ones dropped."""
    return F.array_join(F.filter(F.transform(F.split(code, "\n"), lambda x: F.lower(F.trim(x, F.lit(WHITE)))), lambda x: x != ""), "\n")


def first_line(text: Column) -> Column:
    """The first line that isn't blank, trimmed; null if there is none."""
    return F.get(F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x, F.lit(WHITE))), lambda x: x != ""), F.lit(0))


def contains_any(text: Column, markers: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, markers)), lambda m: F.contains(text, m))


def truthy(flag: Column, accepted: tuple[str, ...] = ("true", "1", "yes")) -> Column:
    """Whether a text flag says yes; which words do so is the caller's choice. Null doesn't."""
    return F.coalesce(F.lower(F.trim(flag)).isin(*accepted), F.lit(False))


def safe_int(text: Column, default: int = 0) -> Column:
    return F.coalesce(text.try_cast("int"), F.lit(default))


def char_tokens(text: Column, vocab: int) -> Column:
    """Code points modulo vocab."""
    return F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.pmod(F.ascii(c), F.lit(vocab)))


def replace_first(text: Column, old: Column, new: Column) -> Column:
    """text with the first old replaced; text itself if there is none."""
    at = F.instr(text, old)
    return F.when(at > 0, F.concat(F.substr(text, F.lit(1), at - 1), new, F.substr(text, at + F.length(old)))).otherwise(text)


def duration(seconds: Column) -> Column:
    return F.concat(F.floor(seconds / 60).cast("string"), F.lit("m "), F.pmod(seconds, F.lit(60)).cast("string"), F.lit("s"))


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    """Half-even rounded percentage; 0 of no rows."""
    return F.coalesce(F.bround(F.try_divide(100.0 * part, whole), digits), F.lit(0.0))


def equal_width_bin(v: Column, low: Column, high: Column, n: int) -> Column:
    """The right-closed bin, from 0, of v among n bins of equal width between low and high."""
    return F.greatest(F.lit(0), F.ceil((v - low) / F.nullif(high - low, F.lit(0)) * n).cast("int") - 1)
