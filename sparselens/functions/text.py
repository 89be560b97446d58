"""Text columns: context strings, token flags, reply parsing, natural order of names."""

from pyspark.sql import functions as F

# Characters that have case; everything else separates words for the title test.
_CASED = r"\p{Lu}\p{Ll}\p{Lt}"
TITLE_PATTERN = rf"^[^{_CASED}]*[\p{{Lu}}\p{{Lt}}]\p{{Ll}}*([^{_CASED}]+[\p{{Lu}}\p{{Lt}}]\p{{Ll}}*)*[^{_CASED}]*$"
DIGIT_PATTERN = r"^[\p{Nd}²³¹⁰⁴-⁹₀-₉]+$"
PUNCT_PATTERN = r"^\p{P}+$"
WORD_PATTERN = r" ?[^ \t\n\r]+"
LINE_BREAK = r"\r\n|[\n\r\u000B\u000C\u001C-\u001E\u0085  ]"


def strip(text):
    """Both ends free of any Unicode white space."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def words(text):
    """Runs of non-blanks, each keeping at most one leading space."""
    return F.regexp_extract_all(text, F.lit(WORD_PATTERN), F.lit(0))


def context_string(context, token, window):
    """Context joined to one string with element ``window`` replaced by ``**token**``."""
    marked = F.concat(F.lit("**"), token, F.lit("**"))
    return F.array_join(F.transform(context, lambda t, i: F.when(i == window, marked).otherwise(t)), "")


def joined_context(context, token, window):
    """Context joined with the token at position ``window``; appended to a short list."""
    rest = F.slice(context, window + 2, F.greatest(F.size(context) - (window + 1), F.lit(0)))
    return F.array_join(F.concat(F.slice(context, 1, window), F.array(token), rest), "")


def char_offset(context, window):
    """Characters before the token in the joined context."""
    return F.length(F.array_join(F.slice(context, 1, window), ""))


def subword_position(token):
    return F.when(token.startswith(" "), "word_initial").otherwise("word_medial")


def is_numeric(token):
    return strip(token).rlike(DIGIT_PATTERN)


def is_upper(token):
    t = strip(token)
    return (t == F.upper(t)) & (t != F.lower(t)) & (F.length(t) > 1)


def is_title(token):
    return strip(token).rlike(TITLE_PATTERN)


def is_whitespace(token):
    return strip(token) == ""


def is_punct(token):
    return strip(token).rlike(PUNCT_PATTERN)


def covering_word(joined, offset):
    """The word of a text that covers a position: letters and digits around it, or the one sign
    that stands there; null where a blank or nothing does."""
    before, after = F.substring(joined, F.lit(1), offset), F.substring(joined, offset + 1, F.length(joined))
    return (F.when(after.rlike(r"^[\p{L}\p{N}]"), F.concat(F.regexp_extract(before, r"[\p{L}\p{N}]*$", 0),
                                                          F.regexp_extract(after, r"^[\p{L}\p{N}]+", 0)))
            .when(after.rlike(r"^\S"), F.substring(after, F.lit(1), F.lit(1))))


def numbered_list(items):
    """Array of texts -> "1. first\\n2. second"."""
    return F.array_join(F.transform(
        items, lambda t, i: F.concat((i + 1).cast("string"), F.lit(". "), t)), "\n")


def _label_line(reply):
    lines = F.filter(F.split(strip(reply), LINE_BREAK),
                     lambda l: F.lower(strip(l)).startswith("label:"))
    return F.try_element_at(lines, F.lit(-1))


def reply_label(reply):
    """Text after the first colon of the last "label:" line; the whole reply without one."""
    line = _label_line(reply)
    after = F.substring(line, F.instr(line, ":") + 1, F.length(line))
    return F.when(line.isNull(), strip(reply)).otherwise(strip(after))


def reply_reasoning(reply):
    """Text before the last occurrence of the label line; empty without one."""
    line = _label_line(reply)
    return F.when(line.isNull(), F.lit("")).otherwise(
        strip(F.substring(reply, F.lit(1), _last_position(line, reply))))


def _last_position(part, text):
    """Number of characters before the last occurrence of ``part``."""
    back = F.position(F.reverse(part), F.reverse(text))
    return F.length(text) - (back - 1) - F.length(part)


def natural_key(name):
    """Sort key in which digit runs compare as numbers and text compares without case.

    Text and number parts alternate, starting with text; a number is written as its digit
    count and its digits without leading zeros, so string order is numeric order.
    """
    parts = F.split(name, r"(?<=\d)(?=\D)|(?<=\D)(?=\d)")
    parts = F.when(name.rlike(r"^\d"), F.concat(F.array(F.lit("")), parts)).otherwise(parts)

    def part(p):
        digits = F.regexp_replace(p, "^0+", "")
        number = F.concat(F.lpad(F.length(digits).cast("string"), 10, "0"), digits)
        return F.when(p.rlike(r"^\d+$"), number).otherwise(F.lower(p))

    return F.transform(parts, part)


def alive_file_name(dataset, prefix):
    """Alive-set file that belongs to a dataset name."""
    name = F.element_at(F.split(dataset, "/"), -1)
    return F.concat(F.lit("alive_features_"), F.replace(name, F.lit(prefix), F.lit("")), F.lit(".json"))


def short_label(label, limit):
    """First ``limit`` characters and "..." when the label is longer."""
    return F.when(F.length(label) > limit,
                  F.concat(F.substring(label, 1, limit), F.lit("..."))).otherwise(label)


def table_name(expansion, lam, suffix="full"):
    """Table name of a run; dots of lambda become underscores."""
    return F.concat(F.lit("hf_"), expansion.cast("string"), F.lit("x_"),
                    F.replace(lam, F.lit("."), F.lit("_")), F.lit("_" + suffix))


def is_polysemantic(label):
    return F.upper(label).contains("POLYSEMANTIC")
