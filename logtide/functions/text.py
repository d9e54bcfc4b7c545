"""Text expressions: folding, cleaning, counting, tags and display strings."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from logtide.functions.bind import bind

# Blanks other than newline, as the line cleaner sees them.
BLANKS = r"[ \t\x0B\f\r\x1c-\x1f]+"
OTHER_BLANKS = r"[\t\x0B\f\r\x1c-\x1f]"


def ascii_fold(text: Column) -> Column:
    """Drop every character outside ASCII."""
    return F.regexp_replace(text, r"[^\x00-\x7F]", "")


def collapse_spaces(text: Column) -> Column:
    """Squeeze runs of blanks, newlines excepted, to one space. Texts with single spaces alone stay as they are."""
    return bind(
        text, lambda t: F.when(t.contains("  ") | t.rlike(OTHER_BLANKS), F.regexp_replace(t, BLANKS, " ")).otherwise(t)
    )


def clean_line(text: Column) -> Column:
    """ASCII fold, then squeezed blanks."""
    return collapse_spaces(ascii_fold(text))


def clean_for_classifier(text: Column) -> Column:
    """Words only: addresses and links named, digits dropped, camel case split."""
    steps = [
        (r"\b(?:\d{1,3}\.){3}\d{1,3}\b", "IPADDRESS"),
        (r"https?://\S+|www\.\S+", "URL"),
        (r"[^a-zA-Z0-9]+", " "),
        (r"\d+", ""),
        (r"(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", " "),
        (r" +", " "),
    ]
    for pattern, replacement in steps:
        text = F.regexp_replace(text, pattern, replacement)
    return F.lower(F.trim(text))


def without(text: Column, part: Column) -> Column:
    """Text with every literal occurrence of part removed."""
    return F.when(part.isNull(), text).otherwise(F.replace(text, part, F.lit("")))


def digit_count(text: Column) -> Column:
    return F.length(F.regexp_replace(text, "[^0-9]+", "")).cast("long")


def letter_count(text: Column) -> Column:
    return F.length(F.regexp_replace(text, "[^a-zA-Z]+", "")).cast("long")


def token_count(text: Column) -> Column:
    """Pieces between single spaces, empty ones included."""
    return F.size(F.split(text, " ", -1)).cast("long")


def escape_tags(text: Column) -> Column:
    """Drop script tags, join repeated line breaks, escape all other markup."""
    text = F.regexp_replace(text, r"(?i)</?script>", "")
    text = F.regexp_replace(text, r"(?:<br\s*/?>\s*)++", "<br>")
    pieces = F.regexp_extract_all(text, F.lit(r"(<[^>]+>|[^<]+|<)"), F.lit(1))

    def escaped(piece: Column) -> Column:
        out = piece
        for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
            out = F.replace(out, F.lit(plain), F.lit(entity))
        return F.when(F.lower(piece).isin("<br>", "<br/>", "</br>"), piece).otherwise(out)

    return F.array_join(F.transform(pieces, escaped), "")


def strip_tags(text: Column) -> Column:
    return F.regexp_replace(text, "<[^>]*>", "")


def newline_entities(text: Column) -> Column:
    return F.replace(text, F.lit("\n"), F.lit("&#13;&#10;"))


def newline_breaks(text: Column) -> Column:
    return F.replace(text, F.lit("\n"), F.lit("</br>"))


def annotated_line(text: Column, fault: Column, signal: Column) -> Column:
    """The report line: text, fault category, golden signal."""
    return F.concat(
        newline_entities(text),
        F.lit(" => Fault-Categories: "), fault,
        F.lit(" => Golden-Signal: "), signal,
    )


def parse_annotated_line(line: Column) -> Column:
    """text, fault and signal of a report line; the last marks count, as a text may hold some itself."""
    form = r"(?s)^(.*) => Fault-Categories: (.*?) => Golden-Signal: (.*)$"
    return F.struct(*[F.regexp_extract(line, form, i).alias(n) for i, n in enumerate(("text", "fault", "signal"), 1)])


def size_display(size: Column) -> Column:
    """Bytes as '4.0 MB'; null for negative or missing sizes."""
    def scaled(unit: float, suffix: str) -> Column:
        # This format rounds halves to even.
        shown = F.call_function("format_number", size / F.lit(unit), F.lit("0.0"))
        return F.concat(shown, F.lit(f" {suffix}"))

    return (
        F.when(size < 0, None)
        .when(size >= 1e9, scaled(1e9, "GB"))
        .when(size >= 1e6, scaled(1e6, "MB"))
        .when(size >= 1e3, scaled(1e3, "KB"))
        .otherwise(F.concat(size.cast("long").cast("string"), F.lit(" B")))
    )


def thousands(number: Column) -> Column:
    return F.format_number(number, 0)


def log_scaled(count: Column) -> Column:
    """Bar height of a timeline: log10(n + 1) to two digits, zero stays zero."""
    return F.when(count == 0, F.lit(0.0)).otherwise(F.round(F.log10(count + 1), 2))


def log_height(count: Column) -> Column:
    """Height in the temporal evolution: log10(n), and zero where there is nothing."""
    return F.when(count > 0, F.log10(count)).otherwise(F.lit(0.0))


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]+)$", 1)


def preview(text: Column) -> Column:
    """Whole text under 500 characters, else the first 400 and dots."""
    return F.when(F.length(text) < 500, text).otherwise(
        F.concat(F.substring(text, 1, 400), F.lit("..."))
    )


def duration_label(start: Column, end: Column) -> Column:
    return F.concat_ws(" -- ", start, end)
