"""Rules over free text: normalising, personal data, clearance, remote work, markup."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from postloom import fixed_values as fv
from postloom.functions.expr import col, contains_any, fixed_map, let, strip, title_case


def normalize_text(c: Column | str) -> Column:
    """Strip, lower and collapse white space; null gives an empty text."""
    text = F.lower(strip(F.coalesce(col(c), F.lit(""))))
    return F.regexp_replace(text, r"(?U)\s+", " ")


# The address patterns, begun only where a run of address characters begins (or right after a match) and never
# given back: what follows the run does not depend on where in it a match starts, so the matches are those of the
# plain patterns, found in one pass over a long run. The second keeps what stands before the first word boundary.
_RUN_START = r"(?:\G|(?<![a-zA-Z0-9._%+-]))"
_EMAIL = _RUN_START + fv.EMAIL_PATTERN.replace("]+@", "]++@", 1)
_PII_EMAIL = f"(?U){_RUN_START}((?:(?!\\b)[A-Za-z0-9._%+-])*+)" + fv.PII_EMAIL_PATTERN.removeprefix("(?U)").replace("]+@", "]++@", 1)


def emails(c: Column | str) -> Column:
    """Every email address in order of appearance; null for a null or empty text."""
    c = col(c)
    found = F.when(
        c.contains("@"), F.regexp_extract_all(c, F.lit(_EMAIL), 0)
    ).otherwise(F.array().cast("array<string>"))
    return F.when(c != "", found)


def remove_pii(c: Column | str) -> Column:
    """Mask a leading name, email addresses, phone numbers and urls; keep the text of links."""
    lines = F.regexp_replace(col(c), fv.LINE_BREAK_PATTERN, "\n")
    lines = F.regexp_replace(lines, r"\n\z", "")

    def rejoin(text: Column) -> Column:
        first = F.substring_index(text, "\n", 1)
        rest = F.substring(text, F.length(first) + 2, F.length(text))
        masked = F.regexp_replace(first, fv.PII_NAME_PATTERN, fv.PII_NAME_TEXT)
        return F.concat(masked, F.lit("\n"), rest)

    text = F.when(col(c) == "", F.lit("")).otherwise(let(lines, rejoin))
    # an address has no line break, so only the lines with its sign are searched for one
    text = let(text, lambda t: F.when(t.contains("@"), _in_lines(t, "@", _PII_EMAIL, f"$1{fv.PII_EMAIL_TEXT}")).otherwise(t))
    # each pattern needs one of these marks, and finding a mark is far cheaper than a failed match
    for marks, pattern, mask in (
        ([], fv.PII_PHONE_PATTERN, fv.PII_PHONE_TEXT),
        (["<a"], fv.PII_ANCHOR_PATTERN, "$1"),
        (["http", "www"], fv.PII_URL_PATTERN, fv.PII_URL_TEXT),
    ):
        text = _replace_where(text, marks, pattern, mask)
    return text


def _in_lines(text: Column, mark: str, pattern: str, mask: str) -> Column:
    def line(t: Column) -> Column:
        return F.when(t.contains(mark), F.regexp_replace(t, pattern, mask)).otherwise(t)

    return F.array_join(F.transform(F.split(text, "\n"), line), "\n")


def _replace_where(text: Column, marks: list[str], pattern: str, mask: str) -> Column:
    if not marks:
        return F.regexp_replace(text, pattern, mask)
    return let(
        text,
        lambda t: F.when(contains_any(t, marks), F.regexp_replace(t, pattern, mask)).otherwise(t),
    )


def redact(c: Column | str) -> Column:
    """Cut at the first line that starts with the benefits heading; drop blank and boilerplate lines."""

    def keep(lines: Column) -> Column:
        cut = F.array_position(
            F.transform(lines, lambda x: x.startswith(fv.REDACT_CUT_PREFIX)), F.lit(True)
        )
        kept = F.when(cut > 0, F.slice(lines, F.lit(1), (cut - 1).cast("int"))).otherwise(lines)
        return F.filter(
            kept, lambda x: (strip(x) != "") & ~contains_any(x, fv.REDACT_PHRASES)
        )

    return F.array_join(let(F.split(col(c), "\n"), keep), "\n")


def clearance_flag(description: Column | str, title: Column | str) -> Column:
    """1 when the description or the title asks for a security clearance, else 0."""
    found = F.coalesce(
        col(description).rlike(fv.CLEARANCE_DESCRIPTION_PATTERN), F.lit(False)
    ) | F.coalesce(col(title).rlike(fv.CLEARANCE_TITLE_PATTERN), F.lit(False))
    return F.when(found, 1).otherwise(0)


def remote_flag(*parts: Column | str) -> Column:
    """True when any of the texts speaks of remote work."""
    return contains_any(F.lower(F.concat_ws(" ", *[col(p) for p in parts])), fv.REMOTE_WORDS)


def located_remote(*parts: Column | str) -> Column:
    """True when the location words hold ``remote``."""
    return F.lower(F.concat_ws(" ", *[col(p) for p in parts])).contains("remote")


def industry(c: Column | str) -> Column:
    text = F.replace(F.replace(col(c), F.lit("Iv1"), F.lit("")), F.lit("_"), F.lit(" "))
    return F.when(col(c) != "", strip(title_case(text)))


def truthy(c: Column | str) -> Column:
    return F.coalesce(F.lower(col(c).cast("string")).isin(fv.TRUE_WORDS), F.lit(False))


def blocked_page(title: Column | str, html: Column | str) -> Column:
    """Kind of block page, or null for an ordinary page, by its title and all of its visible text."""
    head = F.lower(col(title))

    def classify(snippet: Column) -> Column:
        return (
            F.when(
                snippet.contains("cloudflare") | head.contains("just a moment"), fv.BLOCK_CLOUDFLARE
            )
            .when(head.contains("access denied") | head.contains("403"), fv.BLOCK_DENIED)
            .when(snippet.contains("captcha"), fv.BLOCK_CAPTCHA)
            .when(
                snippet.contains("are you a robot") | snippet.contains("are you human"),
                fv.BLOCK_BOT,
            )
        )

    return let(F.lower(html_to_text(html)), classify)


def shorter_refetch(new: Column | str, old: Column | str) -> Column:
    """True when a fetched text is clearly shorter than the one already held."""
    held = F.length(strip(F.coalesce(col(old), F.lit(""))))
    return (held > 0) & (F.length(col(new)) < 0.9 * held)


def ready_to_score(resume: Column | str, text: Column | str) -> Column:
    """True when résumé and posting text are both long enough to be scored."""

    def enough(c: Column) -> Column:
        return F.coalesce(F.length(strip(c)) >= fv.READY_MIN_CHARS, F.lit(False))

    return enough(col(resume)) & enough(col(text))


# --- markup ---------------------------------------------------------------------------------

_HIDDEN = r"(?is)<!--.*?-->|<!doctype[^>]*>|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>"
_TAG = r"(?s)<(?:/?[a-zA-Z](?:[^<>\"']|\"[^\"]*+\"|'[^']*+')*+)>"


def unescape(c: Column | str) -> Column:
    """Named and numeric character references to characters; unknown ones are kept."""
    names = fixed_map({name: chr(code) for name, code in name2codepoint.items()})

    def from_code(number: Column) -> Column:
        wide = F.unhex(F.lpad(F.hex(number), 8, "0"))
        return F.when(number.between(1, 0x10FFFF), F.decode(wide, "UTF-32"))

    def piece(part: Column) -> Column:
        ref = F.substring_index(part, ";", 1)
        decimal = from_code(F.regexp_extract(ref, r"^#(\d{1,7})$", 1).try_cast("bigint"))
        hexadecimal = from_code(
            F.conv(F.regexp_extract(ref, r"^#[xX]([0-9a-fA-F]{1,6})$", 1), 16, 10).try_cast("bigint")
        )
        named = F.try_element_at(names, ref)
        found = F.when(
            part.contains(";"),
            F.when(part.startswith("#"), F.coalesce(decimal, hexadecimal)).otherwise(named),
        )
        tail = F.substring(part, F.length(ref) + 2, F.length(part))
        return F.coalesce(F.concat(found, tail), F.concat(F.lit("&"), part))

    def decode(parts: Column) -> Column:
        rest = F.slice(parts, F.lit(2), F.size(parts))
        return F.concat(F.element_at(parts, 1), F.array_join(F.transform(rest, piece), ""))

    return let(
        col(c), lambda t: F.when(t.contains("&"), let(F.split(t, "&"), decode)).otherwise(t)
    )


def html_to_text(c: Column | str) -> Column:
    """Visible text of a page: tags out, references decoded, white space collapsed."""
    text = F.regexp_replace(F.regexp_replace(col(c), _HIDDEN, " "), _TAG, " ")
    return strip(F.regexp_replace(unescape(text), r"(?U)\s+", " "))


def html_to_markdown(c: Column | str) -> Column:
    """Headings, emphasis, links, lists and paragraphs as markdown."""
    text = _replace_where(col(c), ["<!", "<s", "<S"], _HIDDEN, "")
    text = F.regexp_replace(text, r"(?U)\s+", " ")
    text = let(text, lambda t: F.when(t.contains("<"), _marked(t)).otherwise(t))
    text = unescape(text)
    text = _replace_where(text, ["\n ", "\n\t"], r"\n[ \t]+", "\n")
    text = _replace_where(text, ["\n\n\n"], r"\n{3,}", "\n\n")
    return strip(text)


#: Tags of ``markdown_steps`` that most short texts lack; without them only the steps of these numbers find anything.
_RARE = r"(?i)<(?:h[1-6r]|br|a|/?(?:li|i|em|code)|/t[dh])"
_HEADINGS, _COMMON = 6, (8, 14, 16)


def _marked(text: Column) -> Column:
    """``markdown_steps`` in order, but for those that find no tag of theirs: one search tells for many."""
    steps = markdown_steps()
    some = _replaced(text, [steps[k] for k in _COMMON])
    headed = F.when(text.rlike(r"(?i)<h[1-6]"), _replaced(text, steps[:_HEADINGS])).otherwise(text)
    return F.when(text.rlike(_RARE), _replaced(headed, steps[_HEADINGS:])).otherwise(some)


def _replaced(text: Column, steps: list[tuple[str, str]]) -> Column:
    for pattern, mark in steps:
        text = F.regexp_replace(text, pattern, mark)
    return text


def markdown_steps() -> list[tuple[str, str]]:
    """Patterns and what takes their place, in order."""
    steps = [(rf"(?i) ?<h{n}(?:\s[^>]*)?> ?", "\n\n" + "#" * n + " ") for n in range(1, 7)]
    steps += [
        (r"(?i) ?<br\s*/?> ?", "  \n"),
        (r"(?i) ?<hr\s*/?> ?", "\n\n---\n\n"),
        (r"(?i)</?(?:b|strong)(?:\s[^>]*)?>", "**"),
        (r"(?i)</?(?:i|em)(?:\s[^>]*)?>", "*"),
        (r"(?i)</?code(?:\s[^>]*)?>", "`"),
        (r"(?i)<a\s(?:[^>]*\s)?href=\"([^\"]*)\"[^>]*>(.*?)</a>", r"[$2]($1)"),
        (r"(?i) ?<li(?:\s[^>]*)?> ?", "\n* "),
        (r"(?i) ?</li> ?", ""),
        (
            r"(?i) ?</?(?:p|div|section|article|main|header|footer|nav|aside|ul|ol|dl|table|tr|"
            r"blockquote|pre|h[1-6]|title|head|body|html)(?:\s[^>]*)?> ?",
            "\n\n",
        ),
        (r"(?i) ?</t[dh]> ?", " | "),
        (_TAG, ""),
    ]
    return steps


def strip_attributes(c: Column | str) -> Column:
    """Drop the attributes of the outermost tag of a block."""
    return F.regexp_replace(col(c), r"^(\s*<[a-zA-Z][\w-]*)(?:[^<>\"']|\"[^\"]*\"|'[^']*')*>", "$1>")


def page_title(c: Column | str) -> Column:
    return html_to_text(F.regexp_extract(col(c), r"(?is)<title[^>]*>(.*?)</title", 1))
